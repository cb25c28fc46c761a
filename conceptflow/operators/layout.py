"""Blocks on pages: reading order, captions and their citations, tables that came out as prose, passages that define."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from conceptflow.functions import text as tx
from conceptflow.operators import parts


def reading_order(blocks: DataFrame, width: float) -> DataFrame:
    """``blocks`` (document_id, page, x0, y0, x1, y1, id) with their place on the page, from 1.

    Blocks over the middle of a page of ``width`` end a band; within a band the left
    column goes before the right one. Ties go by id.
    """
    centre, margin = width / 2, width * 0.05
    wide = (F.col("x0") < centre - margin) & (F.col("x1") > centre + margin)
    page = Window.partitionBy("document_id", "page")
    band = F.sum(wide.cast("int")).over(page.orderBy("y0", "x0", "id", "x1").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    column = F.when(wide, 0).when((F.col("x0") + F.col("x1")) / 2 <= centre, 1).otherwise(2)
    rows = blocks.withColumn("_band", band).withColumn("_column", column)
    return rows.withColumn("place", F.row_number().over(page.orderBy("_band", "_column", "y0", "x0", "id", "x1"))).drop("_band", "_column")


def citations(blocks: DataFrame) -> DataFrame:
    """(document_id, caption, paragraph): ordinals of captions with a number and of the paragraphs that cite it."""
    number = F.nullif(F.regexp_extract("text", tx.CAPTION_NUMBER, 1), F.lit(""))
    captions = blocks.where("block_type = 'caption'").select("document_id", F.col("ordinal").alias("caption"), number.alias("number")).where("number is not null")
    numbers = F.array_distinct(F.regexp_extract_all("text", F.lit(tx.TABLE_CITATION), 1))
    citing = blocks.where("block_type = 'paragraph'").select("document_id", F.col("ordinal").alias("paragraph"), F.explode(numbers).alias("number"))
    # A long document may cite one number all over: pairs of blocks of its rows are dealt over tasks.
    return parts.paired(captions, citing, ["document_id", "number"], "caption", "paragraph").select("document_id", "caption", "paragraph")


def table_gaps(blocks: DataFrame) -> DataFrame:
    """(document_id, page) of pages with a table's caption but no table."""
    page = ["document_id", "page"]
    captioned = blocks.where((F.col("block_type") == "caption") & F.col("text").rlike(tx.TABLE_CAPTION)).select(page).distinct()
    return captioned.join(blocks.where("block_type = 'table'").select(page), page, "left_anti")


def summary(blocks: DataFrame) -> DataFrame:
    """(document_id, block_type, blocks, boilerplate)."""
    return blocks.groupBy("document_id", "block_type").agg(F.count("*").alias("blocks"), F.count_if("is_boilerplate").alias("boilerplate"))


def passages(blocks: DataFrame, surfaces: DataFrame, limit: int) -> DataFrame:
    """(iri, document_id, ordinal, cue, surface): blocks that define a class, over as many documents as there are.

    ``surfaces``: (iri, surface, place). A surface meets only the blocks that hold
    its first word, by an equi-join on words; the surface of the smallest place
    wins in a block. Of each class ``limit`` passages stay: a first of each
    document, then seconds, and so on.
    """
    first = lambda c: F.regexp_extract(F.lower(c), r"([\p{L}\p{N}_]+)", 1)
    asked = surfaces.select("iri", "surface", "place", first("surface").alias("word")).where("word <> ''")
    own = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), 1))
    known = asked.select("word").distinct()
    near = blocks.select("document_id", "ordinal", F.explode(own).alias("word")).join(known, "word", "left_semi")
    cued = near.join(blocks.select("document_id", "ordinal", "text"), ["document_id", "ordinal"]).join(asked, "word")
    cued = cued.withColumn("cue", tx.definitional_cue(F.col("text"), F.col("surface"))).where("cue is not null")
    hits = cued.groupBy("iri", "document_id", "ordinal").agg(F.min(F.struct("place", "surface", "cue")).alias("m"))
    turn = F.row_number().over(Window.partitionBy("iri", "document_id").orderBy("ordinal"))
    rows = hits.withColumn("_turn", turn).where(F.col("_turn") <= limit)
    order = F.row_number().over(Window.partitionBy("iri").orderBy("_turn", "document_id"))
    return rows.withColumn("_n", order).where(F.col("_n") <= limit).select("iri", "document_id", "ordinal", "m.cue", "m.surface")
