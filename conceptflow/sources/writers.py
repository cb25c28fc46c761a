"""Writers: brat lines, N-Quads, JSON lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def brat_lines(mentions: DataFrame) -> DataFrame:
    """(document_id, ordinal, value): a text-bound line for each mention (document_id, ordinal, iri, start, stop, text)."""
    line = F.format_string("T%d\t%s %d %d\t%s", F.col("ordinal") + 1, "iri", "start", "stop", F.regexp_replace("text", r"\s+", " "))
    return mentions.select("document_id", "ordinal", line.alias("value"))


def brat_document(mentions: DataFrame, relations: DataFrame) -> DataFrame:
    """(document_id, part, place, value): brat's lines of documents: terms, attributes, relations, coreference, in this order.

    ``mentions``: (document_id, ordinal, id, iri, start, stop, text, known boolean,
    entity); ``relations``: (document_id, ordinal, subject, predicate, object),
    whose ends are entities or mentions. An entity stands for its first mention; a
    relation with an unknown end is left out; an entity of one mention is no chain.
    """
    own = Window.partitionBy("document_id").orderBy("ordinal")
    term = mentions.withColumn("n", F.row_number().over(own)).withColumn("t", F.concat(F.lit("T"), F.col("n").cast("string")))
    place = F.col("n").cast("bigint").alias("place")
    terms = term.select("document_id", F.lit(0).alias("part"), place, F.format_string("%s\t%s %d %d\t%s", "t", F.coalesce("iri", F.lit("Unassigned")), "start", "stop", "text").alias("value"))
    known = term.where("known").withColumn("a", F.row_number().over(own))
    attributes = known.select("document_id", F.lit(1).alias("part"), place, F.format_string("A%d\tInInventory %s", "a", "t").alias("value"))
    chained = term.where("coalesce(entity, '') <> ''").groupBy("document_id", "entity")
    chains = chained.agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda x: x["t"]).alias("m"), F.min("n").alias("first"))
    # An entity's name outranks a mention of the same id.
    ends = chains.select("document_id", F.col("entity").alias("name"), F.lit(0).alias("r"), F.col("m")[0].alias("t")).unionByName(term.select("document_id", F.col("id").alias("name"), F.lit(1).alias("r"), "t"))
    ends = ends.groupBy("document_id", "name").agg(F.min_by("t", "r").alias("t"))
    side = lambda column, name: ends.select("document_id", F.col("name").alias(column), F.col("t").alias(name))
    numbered = relations.withColumn("r", F.row_number().over(own))
    related = numbered.join(side("subject", "t1"), ["document_id", "subject"]).join(side("object", "t2"), ["document_id", "object"])
    lines = related.select("document_id", F.lit(2).alias("part"), F.col("r").cast("bigint").alias("place"), F.format_string("R%d\t%s Arg1:%s Arg2:%s", "r", "predicate", "t1", "t2").alias("value"))
    groups = chains.where("size(m) > 1").select("document_id", F.lit(3).alias("part"), F.col("first").cast("bigint").alias("place"), F.concat(F.lit("*\tCoreference "), F.array_join("m", " ")).alias("value"))
    return reduce(DataFrame.unionByName, [terms, attributes, lines, groups])


def manifest(**parts: DataFrame) -> DataFrame:
    """(part, n): how many rows of each part an export holds."""
    return reduce(DataFrame.unionByName, [rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n") for name, rows in parts.items()])


def nquads(quads: DataFrame) -> DataFrame:
    """(value): lines of (s, p, o, g); g null: the default graph."""
    return quads.select(F.concat_ws(" ", "s", "p", "o", "g", F.lit(".")).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("overwrite").text(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
