"""Order-dependent folds over the rows of one document: chunking, batching, position clusters, near-duplicate screens.

A fold holds one document's rows (or one list) at a time, never a group that
grows with the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from conceptflow.functions import text as tx
from conceptflow.operators import parts
from conceptflow.session import cut


def markdown_spans(blocks: DataFrame) -> DataFrame:
    """``blocks`` with span_start and span_end in the text joined by a blank line; boilerplate gets none."""
    order = Window.partitionBy("document_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.when(F.col("is_boilerplate"), 0).otherwise(F.length("text") + 2)
    end = F.sum(size).over(order) - 2
    return blocks.withColumn("span_end", F.when(~F.col("is_boilerplate"), end)).withColumn("span_start", F.col("span_end") - F.length("text"))


def _groups(kinds: list[str]) -> list[list[int]]:
    """A table or figure and its caption stay together, greedily from the left."""
    out, i = [], 0
    while i < len(kinds):
        pair = {kinds[i], kinds[i + 1]} if i + 1 < len(kinds) else set()
        both = "caption" in pair and bool(pair & {"table", "figure"})
        out.append([i, i + 1] if both else [i])
        i += 2 if both else 1
    return out


def chunk_rows(kinds: list[str], sizes: list[int], target: int, most: int) -> list[int]:
    """Chunk number of each block: closed before it would pass ``most``, or when it reaches ``target``."""
    numbers, chunk, held = [0] * len(kinds), 0, 0
    for group in _groups(kinds):
        size = sum(sizes[i] for i in group)
        if held and held + size > most:
            chunk, held = chunk + 1, 0
        for i in group:
            numbers[i] = chunk
        held += size
        if held >= target:
            chunk, held = chunk + 1, 0
    return numbers


def chunks(blocks: DataFrame, target: int, most: int) -> DataFrame:
    """(document_id, ordinal, chunk) of the usable blocks of every document."""
    usable = blocks.where("not is_boilerplate and block_type <> 'unparsed' and trim(text) <> ''")

    def fold(rows: list[tuple]) -> Iterator[tuple]:
        numbers = chunk_rows([r[2] for r in rows], [r[3] for r in rows], target, most)
        return ((r[0], r[1], n) for r, n in zip(rows, numbers, strict=True))

    narrow = usable.select(F.col("document_id").cast("bigint").alias("document_id"), F.col("ordinal").cast("int").alias("ordinal"), "block_type", F.length("text").alias("size"))
    return parts.folded(narrow, "document_id", ["ordinal"], fold, "document_id bigint, ordinal int, chunk int")


def batch_numbers(labels: list[str], size: int) -> list[int]:
    """Batch of each label of one sorted list, one after another: what ``batches`` makes of a table."""
    out, batch, held = [], 0, 0
    for label in labels:
        out.append(batch)
        held += 1
        if int(hashlib.sha1(label.encode()).hexdigest()[:8], 16) % size == 0 or held >= 2 * size:
            batch, held = batch + 1, 0
    return out


def batches(labels: DataFrame, size: int) -> DataFrame:
    """(label, batch, place): content-defined batches of the sorted distinct labels.

    A label whose hash is a multiple of ``size`` ends a stretch, a stretch's
    every 2 x ``size`` labels end a batch. So a batch is (stretch, part), named by
    the stretch's first label and the part; place counts within it. Labels are
    sorted range by range: only the counts of ranges are summed in one place.
    """
    if size < 1:
        raise ValueError("a batch holds at least one label")
    ends = F.conv(F.substring(F.sha1(F.col("label").cast("binary")), 1, 8), 16, 10).cast("bigint") % size == 0
    own = labels.select("label").where("label is not null").distinct().withColumn("ends", ends)
    ranged = cut(own.repartitionByRange("label").withColumn("part", F.spark_partition_id()))
    # In each range, the stretches that end before a label; ranges begin where the ones before left off.
    order = Window.partitionBy("part").orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("before", F.coalesce(F.sum(F.col("ends").cast("bigint")).over(order), F.lit(0)))
    ended = ranged.groupBy("part").agg(F.sum(F.col("ends").cast("bigint")).alias("n"))  # a row for each range
    base = ended.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    stretches = local.join(F.broadcast(base), "part").select("label", (F.col("base") + F.col("before")).alias("stretch"))
    place = F.row_number().over(Window.partitionBy("stretch").orderBy("label")) - 1
    first = F.min("label").over(Window.partitionBy("stretch"))
    placed = stretches.select("label", first.alias("first"), place.alias("place"))
    name = F.concat_ws("#", "first", (F.col("place") / (2 * size)).cast("bigint").cast("string"))
    return placed.select("label", name.alias("batch"), (F.col("place") % (2 * size)).alias("place"))


def boilerplate(blocks: DataFrame, template, share: float, most_chars: int, least_pages: int = 3) -> DataFrame:
    """(document_id, template, pages): templates on more than ``share`` of a document's pages."""
    pages = blocks.groupBy("document_id").agg(F.countDistinct("page").alias("n_pages")).where(F.col("n_pages") >= least_pages)
    short = blocks.where((F.trim("text") != "") & (F.length("text") <= most_chars))
    found = short.groupBy("document_id", template.alias("template")).agg(F.countDistinct("page").alias("pages"), F.count("*").alias("n"))
    return found.join(pages, "document_id").where((F.col("pages") / F.col("n_pages") > share) & (F.col("n") > 1)).select("document_id", "template", "pages")


def position_clusters(places: list[tuple[float, float, float, float]], tolerance: float) -> list[int]:
    """Cluster of each box: the first whose first member lies within ``tolerance`` on all sides."""
    firsts: list[tuple[float, ...]] = []
    out = []
    for place in places:
        k = next((i for i, first in enumerate(firsts) if all(abs(a - b) <= tolerance for a, b in zip(place, first, strict=True))), len(firsts))
        if k == len(firsts):
            firsts.append(place)
        out.append(k)
    return out


def screen(questions: list[str], threshold: float) -> list[bool]:
    """Whether each question is kept: no near copy of one kept before; a threshold above 1 keeps all."""
    if threshold > 1:
        return [True] * len(questions)
    kept: list[str] = []
    out = []
    for question in questions:
        out.append(not any(_ratio(question, k) >= threshold for k in kept))
        if out[-1]:
            kept.append(question)
    return out


def screened(answers: DataFrame, shown: DataFrame, threshold: float) -> DataFrame:
    """(cq_type, ordinal, verdict) of a model's questions: kept, or why not.

    ``answers``: (cq_type, ordinal, question, sparql, passage, parses), passage
    counts from 1; ``shown``: (cq_type, n) passages. In this order: no passage
    that was shown is cited; the same words as one kept before (letters and case
    alone differ from none); nearly the text of one kept before; the query doesn't
    parse; one triple answers it. Only what the first rules let pass, once for
    each wording, is compared with what is kept, in one task: they are what people
    are to read.
    """
    cited = F.coalesce(F.col("passage").between(1, F.col("n")), F.lit(False))
    rows = answers.join(shown, "cq_type", "left").withColumn("same", tx.normalized(F.col("question")))
    rows = rows.withColumn("shape", F.when(~cited, "no passage").when(~F.col("parses"), "does not parse").when(tx.single_triple(F.col("sparql")), "a single triple"))
    order = Window.partitionBy("same").orderBy("cq_type", "ordinal").rowsBetween(Window.unboundedPreceding, -1)
    # A wording is taken by its first question without fault, unless that is a near copy, which the fold tells.
    good = rows.withColumn("earlier", F.coalesce(F.count(F.when(F.col("shape").isNull(), 1)).over(order), F.lit(0)))
    first = good.where("shape is null and earlier = 0").select("cq_type", "ordinal", "question", "same")

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["cq_type", "ordinal"])
        return part[["same"]].assign(near=[not good for good in screen(part.question.tolist(), threshold)])

    near = first.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(fold, "same string, near boolean")
    judged = good.join(near, "same", "left")
    taken = (F.col("earlier") > 0) & ~F.coalesce("near", F.lit(False))
    verdict = F.when(F.col("shape") == "no passage", "no passage").when(taken, "duplicate").when((F.col("near") == True) & (F.col("shape").isNull()), "near-duplicate")  # noqa: E712
    return judged.select("cq_type", "ordinal", F.coalesce(verdict, F.col("shape"), F.lit("kept")).alias("verdict"))


def _ratio(a: str, b: str) -> float:
    """Matching blocks' ratio, after its upper bounds."""
    found = SequenceMatcher(None, a, b)
    return min(found.real_quick_ratio(), found.quick_ratio(), 1.0) and found.ratio()
