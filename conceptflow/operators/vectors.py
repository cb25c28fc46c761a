"""Typing mentions by exact vector search, similarity joins and single-link clusters.

Arrow blocks of mentions are multiplied with blocks of class names. Names are
sent out in blocks of at most ``NAME_VALUES`` numbers, one pass each, so the
inventory may grow without a larger broadcast; passes meet in a top-k window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from conceptflow.operators.components import connected_components

NAME_VALUES = 4_000_000
#: Blocks that a similarity join deals its rows to, their least and greatest length, its tasks at most, and the rows that one task sends out.
BLOCKS, LEAST_ROWS, MOST_ROWS, MOST_TASKS, SENT_ROWS = 32, 2048, 32_768, 2048, 100_000


def _rows(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _ranked(shared, top_k: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        iris, names = shared.value
        classes, starts = np.unique(iris, return_index=True)
        for batch in batches:
            if not batch.num_rows:
                continue
            scores = np.maximum.reduceat(_unit(_rows(batch.column(1))) @ names.T, starts, axis=1)
            scores = np.round(scores, 6)
            order = np.lexsort((np.broadcast_to(np.arange(len(classes)), scores.shape), -scores), axis=1)[:, :top_k]
            rows = np.repeat(np.arange(len(scores)), order.shape[1])
            picked = order.ravel()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array(classes[picked].tolist(), pa.string()), pa.array(scores[rows, picked])], ["mention_id", "iri", "score"]
            )

    return scan


def rank_targets(mentions: DataFrame, names: DataFrame, top_k: int = 5) -> DataFrame:
    """(mention_id, iri, score, rank): the classes with the nearest name, score desc then iri.

    ``mentions``: (mention_id, v); ``names``: (iri, v), a row for each name of a
    class. A class scores as its nearest name. No names: no rows.
    """
    spark = mentions.sparkSession
    block, parts = [], []

    def flush() -> None:
        block.sort(key=lambda r: r[0])
        shared = spark.sparkContext.broadcast((np.array([r[0] for r in block]), _unit(np.array([r[1] for r in block], np.float64))))
        kind = dict(mentions.dtypes)["mention_id"]
        parts.append(mentions.select("mention_id", "v").mapInArrow(_ranked(shared, top_k), f"mention_id {kind}, iri string, score double"))
        block.clear()

    for row in names.select("iri", "v").orderBy("iri").toLocalIterator():
        block.append((row["iri"], row["v"]))
        if len(block) * len(row["v"]) >= NAME_VALUES:
            flush()
    if block:
        flush()
    if not parts:
        return spark.createDataFrame([], f"mention_id {dict(mentions.dtypes)['mention_id']}, iri string, score double, rank int")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionAll(part)
    best = found.groupBy("mention_id", "iri").agg(F.max("score").alias("score")) if len(parts) > 1 else found
    rank = F.row_number().over(Window.partitionBy("mention_id").orderBy(F.desc("score"), "iri"))
    return best.withColumn("rank", rank).where(F.col("rank") <= top_k)


def zone(score: Column, auto: float, grey: float) -> Column:
    return F.when(score >= auto, "auto").when(score >= grey, "grey").otherwise("discarded")


def typings(ranked: DataFrame, auto: float, grey: float) -> DataFrame:
    """(mention_id, iri, score, zone, runner_up): one row for each mention, iri null if nothing is near enough."""
    one = ranked.groupBy("mention_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("iri"))).alias("iri"),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("score"),
        F.max(F.when(F.col("rank") == 2, F.col("iri"))).alias("runner_up"),
    )
    kind = zone(F.col("score"), auto, grey)
    return one.select("mention_id", F.when(kind != "discarded", F.col("iri")).alias("iri"), "score", kind.alias("zone"), "runner_up")


def _pairs(floor: float):
    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            a, b = left.column("id").to_numpy(), right.column("id").to_numpy()
            x, y = (_unit(_rows(t.column("v").combine_chunks())) for t in (left, right))
            inside = left.column("_b")[0] == left.column("_c")[0]
            # Single precision rules out what is below the floor by more than it can err; the rest is scored in double precision.
            u, w, short = x.astype(np.float32), y.astype(np.float32).T, np.float32(floor - 1e-6 - 1.2e-7 * (x.shape[1] + 4))
            for i in range(0, len(x), 512):
                p, q = np.nonzero(u[i : i + 512] @ w >= short)
                few = len(p) <= 512 * len(y) // 256
                raw = (x[i + p] * y[q]).sum(1) if few else (x[i : i + 512] @ y.T)[p, q]
                score, one, two = np.round(raw, 6), a[i + p], b[q]
                kept = (score >= floor) & (one < two if inside else one != two)
                out[0].append(np.minimum(one, two)[kept]), out[1].append(np.maximum(one, two)[kept]), out[2].append(score[kept])
        whole = [np.concatenate(c) if c else np.empty(0) for c in out]
        return pa.table([pa.array(whole[0].astype(np.int64)), pa.array(whole[1].astype(np.int64)), pa.array(whole[2].astype(np.float64))], ["a", "b", "score"])

    return join


def similar_pairs(vectors: DataFrame, floor: float, block_rows: int | None = None) -> DataFrame:
    """(a, b, score) with a < b and cosine >= ``floor``, exactly: blocks of rows meet pairwise in Arrow.

    ``vectors``: (id bigint, v). Rows are spread by a hash of their id over blocks
    of about ``block_rows``; each pair of blocks, taken once, is one group, and
    only real pairs leave it. By default there are up to ``BLOCKS`` blocks of
    ``LEAST_ROWS`` to ``MOST_ROWS`` rows, so a row is sent out that often at most
    until blocks are full, and what is shuffled grows with the rows.
    """
    rows = vectors.count()
    blocks = 1 + rows // (block_rows or min(MOST_ROWS, max(LEAST_ROWS, -(-rows // BLOCKS))))
    # Dealt first, so that no task repeats more than some of the rows, however few files they come from.
    even = vectors.repartition(max(vectors.sparkSession.sparkContext.defaultParallelism, rows * (blocks + 1) // SENT_ROWS), "id")
    spread = even.withColumn("_n", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    n_tasks = max(vectors.sparkSession.sparkContext.defaultParallelism, min(blocks * (blocks + 1) // 2, MOST_TASKS))

    def side(first: str, second: str, low: Column, high: Column) -> DataFrame:
        # New names for both sides: a cogroup of two branches of one table confuses their columns.
        own = spread.select(F.col("id").alias("id"), F.col("v").alias("v"), F.col("_n").alias(first)).withColumn(second, F.explode(F.sequence(low, high)))
        return own.repartition(n_tasks, "_b", "_c").groupBy("_b", "_c")

    left, right = side("_b", "_c", F.col("_b"), F.lit(blocks - 1)), side("_c", "_b", F.lit(0), F.col("_c"))
    return left.cogroup(right).applyInArrow(_pairs(floor), "a bigint, b bigint, score double")


def single_link(vectors: DataFrame, threshold: float, min_support: int) -> DataFrame:
    """(cluster_id, size, least): components of similar pairs with ``min_support`` members; the id hashes the sorted members."""
    roots = connected_components(similar_pairs(vectors, threshold).select("a", "b"))
    grouped = roots.groupBy("root").agg(F.sort_array(F.collect_list("node")).alias("members")).where(F.size("members") >= min_support)
    ids = F.sha1(F.array_join(F.col("members").cast("array<string>"), ",").cast("binary"))
    return grouped.select(ids.alias("cluster_id"), F.size("members").cast("bigint").alias("size"), F.element_at("members", 1).alias("least"))


def entities(pairs: DataFrame, mentions: DataFrame) -> DataFrame:
    """(mention_id, entity): components over merge decisions; the anchor is the smallest mention id."""
    roots = connected_components(pairs)
    anchors = roots.groupBy("root").agg(F.least(F.min("node"), F.min("root")).alias("entity"))
    named = roots.join(anchors, "root").select(F.col("node").alias("mention_id"), "entity")
    return mentions.join(named, "mention_id", "left").select("mention_id", F.coalesce("entity", "mention_id").alias("entity"))
