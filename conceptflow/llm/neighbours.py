"""Nearest neighbours by shifted space-filling curves.

Vectors are projected on a few random directions, shifted, and ordered along a
Hilbert curve, several times over with other directions and shifts. Spark
range-partitions each ordering, so every row has a place in each. A query looks
at the rows whose places are near its own, ordering by ordering; candidates
merge and are reranked by the exact distance.

How near is measured, not guessed: the true neighbours of a bounded number of
probes are found by brute force, and the window is as wide as ``RECALL`` of them
need in their best ordering. On clustered vectors that is a few rows; vectors
without structure, whose neighbours no projection knows, need a good part of all.

``exact`` adds a check: blocks of the first ordering outside a query's window
whose centre and radius can't rule out a nearer row are searched too.

Work is dealt in (block, group of queries) pairs of bounded size. Rows with equal
keys are spread by their number, so a block stays small whatever repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from conceptflow.llm import arrow
from conceptflow.session import discard, shelve, table

CURVES, DIMENSIONS, BITS = 8, 8, 7
#: Rows whose vectors fit the projections' ranges, and queries whose true neighbours fit the windows.
SAMPLE_ROWS, PROBES = 10_000, 64
#: Share of the probes' neighbours that the windows are to reach.
RECALL = 0.95
#: A window spans about so many blocks, of rows between these bounds.
SPAN, LEAST_ROWS, MOST_ROWS = 8, 64, 4096
#: Queries and block centres that one task compares at once.
QUERY_GROUP, CENTRE_GROUP = 1024, 4096


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of integer points (n, d) below 2**bits; bits * d at most 62.

    Transposed coordinates are unfolded level by level, Gray-decoded and
    interleaved, after Skilling (2004), for all points at once.
    """
    x = [c.astype(np.int64) for c in points.T]
    top = 1 << (bits - 1)
    level = top
    while level > 1:
        low = level - 1
        for i in range(len(x)):
            on = (x[i] & level) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap
        level >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip, level = np.zeros_like(x[0]), top
    while level > 1:
        flip = np.where((x[-1] & level) > 0, flip ^ (level - 1), flip)
        level >>= 1
    key = np.zeros_like(flip)
    for b in range(bits - 1, -1, -1):
        for c in x:
            key = (key << 1) | (((c ^ flip) >> b) & 1)
    return key


class Curve:
    """One projection, shift and range."""

    def __init__(self, sample: np.ndarray, seed: int) -> None:
        rng = np.random.default_rng(seed)
        d = min(DIMENSIONS, sample.shape[1])
        self.axes = np.linalg.qr(rng.standard_normal((sample.shape[1], d)))[0]
        flat = sample @ self.axes
        self.low, self.width = flat.min(0), np.maximum(np.ptp(flat, axis=0), 1e-12)
        self.shift = rng.random(d)

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        place = ((vectors @ self.axes - self.low) / self.width + self.shift) / 2
        return hilbert(np.clip(place * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64), BITS)


def _matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _keyed(curves: list[Curve], d: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column(1), d)
            for c, curve in enumerate(curves):
                keys = curve.keys(vectors)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(keys), c, np.int32)), pa.array(keys)], ["row", "curve", "key"])

    return scan


def nearest(queries: tuple[np.ndarray, np.ndarray], rows: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, ...]:
    """(query row, row, id, distance): each query's k nearest rows but itself, ties to smaller ids, then rows.

    A matrix product finds who can be among them, exact differences decide;
    squares are added in the order of the components.
    """
    (qi, q), (ri, ids, r) = queries, rows
    norms, out = (r * r).sum(1), [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for i in range(0, len(q), 256):
        part = q[i : i + 256]
        own = (part * part).sum(1)
        rough = own[:, None] + norms - 2 * part @ r.T
        slack = 1e-9 * (1 + norms.max(initial=0.0) + own)
        for j in range(len(part)):
            near = np.where(ri == qi[i + j], np.inf, rough[j])
            kth = np.partition(near, k - 1)[k - 1] if len(near) > k else np.inf
            at = np.flatnonzero((near <= kth + slack[j]) & (ri != qi[i + j]))
            exact = np.sqrt(np.cumsum((r[at] - part[j]) ** 2, axis=1)[:, -1]) if len(at) else np.empty(0)
            best = np.lexsort((ri[at], ids[at], exact))[:k]
            out.append((np.full(len(best), qi[i + j]), ri[at][best], ids[at][best], exact[best]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


FOUND = "query bigint, row bigint, vec_id bigint, score double"


def _found(columns: tuple[np.ndarray, ...]) -> pa.Table:
    return pa.table([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query", "row", "vec_id", "score"])


def _searched(d: int, k: int):
    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        queries = left.column("query").to_numpy(), _matrix(left.column("q"), d)
        rows = right.column("row").to_numpy(), right.column("vec_id").to_numpy(), _matrix(right.column("v"), d)
        return _found(nearest(queries, rows, k))

    return join


def _probed(shared, d: int, k: int):
    """Each batch's nearest rows of the probes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2), d)
            yield from _found(nearest(shared.value, rows, k)).to_batches()

    return scan


def _summary(d: int):
    def describe(block: pa.Table) -> pa.Table:
        vectors = _matrix(block.column("v"), d)
        centre = vectors.mean(0)
        radius = float(np.sqrt(((vectors - centre) ** 2).sum(1)).max())
        return pa.table([block.column("block")[:1], pa.array([centre.tolist()], pa.list_(pa.float64())), pa.array([radius])], ["block", "centre", "radius"])

    return describe


def _open(d: int):
    """(query, block) pairs of queries and centres that a query's k-th distance doesn't rule out, but for blocks in its window."""

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        queries, ids, low, high, worst = (left.column(name).to_numpy() for name in ("query", "group", "low", "high", "worst"))
        blocks, radii, centres = right.column("block").to_numpy(), right.column("radius").to_numpy(), _matrix(right.column("centre"), d)
        vectors, out = _matrix(left.column("q"), d), []
        for i in range(len(queries)):
            least = np.sqrt(((centres - vectors[i]) ** 2).sum(1)) - radii
            found = blocks[(least <= worst[i] * (1 + 1e-9) + 1e-9) & ((blocks < low[i]) | (blocks > high[i]))]
            out.append((np.full(len(found), queries[i]), np.full(len(found), ids[i]), found))
        columns = [np.concatenate(x) if out else np.empty(0, np.int64) for x in (zip(*out, strict=True) if out else ((), (), ()))]
        return pa.table([pa.array(x.astype(np.int64)) for x in columns], ["query", "group", "block"])

    return join


def usable(table_: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v): rows whose vector isn't null, zero, and has no null or non-finite component."""
    kind = "float" if dict(table_.dtypes)[vector] == "array<float>" else "double"
    v = F.transform(F.col(vector), lambda x: x.cast(kind))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return table_.select(F.col(key).cast("bigint").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(good)


def places(rows: DataFrame, curves: list[Curve], d: int, partitions: int) -> DataFrame:
    """(row, curve, pos): each row's place, from 0 without gaps, along each curve."""
    keyed = rows.select("row", "v").mapInArrow(_keyed(curves, d), "row bigint, curve int, key bigint")
    ranged = keyed.repartitionByRange(partitions, "curve", "key", F.xxhash64("row"), "row").sortWithinPartitions("curve", "key", F.xxhash64("row"), "row")
    numbered = shelve(ranged.select("row", "curve", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("nth")))
    sizes = numbered.groupBy("curve", "part").agg(F.count("*").alias("n"), F.min("nth").alias("first"))  # partitions + CURVES rows at most
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("curve", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return numbered.join(F.broadcast(sizes), ["curve", "part"]).select("row", "curve", (F.col("base") + F.col("nth") - F.col("first")).alias("pos"))


def window_width(rows: DataFrame, placed: DataFrame, probes: list, d: int, k: int, recall: float) -> int:
    """Places to either side within which ``recall`` of the probes' true neighbours stand in one ordering or another."""
    own = np.array([r["row"] for r in probes], np.int64), np.array([r["v"] for r in probes], np.float64).reshape(-1, d)
    shared = rows.sparkSession.sparkContext.broadcast(own)
    best = _best(rows.select("row", "vec_id", "v").mapInArrow(_probed(shared, d, k), FOUND), k).select("query", "row").collect()  # PROBES x k
    wanted = {r[k_] for r in best for k_ in (0, 1)}
    at: dict[int, dict[int, int]] = {}
    for r in placed.where(F.col("row").isin(sorted(wanted))).collect():  # PROBES x (k + 1) x CURVES
        at.setdefault(r["row"], {})[r["curve"]] = r["pos"]
    gaps = sorted(min(abs(at[q][c] - at[t][c]) for c in at[q]) for q, t in best)
    return gaps[min(len(gaps) - 1, int(recall * len(gaps)))] if gaps else 0


def search(
    vectors: DataFrame, is_query, k: int = 10, key: str = "vec_id", vector: str = "embedding", recall: float = RECALL, exact: bool = False, curves: int = CURVES
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest other rows of each row that ``is_query`` (a condition on vec_id) marks.

    Vectors that are null, zero or hold null or non-finite components, rows
    without id, and vectors of another length than most take no part. Rows that
    share an id are rows of their own. Equal distances are ranked by id; fewer
    rows than k: all of them; no rows or queries: an empty result. Other columns
    are ignored.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = usable(vectors, key, vector)
    size = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if size is None:
        return empty
    d, n = size["d"], size["n"]
    arrow.batched(spark)
    rows = shelve(rows.where(F.size("v") == d).withColumn("row", F.monotonically_increasing_id()))
    asked = rows.where(is_query)
    probes = asked.orderBy(F.xxhash64("row"), "row").limit(PROBES).collect()
    if not probes:
        return empty
    sample = np.array([r["v"] for r in rows.select("v").orderBy(F.xxhash64("row"), "row").limit(SAMPLE_ROWS).collect()], np.float64)
    made = [Curve(sample, seed) for seed in range(curves)]
    partitions = max(1, -(-n * curves // (MOST_ROWS * 64)))
    placed = shelve(places(rows, made, d, max(partitions, spark.sparkContext.defaultParallelism)))
    width = max(k, window_width(rows, placed, probes, d, k, recall))
    step = min(MOST_ROWS, max(LEAST_ROWS, -(-2 * width // SPAN)))
    queries = asked.count()
    groups = 1 + int(queries * min(1.0, (2 * width + step) / n)) // QUERY_GROUP
    group = F.pmod(F.xxhash64("row"), F.lit(groups))
    blocked = shelve(placed.withColumn("block", F.expr(f"pos div {step}")).join(rows, "row"))
    numbers = lambda n: F.explode(F.expr(f"sequence(0L, {n - 1}L)"))
    ends = [F.expr(f"greatest(pos - {width}, 0) div {step}").alias("low"), F.expr(f"least(pos + {width}, {n - 1}) div {step}").alias("high")]
    own = blocked.where(is_query).select("curve", F.col("row").alias("query"), F.col("v").alias("q"), group.alias("group"), *ends)
    by = ["curve", "block", "group"]
    windows = own.select("curve", "query", "q", "group", F.explode(F.sequence("low", "high")).alias("block"))
    held = lambda table_: table_.withColumn("group", numbers(groups)) if groups > 1 else table_.withColumn("group", F.lit(0).cast("bigint"))
    found = shelve(_best(windows.groupBy(by).cogroup(held(blocked).groupBy(by)).applyInArrow(_searched(d, k), FOUND), k))
    if exact:
        first = blocked.where("curve = 0")
        worst = found.groupBy("query").agg(F.when(F.count("*") >= k, F.max("score")).otherwise(F.lit(float("inf"))).alias("worst"))
        # A query group of QUERY_GROUP meets a group of CENTRE_GROUP centres in one task.
        many = 1 + queries // QUERY_GROUP
        bounded = own.where("curve = 0").drop("group").join(worst, "query", "left").withColumn("worst", F.coalesce("worst", F.lit(float("inf"))))
        bounded = bounded.withColumn("group", F.pmod(F.xxhash64("query"), F.lit(many)))
        supers = 1 + n // (step * CENTRE_GROUP)
        centres = first.groupBy("block").applyInArrow(_summary(d), "block bigint, centre array<double>, radius double").withColumn("super", F.expr(f"block div {CENTRE_GROUP}"))
        left = bounded.withColumn("super", numbers(supers + 1))
        right = centres.withColumn("group", numbers(many))
        pairs = left.groupBy("super", "group").cogroup(right.groupBy("super", "group")).applyInArrow(_open(d), "query bigint, group bigint, block bigint")
        wider = pairs.join(bounded.select("query", "q"), "query").select("query", "q", "block", "group")
        rest = first.withColumn("group", numbers(many))
        more = wider.groupBy("block", "group").cogroup(rest.groupBy("block", "group")).applyInArrow(_searched(d, k), FOUND)
        found = _best(found.select("query", "row", "vec_id", "score").unionByName(more), k)
    ids = asked.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    best = found.join(ids, "query").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    discard(placed)
    return best


def _best(found: DataFrame, k: int) -> DataFrame:
    distinct = found.groupBy("query", "row", "vec_id").agg(F.min("score").alias("score"))
    ranked = distinct.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id", "row")))
    return ranked.where(F.col("rank") <= k)


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, exact=True)


QUERIES = {"op10_neighbours": op10_neighbours}
#: Brute force; list_reduce adds the squares in the same order.
ORACLES = {
    "op10_neighbours": """
WITH u AS (
  SELECT row_number() OVER () AS row, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
p AS (SELECT q.row AS query, q.vec_id AS query_id, r.vec_id, r.row, sqrt(list_reduce(list_transform(list_zip(q.v, r.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])), lambda x, y: x + y)) AS score FROM u q JOIN u r ON q.row <> r.row AND q.vec_id % 100 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score, vec_id, row) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM k WHERE rank <= 10
"""
}
