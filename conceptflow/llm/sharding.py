"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Shard sizes are fixed first (at most one apart). How many rows each input
partition sends to each shard is then drawn exactly: partition by partition, a
multivariate hypergeometric draw from the places that are left. Every partition
permutes its rows and deals them out by its row of the matrix, rows are
exchanged, and each shard is permuted again, in buckets of a random key, so no
task holds a whole shard. All draws depend on the seed, the partition and the
row alone; the partition's content is written to the shared folder before, so a
lost executor repeats the same deal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from conceptflow.session import cut, table


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Rows of each shard: at most one apart, larger ones first."""
    return np.full(shards, rows // shards) + (np.arange(shards) < rows % shards)


def communication_matrix(partition_rows: dict[int, int], sizes: np.ndarray, seed: int) -> dict[int, np.ndarray]:
    """Rows that each partition sends to each shard; rows and columns sum up exactly.

    The distribution is that of a uniform permutation of all rows.
    """
    left, matrix = sizes.astype(np.int64).copy(), {}
    for p, rows in sorted(partition_rows.items()):
        rng = np.random.default_rng([seed, p])
        own, todo, total = np.zeros(len(left), np.int64), rows, int(left.sum())
        for s, places in enumerate(left.tolist()):
            rest = total - places
            own[s] = todo if not rest else _hypergeometric(rng, places, rest, todo)
            todo, total = todo - int(own[s]), rest
        left -= own
        matrix[p] = own
    return matrix


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Good ones among ``draws`` without replacement, at any size.

    numpy's draw takes less than 10**9 of a kind. Beyond, the distribution is
    inverted: ratios of neighbouring probabilities, multiplied out from the mode
    over 14 standard deviations to either side (what lies beyond is less than a
    double's rounding), give all weights.
    """
    if max(good, bad) < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, draws)) if good and draws else 0
    total, lowest, highest = good + bad, max(0, draws - bad), min(draws, good)
    if lowest == highest:
        return lowest
    share = draws / total
    reach = int(14 * np.sqrt(good / total * bad / total * draws * (1 - share) + 1)) + 14
    mode = min(highest, max(lowest, (draws + 1) * (good + 1) // (total + 2)))
    up = np.arange(mode, min(highest, mode + reach), dtype=np.float64)
    down = np.arange(mode, max(lowest, mode - reach), -1, dtype=np.float64)
    rise = np.cumprod((good - up) / (up + 1) * ((draws - up) / (bad - draws + up + 1)))
    fall = np.cumprod(down / (good - down + 1) * ((bad - draws + down) / (draws - down + 1)))
    weights = np.concatenate([fall[::-1], [1.0], rise])
    at = int(np.searchsorted(np.cumsum(weights), rng.random() * weights.sum(), "right"))
    return mode - len(fall) + min(at, len(weights) - 1)


def _dealt(shared, columns: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seed, matrix = shared.value
        deals: dict[int, tuple[np.random.Generator, np.ndarray]] = {}
        for batch in batches:
            parts = batch.column(columns).to_numpy()
            shard, draw = np.empty(len(parts), np.int32), np.empty(len(parts), np.int64)
            for p in np.unique(parts).tolist():
                if p not in deals:
                    rng = np.random.default_rng([seed, p, 1])
                    deals[p] = rng, rng.permutation(np.repeat(np.arange(len(matrix[p]), dtype=np.int32), matrix[p]))
                rng, deal = deals[p]
                own = np.flatnonzero(parts == p)
                shard[own], deals[p] = deal[: len(own)], (rng, deal[len(own) :])
                draw[own] = rng.integers(0, 1 << 62, len(own))
            yield pa.RecordBatch.from_arrays([*batch.columns[:columns], pa.array(shard), pa.array(draw)], [*batch.schema.names[:columns], "shard", "draw"])

    return scan


def shuffled(rows: DataFrame, shards: int = 16, seed: int = 7, bucket_rows: int = 20_000) -> DataFrame:
    """``rows`` with ``shard`` and ``slot`` (gapless from 0 in its shard), by a uniform random permutation.

    Shard sizes differ by one at most whatever the content: nulls, ties and
    repeated rows count like any other. An empty table gives no rows; with fewer
    rows than shards, the last shards stay empty. Column names that the shuffle
    adds are refused. A partition's deal takes four bytes a row in its task.
    """
    if clash := {"shard", "slot", "part", "draw", "bucket", "base", "place"} & set(rows.columns):
        raise ValueError(f"columns {sorted(clash)} are taken")
    spark, n = rows.sparkSession, len(rows.columns)
    base = cut(rows.withColumn("part", F.spark_partition_id()))
    counts = {r["part"]: r["n"] for r in base.groupBy("part").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    matrix = communication_matrix(counts, shard_sizes(total, shards), seed)
    shared = spark.sparkContext.broadcast((seed, matrix))
    fields = ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes)
    # The second permutation: a shard's rows in the order of their draws, in buckets by the draws' low bits.
    buckets = 1 + total // (shards * bucket_rows)
    dealt = cut(base.mapInArrow(_dealt(shared, n), f"{fields}, shard int, draw bigint").withColumn("bucket", F.pmod("draw", F.lit(buckets))))
    sizes = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "bucket").orderBy("draw")
    placed = dealt.withColumn("place", F.row_number().over(within) - 1).join(sizes, ["shard", "bucket"])
    return placed.select(*rows.columns, "shard", (F.col("base") + F.col("place")).cast("bigint").alias("slot"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.coalesce("text", F.lit("")).cast("binary")
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(body) + 1).cast("bigint").alias("size"), F.crc32(body).alias("text_crc32"))
    return shuffled(rows).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op8_sharding": op8_sharding}
ORACLES: dict[str, str] = {}
