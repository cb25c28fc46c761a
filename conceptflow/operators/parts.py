"""How rows are dealt over tasks: joins of large groups by pairs of blocks, partitions of bounded length, streamed folds."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of one key that meet in a task from each side; pairs and rows that a task is planned for; tasks of a join at most.
BLOCK_ROWS, TASK_PAIRS, TASK_ROWS, MOST_TASKS = 16_384, 1 << 25, 500_000, 8192


def tasks(df: DataFrame, rows: int | None = None) -> int:
    """As many tasks as leave about ``rows`` rows (``TASK_ROWS``) to each."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // (rows or TASK_ROWS)))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` by a hash of ``keys``, in partitions of bounded length, which Spark won't merge again."""
    return df.repartition(tasks(df), *keys)


def paired(left: DataFrame, right: DataFrame, on: list[str], left_id: str, right_id: str, block_rows: int | None = None) -> DataFrame:
    """``left`` joined with ``right`` on ``on``, whatever the size of a group: each pair of its blocks is dealt by itself.

    The sides have no other column in common; ``left_id`` and ``right_id`` tell
    their rows apart and put them into blocks of about ``block_rows`` (``BLOCK_ROWS``). Only keys
    with several blocks, which are few, are broadcast; no pair is shuffled.
    """
    block_rows = block_rows or BLOCK_ROWS
    left, right = left.dropna(subset=on), right.dropna(subset=on)
    one = lambda rows, n, m: rows.select(*on, F.lit(n).alias("_n"), F.lit(m).alias("_m"))
    sizes = one(left, 1, 0).unionAll(one(right, 0, 1)).groupBy(*on).agg(F.sum("_n").alias("_n"), F.sum("_m").alias("_m"))
    pairs, rows = sizes.agg(F.sum(F.col("_n").cast("double") * F.col("_m")), F.sum(F.col("_n") + F.col("_m"))).first()
    blocks = lambda c: F.greatest(F.ceil(F.col(c) / block_rows), F.lit(1)).cast("int")
    large = F.broadcast(sizes.where(F.greatest("_n", "_m") > block_rows).select(*on, blocks("_n").alias("_ln"), blocks("_m").alias("_rn")))
    n_tasks = max(left.sparkSession.sparkContext.defaultParallelism, min(MOST_TASKS, int((pairs or 0) // TASK_PAIRS + (rows or 0) // TASK_ROWS)))

    def side(df: DataFrame, own: str, n: str, other: str, m: str, key: str) -> DataFrame:
        count = lambda c: F.coalesce(F.col(c), F.lit(1))
        block = F.pmod(F.xxhash64(key), count(n)).cast("int")
        each = df.join(large, on, "left").withColumn(own, block).withColumn(other, F.explode(F.sequence(F.lit(0), count(m) - 1)))
        return each.drop("_ln", "_rn").repartition(n_tasks, *on, "_i", "_j")

    return side(left, "_i", "_ln", "_j", "_rn", left_id).join(side(right, "_j", "_rn", "_i", "_ln", right_id).hint("merge"), [*on, "_i", "_j"]).drop("_i", "_j")


def folded(df: DataFrame, key: str, order: list[str], fold: Callable[[list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """``fold`` of the rows of each ``key``, one group after another in a task, which holds one group and one batch at a time.

    ``fold`` gets a group's rows as tuples in the order of ``order`` and yields rows of ``schema``.
    """
    place = df.columns.index(key)
    made = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], field.type) for i, field in enumerate(made)], names=made.names)
        for rows in batches:
            for row in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                if held and held[0][place] != row[place]:
                    out.extend(fold(held))
                    held = []
                held.append(row)
            if len(out) >= 10_000:
                yield batch()
                out = []
        if held:
            out.extend(fold(held))
        if out:
            yield batch()

    return dealt(df, key).sortWithinPartitions(key, *order).mapInArrow(scan, schema)
