"""Joins whose keys may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it has more rows than this, and more than one row in ``SHARE`` of all.
LEAST, SHARE = 1000, 10_000


def free(name: str, columns: list[str]) -> str:
    """``name``, with underscores appended while a column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], sizes: DataFrame, how: str = "inner", salt_by: list[str] | None = None) -> DataFrame:
    """``left`` joined with ``right`` on ``keys``; hot keys' rows are dealt over several tasks.

    ``sizes``: ``keys`` and n, the number of rows of ``left`` with each key. A hot
    key gets one salt for each bound's worth of its rows, left rows draw one by a
    hash of ``salt_by`` (all columns by default) and right rows are repeated for
    each. Hot keys are fewer than ``SHARE``, so the list of them is broadcast.
    """
    total = sizes.agg(F.sum("n").alias("n")).first()["n"] or 0
    bound = max(LEAST, total // SHARE)
    hot = F.broadcast(sizes.where(F.col("n") > bound).select(*keys, F.ceil(F.col("n") / bound).cast("int").alias("salts_")))
    one = F.coalesce("salts_", F.lit(1))
    drawn = F.pmod(F.xxhash64(F.spark_partition_id(), *[F.col(c) for c in salt_by or left.columns]), one).cast("int")
    salted = left.join(hot, keys, "left").withColumn("salt_", drawn).drop("salts_")
    repeated = right.join(hot, keys, "left").withColumn("salt_", F.explode(F.sequence(F.lit(0), one - 1))).drop("salts_")
    return salted.join(repeated, [*keys, "salt_"], how).drop("salt_")
