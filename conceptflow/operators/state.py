"""State mutation as pure table algebra: every function returns the next table.

Writers overwrite only the partitions they touch (dynamic overwrite), so a step
that runs twice leaves the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``changes`` replace those of the same keys; columns in ``keep`` retain their old value where there is one."""
    old = current.select(*keys, *[F.col(c).alias(f"_{c}") for c in keep])
    new = changes.join(old, keys, "left") if keep else changes
    for c in keep:
        new = new.withColumn(c, F.coalesce(f"_{c}", c))
    return current.join(changes, keys, "left_anti").unionByName(new.select(current.columns))


def replace_group(current: DataFrame, changes: DataFrame, by: list[str]) -> DataFrame:
    """All rows of the groups that ``changes`` has are replaced by them."""
    return current.join(changes.select(by).distinct(), by, "left_anti").unionByName(changes.select(current.columns))


def insert_absent(current: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return current.unionByName(rows.dropDuplicates(keys).join(current, keys, "left_anti").select(current.columns))


def prefer(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in ``order``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def merge_sync(current: DataFrame, findings: DataFrame, kinds: list[str]) -> DataFrame:
    """Review items after a run (id, kind, status): new ones open, superseded ones that return reopen, open ones that
    vanish from the given kinds are superseded, decisions stay."""
    old = current.select("id", F.col("kind").alias("_kind"), "status")
    new = findings.select("id", "kind").distinct().withColumn("_here", F.lit(True))
    both = old.join(new, "id", "full")
    status = (
        F.when(F.col("status").isNull(), "open")
        .when(F.col("_here") & (F.col("status") == "superseded"), "open")
        .when(F.col("_here").isNull() & (F.col("status") == "open") & F.col("_kind").isin(kinds), "superseded")
        .otherwise(F.col("status"))
    )
    return both.select("id", F.coalesce("_kind", "kind").alias("kind"), status.alias("status"))


def write_partition(df: DataFrame, path: str, by: list[str]) -> None:
    """Overwrite only the partitions that ``df`` has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
