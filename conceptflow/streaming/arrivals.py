"""Events as a stream: windows with watermarks, and arrivals folded into a table batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptflow.operators.state import insert_absent
from conceptflow.session import _shared_folder


def windowed(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) by tumbling event-time windows; the same plan serves batches and streams."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    found = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, n): a user's events without a pause of ``gap``."""
    found = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("w.start").alias("start"), "n")


def once(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """All that is there now, through a streaming query."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", f"{_shared_folder(stream.sparkSession)}/stream-{name}").start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def append_new(spark: SparkSession, stream: DataFrame, target: str, keys: list[str]):
    """Start a query that appends rows with unseen keys to the Parquet table ``target``; a batch that runs twice adds nothing."""

    def add(batch: DataFrame, _: int) -> None:
        known = spark.read.schema(batch.schema).parquet(target)
        insert_absent(known.limit(0), batch.join(known.select(keys), keys, "left_anti"), keys).write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(add).trigger(availableNow=True).option("checkpointLocation", f"{target}/_arrivals").start()
