"""What the Arrow-based operators share: batch size and the narrow input."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch. Texts of 100 kB give batches of about 50 MB.
BATCH_ROWS = 512


def batched(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch, so that long texts don't pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def steady(scan: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``scan`` without the cycle collector, which would walk every word of a batch again and again.

    Words and hashes form no cycles; they are freed by their reference counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        try:
            yield from scan(batches)
        finally:
            gc.enable()

    return run


def id_and_text(docs: DataFrame) -> DataFrame:
    """(doc_id bigint, text as UTF-8 bytes); whatever else the table has stays in the file."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
