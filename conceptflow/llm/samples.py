"""Bounded samples of labelled documents, for fitting on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conceptflow.llm import arrow


def _described(describe, names: list[str]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [describe(text) for text in batch.column(1).to_pylist()]
            values = [pa.array([f[k] for f in found], pa.binary()) for k in range(len(names) - 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int32()), *values], names)

    return scan


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int, describe, fields: str, where: Column | None = None) -> list[tuple]:
    """(doc_id, description, label, weight), ``rows`` at most for each label.

    ``describe`` turns a whole text, on the executors, into the values of
    ``fields``; only these, as a tuple, reach the driver.

    A row's weight is the number of rated rows of its label over that of sampled
    ones, so weighted shares of labels are those of the whole table. Which rows
    is decided by a hash of the id, so a run repeats itself. Ids and labels that
    are null, and ids with several labels, are left out.
    """
    rated = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null")
    rated = rated.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").drop("z")
    if where is not None:
        rated = rated.where(where)
    counts = {r["y"]: r["count"] for r in rated.groupBy("y").count().orderBy("y").limit(100).collect()}
    chosen = [rated.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for y in counts]
    if not chosen:
        return []
    ids = chosen[0]
    for more in chosen[1:]:
        ids = ids.unionAll(more)
    arrow.batched(docs.sparkSession)
    schema = f"doc_id bigint, y int, {fields}"
    scan = arrow.steady(_described(describe, T._parse_datatype_string(schema).names))
    texts = arrow.id_and_text(docs).join(F.broadcast(ids), "doc_id").select("doc_id", "text", "y")
    found = texts.mapInArrow(scan, schema).collect()  # rows x grades descriptions at most, but for repeated rows of documents
    weight = {y: n / min(n, rows) for y, n in counts.items()}
    return sorted({r[0]: (r[0], tuple(r[2:]), r[1], weight[r[1]]) for r in found}.values())
