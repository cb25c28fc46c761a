"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered
thresholds cut its value into grades: P(grade >= k) = s(w.x - t[k]). Expected
grade and tail probability follow, and selection is by the tail. Features are
hashed words, hashed word shapes (letters as a or A, digits as 0, marks as they
are) and a few hashed facts of the whole text; weights of a text are square
roots of counts, scaled to length 1. The fit runs on the driver over the features
of a bounded sample of rated rows; fit and scoring read whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptflow.llm import arrow
from conceptflow.llm.samples import labelled
from conceptflow.llm.textscan import space_words, word_hashes
from conceptflow.session import table

#: Rated rows of each grade in the fit.
SAMPLE_ROWS = 3000
BUCKETS = 1 << 16
#: Least probability of the grade that is kept.
KEEP = 0.5
_SHAPE = bytes(
    0x41 if 0x41 <= b <= 0x5A else 0x61 if 0x61 <= b <= 0x7A or b >= 0x80 else 0x30 if 0x30 <= b <= 0x39 else b for b in range(256)
)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, value) of a text's features; values have length 1. An empty text has its facts alone."""
    words = space_words(text)
    shapes = text.translate(_SHAPE).split() if text else []
    lines = text.split(b"\n") if text else []
    share = lambda some: int(10 * len(set(some)) / len(some)) if some else 10
    facts = [b"words%d" % share(words), b"lines%d" % share(lines), b"shapes%d" % share(shapes), b"size%d" % len(words).bit_length()]
    groups = []
    for seed, some, weight in ((0, words, 1.0), (1, shapes, 1.0), (2, facts, 0.5)):
        if some:
            at, n = np.unique(word_hashes(some, seed) % np.uint64(BUCKETS), return_counts=True)
            value = np.sqrt(n)
            groups.append((at.astype(np.int64), weight * value / np.linalg.norm(value)))
    at, value = (np.concatenate(x) for x in zip(*groups, strict=True))
    return at, value / np.linalg.norm(value)


def packed(text: bytes | None) -> tuple[bytes, bytes]:
    at, value = features(text)
    return at.astype(np.int32).tobytes(), value.tobytes()


def unpacked(found: tuple[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(found[0], np.int32).astype(np.int64), np.frombuffer(found[1], np.float64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def fit(sample: list[tuple], rounds: int = 300, rate: float = 0.3, ridge: float = 1e-4) -> Model:
    """Weights and thresholds by full-batch AdaGrad; grades are 0, 1, ..., and unrated ones between are allowed.

    Rows are (doc_id, text or its packed features, grade) and optionally a weight, 1 if there is none.
    With one grade or none there is nothing to learn: every text gets that grade.
    """
    top = max((r[2] for r in sample), default=0)
    if len({r[2] for r in sample}) < 2:
        return Model(np.zeros(BUCKETS), np.full(top, -50.0))
    found = [unpacked(r[1]) if isinstance(r[1], tuple) else features(r[1]) for r in sample]
    rows = np.repeat(np.arange(len(found)), [len(at) for at, _ in found])
    at, value = (np.concatenate(x) for x in zip(*found, strict=True))
    y, n = np.array([r[2] for r in sample]), len(sample)
    each = np.array([r[3] if len(r) > 3 else 1.0 for r in sample])
    each /= each.sum()
    above = np.array([each[y >= k].sum() for k in range(1, top + 1)]).clip(1e-3, 1 - 1e-3)
    t = np.log((1 - above) / above)
    w, past_w, past_t = np.zeros(BUCKETS), np.full(BUCKETS, 1e-8), np.full(top, 1e-8)
    for _ in range(rounds):
        z = np.bincount(rows, value * w[at], n)
        tail = np.column_stack([np.ones(n), _sigmoid(z[:, None] - t), np.zeros(n)])
        p = (tail[np.arange(n), y] - tail[np.arange(n), y + 1]).clip(1e-9)
        slope = tail * (1 - tail)
        low, high = each * slope[np.arange(n), y] / p, each * slope[np.arange(n), y + 1] / p
        gz = high - low
        gt = np.array([low[y == k].sum() - high[y == k - 1].sum() for k in range(1, top + 1)])
        gw = np.bincount(at, gz[rows] * value, BUCKETS) + ridge * w
        past_w += gw**2
        past_t += gt**2
        w -= rate * gw / np.sqrt(past_w)
        t = np.maximum.accumulate(t - rate * gt / np.sqrt(past_t))
    return Model(w, t)


def tails(model: Model, text: bytes | None) -> np.ndarray:
    """P(grade >= k) for k = 1, 2, ..."""
    at, value = features(text)
    return _sigmoid(float(value @ model.weights[at]) - model.thresholds)


def _rated(shared, at: int, keep_columns: bool, grade: int, least: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [tails(model, t) for t in batch.column(at).cast(pa.binary()).to_pylist()]
            tail = np.array([float(p[grade - 1]) if len(p) >= grade else 0.0 for p in found])
            if keep_columns:
                yield batch.filter(pa.array(tail >= least, pa.bool_()))
            else:
                expected = np.array([float(p.sum()) for p in found])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(expected), pa.array(tail)], ["doc_id", "expected_grade", "tail_probability"])

    return scan


def ratings(docs: DataFrame, model: Model, grade: int = 1) -> DataFrame:
    """(doc_id, expected_grade, tail_probability) of every row; the tail is P(grade >= ``grade``).

    Null and empty texts are rated by the facts of an empty text; equal texts
    are rated alike; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    arrow.batched(spark)
    scan = _rated(spark.sparkContext.broadcast(model), 1, False, grade, 0.0)
    return arrow.id_and_text(docs).mapInArrow(arrow.steady(scan), "doc_id bigint, expected_grade double, tail_probability double")


def accepted(docs: DataFrame, model: Model, grade: int = 1, least: float = KEEP) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose tail probability is ``least`` or more."""
    spark = docs.sparkSession
    arrow.batched(spark)
    return docs.mapInArrow(arrow.steady(_rated(spark.sparkContext.broadcast(model), docs.columns.index("text"), True, grade, least)), docs.schema)


def fitted(spark: SparkSession, sf_dir: str) -> Model:
    """The model of the ratings in ``labels.quality``."""
    return fit(labelled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", SAMPLE_ROWS, packed, "buckets binary, weights binary"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = ratings(table(spark, sf_dir, "documents"), fitted(spark, sf_dir))
    return rated.withColumn("keep", F.col("tail_probability") >= KEEP)


QUERIES = {"op3_quality": op3_quality}
ORACLES: dict[str, str] = {}
