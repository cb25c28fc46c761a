"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic text.
Every window of a text (``WIDTH`` words, each ``STRIDE`` words) is compressed
with each, in a frame that both dictionaries know; what the toxic one saves is
the window's gain. A window that shares no run of ``RUN`` bytes with what the
toxic dictionary adds has nothing to gain and isn't compressed. Counts of windows above thresholds and the largest gains
describe a document, and a logistic calibration, fitted on labelled documents
that the dictionaries were not trained on, turns them into the score.

Labels are of whole documents while the tell-tale part may be a few words, and
zstandard's own trainer keeps what is frequent, which is what both classes
share. So the ordinary dictionary is zstandard's, and the toxic one is that plus
what toxic text adds: cover selection again (segments of ``SEGMENT`` bytes, most
worth first; a run of ``RUN`` bytes that a chosen segment holds is worth nothing
any more), where a run is worth the log-likelihood ratio of its number of toxic
against ordinary documents in place of its frequency.

The fit uses the whole texts of a bounded sample of labelled rows, scoring reads
whole texts.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptflow.llm import arrow
from conceptflow.llm.samples import labelled
from conceptflow.llm.textscan import alnum_words, mixed
from conceptflow.session import table

#: Labelled rows of either class in the fit.
SAMPLE_ROWS = 3000
#: Words of a window, and from one window's start to the next.
WIDTH, STRIDE = 3, 2
FRAME = b"|~window~|"
#: Bytes of the ordinary dictionary and of what toxic text adds at most.
ORDINARY_BYTES, TOXIC_BYTES = 1 << 16, 1 << 13
SEGMENT, RUN = 16, 6
#: Windows of ordinary text that its dictionary is trained on.
TRAINED_WINDOWS = 100_000
#: Least log-likelihood ratio of a run of bytes that is worth anything.
SURPRISE = 40.0
#: Runs are counted under hashes of so many values.
CELLS = 1 << 22
#: Gains, in bytes, whose windows are counted, and those whose share of all windows is taken.
STEPS, SHARES = (2, 3, 4, 5, 6), (3, 4, 5)
FEATURES = 3 + len(STEPS) + len(SHARES) + 1
THRESHOLD = 0.3
_PARSING = {
    "window_log": 17, "hash_log": 16, "chain_log": 18, "search_log": 3, "min_match": 3, "target_length": 16, "strategy": zstandard.STRATEGY_BTOPT,
    "write_content_size": 0, "write_checksum": 0, "write_dict_id": 0,
}


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]
    bias: float


def plain(text: bytes | None) -> tuple[bytes, bytes]:
    """A text's lower-cased words, and a digest of the text."""
    return b" ".join(alnum_words(text)), hashlib.sha256(text or b"").digest()


def framed(words: list[bytes]) -> bytes:
    return b"%b %b %b" % (FRAME, b" ".join(words), FRAME)


def windows(words: list[bytes]) -> list[bytes]:
    """Framed runs of ``WIDTH`` words; one of fewer if there are fewer, none if none."""
    last = max(1, len(words) - WIDTH + STRIDE) if words else 0
    return [framed(words[i : i + WIDTH]) for i in range(0, last, STRIDE)]


def runs(text: bytes) -> np.ndarray:
    """The cell of each run of ``RUN`` bytes, by place."""
    data = np.frombuffer(text, np.uint8).astype(np.uint64)
    n = max(0, len(data) - RUN + 1)
    code = np.zeros(n, np.uint64)
    for k in range(RUN):
        code = (code << np.uint64(8)) | data[k : k + n]
    return (mixed(code * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(CELLS)).astype(np.int32)


def surprise(a: np.ndarray, b: np.ndarray, n: int, m: int) -> np.ndarray:
    """Log-likelihood ratio (G) of ``a`` of ``n`` texts against ``b`` of ``m``; 0 if it is small or the first share isn't six times the second."""
    a, b = a.astype(float), b.astype(float)
    share = (a + b) / (n + m)
    term = lambda x, expected: np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / np.maximum(expected, 1e-9)), 0.0)
    g = 2 * (term(a, n * share) + term(b, m * share) + term(n - a, n * (1 - share)) + term(m - b, m * (1 - share)))
    return np.where((a * m >= 6 * b * n) & (g >= SURPRISE), g, 0.0)


def cover(texts: list[bytes], worth: np.ndarray, size: int) -> bytes:
    """Segments of ``texts`` by their runs' worth, the best last: zstandard reaches the end of a dictionary most cheaply.

    ``worth`` is by cell and is used up. Worths only fall, so a segment on top
    whose worth still holds is the best there is.
    """
    span, heap, met = SEGMENT - RUN + 1, [], set()
    for text in texts:
        cells = runs(text)
        own = worth[cells]
        total = np.concatenate([[0.0], np.cumsum(own)])
        for i in np.flatnonzero(own > 0).tolist():
            if (piece := text[i : i + SEGMENT]) not in met:
                met.add(piece)
                heap.append((-float(total[min(i + span, len(own))] - total[i]), piece))
    heapq.heapify(heap)
    chosen: list[bytes] = []
    while heap and size > 0:
        value, piece = heapq.heappop(heap)
        cells = runs(piece)
        own = worth[cells]
        if (left := float(own.sum())) <= 0:
            continue
        if heap and left < -heap[0][0] - 1e-9:
            heapq.heappush(heap, (-left, piece))
            continue
        piece = piece[: int(np.flatnonzero(own > 0)[-1]) + RUN]
        worth[cells] = 0.0
        size -= len(piece)
        chosen.append(piece)
    return b"".join(reversed(chosen))


def ordinary_dictionary(texts: list[bytes]) -> bytes:
    """Zstandard's dictionary of ordinary windows; of too few to train on, their text is the dictionary."""
    found = [w for text in texts for w in windows(text.split())]
    found = found[:: max(1, -(-len(found) // TRAINED_WINDOWS))]
    bare = [w[len(FRAME) : -len(FRAME)] for w in found]
    try:
        return zstandard.train_dictionary(ORDINARY_BYTES, bare, k=32, d=RUN).as_bytes()
    except zstandard.ZstdError:
        return b"".join(bare)[-ORDINARY_BYTES:]


class Gains:
    """Compression gains of windows."""

    def __init__(self, toxic: bytes, ordinary: bytes) -> None:
        parsing = zstandard.ZstdCompressionParameters(**_PARSING)

        def make(content: bytes) -> zstandard.ZstdCompressor:
            known = zstandard.ZstdCompressionDict(content + 2 * FRAME, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(compression_params=parsing)
            return zstandard.ZstdCompressor(dict_data=known, compression_params=parsing)

        self.toxic, self.ordinary = make(ordinary + toxic).compress, make(ordinary).compress
        self.added = np.zeros(CELLS, bool)
        self.added[runs(toxic)] = True

    def of(self, words: list[bytes]) -> np.ndarray:
        """The gain of every window of the words."""
        n = len(range(0, max(1, len(words) - WIDTH + STRIDE), STRIDE)) if words else 0
        gains = np.zeros(n, np.int64)
        at = np.flatnonzero(self.added[runs(b" %b " % b" ".join(words))])
        if len(at):
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            first = np.unique(np.searchsorted(ends, at)) // STRIDE
            near = np.unique(np.concatenate([first - k for k in range(-(-WIDTH // STRIDE))]))
            toxic, ordinary = self.toxic, self.ordinary
            for k in near[(near >= 0) & (near < n)].tolist():
                window = framed(words[STRIDE * k : STRIDE * k + WIDTH])
                gains[k] = len(ordinary(window)) - len(toxic(window))
        return gains

    def features(self, words: list[bytes]) -> list[float]:
        """Largest gains, and how many windows, and which share of all, gain so much."""
        gains = self.of(words)
        if not len(gains):
            return [0.0] * FEATURES
        top = np.sort(gains)[::-1][:3].tolist()
        over = [int((gains >= q).sum()) for q in STEPS]
        shares = [(int((gains >= q).sum()) / len(gains)) ** 0.5 for q in SHARES]
        return [*map(float, top), *[0.0] * (3 - len(top)), *np.log1p(over).tolist(), *shares, float(np.log1p(len(gains)))]


def logistic(x: np.ndarray, y: np.ndarray, each: np.ndarray, ridge: float = 1.0, steps: int = 50) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton's method; ``each`` weighs the rows, 1 on average."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.array([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (each * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (each * (p - y)) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def fresh(words: list[bytes], met: set[bytes]) -> bytes:
    """The stretches of a text that stand in runs of ``WIDTH`` words not yet in ``met``, between line ends; they are added to it."""
    own = [b" ".join(words[i : i + WIDTH]) for i in range(max(1, len(words) - WIDTH + 1))]
    out, until = [], 0
    for i, run in enumerate(own):
        if run not in met:
            if i > until:
                out.append(b"\n")
            out += words[max(i, until) : i + WIDTH]
            until = max(until, i + WIDTH)
    met.update(own)
    return b" %b " % b" ".join(out)


def counted(texts: list[bytes], once: bool) -> np.ndarray:
    """In how many texts each run of bytes stands, by cell.

    Copies and near copies would pass off a text's own words as its class's: a
    run of ``WIDTH`` words counts in the first text that has it. Only where
    nothing is worth anything then, ``once`` is to be False, and every text counts.
    """
    counts, met = np.zeros(CELLS, np.int32), set()
    for text in texts:
        counts[np.unique(runs(fresh(text.split(), met) if once else text))] += 1
    return counts


def dictionaries(sample: list[tuple]) -> tuple[bytes, bytes]:
    """(toxic addition, ordinary) of labelled texts; a text that many copies repeat counts once."""
    own: list[list[bytes]] = [[], []]
    for (_, y), text in {(r[1][1], r[2]): b" %b " % r[1][0] for r in sample}.items():
        own[y].append(text)
    for once in (True, False):
        ordinary, toxic = (counted(texts, once) for texts in own)
        at, worth = np.flatnonzero(toxic), np.zeros(CELLS)
        worth[at] = surprise(toxic[at], ordinary[at], max(1, len(own[1])), max(1, len(own[0])))
        if added := cover(own[1], worth, TOXIC_BYTES):
            break
    return added, ordinary_dictionary(own[0])


def fit(sample: list[tuple], parts: int = 3, spark: SparkSession | None = None) -> Model:
    """Dictionaries of all parts of the sample but one; calibration on that one.

    Rows are (doc_id, text or what ``plain`` makes of it, label) and optionally a weight, 1 if there is none.
    With ``spark`` the features are made on the executors.
    With one label alone in either there is nothing to compare: every text gets the smoothed rate of the labels.
    """
    sample = [(r[0], r[1] if isinstance(r[1], tuple) else plain(r[1]), *r[2:]) for r in sample]
    weight = lambda r: r[3] if len(r) > 3 else 1.0
    apart = [zlib.crc32(b"part %d" % r[0]) % parts == 0 for r in sample]
    trained, held = ([r for r, x in zip(sample, apart, strict=True) if x == own] for own in (False, True))
    if any({r[2] for r in some} != {0, 1} for some in (trained, held)):
        rate = (sum(r[2] * weight(r) for r in sample) + 1) / (sum(map(weight, sample)) + 2)
        return Model(b"", b"", (0.0,) * FEATURES, float(np.log(rate / (1 - rate))))
    pair = dictionaries(trained)
    gains = Gains(*pair)
    x = np.array([gains.features(r[1][0].split()) for r in held]) if spark is None else _features_of(spark, [r[1][0] for r in held], pair)
    y, each = np.array([r[2] for r in held], float), np.array([weight(r) for r in held])
    weights, bias = logistic(x, y, each / each.mean())
    return Model(*pair, tuple(weights.tolist()), bias)


def _features_of(spark: SparkSession, texts: list[bytes], pair: tuple[bytes, bytes]) -> np.ndarray:
    """Features of texts, as words, in their order."""
    shared = spark.sparkContext.broadcast(pair)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = Gains(*shared.value)
        for batch in batches:
            found = [gains.features(words.split()) for words in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], ["n", "x"])

    sent = pa.table([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.binary())], ["n", "words"])
    found = spark.createDataFrame(sent).mapInArrow(arrow.steady(describe), "n bigint, x array<double>").collect()
    return np.array([r["x"] for r in sorted(found)])


_GAINS: dict[tuple[bytes, bytes], Gains] = {}


def _scored(shared):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        key = (model.toxic, model.ordinary)
        if key not in _GAINS:
            _GAINS.clear()
            _GAINS[key] = Gains(*key)
        gains, weights = _GAINS[key], np.array(model.weights)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            x = np.array([gains.features(alnum_words(t)) if model.ordinary else [0.0] * len(weights) for t in texts]).reshape(len(texts), len(weights))
            score = 1 / (1 + np.exp(-np.clip(x @ weights + model.bias, -50, 50)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    return scan


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of ``docs`` (doc_id, text; others are ignored).

    Null and empty texts have no windows and get the score of no evidence; equal
    texts get equal scores; repeated rows and null ids stay; an empty table gives
    no rows. A very long text is one more text with more windows.
    """
    spark = docs.sparkSession
    arrow.batched(spark)
    return arrow.id_and_text(docs).mapInArrow(arrow.steady(_scored(spark.sparkContext.broadcast(model))), "doc_id bigint, score double")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = fit(labelled(docs, labels, "toxic", SAMPLE_ROWS, plain, "words binary, digest binary", ~held_out), spark=spark)
    scored = scores(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op5_toxicity": op5_toxicity}
#: Compression is not expressible in SQL; tests/llm checks held-out accuracy.
ORACLES: dict[str, str] = {}
