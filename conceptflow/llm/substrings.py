"""Removal of repeated passages by level-wise doubling of repeated windows.

Level 1 looks at windows of half the length that counts. A window of the full
length holds ``half + 1`` of them, so among any ``half + 1`` consecutive ones
the smallest hash (leftmost in a tie) is marked; a passage that repeats marks
the same places wherever it stands, hence no repeat is lost while a small part
of all windows is shuffled. Marked windows that stand in one document alone
end there. Level 2 doubles: full windows around surviving marks are hashed
(128 bits) and compared in the same way; those whose sequence also starts in a
document with a smaller id are removed. Longer repeats consist of such windows,
so doubling ends at the length that removal is defined by: at twice that length
the survivors' words are covered by the shorter windows already.

Equal texts are one text from the start, known by its hash: a copy of an earlier
document loses all it has without any window being compared, and a mark must
stand in two different texts to survive.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptflow.llm import arrow
from conceptflow.llm.textscan import RollingHash, covered, space_words, word_hashes
from conceptflow.llm.skew import spread_join
from conceptflow.session import cut, discard, release, shelve, table

_SECOND_BASE, _SECOND_SEED = 0xC2B2AE3D27D4EB4F, 11


def marks(hashes: np.ndarray, span: int) -> np.ndarray:
    """Places of the smallest hash (leftmost in a tie) of every ``span`` consecutive ones; of all if fewer."""
    n = len(hashes)
    if not n:
        return np.empty(0, np.int64)
    if n <= span:
        return np.array([int(np.argmin(hashes))])
    views = np.lib.stride_tricks.sliding_window_view(hashes, span)
    step = max(1, (1 << 22) // span)
    found = [np.unique(np.argmin(views[i : i + step], axis=1) + np.arange(i, min(i + step, len(views)))) for i in range(0, len(views), step)]
    return np.unique(np.concatenate(found))


def _marked(half: int, width: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = RollingHash()
        for batch in batches:
            rows, values, places = [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                words = space_words(text)
                if len(words) < width:
                    continue
                own = rolling.windows(word_hashes(words), half)
                at = marks(own, width - half + 1)
                rows.append(np.full(len(at), row, np.int64))
                values.append(own[at])
                places.append(at)
            if rows:
                keys = batch.column(0).take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(np.concatenate(values).view(np.int64)), pa.array(np.concatenate(places).astype(np.int32))], ["k", "h", "at"]
                )

    return scan


def _doubled(half: int, width: int):
    """Full windows that hold a surviving mark: rows (doc_id, text, at: array, k) to (doc_id, k, h, g, at)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = RollingHash(), RollingHash(_SECOND_BASE)
        for batch in batches:
            rows, h, g, places = [], [], [], []
            for row, (text, at) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                words = space_words(text)
                n = len(words) - width + 1
                if n <= 0 or not at:
                    continue
                starts = np.unique(np.array(at, np.int64)[:, None] - np.arange(width - half + 1))
                starts = starts[(starts >= 0) & (starts < n)]
                rows.append(np.full(len(starts), row, np.int64))
                h.append(first.windows(word_hashes(words), width)[starts])
                g.append(second.windows(word_hashes(words, _SECOND_SEED), width)[starts])
                places.append(starts)
            if rows:
                values = [pa.array(np.concatenate(x).view(np.int64)) for x in (h, g)]
                own = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(own), batch.column(3).take(own), *values, pa.array(np.concatenate(places).astype(np.int32))],
                    ["doc_id", "k", "h", "g", "at"],
                )

    return scan


def _removed(width: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, texts = [], [], []
            for text, at, copy in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                words = space_words(text)
                total.append(len(words))
                if copy and len(words) >= width:
                    gone.append(len(words))
                    words = []
                elif at:
                    mask = covered(np.array(at, np.int64), width, len(words))
                    gone.append(int(mask.sum()))
                    words = [w for w, out in zip(words, mask.tolist(), strict=True) if not out]
                else:
                    gone.append(0)
                texts.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    return scan


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, k, k2, text): 128 bits of a text's hash, null being empty."""
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), body.alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("k"), F.xxhash64(F.lit(1), "text").alias("k2"), "text")


def _first_owners(keyed: DataFrame) -> DataFrame:
    """(k, k2, doc_id): the smallest document of each text."""
    return keyed.groupBy("k", "k2").agg(F.min("doc_id").alias("doc_id"))


def _places(keyed: DataFrame, owners: DataFrame, width: int) -> DataFrame:
    """(doc_id, k, at: array<int>): starts of windows, in texts' first owners, that also start in a smaller document."""
    half = (width + 1) // 2
    first = shelve(keyed.select("k", "text").mapInArrow(arrow.steady(_marked(half, width)), "k bigint, h bigint, at int"))
    shared = first.groupBy("h").agg(F.min("k").alias("least"), F.max("k").alias("most"), F.count("*").alias("n")).where("least < most")
    shared = cut(shared.select("h", "n"))
    release(first.sparkSession)
    # A passage in very many texts: its marks are dealt over tasks.
    alive = shelve(spread_join(first, shared.select("h"), ["h"], shared).groupBy("k").agg(F.collect_set("at").alias("at")))
    del shared
    discard(first)
    release(alive.sparkSession)
    # Texts that share k without being equal are both looked at: marks only choose what level 2 compares in full.
    alive = owners.select("k", "doc_id").join(alive, "k").select("doc_id", "k", "at")
    rows = keyed.select("doc_id", "k", "text").join(alive, ["doc_id", "k"]).select("doc_id", "text", "at", "k")
    second = rows.mapInArrow(arrow.steady(_doubled(half, width)), "doc_id bigint, k bigint, h bigint, g bigint, at int")
    repeated = second.groupBy("h", "g").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    later = second.join(repeated.select("h", "g", "least"), ["h", "g"]).where("least < doc_id")
    return later.groupBy("doc_id", "k").agg(F.collect_set("at").alias("at"))


def deduplicated(docs: DataFrame, width: int = 50) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): every document without the words of later repeats.

    kept: the remaining words joined by one space. A word goes if any window of
    ``width`` words over it also starts in a document with a smaller doc_id,
    judged on the input. Null texts have no words and give an empty kept; texts
    below ``width`` words stay; rows that share a doc_id don't remove from each
    other; a null doc_id neither removes nor loses anything; an empty
    table gives no rows; other columns are ignored.
    """
    if width < 2:
        raise ValueError("a window has two words at least")
    arrow.batched(docs.sparkSession)
    keyed = _keyed(docs.where("doc_id is not null"))
    owners = shelve(_first_owners(keyed))
    places = _places(keyed, owners, width)
    copies = keyed.select("doc_id", "k", "k2").join(owners.withColumnRenamed("doc_id", "owner"), ["k", "k2"]).where("owner < doc_id").select("doc_id", "k").distinct()
    found = places.withColumn("copy", F.lit(False)).unionByName(copies.withColumn("copy", F.lit(True)), allowMissingColumns=True)
    # The same exchange of the texts serves the level above and this join.
    rows = keyed.select("doc_id", "k", "text").join(found, ["doc_id", "k"], "left").select("doc_id", "text", "at", "copy")
    nameless = arrow.id_and_text(docs.where("doc_id is null")).select("doc_id", "text", F.lit(None).cast("array<int>").alias("at"), F.lit(False).alias("copy"))
    return rows.unionByName(nameless).mapInArrow(arrow.steady(_removed(width)), "doc_id bigint, n_words bigint, n_removed bigint, kept string")


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = deduplicated(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def digest(words: list[bytes]) -> str:
    """What kept_sha256 holds, for tests."""
    return hashlib.sha256(b" ".join(words)).hexdigest()


QUERIES = {"op2_substrings": op2_substrings}
_SPLIT = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
ORACLES = {
    "op2_substrings": f"""
WITH d AS (SELECT doc_id, {_SPLIT} AS w FROM documents),
g AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM g),
m AS (SELECT k, min(doc_id) AS least FROM h GROUP BY k),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM h JOIN m USING (k) WHERE least < doc_id),
x AS (SELECT doc_id, list(j) AS gone, count(*) AS n FROM c GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE [w[q] FOR q IN range(1, len(w) + 1) IF NOT list_contains(gone, q)] END, ' ')) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id)
"""
}
