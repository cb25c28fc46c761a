"""Benchmark decontamination: a broadcast hash set of benchmark n-grams, verified hits.

Benchmark items are cut into windows of ``n`` words (an item with fewer, but
not none, is one window). Their rolling hashes, sorted, are broadcast with the
window's words and items; each document's windows are looked up by binary
search and every match is verified word by word before it counts.

The broadcast is bounded: items go out in blocks of at most ``BLOCK_WORDS``
words. A row passes through the blocks one after another and gathers their hits,
without a shuffle, so whatever its id it stays a row of its own and the
benchmark may grow without a larger broadcast. Reading the blocks uses one
item's text at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptflow.llm import arrow
from conceptflow.llm.textscan import RollingHash, alnum_words, word_hashes
from conceptflow.session import table

#: Words of benchmark text in one broadcast (about 100 MB of windows at most, half a kilobyte each).
BLOCK_WORDS = 200_000


class WindowIndex:
    """Windows of benchmark items, by length and hash."""

    def __init__(self, items: list[tuple[str, list[bytes]]], n: int) -> None:
        self.n, self.rolling = n, None
        found: dict[tuple[bytes, ...], set[str]] = {}
        for item, words in items:
            width = min(n, len(words))
            for i in range(len(words) - width + 1 if words else 0):
                found.setdefault(tuple(words[i : i + width]), set()).add(item)
        self.windows = [(w, sorted(who)) for w, who in found.items()]
        rolling, keyed = RollingHash(), {}
        for k, (words, _) in enumerate(self.windows):
            value = int(rolling.windows(word_hashes(list(words)), len(words))[0])
            keyed.setdefault(len(words), []).append((value, k))
        self.by_width = {w: (np.array([v for v, _ in sorted(x)], np.uint64), [k for _, k in sorted(x)]) for w, x in keyed.items()}

    def search(self, words: list[bytes]) -> Iterator[tuple[int, int, list[str]]]:
        """(start, width, items) of every window that stands in ``words``."""
        if self.rolling is None:
            self.rolling = RollingHash()
        hashes = word_hashes(words) if words else None
        for width, (known, ids) in self.by_width.items():
            if len(words) < width:
                continue
            own = self.rolling.windows(hashes, width)
            at = np.searchsorted(known, own)
            for i in np.flatnonzero(known[np.minimum(at, len(known) - 1)] == own).tolist():
                k = int(at[i])
                while k < len(known) and known[k] == own[i]:
                    window, items = self.windows[ids[k]]
                    if tuple(words[i : i + width]) == window:
                        yield i, width, items
                    k += 1


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("binary").alias("t"))
    for row in rows.where("i is not null and t is not null").toLocalIterator():
        words = alnum_words(bytes(row["t"]))
        if block and size + len(words) > block_words:
            yield block
            block, size = [], 0
        block.append((row["i"], words))
        size += len(words)
    yield block


def _scanner(shared, last: bool):
    """Rows (row, text, hit_words, items) with a block's hits added; the last block's have their number of words in place of the text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            counts, hits, items = [], [], []
            for text, known, ids in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                words = alnum_words(text)
                places, who = set(known), set(ids)
                for start, width, found in index.search(words):
                    places.update(range(start, start + width))
                    who.update(found)
                counts.append(len(words))
                hits.append(sorted(places))
                items.append(sorted(who))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()) if last else batch.column(1), pa.array(hits, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))],
                ["row", "n_words" if last else "text", "hit_words", "items"],
            )

    return scan


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", n: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(key, n_words, hit_words, items) for every row of ``docs`` (key, text; others ignored).

    hit_words: sorted places (from 0) of the words inside benchmark windows;
    items: ids (as strings, sorted) with occurring windows. Null and empty texts
    have no words; null items and items without words have no windows; rows with
    repeated or null keys stay rows of their own, equal texts have equal hits; an
    empty benchmark finds nothing, an empty table gives no rows.
    """
    spark = docs.sparkSession
    arrow.batched(spark)
    none = [F.expr("cast(array() as array<bigint>)").alias("hit_words"), F.expr("cast(array() as array<string>)").alias("items")]
    rows = docs.select(F.col(key).alias("row"), F.col("text").cast("binary").alias("text"), *none)
    kind, blocks = dict(rows.dtypes)["row"], list(_indexes(benchmark, n, block_words))
    for k, shared in enumerate(blocks):
        last = k == len(blocks) - 1
        rows = rows.mapInArrow(_scanner(shared, last), f"row {kind}, {'n_words bigint' if last else 'text binary'}, hit_words array<bigint>, items array<string>")
    return rows.withColumnRenamed("row", key)


def _indexes(benchmark: DataFrame, n: int, block_words: int):
    """A broadcast index for each block; one at least."""
    for block in _blocks(benchmark, block_words):
        yield benchmark.sparkSession.sparkContext.broadcast(WindowIndex(block, n))


def clean_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no benchmark window.

    Null and empty texts hold none and stay, as do repeated rows and null ids; an
    empty benchmark removes nothing.
    """
    arrow.batched(docs.sparkSession)
    kept = docs
    for shared in _indexes(benchmark, n, BLOCK_WORDS):
        kept = kept.mapInArrow(_filter(shared, docs.columns.index("text")), docs.schema)
    return kept


def _filter(shared, at: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            yield batch.filter(pa.array([next(index.search(alnum_words(t)), None) is None for t in texts], pa.bool_()))

    return scan


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("bigint").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


def digest(items: list[str]) -> str:
    """What items_sha256 holds, for tests."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


QUERIES = {"op4_decontamination": op4_decontamination}
_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
ORACLES = {
    "op4_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
g AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS width, unnest([array_to_string(w[i:i + least(10, len(w)) - 1], ' ') FOR i IN range(1, greatest(len(w) - 9, 1) + 1)]) AS gram
  FROM b WHERE len(w) > 0
),
p AS (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM d, (SELECT DISTINCT width FROM g)),
h AS (
  SELECT doc_id, i, p.width, item_id FROM p JOIN g ON g.width = p.width AND g.gram = array_to_string(w[i:i + p.width - 1], ' ')
),
c AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + width)) AS j FROM h) GROUP BY 1),
s AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(s.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s.ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)
"""
}
