"""Near-duplicate documents by SimHash and multi-index hashing.

A fingerprint has 64 bits. Two that differ in at most four bits differ, over
three segments of 22, 21 and 21 bits, in at most one bit of the first or of the
second segment, or in none of the third (2 + 2 + 1 would be five). So every
fingerprint is stored under its three segments, and probes the Hamming balls of
radius 1, 1 and 0 around them. Of two keys one bit apart only the one with the
0 probes, so each pair is met once per segment. Matches are verified on all 64
bits in the join's condition: only real links leave the join. Distinct
fingerprints take part, never documents, so copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptflow.llm import arrow
from conceptflow.llm.skew import spread_join
from conceptflow.llm.textscan import ascii_lower, shingle_bytes, space_words
from conceptflow.operators.components import connected_components
from conceptflow.session import cut, table

#: (shift, bits, radius) of the segments for at most four differing bits.
SEGMENTS = ((42, 22, 1), (21, 21, 1), (0, 21, 0))
MAX_BITS = 4


def votes(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprints of documents whose shingle hashes lie one after another (sizes: how many each)."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64)
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        packed = np.packbits(2 * ones > sizes[full][:, None], axis=1)
        out[full] = packed.view(">u8").ravel()
    return out


def fingerprints(texts: list[bytes | None], shingle: int = 4, seed: int = 42, block: int = 1 << 18) -> np.ndarray:
    """64-bit SimHash of each text; ``block`` bounds the hashes whose bits are unpacked at once, also of one long text."""
    digest, out, hashes, sizes = xxhash.xxh64_intdigest, [], [], []
    for text in [*texts, None]:
        own = [digest(s, seed) for s in shingle_bytes(space_words(ascii_lower(text or b"")), shingle)]
        if len(own) > block:
            own, long = [], np.array(own, np.uint64)
            ones = sum(np.unpackbits(long[i : i + block].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64) for i in range(0, len(long), block))
            mark = int(np.packbits(2 * ones > len(long)).view(">u8")[0])
        else:
            mark = None
        hashes += own
        sizes.append(len(own))
        if mark is not None or len(hashes) >= block or len(out) + len(sizes) > len(texts):
            out.extend(votes(np.array(hashes, np.uint64), np.array(sizes)).tolist())
            if mark is not None:
                out[-1] = mark
            hashes, sizes = [], []
    return np.array(out[: len(texts)], np.uint64)


def _fingerprinted(shingle: int, seed: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = fingerprints(batch.column(1).to_pylist(), shingle, seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks.view(np.int64))], ["doc_id", "fp"])

    return scan


def fingerprint_table(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of every row, fp as a signed bigint; a null text counts as empty."""
    arrow.batched(docs.sparkSession)
    return arrow.id_and_text(docs).mapInArrow(_fingerprinted(shingle, seed), "doc_id bigint, fp bigint")


def _keys(probe: bool) -> Column:
    """Keys of a fingerprint: segment number and bits; with probe, the balls' upper halves too."""
    parts = []
    for n, (shift, bits, radius) in enumerate(SEGMENTS):
        key = f"(shiftrightunsigned(fp, {shift}) & {(1 << bits) - 1}L)"
        tag = f"{n << 24}L"
        parts.append(f"array({tag} | {key})")
        if probe and radius:
            zero = f"filter(sequence(0, {bits - 1}), b -> (shiftrightunsigned({key}, b) & 1L) = 0L)"
            parts.append(f"transform({zero}, b -> {tag} | {key} | shiftleft(1L, b))")
    return F.explode(F.expr(f"concat({', '.join(parts)})"))


def links(marks: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): pairs of distinct fingerprints in ``marks.fp`` at 1 to ``max_bits`` (4 at most) differing bits.

    A pair can come once for each segment that shows it.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"the segments are laid out for at most {MAX_BITS} bits")
    stored = marks.select(_keys(False).alias("key"), F.col("fp").alias("b"))
    probes = marks.select(_keys(True).alias("key"), F.col("fp").alias("a"))
    own = " or ".join(f"key = ({n << 24}L | (shiftrightunsigned(a, {s}) & {(1 << w) - 1}L))" for n, (s, w, _) in enumerate(SEGMENTS))
    met = probes.join(stored, "key").where(f"a <> b and bit_count(a ^ b) <= {max_bits} and (not ({own}) or a < b)")
    return met.select("a", "b")


def near_duplicates(docs: DataFrame, shingle: int = 4, seed: int = 42, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs`` (doc_id, text; other columns are ignored).

    component_id is the smallest doc_id that chains of links reach, its own
    included. Null and empty texts have fingerprint 0 and link like any other;
    repeated rows stay; rows with a null doc_id keep their place but give no
    component its name (null if all are null). An empty table gives no rows. Rows
    of a hot fingerprint are dealt over several tasks.
    """
    marked = cut(fingerprint_table(docs, shingle, seed))
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = connected_components(links(distinct.select("fp"), max_bits))
    grouped = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grouped.join(names, "root").select("fp", "component_id")
    return spread_join(marked, named, ["fp"], distinct.select("fp", "n")).select("doc_id", "fp", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op1_simhash": op1_simhash}
#: 64-bit votes over XXH64 are not expressible in DuckDB SQL; tests/llm compares with brute force.
ORACLES: dict[str, str] = {}
