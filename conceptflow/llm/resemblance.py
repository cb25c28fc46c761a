"""Near copies by SimHash and the Jaccard similarity of shingle sets: fingerprints and MinHash bands find candidates, whole texts decide.

Candidates are, first, texts whose SimHash fingerprints differ in at most four
bits, by ``simhash.links``. Most pairs at 0.8 differ in more bits, so MinHash
bands find what is beyond that radius. A pair at similarity s shares a band of ``ROWS`` minima with probability
s ** ROWS, so with ``BANDS`` bands a pair at 0.8 is missed about once in 16,000
times. Every link is verified on the shingles themselves. Texts with the same
words are one node, so exact copies cost nothing.

Only components are wanted, so not every pair needs a test. First each
fingerprint is tested against the smallest one near it, and each bucket (of a
band, or of one fingerprint) is one chain in pseudo-random order. Of what is still in several
components, every remaining pair is tested, but for those of two nodes that
are in one component already; a pair of a bucket is met in the first band it shares. Before
texts are fetched for a pair of a bucket, an exact bound decides: each shingle sets one of 1,024
bits, and a bit that one text has and the other hasn't is a shingle that they
don't share. A pair whose bits rule out the similarity never leaves the join.

The many steps leave plans, broadcasts and map outputs on the driver. Each is
released when it is done, so that the driver's heap doesn't grow with their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from conceptflow.llm import arrow, simhash
from conceptflow.llm.skew import spread_join
from conceptflow.llm.textscan import ascii_lower, shingle_bytes, space_words, word_hashes
from conceptflow.operators.components import connected_components
from conceptflow.session import cut, discard, release, shelve

#: Least similarity of a link.
LEAST = 0.8
BANDS, ROWS = 32, 6
#: Shingles whose hashes are permuted at once.
BLOCK = 4096
#: Longs of a node's bits.
LONGS = 16
_FACTORS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes | None, shingle: int = 5) -> set[bytes]:
    return set(shingle_bytes(space_words(ascii_lower(text or b"")), shingle))


def node(text: bytes | None) -> int:
    """A signed 64-bit mark of the text's words."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(b" ".join(space_words(ascii_lower(text or b""))))).astype(np.int64))


def bands(found: set[bytes]) -> np.ndarray:
    """A signed 64-bit key for each band; none for a text without words."""
    if not found:
        return np.empty(0, np.int64)
    hashes, least = word_hashes(list(found)), np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), BLOCK):
        least = np.minimum(least, (hashes[None, i : i + BLOCK] * _FACTORS[:, None]).min(1))
    keys = [xxhash.xxh3_64_intdigest(part.tobytes(), k) for k, part in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64)


def bits(found: set[bytes]) -> np.ndarray:
    """A bit for each shingle, as signed 64-bit numbers."""
    out = np.zeros(64 * LONGS, np.uint8)
    if found:
        out[word_hashes(list(found), 7) % np.uint64(64 * LONGS)] = 1
    return np.packbits(out).view(">i8").astype(np.int64)


def similarity(a: set[bytes], b: set[bytes]) -> float:
    """Jaccard; two empty sets are equal."""
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def _marked(shingle: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sets = [shingles(t, shingle) for t in texts]
            prints = simhash.fingerprints(texts, shingle)
            # Texts of one fingerprint share a bucket, like those that share a band.
            same = np.array([xxhash.xxh3_64_intdigest(p.tobytes(), BANDS) for p in prints], np.uint64).view(np.int64).tolist()
            keys = [[*bands(x).tolist(), k] if x else [] for x, k in zip(sets, same, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([node(t) for t in texts], pa.int64()), pa.array(keys, pa.list_(pa.int64())),
                 pa.array(list(map(len, sets)), pa.int32()), pa.array([bits(x).tolist() for x in sets], pa.list_(pa.int64())), pa.array(prints.view(np.int64))],
                ["doc_id", "text_hash", "node", "bands", "size", "bits", "fp"],
            )

    return scan


def _noded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([node(t) for t in batch.column(1).to_pylist()], pa.int64()), batch.column(1)], ["node", "text"])


def _verified(shingle: int, least: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(k).to_pylist() for k in range(4))
            kept = [similarity(shingles(s, shingle), shingles(t, shingle)) >= least for s, t in zip(x, y, strict=True)]
            at = [k for k, good in enumerate(kept) if good]
            yield pa.RecordBatch.from_arrays([pa.array([v[k] for k in at], pa.int64()) for v in (a, b)], ["a", "b"])

    return scan


def _links(pairs: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are similar."""
    x, y = (texts.select(F.col("node").alias(k), F.col("text").alias(t)) for k, t in (("a", "x"), ("b", "y")))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
    return cut(both.mapInArrow(arrow.steady(_verified(shingle, least)), "a bigint, b bigint"))


def _rest_near(near: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b): pairs whose fingerprints are linked in ``near`` and that are in different components."""
    rooted = cut(nodes.select("fp", "node").join(roots, "node", "left").select("fp", "node", F.coalesce("root", "node").alias("root")))
    x, y = (rooted.select(F.col("fp").alias(f"f{k}"), F.col("node").alias(k), F.col("root").alias(f"r{k}")) for k in ("a", "b"))
    pairs = near.join(x, "fa").join(y, "fb").where("ra <> rb")
    return cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def _rest(met: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """(a, b): pairs that share a bucket, are in different components and aren't ruled out by their bits. One of each is outside its bucket's largest component."""
    rooted = met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = rooted.groupBy("key", "root").agg(F.count("*").alias("n"))
    main = sizes.groupBy("key").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.count("*").alias("parts")).where("parts > 1")
    split = shelve(rooted.join(main, "key").select("key", "place", "node", "bands", "size", "bits", "root", (F.col("root") == F.col("main")).alias("most")))
    few = split.where("not most").select("key", "place", F.col("node").alias("a"), F.col("bands").alias("ka"), F.col("root").alias("ra"), F.col("size").alias("na"), F.col("bits").alias("xa"))
    every = split.select("key", F.col("node").alias("b"), F.col("bands").alias("kb"), F.col("root").alias("rb"), F.col("size").alias("nb"), F.col("bits").alias("xb"), "most")
    first = "array_position(zip_with(ka, kb, (x, y) -> x = y), true) = place + 1"
    alone = lambda x, y: " + ".join(f"bit_count({x}[{k}] & ~{y}[{k}])" for k in range(LONGS))
    # At most ``common`` shingles are shared; a little slack keeps rounding from ruling out a pair at the edge.
    common = f"least(na - ({alone('xa', 'xb')}), nb - ({alone('xb', 'xa')}))"
    possible = f"{1 + least} * {common} >= {least} * (na + nb) - 1e-6"
    pairs = few.join(every, "key").where(f"ra <> rb and (most or a < b) and {possible} and {first}")
    found = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    discard(split)
    return found


@contextmanager
def unconstrained(spark: SparkSession) -> Iterator[None]:
    """Plans without inferred constraints: a checkpoint hands them on, so that they multiply on the driver with every round. Results are the same."""
    name = "spark.sql.constraintPropagation.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def near_copies(docs: DataFrame, shingle: int = 5, least: float = LEAST) -> DataFrame:
    """(doc_id, text_hash, root, component_id) for every row of ``docs`` (doc_id, text; other columns are ignored).

    component_id is the smallest doc_id that chains of links reach, its own
    included; root is the component's own mark, whatever the ids; text_hash
    (xxhash64 of the text) tells rows of one doc_id apart. Null and empty texts are copies of each other; repeated rows stay;
    rows with a null doc_id link like others but give no component its name
    (null if all are null). An empty table gives no rows.
    """
    with unconstrained(docs.sparkSession):
        return _near_copies(docs, shingle, least)


def _near_copies(docs: DataFrame, shingle: int, least: float) -> DataFrame:
    arrow.batched(docs.sparkSession)
    own = arrow.id_and_text(docs)
    hashed = own.withColumn("text_hash", F.xxhash64("text"))
    marked = shelve(hashed.mapInArrow(arrow.steady(_marked(shingle)), "doc_id bigint, text_hash bigint, node bigint, bands array<bigint>, size int, bits array<bigint>, fp bigint"))
    nodes = cut(marked.groupBy("node").agg(F.min("doc_id").alias("name"), F.first("bands").alias("bands"), F.first("size").alias("size"), F.first("bits").alias("bits"), F.first("fp").alias("fp"), F.count("*").alias("n")))
    keyed = nodes.select("node", F.posexplode("bands").alias("place", "key"))
    release(docs.sparkSession)
    shared = keyed.groupBy("key").count().where("count > 1").select("key")
    met = shelve(keyed.join(shared, "key").join(nodes.select("node", "bands", "size", "bits"), "node"))
    prints = nodes.groupBy("fp").agg(F.min("node").alias("node"))
    linked = simhash.links(nodes.select("fp").distinct())
    near = cut(linked.select(F.least("a", "b").alias("fa"), F.greatest("a", "b").alias("fb")).distinct())
    release(docs.sparkSession)
    both = near.unionByName(near.select(F.col("fb").alias("fa"), F.col("fa").alias("fb")))
    close = nodes.join(both.select(F.col("fa").alias("fp")).distinct(), "fp", "left_semi")
    busy = shelve(met.select("node").unionByName(close.select("node")).distinct())
    texts = shelve(own.mapInArrow(arrow.steady(_noded), "node bigint, text binary").dropDuplicates(["node"]).join(busy, "node", "left_semi"))
    release(docs.sparkSession)
    order = Window.partitionBy("key").orderBy(F.xxhash64("key", "node"), "node")
    x, y = (prints.select(F.col("fp").alias(f), F.col("node").alias(n)) for f, n in (("fa", "node"), ("fb", "before")))
    nearest = both.groupBy("fa").agg(F.min("fb").alias("fb")).join(x, "fa").join(y, "fb").select("node", "before")
    chained = met.select("node", F.lag("node").over(order).alias("before")).where("before is not null").unionByName(nearest)
    pairs = cut(chained.select(F.least("node", "before").alias("a"), F.greatest("node", "before").alias("b")).distinct())
    links = _links(pairs, texts, shingle, least)
    release(docs.sparkSession)
    first = connected_components(links)
    release(docs.sparkSession)
    rest = _rest(met, first, least).unionByName(_rest_near(near, close, first)).distinct().join(pairs, ["a", "b"], "left_anti")
    release(docs.sparkSession)
    more = _links(rest, texts, shingle, least)
    release(docs.sparkSession)
    roots = connected_components(links.unionByName(more))
    discard(met, busy, texts)
    release(docs.sparkSession)
    grouped = nodes.select("node", "name").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = grouped.groupBy("root").agg(F.min("name").alias("component_id"))
    named = grouped.join(names, "root").select("node", "root", "component_id")
    return spread_join(marked.select("doc_id", "text_hash", "node"), named, ["node"], nodes.select("node", "n")).select("doc_id", "text_hash", "root", "component_id")
