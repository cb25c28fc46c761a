"""Best-fit packing of token sequences by bin completion.

Pieces are at most ``capacity`` tokens long, so a corpus of any size is a
histogram of at most ``capacity`` lengths. The plan is made from it alone.

First best-fit completions: for the largest length left, branch and bound
enumerates fillings of the rest of a sequence, prunes by the waste bound, and
applies the winner as often as the counts allow. Every application uses a length
up, so this work does not depend on the number of pieces. If the plan needs no
more sequences than a lower bound, it is optimal.

Otherwise it is the incumbent of a branch and bound over sequences: around the
largest piece left, all undominated fillings are tried, least waste first, and a
branch ends where its sequences and the lower bound of what is left can't beat
the incumbent. ``nodes`` bounds that search and, with it, the part of the plan
that is searched again (its ``TAIL`` worst filled sequences); with None there is
no bound, the whole plan is searched, and the result is optimal.

Pieces then find their sequences by their rank in their length, in a table whose
size is bounded by the capacity.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from conceptflow.llm import arrow
from conceptflow.session import cut, table

CAPACITY = 4096
#: Nodes of the search over sequences, and sequences that a bounded search packs again.
NODES, TAIL = 20_000, 40
#: Cached words of a worker (about 200 bytes each); at the bound the cache starts anew.
CACHE = 1_000_000
#: Texts for which normalising is lower-casing alone: printable ASCII, precomposed Latin letters, blanks.
_PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ž \t\n\r\x0b\x0c]*")
#: Fixed value: the tokenizer's own word pattern, over these characters.
_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-įı-ž]+|[0-9]|[^a-zß-öø-įı-ž0-9 \t\n\r\x0b\x0c]+")


class Encoder:
    """Token ids, as little-endian bytes, of texts; each distinct word is encoded once.

    A plain text is lower-cased and cut by the tokenizer's own word pattern. The
    tokenizer's words never cross ASCII white space, so any other text is cut
    there, and its parts that aren't plain are encoded as they are.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[n for token, n in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def _cut(self, text: str) -> list[str]:
        if "<|" not in text and _PLAIN.fullmatch(text):
            return _WORD.findall(text.lower())
        found = []
        for part in text.encode().split():
            word = part.decode()
            found += _WORD.findall(word.lower()) if "<|" not in word and _PLAIN.fullmatch(word) else [word]
        return found

    def _learn(self, fresh: list[str]) -> None:
        plain = [w for w in fresh if "<|" not in w and _PLAIN.fullmatch(w)]
        for i in range(0, len(plain), 5000):
            some = plain[i : i + 5000]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            stops = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            if len(stops) == len(some):
                code, at = ids.tobytes(), 0
                for word, stop in zip(some, stops.tolist(), strict=True):
                    self.known[word], at = code[at:stop], stop
        rest = [w for w in fresh if w not in self.known]
        for word, code in zip(rest, self.tokenizer.encode_batch(rest, add_special_tokens=False), strict=True):
            self.known[word] = np.array(code.ids, "<u4").tobytes()

    def ids(self, texts: list[bytes]) -> list[bytes]:
        cut = [self._cut(text.decode()) for text in texts]
        wanted = set().union(*cut)
        fresh = list(wanted.difference(self.known))
        if len(self.known) + len(fresh) > CACHE:
            self.known.clear()
            fresh = list(wanted)
        self._learn(fresh)
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in cut]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _pieces(path: str, end_id: int, capacity: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = encoder(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            columns: tuple[list, ...] = ([], [], [], [], [])
            texts = [x or b"" for x in batch.column(1).to_pylist()]
            for row, ids in enumerate(own.ids(texts)):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    piece = ids[at : at + 4 * capacity]
                    for column, x in zip(columns, (row, k, at // 4, len(piece) // 4, zlib.crc32(piece)), strict=True):
                        column.append(x)
            rows, *rest = columns
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(x, kind) for x, kind in zip(rest, kinds, strict=True)]],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return scan


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and ``end_id``, cut at ``capacity``."""
    arrow.batched(docs.sparkSession)
    return arrow.id_and_text(docs).mapInArrow(arrow.steady(_pieces(tokenizer, end_id, capacity)), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


@dataclass(frozen=True)
class Pattern:
    """A filling (lengths, largest first) and the number of sequences that use it."""

    lengths: tuple[int, ...]
    times: int


def completion(room: int, lengths: list[int], counts: dict[int, int], budget: int = 500) -> list[tuple[int, int]]:
    """(length, how many) of an undominated filling of ``room`` with the least waste.

    ``lengths`` ascends; ``counts`` says how many pieces of each are left. Branch
    and bound over (length, number) with the largest length that fits first, as
    best fit does: its filling is the first incumbent. A branch ends when
    nothing fits any more, and is pruned when all pieces it may still use can't
    bring its waste below the incumbent's. ``budget`` bounds the nodes; beyond
    it the incumbent, a valid filling at any time, is returned.
    """
    supply = np.cumsum([x * counts[x] for x in lengths]).tolist()
    waste, best, nodes = room + 1, [], 0

    def extend(left: int, top: int, chosen: list[tuple[int, int]]) -> None:
        nonlocal waste, best, nodes
        nodes += 1
        top = min(top, bisect_right(lengths, left) - 1)
        if top < 0:
            if left < waste:
                waste, best = left, chosen
            return
        for at in range(top, -1, -1):
            if left - supply[at] >= waste:
                return
            x = lengths[at]
            for n in range(min(counts[x], left // x), 0, -1):
                extend(left - n * x, at - 1, [*chosen, (x, n)])
                if not waste or nodes >= budget:
                    return

    extend(room, len(lengths) - 1, [])
    return best


def least_sequences(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's lower bound: pieces above capacity - k stand alone, those above half never meet, the rest fills up."""
    lengths = sorted(counts)
    best = -(-sum(x * n for x, n in counts.items()) // capacity)
    for k in [0, *[x for x in lengths if 2 * x <= capacity]]:
        alone = sum(counts[x] for x in lengths if x > capacity - k)
        large = [(x, counts[x]) for x in lengths if 2 * x > capacity and x <= capacity - k]
        room = sum((capacity - x) * n for x, n in large)
        rest = sum(x * counts[x] for x in lengths if x >= k and 2 * x <= capacity)
        best = max(best, alone + sum(n for _, n in large) + max(0, -(-(rest - room) // capacity)))
    return best


def dominated(filling: list[int], room: int, counts: dict[int, int]) -> bool:
    """Whether one more piece of ``counts`` could stand for some of ``filling``, or for none, and leave no more waste.

    Then the filling with that piece does what this one does, as its pieces fit
    wherever the exchanged one would stand. ``counts`` is what the filling leaves.
    """
    waste, sums = room - sum(filling), {0: 0}
    for x in filling:
        for total, n in list(sums.items()):
            sums[total + x] = max(sums.get(total + x, 0), n + 1)
    return any(total < x <= total + waste or (total == x and sums[total] > 1) for x, n in counts.items() if n for total in sums)


def fillings(room: int, counts: dict[int, int]) -> Iterator[tuple[int, ...]]:
    """Undominated sets of pieces of ``counts`` within ``room``, lengths descending; the empty one if nothing fits."""
    lengths = sorted((x for x, n in counts.items() if n and x <= room), reverse=True)

    def extend(left: int, at: int, chosen: list[int]) -> Iterator[tuple[int, ...]]:
        while at < len(lengths) and lengths[at] > left:
            at += 1
        if at == len(lengths):
            rest = dict(counts)
            for x in chosen:
                rest[x] -= 1
            if not dominated(chosen, room, rest):
                yield tuple(chosen)
            return
        x = lengths[at]
        for n in range(min(counts[x], left // x), -1, -1):
            yield from extend(left - n * x, at + 1, chosen + [x] * n)

    return extend(room, 0, [])


def searched(counts: dict[int, int], capacity: int, incumbent: int, nodes: int | None) -> list[tuple[int, ...]] | None:
    """Fewer than ``incumbent`` sequences for all pieces of ``counts``, or None if there are none or the nodes run out."""
    best: list[tuple[int, ...]] | None = None
    spent, bound = 0, least_sequences(counts, capacity)
    stack: list[tuple[dict[int, int], list[tuple[int, ...]]]] = [({x: n for x, n in counts.items() if n}, [])]
    while stack and incumbent > bound and (nodes is None or spent < nodes):
        left, made = stack.pop()
        spent += 1
        if not left:
            if len(made) < incumbent:
                best, incumbent = made, len(made)
            continue
        if len(made) + least_sequences(left, capacity) >= incumbent:
            continue
        first = max(left)
        rest = left | {first: left[first] - 1}
        found = []
        for filling in fillings(capacity - first, rest):
            found.append(filling)
            spent += 1
            if nodes is not None and spent >= nodes:
                break
        # The stack's end is tried first: least waste, then few large pieces.
        for filling in sorted(found, key=lambda f: (sum(f), -len(f))):
            after = dict(rest)
            for x in filling:
                after[x] -= 1
            stack.append(({x: n for x, n in after.items() if n}, [*made, (first, *filling)]))
    return best


def plan(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int | None = NODES, budget: int = 500) -> list[Pattern]:
    """Patterns that use every length of the histogram exactly as often as it counts; with ``nodes`` None as few sequences as there can be."""
    made = completed(histogram, capacity, budget)
    if sum(p.times for p in made) <= least_sequences({x: n for x, n in histogram.items() if n > 0}, capacity):
        return made
    made.sort(key=lambda p: -sum(p.lengths))
    tail, size = [], 0
    while made and (nodes is None or size < TAIL):
        last = made.pop()
        times = last.times if nodes is None else min(last.times, TAIL - size)
        if times < last.times:
            made.append(Pattern(last.lengths, last.times - times))
        tail.append(Pattern(last.lengths, times))
        size += times
    pieces: dict[int, int] = {}
    for p in tail:
        for x in p.lengths:
            pieces[x] = pieces.get(x, 0) + p.times
    better = searched(pieces, capacity, size, nodes)
    return made + (tail if better is None else [Pattern(filling, 1) for filling in better])


def completed(histogram: dict[int, int], capacity: int, budget: int) -> list[Pattern]:
    """Best-fit completions, the largest length first."""
    counts = {x: n for x, n in histogram.items() if n > 0}
    lengths = sorted(counts)
    made: list[Pattern] = []
    while lengths:
        first = lengths[-1]
        counts[first] -= 1
        open_to = lengths[: bisect_right(lengths, capacity - first)]
        need = dict(completion(capacity - first, [x for x in open_to if counts[x]], counts))
        counts[first] += 1
        need[first] = need.get(first, 0) + 1
        times = min(counts[x] // n for x, n in need.items())
        for x, n in need.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x], lengths[bisect_right(lengths, x) - 1]
        made.append(Pattern(tuple(x for x, n in sorted(need.items(), reverse=True) for _ in range(n)), times))
    return made


def _tables(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: from which rank on an interval holds, its first sequence, and its offset in them."""
    by: dict[int, list[list[int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for p in patterns:
        offset = 0
        for x in p.lengths:
            first = taken.get(x, 0)
            by.setdefault(x, []).append([first, sequence, offset])
            taken[x] = first + p.times
            offset += x
        sequence += p.times
    return {x: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for x, rows in by.items()}


def _placed(shared):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        for batch in batches:
            lengths, ranks = (batch.column(k).to_numpy() for k in (3, 5))
            sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
            for x in np.unique(lengths):
                own = np.flatnonzero(lengths == x)
                first, sequences, offsets = tables[int(x)]
                at = np.searchsorted(first, ranks[own], "right") - 1
                sequence[own], offset[own] = sequences[at] + ranks[own] - first[at], offsets[at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return scan


def ranked(pieces: DataFrame, groups: int) -> DataFrame:
    """``pieces`` with ``rank``, gapless from 0 in each length; ``groups`` spreads a hot length over tasks."""
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    return salted.withColumn("place", F.row_number().over(within) - 1).join(sizes, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("place"))


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, group_rows: int = 200_000, nodes: int | None = NODES) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row for every piece of ``docs`` (doc_id, text).

    Null and empty texts are the end id alone; texts longer than ``capacity``
    are cut; equal documents are packed one by one; other columns are ignored;
    an empty table gives no rows. Sequence numbers are 0, 1, ... without gaps.
    ``group_rows`` bounds the pieces of one length in one task; ``nodes`` is the
    plan's (None: as few sequences as there can be, at any cost).
    """
    spark = docs.sparkSession
    pieces = cut(token_pieces(docs, tokenizer, end_id, capacity))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(_tables(plan(histogram, capacity, nodes)))
    groups = 1 + max(histogram.values(), default=0) // group_rows
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "rank"]
    return ranked(pieces, groups).select(columns).mapInArrow(
        _placed(shared), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op9_packing": op9_packing}
#: Tokenizing is not expressible in DuckDB SQL; tests/llm checks the round trip and the bound.
ORACLES: dict[str, str] = {}
