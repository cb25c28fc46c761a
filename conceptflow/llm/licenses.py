"""License scans by a positional index of rare tokens.

Templates (notices as word sequences, each with a mandatory key phrase; the base
phrases are templates that are all key) are indexed by word and place. The inverse document frequency of their words is
counted over the whole corpus. A template whose key words all occur in a text is
looked up by the rarest of them; each occurrence gives an alignment (template,
start), and the places of the other key words are intersected with it by
relative position, rarest first. The key phrase is then verified word by word,
and the IDF-weighted share of template words in place is the score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptflow.llm import arrow
from conceptflow.llm.textscan import alnum_words
from conceptflow.session import table


@dataclass(frozen=True)
class Template:
    label: str
    notice: str
    key: str


#: The contract's phrases and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Public licence notices, as their word sequences, with mandatory key phrases.
TEMPLATES = (
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-2.0", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("gpl", "it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license as published by"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("mit", "released under the mit license", "the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted free of charge"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    Template("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    Template("cc-by-4.0", "creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    Template("cc0-1.0", "this work is dedicated to the public domain under cc0 1 0 universal", "cc0 1 0 universal"),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    Template("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software for any purpose"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software released into the public domain"),
)


class Index:
    """Templates and phrases by word and place, with the corpus's IDF."""

    def __init__(self, idf: dict[bytes, float], templates: tuple[Template, ...] = TEMPLATES) -> None:
        self.idf, self.own = idf, len(templates)
        self.templates = templates = templates + tuple(Template(label, phrase, phrase) for phrase, label in BASE)
        self.words = [t.notice.encode().split() for t in templates]
        self.keys: list[tuple[int, list[bytes]]] = []
        for t, words in zip(templates, self.words, strict=True):
            key = t.key.encode().split()
            at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
            self.keys.append((at, key))
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        for n, (at, key) in enumerate(self.keys):
            for k, w in enumerate(key):
                self.postings.setdefault(w, []).append((n, at + k))
        self.probes = [[(w, k) for k, w in sorted(enumerate(key, at), key=lambda x: (-idf[x[1]], x))] for at, key in self.keys]

    def alignments(self, words: list[bytes], at: dict[bytes, list[int]]) -> Iterator[tuple[int, int]]:
        """(template, start) of every place where a key phrase stands."""
        for n in {n for w in at for n, _ in self.postings.get(w, ())}:
            starts: set[int] | None = None
            for w, k in self.probes[n]:
                here = at.get(w, ())
                starts = {i - k for i in here} if starts is None else starts.intersection(i - k for i in here)
                if not starts:
                    break
            place, key = self.keys[n]
            yield from ((n, i) for i in sorted(starts or ()) if words[i + place : i + place + len(key)] == key)

    def matches(self, words: list[bytes], at: dict[bytes, list[int]]) -> tuple[list[tuple[int, str]], list[tuple[str, float]]]:
        """Places of the base phrases, and (label, share) of every other verified alignment."""
        base, found = [], []
        for n, start in self.alignments(words, at):
            if n >= self.own:
                base.append((start, self.templates[n].label))
                continue
            notice = self.words[n]
            weight = sum(self.idf[w] for w in notice)
            here = sum(self.idf[w] for k, w in enumerate(notice) if 0 <= start + k < len(words) and words[start + k] == w)
            found.append((self.templates[n].label, here / weight if weight else 1.0))
        return sorted(base), found

    def scan(self, text: bytes | None) -> tuple[int, list[tuple[int, str]], list[tuple[str, float]]]:
        words = alnum_words(text)
        wanted = self.postings.keys() & set(words)
        if not wanted:
            return len(words), [], []
        at: dict[bytes, list[int]] = {}
        for i, w in enumerate(words):
            if w in wanted:
                at.setdefault(w, []).append(i)
        return len(words), *self.matches(words, at)


def vocabulary(templates: tuple[Template, ...] = TEMPLATES) -> list[bytes]:
    return sorted({w for t in templates for w in t.notice.encode().split()} | {w for p, _ in BASE for w in p.encode().split()})


def _counted(known: set[bytes]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(1).to_pylist():
                counts[b""] += 1
                counts.update(known.intersection(alnum_words(text)))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    return scan


def inverse_frequencies(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[bytes, float]:
    """IDF of the licence words over all rows of ``docs``; a row for each word and partition is all that is gathered."""
    arrow.batched(docs.sparkSession)
    words = vocabulary(templates)
    partial = arrow.id_and_text(docs).mapInArrow(arrow.steady(_counted(set(words))), "word string, n bigint")
    counts = {r["word"].encode(): r["n"] for r in partial.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    total = counts.get(b"", 0)
    return {w: math.log((total + 1) / (counts.get(w, 0) + 1)) for w in words}


def _scanned(shared):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value)
        for batch in batches:
            rows = [index.scan(text) for text in batch.column(1).to_pylist()]
            base = [sorted({label for _, label in places}) for _, places, _ in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([n for n, _, _ in rows], pa.int64()),
                    pa.array([[i for i, _ in places] for _, places, _ in rows], pa.list_(pa.int64())),
                    pa.array(base, pa.list_(pa.string())),
                    pa.array([sorted({*b, *(label for label, _ in found)}) for b, (_, _, found) in zip(base, rows, strict=True)], pa.list_(pa.string())),
                    pa.array([max((share for _, share in found), default=0.0) for _, _, found in rows], pa.float64()),
                ],
                ["doc_id", "n_words", "places", "base_labels", "labels", "score"],
            )

    return scan


def licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, places, base_labels, labels, score) for every row of ``docs`` (doc_id, text; others ignored).

    places: starts (words from 0) of the base phrases, all of them, in order;
    labels: base labels and those of verified templates; score: the best share.
    Null and empty texts have no words, places or labels and score 0; equal
    texts get equal results; an empty table gives no rows.
    """
    spark = docs.sparkSession
    arrow.batched(spark)
    shared = spark.sparkContext.broadcast(inverse_frequencies(docs))
    schema = "doc_id bigint, n_words bigint, places array<bigint>, base_labels array<string>, labels array<string>, score double"
    return arrow.id_and_text(docs).mapInArrow(arrow.steady(_scanned(shared)), schema)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.get("places", F.lit(0)).alias("first_word"),
        F.get("places", F.size("places") - 1).alias("last_word"),
        F.concat_ws(",", "base_labels").alias("base_labels"),
        F.concat_ws(",", "labels").alias("labels"),
        "score",
    )


QUERIES = {"op7_licenses": op7_licenses}
ORACLES: dict[str, str] = {}
