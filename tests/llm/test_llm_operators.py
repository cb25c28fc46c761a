"""Brute-force twins, edge cases and held-out accuracy of the operators on small fixtures."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conceptflow.llm import (
    decontaminate,
    licenses,
    neighbours,
    packing,
    quality,
    secrets,
    sharding,
    simhash,
    substrings,
    toxicity,
)

public_tokenizers = pytest.importorskip("public_tokenizers")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [None, "", " \n\t", "one", "One one ONE", "É x \x1c y", "x" * 5000]


def words(text, pattern):
    return pattern.findall(text or "")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=70))
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 200))) for _ in range(60)]
    texts += [f"{t} {passage} {rng.choice(vocabulary)}" for t in texts[:12]]
    texts += [texts[0]] * 20 + [texts[1] + " tail"] * 3 + [" ".join([texts[2].split()[0]] + texts[2].split()[2:])]
    texts += [passage + " " + passage] + ODD
    return [(i * 7 % 997, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    # An extra column with a name that the operators use inside.
    return spark.createDataFrame([(i, t, "x", i) for i, t in corpus], "doc_id bigint, text string, k string, at bigint")


def empty(docs):
    return docs.where("false")


def brute_fingerprint(text):
    w = words((text or "").translate(LOWER), SPACE)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_is_brute_force(docs, corpus):
    marks = {i: brute_fingerprint(t) for i, t in corpus}
    found = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert {i: r["fp"] & (1 << 64) - 1 for i, r in found.items()} == marks
    label = {i: i for i in marks}
    for _ in marks:
        for a in marks:
            label[a] = min(label[b] for b in marks if (marks[a] ^ marks[b]).bit_count() <= 4)
    for i in marks:
        while label[label[i]] != label[i]:
            label[i] = label[label[i]]
    assert {i: r["component_id"] for i, r in found.items()} == label
    assert simhash.near_duplicates(empty(docs)).count() == 0


def test_simhash_links_every_near_pair(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    near = [x ^ sum(1 << b for b in rng.sample(range(64), k)) for x in base for k in (1, 2, 3, 4, 5)]
    marks = sorted({*base, *near})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    found = {frozenset(r) for r in simhash.links(spark.createDataFrame([(signed(x),) for x in marks], "fp bigint")).collect()}
    wanted = {frozenset((signed(a), signed(b))) for i, a in enumerate(marks) for b in marks[:i] if (a ^ b).bit_count() <= 4}
    assert found == wanted


def brute_substrings(corpus, width):
    first = {}
    for i, t in corpus:
        w = words(t, SPACE)
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, t in corpus:
        w = words(t, SPACE)
        gone = {j for k in range(len(w) - width + 1) if first[tuple(w[k : k + width])] < i for j in range(k, k + width)}
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


@pytest.mark.parametrize("width", [50, 7, 2])
def test_substrings_are_brute_force(docs, corpus, width):
    found = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substrings.deduplicated(docs, width).collect()}
    assert found == brute_substrings(corpus, width)


def test_substrings_edges(spark, docs):
    assert substrings.deduplicated(empty(docs)).count() == 0
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(None, passage), (1, passage), (1, passage), (2, passage + " x")]
    found = Counter((r["doc_id"], r["n_removed"]) for r in substrings.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert found == {(None, 0): 1, (1, 0): 2, (2, 60): 1}


@pytest.mark.parametrize("block", [1_000_000, 30])
def test_contamination_is_brute_force(spark, docs, corpus, block):
    items = [(1, " ".join(words(corpus[3][1], SPACE)[:25])), (2, "One, one!"), (10, None), (3, ""), (4, corpus[61][1]), (5, corpus[61][1])]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    grams = {}
    for i, t in items:
        w = words((t or "").translate(LOWER), ALNUM)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            grams.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    wanted = {}
    for i, t in corpus:
        w = words((t or "").translate(LOWER), ALNUM)
        hits = [(k, g) for g in grams for k in range(len(w) - len(g) + 1) if tuple(w[k : k + len(g)]) == g]
        wanted[i] = (len(w), sorted({j for k, g in hits for j in range(k, k + len(g))}), sorted({x for _, g in hits for x in grams[g]}))
    found = {r["doc_id"]: (r["n_words"], r["hit_words"], r["items"]) for r in decontaminate.contamination(docs, bench, block_words=block).collect()}
    assert found == wanted and any(x[1] for x in wanted.values())
    assert {r["doc_id"] for r in decontaminate.clean_documents(docs, bench).collect()} == {i for i, x in wanted.items() if not x[1]}
    assert decontaminate.contamination(docs, bench.where("false")).where("size(hit_words) > 0").count() == 0


SECRETS = [
    'a token = "0123456789abcdef01234567" b', "PASSWORD: hunter2hunter2, passwd=abc secret=abcdef", "passwd: token = abcdefgh",
    "AKIA" + "Z" * 16 + " AKIASHORT", "😀 api_key='x/y+z=.-_q' 😀 deadbeefdeadbeefdeadbeef", "token=AKIA" + "1" * 20, "ghp_" + "a" * 40,
]


def base_spans(text):
    kinds = [
        (re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
        (re.compile("AKIA[A-Z0-9]+"), 0, 20),
        (re.compile("[0-9a-f]+"), 0, 24),
    ]
    return sorted((m.start(), k, m.end()) for k, (p, g, least) in enumerate(kinds) for m in p.finditer(text or "") if len(m.group(g)) >= least)


def test_secrets_are_brute_force(spark):
    texts = SECRETS + ODD + SECRETS[:1] * 5
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found, ledger = secrets.scan(rows)
    got = {r["doc_id"]: [(s["start"], s["place"], s["stop"]) for s in r["spans"] if s["place"] < 3] for r in found.collect()}
    assert got == {i: base_spans(t) for i, t in enumerate(texts)}
    assert ledger.count() == len({t or "" for t in texts})


def test_secrets_scan_only_unseen_pairs(spark):
    rows = spark.createDataFrame([(1, SECRETS[0]), (2, SECRETS[3])], "doc_id bigint, text string")
    whole = {r["doc_id"]: r["spans"] for r in secrets.scan(rows)[0].collect()}
    _, ledger = secrets.scan(rows.where("doc_id = 1"), rules=secrets.RULES[:2])
    found, added = secrets.scan(rows, ledger)
    assert {r["doc_id"]: r["spans"] for r in found.collect()} == whole
    assert sorted(len(r["rules"]) for r in added.collect()) == [len(secrets.RULES) - 2, len(secrets.RULES)]
    assert secrets.scan(rows, ledger.unionByName(added))[1].count() == 0
    assert secrets.scan(rows.where("false"))[0].count() == 0


def test_redaction(spark):
    rows = spark.createDataFrame([(0, "😀 x token=AKIA" + "1" * 20 + " y"), (1, None), (2, "clean")], "doc_id bigint, text string")
    found = secrets.scan(rows)[0].withColumn("clean", secrets.redacted(F.col("text"), F.col("spans")))
    assert {r["doc_id"]: r["clean"] for r in found.collect()} == {0: "😀 x [REDACTED] y", 1: None, 2: "clean"}


def test_licenses_are_brute_force(spark):
    texts = [
        "Licensed under the Apache License, Version 2.0.", "x MIT License mit LICENSE", "CC BY-NC 4.0", "GNU General Public", "the Apache, License",
        "This work is licensed under the GNU General Public License, version 3.", "it has a MIT licence", *ODD,
    ]
    found = {r["doc_id"]: r for r in licenses.licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    for i, text in enumerate(texts):
        w = words((text or "").translate(LOWER), ALNUM)
        places = sorted((k, label) for phrase, label in licenses.BASE for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split())
        assert (found[i]["n_words"], found[i]["places"], found[i]["base_labels"]) == (len(w), [k for k, _ in places], sorted({x for _, x in places}))
        assert 0 <= found[i]["score"] <= 1
    assert found[0]["labels"] == ["apache", "apache-2.0"] and found[2]["labels"] == ["cc-by", "cc-by-nc-4.0"] and found[3]["labels"] == []


def test_shards_are_exact_and_uniform(spark):
    rows = spark.range(0, 1003, 1, 7).withColumn("same", F.lit("x"))
    found = sharding.shuffled(rows, 16, bucket_rows=10).toPandas()
    sizes = found.groupby("shard").size()
    assert len(found) == 1003 == found.id.nunique() and sizes.max() - sizes.min() <= 1
    assert all(sorted(part) == list(range(len(part))) for _, part in found.groupby("shard").slot)
    assert abs(found.id.corr(found.shard)) < 0.1 and abs(found.id.corr(found.slot)) < 0.1
    again = sharding.shuffled(rows, 16, bucket_rows=10).toPandas()
    assert found.sort_values("id").reset_index(drop=True).equals(again.sort_values("id").reset_index(drop=True))
    assert sharding.shuffled(rows.where("false")).count() == 0
    with pytest.raises(ValueError):
        sharding.shuffled(rows.withColumn("slot", F.lit(1)))


def test_matrix_sums_and_mean():
    counts = {0: 10, 3: 30, 7: 0, 8: 23}
    sizes = sharding.shard_sizes(63, 4)
    total = np.zeros(4)
    for seed in range(300):
        matrix = sharding.communication_matrix(counts, sizes, seed)
        assert all(matrix[p].sum() == n for p, n in counts.items()) and (sum(matrix.values()) == sizes).all()
        total += matrix[3]
    assert np.abs(total / 300 - 30 * sizes / 63).max() < 0.6


def test_packing_round_trip(spark, docs, corpus):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    found = packing.pack(docs, path, capacity=64, group_rows=5).toPandas()
    for i, text in corpus:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        pieces = found[found.doc_id == i].sort_values("piece")
        assert pieces.length.tolist() == [min(64, len(ids) - k) for k in range(0, len(ids), 64)]
        assert pieces.ids_crc32.tolist() == [zlib.crc32(np.array(ids[k : k + 64], "<u4").tobytes()) for k in range(0, len(ids), 64)]
    for _, part in found.sort_values("offset").groupby("sequence_id"):
        assert part.offset.tolist() == (part.length.cumsum() - part.length).tolist() and part.length.sum() <= 64
    assert found.sequence_id.nunique() <= math.ceil(found.length.sum() / 64) + 1
    assert packing.pack(empty(docs), path).count() == 0


def test_plan_uses_all_and_nears_the_bound():
    rng = random.Random(2)
    for histogram in ({1: 5000}, {100: 1}, {60: 3, 50: 3, 40: 3, 14: 5}, Counter(rng.randrange(1, 101) for _ in range(5000))):
        made = packing.plan(dict(histogram), 100)
        used = Counter()
        for p in made:
            assert sum(p.lengths) <= 100
            used.update({x: p.times * p.lengths.count(x) for x in set(p.lengths)})
        assert used == Counter(histogram)
        assert sum(p.times for p in made) <= 1.01 * least_bins(histogram, 100) + 1


def least_bins(histogram, capacity):
    """Martello and Toth's bound: items above capacity - k stand alone, those above half can't meet, the rest fills up."""
    bounds = []
    for k in range(capacity // 2 + 1):
        alone = sum(n for x, n in histogram.items() if x > capacity - k)
        large = {x: n for x, n in histogram.items() if capacity // 2 < x <= capacity - k}
        rest = sum(x * n for x, n in histogram.items() if k <= x <= capacity // 2)
        room = sum((capacity - x) * n for x, n in large.items())
        bounds.append(alone + sum(large.values()) + max(0, math.ceil((rest - room) / capacity)))
    return max(bounds)


def test_encoder_matches_the_tokenizer():
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, encoder = Tokenizer.from_file(path), packing.Encoder(path)
    texts = [t or "" for t in ODD] + ["don't I'LL!'s", "<|endoftext|> a<|startoftext|>b", "ΣΑΣ İx é é", "日本語 123 4a\x0b5\x0c6", "a b", "ſ ǅ ß ŉ"]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.ids([t.encode() for t in texts])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_neighbours_are_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((900, 12))
    x[300:600] = x[300]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(2000, None), (2100, [0.0] * 12), (2200, [None] + [1.0] * 11), (2300, [float("nan")] * 12), (2400, [1.0]), (None, [1.0] * 12)]
    found = neighbours.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 100 == 0).toPandas()
    assert sorted(found.query_id.unique()) == list(range(0, 900, 100))
    for q, part in found.groupby("query_id"):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        assert part.sort_values("rank").vec_id.tolist() == np.lexsort((np.arange(900), d))[:10].tolist()
    few = neighbours.search(spark.createDataFrame(rows[:4], "vec_id bigint, embedding array<double>"), F.col("vec_id") == 0)
    assert few.count() == 3
    assert neighbours.search(spark.createDataFrame([], "vec_id bigint, embedding array<double>"), F.col("vec_id") == 0).count() == 0


def test_hilbert_neighbours_are_adjacent():
    grid = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    walk = grid[np.argsort(neighbours.hilbert(grid, 3))]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_ordinal_regression_learns_grades():
    rng = random.Random(4)
    marks = [["bad", "junk"], ["plain", "usual"], ["fine", "good"], ["great", "best"]]
    text = lambda g: " ".join(rng.choice(marks[g]) if rng.random() < 0.4 else rng.choice("abcdefgh") for _ in range(40)).encode()
    sample = [(i, text(i % 4), i % 4) for i in range(400)]
    model = quality.fit(sample)
    assert (np.diff(model.thresholds) >= 0).all()
    held = [(text(g), g) for g in range(4) for _ in range(50)]
    guesses = [float(quality.tails(model, t).sum()) for t, _ in held]
    assert np.mean([round(e) == g for e, (_, g) in zip(guesses, held, strict=True)]) > 0.9
    assert all((np.diff(quality.tails(model, t)) <= 1e-12).all() for t, _ in held)
    assert quality.tails(quality.fit([]), b"x").tolist() == []


def test_quality_on_data_and_odd_rows(spark, docs):
    d = "/root/testdata/sf0.01"
    model = quality.fitted(spark, d)
    rated = quality.ratings(spark.read.parquet(f"{d}/documents.parquet"), model).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    assert ((rated.tail_probability >= 0.5) == (rated.quality == 1)).mean() > 0.95
    assert quality.ratings(docs, model).count() == docs.count() and quality.accepted(docs, model).columns == docs.columns
    assert quality.ratings(empty(docs), model).count() == 0


def test_toxicity_on_held_out_rows(spark, docs):
    d = "/root/testdata/sf0.1"
    found = toxicity.op5_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    hit = found.predicted == 1
    assert (found.toxic[hit] == 1).mean() > 0.75 and (hit[found.toxic == 1]).mean() > 0.55
    model = toxicity.fit([(i, b"you idiot loser %d" % i, 1) if i % 3 == 0 else (i, b"plain words %d here" % i, 0) for i in range(300)])
    scored = {r["doc_id"]: r["score"] for r in toxicity.scores(docs, model).collect()}
    assert len(scored) == docs.count() and all(0 <= s < 0.3 for s in scored.values())
    assert toxicity.scores(empty(docs), model).count() == 0


def test_toxicity_with_one_label(docs):
    model = toxicity.fit([(1, b"a", 0), (2, b"b", 0)])
    assert {round(r["score"], 6) for r in toxicity.scores(docs, model).collect()} == {0.25}


def test_digests():
    assert substrings.digest([b"a", b"b"]) == hashlib.sha256(b"a b").hexdigest()
    assert decontaminate.digest(["10", "2"]) == hashlib.sha256(b"10,2").hexdigest()


def labelled_folder(spark, folder, rows):
    """``rows``: (text, quality, toxic)."""
    spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(rows)], "doc_id bigint, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, q, x) for i, (_, q, x) in enumerate(rows)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_capped_samples_keep_the_share_of_labels(spark, tmp_path, monkeypatch):
    # Texts say nothing, so a score is the share of its label in the whole table.
    d = labelled_folder(spark, tmp_path, [("same words %s" % "abc"[i % 3], int(i % 10 != 0), int(i % 10 == 0)) for i in range(1000)])
    monkeypatch.setattr(quality, "SAMPLE_ROWS", 80)
    monkeypatch.setattr(toxicity, "SAMPLE_ROWS", 60)
    assert all(r["tail_probability"] > 0.8 for r in quality.op3_quality(spark, d).collect())
    assert all(0.05 < r["score"] < 0.15 for r in toxicity.op5_toxicity(spark, d).collect())


def test_fits_read_whole_texts(spark, tmp_path):
    # Labels show in the last words alone, behind more than 8192 bytes.
    plain = "some usual words stand here " * 400
    d = labelled_folder(spark, tmp_path, [(plain + ("vilest insults " if i % 4 == 0 else "kinder thoughts ") * 200 + str(i), int(i % 4 != 0), int(i % 4 == 0)) for i in range(240)])
    assert all(r["keep"] == (r["doc_id"] % 4 != 0) for r in quality.op3_quality(spark, d).collect())
    assert all(r["predicted"] == (r["doc_id"] % 4 == 0) for r in toxicity.op5_toxicity(spark, d).collect())


def test_licenses_of_a_text_with_every_notice(spark):
    notices = " ".join(t.notice for t in licenses.TEMPLATES)
    docs = spark.createDataFrame([(1, notices), *((i, "usual words") for i in range(2, 9))], "doc_id bigint, text string")
    found = {r["doc_id"]: r for r in licenses.licenses(docs).collect()}
    assert set(found[1]["labels"]) == {t.label for t in licenses.TEMPLATES} | {label for _, label in licenses.BASE} and found[1]["score"] == pytest.approx(1)
    assert found[2]["labels"] == []
