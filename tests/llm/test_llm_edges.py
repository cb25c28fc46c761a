"""Hot keys, repeated and null ids, clashing columns, very long texts, exact draws and plans, recall of the curves."""

import random
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from conceptflow.llm import decontaminate, licenses, neighbours, packing, resemblance, secrets, sharding, simhash, skew, substrings, toxicity

ROWS = "doc_id bigint, text string"


def test_contamination_keeps_rows_of_one_id_apart(spark):
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(None, " ".join(words[:12])), (None, "x"), (1, " ".join(words[20:35])), (1, " ".join(words[:12])), (2, None), (3, "")], ROWS)
    bench = spark.createDataFrame([(i, " ".join(words[i : i + 11])) for i in range(0, 30, 5)], "item_id bigint, text string")
    one, many = (decontaminate.contamination(docs, bench, block_words=b).collect() for b in (10**6, 11))
    assert Counter(map(repr, one)) == Counter(map(repr, many)) and len(many) == 6
    assert sorted(len(r["hit_words"]) for r in many) == [0, 0, 0, 11, 11, 15]


@pytest.mark.parametrize(("good", "bad", "draws"), [(3 * 10**9, 7 * 10**9, 10**6), (10**12, 3 * 10**13, 10**8)])
def test_large_draws_are_hypergeometric(good, bad, draws):
    rng = np.random.default_rng(5)
    found = np.array([sharding._hypergeometric(rng, good, bad, draws) for _ in range(400)])
    share = good / (good + bad)
    spread = (draws * share * (1 - share) * (1 - draws / (good + bad))) ** 0.5
    assert abs(found.mean() - draws * share) < 5 * spread / 20 and 0.85 < found.std() / spread < 1.15


def test_large_draws_at_the_ends():
    rng = np.random.default_rng(5)
    assert sharding._hypergeometric(rng, 2 * 10**9, 5, 2 * 10**9 + 5) == 2 * 10**9
    assert sharding._hypergeometric(rng, 0, 2 * 10**9, 10) == 0
    assert 2 * 10**9 - 5 <= sharding._hypergeometric(rng, 2 * 10**9, 5, 2 * 10**9) <= 2 * 10**9


def optimum(pieces, capacity):
    best = len(pieces)

    def place(rest, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if not rest:
            best = len(bins)
            return
        for room in sorted({b for b in bins if b + rest[0] <= capacity}):
            at = bins.index(room)
            place(rest[1:], [*bins[:at], room + rest[0], *bins[at + 1 :]])
        place(rest[1:], [*bins, rest[0]])

    place(sorted(pieces, reverse=True), [])
    return best


def test_plans_of_small_instances_are_optimal():
    rng = random.Random(11)
    cases = [[39, 54, 30, 41, 40, 17, 11, 29, 34]] + [[rng.randrange(5, 70) for _ in range(rng.randrange(5, 10))] for _ in range(300)]
    for case, nodes in product(cases, (None, 2000)):
        made = packing.plan(Counter(case), 100, nodes)
        assert Counter(x for p in made for x in p.lengths for _ in range(p.times)) == Counter(case)
        assert sum(p.times for p in made) == optimum(case, 100)


def test_dominated_fillings():
    assert packing.dominated([30, 20], 100, {50: 1}) and packing.dominated([30], 40, {35: 1}) and not packing.dominated([60, 40], 100, {30: 2, 10: 1})
    assert set(packing.fillings(10, {6: 1, 5: 2, 4: 1})) == {(6, 4), (5, 5)}


def test_secrets_with_clashing_columns_and_a_hot_blob(spark):
    rows = [(i, "token = abcdefgh" if i % 2 else "", "mine", 7) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, blob string, spans int")
    found, ledger = secrets.scan(docs)
    assert found.columns == ["doc_id", "text", "blob", "spans", "blob_", "spans_"] and ledger.count() == 2
    got = found.groupBy("blob", "spans", F.size("spans_").alias("n")).count().collect()
    assert sorted((r["blob"], r["spans"], r["n"], r["count"]) for r in got) == [("mine", 7, 0, 1500), ("mine", 7, 1, 1500)]


def test_spread_join_is_a_join(spark):
    left = spark.range(6000).selectExpr("if(id % 3 < 2, 0, id) as k", "id as x", "'c' as salt")
    right = left.select("k").distinct().withColumn("y", F.col("k") + 1)
    sizes = left.groupBy("k").agg(F.count("*").alias("n"))
    out = skew.spread_join(left, right.where("k % 2 = 0"), ["k"], sizes, "left")
    assert sorted(out.columns) == ["k", "salt", "x", "y"] and out.count() == 6000 == out.select("x").distinct().count()
    assert out.where("k % 2 = 0 and (y is null or y <> k + 1) or k % 2 = 1 and y is not null").count() == 0


def test_one_long_text_has_the_fingerprint_of_all_its_shingles():
    rng = random.Random(3)
    text = " ".join(f"w{rng.randrange(50)}" for _ in range(5000)).encode()
    whole = simhash.fingerprints([b"a b", text, None, b"c"])
    assert (simhash.fingerprints([b"a b", text, None, b"c"], block=256) == whole).all()


def test_hot_fingerprints_and_texts(spark):
    texts = ["same words in every copy of this one text here"] * 2500 + [None] * 1500 + ["other words stand alone in this text once"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], ROWS)
    found = simhash.near_duplicates(docs).groupBy("component_id").count().collect()
    assert sorted((r["component_id"], r["count"]) for r in found) == [(0, 2500), (2500, 1500), (4000, 1)]
    near = resemblance.near_copies(docs).groupBy("component_id").count().collect()
    assert sorted((r["component_id"], r["count"]) for r in near) == [(0, 2500), (2500, 1500), (4000, 1)]


def test_a_passage_in_very_many_documents(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    docs = spark.createDataFrame([(i, f"{passage} a{i} b{i}") for i in range(2500)], ROWS)
    found = substrings.deduplicated(docs).groupBy("n_removed").count().collect()
    assert sorted((r["n_removed"], r["count"]) for r in found) == [(0, 1), (55, 2499)]


def test_licenses_by_brute_force_over_templates(spark):
    rng = random.Random(9)
    parts = [t.notice for t in licenses.TEMPLATES] + [t.key for t in licenses.TEMPLATES] + [p for p, _ in licenses.BASE] + ["the mit", "license the apache", "usual words here"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    found = {r["doc_id"]: r for r in licenses.licenses(spark.createDataFrame(list(enumerate(texts)), ROWS)).collect()}
    stands = lambda phrase, text: f" {phrase} " in f" {text} "
    for i, text in enumerate(texts):
        base = {label for phrase, label in licenses.BASE if stands(phrase, text)}
        assert set(found[i]["base_labels"]) == base
        assert set(found[i]["labels"]) == base | {t.label for t in licenses.TEMPLATES if stands(t.key, text)}


def test_curves_alone_find_their_share(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((40, 16)) * 4
    clustered = centres[rng.integers(0, 40, 4000)] + rng.standard_normal((4000, 16)) * 0.5
    for x in (clustered, rng.standard_normal((4000, 16))):
        rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
        found = neighbours.search(rows, F.col("vec_id") % 50 == 0).toPandas().groupby("query_id").vec_id.apply(set)
        hits = 0
        for q, own in found.items():
            d = ((x - x[q]) ** 2).sum(1)
            d[q] = np.inf
            hits += len(own & set(np.argsort(d)[:10].tolist()))
        assert len(found) == 80 and hits / 800 >= 0.9


def test_rows_that_share_an_id_are_rows_of_their_own(spark):
    rows = spark.createDataFrame([(100, [1.0, 0.0]), (5, [1.0, 0.5]), (5, [1.0, 0.25]), (100, [0.0, 1.0])], "vec_id bigint, embedding array<double>")
    found = neighbours.search(rows, F.col("vec_id") % 100 == 0, exact=True).collect()
    assert Counter(r["vec_id"] for r in found) == {5: 4, 100: 2}
    assert neighbours.search(rows, F.col("vec_id") == 7).count() == 0


def test_dictionaries_learn_from_text():
    rng = random.Random(2)
    plain = lambda: " ".join(rng.choice(["river", "stone", "cloud", "window", "green", "paper"]) + rng.choice("abcdefgh") for _ in range(60))
    sample = [(i, (plain() + (" utterly vilest fool " if i % 3 == 0 else " ") + plain()).encode(), int(i % 3 == 0)) for i in range(300)]
    model = toxicity.fit(sample)
    assert b"vilest" in model.toxic and b"river" not in model.toxic and len(model.ordinary) > 100
    gains = toxicity.Gains(model.toxic, model.ordinary)
    known, other = gains.features(b"a vilest fool".split()), gains.features(b"river stone cloud".split())
    assert known[0] >= 4 > other[0] and gains.features([]) == [0.0] * toxicity.FEATURES


def test_near_copies_of_repeated_ids(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    docs = spark.createDataFrame([(4, a), (4, b), (4, b), (2, b), (None, a), (9, a)], ROWS)
    kept = corpus_pipeline.distinct(spark, docs.withColumn("kept", F.lit(1)), "").collect()
    assert sorted((r["doc_id"] or -1, r["text"][0]) for r in kept) == [(-1, "a"), (2, "b"), (4, "a")]
