"""Stages on their own inputs, and the whole chain."""

import random
from itertools import combinations

import pytest

from conceptflow.llm import resemblance

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_every_stage_but_the_last_keeps_the_columns(spark, documents):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, documents, DATA)
        assert out.columns == documents.columns and out.schema == documents.schema
        assert 0 < out.count() <= documents.count()


def test_copies_leave_one_and_secrets_go(spark, documents):
    text = "alpha beta gamma delta epsilon zeta eta theta"
    rows = [(9, text, "en", "s", 1), (4, text, "en", "s", 1), (4, text, "en", "s", 1), (5, None, "en", "s", 0), (None, text, "en", "s", 1), (7, "token = abcdefgh!", "en", "s", 17)]
    docs = spark.createDataFrame(rows, documents.schema)
    assert sorted(r["doc_id"] or -1 for r in corpus_pipeline.distinct(spark, docs, DATA).collect()) == [-1, 4, 5, 7]
    clean = {r["doc_id"]: r for r in corpus_pipeline.unsecret(spark, docs, DATA).collect()}
    assert clean[7]["text"] == "[REDACTED]!" and clean[7]["n_chars"] == 11 and clean[5]["text"] is None
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), DATA).count() == 0


def test_run(spark):
    packed = corpus_pipeline.run(spark, DATA).toPandas()
    assert packed.groupby("sequence_id").length.sum().max() <= 4096 and not packed.duplicated(["doc_id", "piece"]).any()


def test_near_copies_are_components_of_verified_pairs(spark, documents):
    rng = random.Random(7)
    texts = []
    for size in (40, 120, 300):
        for _ in range(6):
            words = [f"w{rng.randrange(10**6)}" for _ in range(size)]
            for changes in (0, 1, 2, 4, 9):  # from copies of one original, and between these, similarities around 0.8
                at = set(rng.sample(range(size), changes))
                texts.append(" ".join("x%d" % rng.randrange(10**6) if i in at else w for i, w in enumerate(words)))
    sets = [resemblance.shingles(t.encode()) for t in texts]
    root = list(range(len(texts)))
    near = [(i, j) for i, j in combinations(range(len(texts)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for _ in texts:
        for i, j in near:
            root[i] = root[j] = min(root[i], root[j])
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], documents.schema)
    assert {r["doc_id"] for r in corpus_pipeline.distinct(spark, docs, DATA).collect()} == set(root)
    assert 18 <= len(set(root)) < len(texts) and {r["doc_id"]: r["component_id"] for r in resemblance.near_copies(docs).collect()} == dict(enumerate(root))
