import random

import pytest
from pyspark.sql import functions as F

from conceptflow import ledger
from conceptflow.operators import folds, graph, relational, state, vectors
from conceptflow.operators.components import connected_components


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    parent = list(range(300))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    found = dict(rows(connected_components(spark.createDataFrame(edges, "a bigint, b bigint"))))
    assert set(found) == {x for a, b in edges if a != b for x in (a, b)}
    assert all((found[a] == found[b]) == (find(a) == find(b)) for a in found for b in found)
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_path_and_star_components(spark):
    path = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert connected_components(path).select("root").distinct().count() == 1


def test_rounds_do_not_hand_size_estimates_on(spark):
    path = spark.range(4000).select(F.xxhash64("id").alias("a"), F.xxhash64(F.col("id") + 1).alias("b"))
    found = connected_components(path)
    estimate = found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()  # had 1,264,940 digits, trebled by every round
    assert estimate < 10**100 and found.select("root").distinct().count() == 1 and found.count() == 4001


def test_typing_best_name_and_ties(spark):
    names = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0]), ("c", [1.0, 1.0])], "iri string, v array<double>")
    mentions = spark.createDataFrame([(1, [2.0, 0.0]), (2, [-1.0, 0.0])], "mention_id bigint, v array<double>")
    ranked = vectors.rank_targets(mentions, names, 3)
    assert [(r["iri"], r["score"]) for r in ranked.where("mention_id = 1").orderBy("rank").collect()] == [("a", 1.0), ("b", 1.0), ("c", 0.707107)]
    typed = {r["mention_id"]: r for r in vectors.typings(ranked, 0.9, 0.5).collect()}
    assert (typed[1]["iri"], typed[1]["zone"], typed[1]["runner_up"]) == ("a", "auto", "b")
    assert (typed[2]["iri"], typed[2]["zone"]) == (None, "discarded")


def test_similarity_pairs_and_clusters(spark):
    points = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.95, 0.31]), (3, [0.8, 0.6]), (4, [0.0, -1.0])], "id bigint, v array<double>")
    assert [(a, b) for a, b, _ in rows(vectors.similar_pairs(points, 0.9, 3))] == [(1, 2), (2, 3)]
    assert [(n, least) for _, n, least in rows(vectors.single_link(points, 0.9, 2))] == [(3, 1)]


def test_state_is_idempotent(spark):
    now = spark.createDataFrame([(1, "a", True), (2, "b", False)], "id int, v string, held boolean")
    new = spark.createDataFrame([(2, "c", True), (3, "d", False)], "id int, v string, held boolean")
    once = state.upsert(now, new, ["id"], keep=("held",))
    assert rows(once) == [(1, "a", True), (2, "c", False), (3, "d", False)] == rows(state.upsert(once, new, ["id"], keep=("held",)))
    old = spark.createDataFrame([("x", "k", "open"), ("y", "k", "superseded"), ("z", "k", "accepted"), ("w", "q", "open")], "id string, kind string, status string")
    found = spark.createDataFrame([("y", "k"), ("n", "k")], "id string, kind string")
    synced = state.merge_sync(old, found, ["k"])
    assert dict((i, s) for i, _, s in rows(synced)) == {"x": "superseded", "y": "open", "z": "accepted", "w": "open", "n": "open"}
    assert rows(state.merge_sync(synced, found, ["k"])) == rows(synced)


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("d", "a")], "child string, parent string")
    closure = graph.ancestors(edges)
    assert ("d", "c") in rows(closure) and rows(graph.cycles(closure)) == [("b",), ("c",)]
    tree = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "a"), ("e", "x")], "child string, parent string")
    assert dict(rows(graph.depths(tree))) == {"a": 1, "x": 1, "b": 2, "d": 2, "e": 2, "c": 3}
    typed = spark.createDataFrame([(1, "c"), (1, "a"), (2, "c"), (2, "d")], "entity int, iri string")
    assert rows(graph.conflicts(typed, graph.ancestors(tree))) == [(2, "c,d")]
    disjoint = spark.createDataFrame([("b", "d")], "a string, b string")
    assert rows(graph.incompatible(disjoint, graph.ancestors(tree))) == [("b", "d"), ("c", "d")]


def test_hash_ignores_order_labels_and_blank_names(spark):
    one = spark.createDataFrame([("a", "p", "_:1"), ("_:1", "q", "b"), ("a", "rdfs:label", "x")], "s string, p string, o string")
    two = spark.createDataFrame([("_:9", "q", "b"), ("a", "p", "_:9"), ("a", "rdfs:label", "y")], "s string, p string, o string")

    def digest(triples):
        names = graph.blank_labels(triples)
        for c in ("s", "o"):
            triples = triples.join(names.withColumnRenamed("node", c), c, "left").withColumn(c, F.coalesce("label", c)).drop("label")
        return graph.state_hash(triples.select("s", "p", "o")).first()["hash"]

    assert digest(one) == digest(two) != digest(one.where("p <> 'q'"))
    assert {r["change"] for r in graph.diff(one, one.where("p <> 'rdfs:label'")).collect()} == {"label"}


def test_patterns(spark):
    triples = spark.createDataFrame([("a", "sub", "b"), ("b", "sub", "c"), ("a", "is", "x"), ("c", "is", "x")], "s string, p string, o string")
    assert rows(graph.match(triples, [("?k", "sub+", "?top"), ("?top", "is", "x")]).select("k", "top")) == [("a", "c"), ("b", "c")]
    found = graph.match(triples, [("?k", "sub+", "c")], [("?k", "is", "x")])
    assert rows(found) == [("b",)]


def test_chunking_keeps_tables_with_captions():
    assert folds.chunk_rows(["paragraph", "caption", "table", "paragraph"], [50, 10, 60, 10], 80, 100) == [0, 1, 1, 1]
    assert folds.chunk_rows(["table", "caption", "paragraph"], [70, 20, 5], 80, 100) == [0, 0, 1]
    assert folds.chunk_rows([], [], 10, 20) == []


def test_batches_change_only_where_content_does():
    labels = sorted(f"label {i}" for i in range(200))
    before = folds.batch_numbers(labels, 5)
    groups = lambda ls, ns: {tuple(x for x, m in zip(ls, ns, strict=True) if m == n) for n in ns}
    more = sorted([*labels, "label 55x"])
    assert len(groups(labels, before) ^ groups(more, folds.batch_numbers(more, 5))) <= 6


def test_screen_and_positions():
    assert folds.screen(["what is a cell?", "what is a cell?", "what is a cel?", "why?"], 0.9) == [True, False, False, True]
    assert folds.position_clusters([(0, 0, 1, 1), (5, 0, 1, 1), (40, 0, 1, 1)], 12) == [0, 0, 1]


def test_spans_index_the_markdown(spark):
    texts = [("one", False), ("running head", True), ("two words", False)]
    blocks = spark.createDataFrame([(1, i, t, b) for i, (t, b) in enumerate(texts)], "document_id int, ordinal int, text string, is_boilerplate boolean")
    markdown = "\n\n".join(t for t, b in texts if not b)
    for r in folds.markdown_spans(blocks).collect():
        assert r["span_start"] is None if r["is_boilerplate"] else markdown[r["span_start"] : r["span_end"]] == r["text"]


def test_curve_and_separation(spark):
    order = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "seq bigint, document_id bigint")
    concepts = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "a")], "document_id bigint, concept string")
    curve = relational.accumulation(order, concepts)
    assert [(n, t) for _, _, n, t in rows(curve)] == [(1, 1), (1, 2), (0, 2)]
    assert relational.tail_slope(curve, 2).first()["slope"] == 0.5
    assert relational.tail_slope(curve, 9).first()["slope"] is None
    scores = spark.createDataFrame([(0.9, True)], "score double, correct boolean")
    assert relational.separation(scores).first()["separation"] == 0.0


def test_ledger_retries_caches_and_aborts(spark):
    empty = spark.createDataFrame([], "key string, label string, status string, attempts int, result string")
    units = spark.createDataFrame([("1", "a", "x"), ("2", "b", "y"), ("2", "b", "y")], "key string, label string, payload string")
    done = ledger.run(empty, units, str.upper)
    assert [(k, r) for k, *_, r in rows(done)] == [("1", "X"), ("2", "Y")]
    assert ledger.plan(done, units).count() == 0
    with pytest.raises(RuntimeError):
        ledger.run(empty, units, lambda _: 1 // 0)
