"""Work of large groups is dealt over tasks, and the results stay those of the plain plan."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conceptflow.operators import folds, graph, parts, passages, resolution, vectors, workflow
from conceptflow.operators.decisions import diagnoses

DATA = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def tasks(df, *keys):
    """The most tasks that rows of one key come out of."""
    placed = df.withColumn("task", F.spark_partition_id()).collect()
    found = {}
    for r in placed:
        found.setdefault(tuple(r[k] for k in keys), set()).add(r["task"])
    return max(map(len, found.values()))


@pytest.mark.parametrize("block_rows", [3, 1000])
def test_paired_is_a_join(spark, block_rows):
    left = spark.createDataFrame([(i, "hot" if i % 4 else None if i % 8 else "own") for i in range(60)] + [(99, "left")], "id bigint, k string")
    right = spark.createDataFrame([(i, "hot" if i % 3 else "own") for i in range(50)] + [(i, "right") for i in range(100, 120)], "id2 bigint, k string")
    assert rows(parts.paired(left, right, ["k"], "id", "id2", block_rows)) == rows(left.join(right, "k"))


def test_pairs_of_one_name_come_out_of_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(parts, "BLOCK_ROWS", 2, raising=False)
    assert tasks(entry.queries()["decision_cascade"](spark, DATA).join(F.broadcast(spark.read.parquet(f"{DATA}/part.parquet")), F.col("l") == F.col("p_partkey")), "p_name") > 1


def _case(spark):
    rng = random.Random(5)
    names = ["a b", "c", "d e", "f", None]
    people = [(i, rng.choice("XYZ"), "The x" if i % 7 == 0 else "Ab Cd" if i % 2 else "ab", rng.choice(names), "en" if i % 3 else "es", rng.choice(["k", "j", None]), {p: rng.choice("12") for p in "pq" if rng.random() < 0.6}) for i in range(40)]
    mentions = spark.createDataFrame(people, "id bigint, document_id string, text string, surface string, language string, class string, keys map<string,string>")
    synonyms = spark.createDataFrame([("a b", "c"), ("c", "a b"), ("d e", "d e"), ("f", "c")], "name string, other string")
    near = spark.createDataFrame([(1, 2, 0.9), (2, 5, 0.7), (3, 30, 0.1), (9, 4, 0.8), (7, 7, 1.0), (10, 20, 0.95)], "a bigint, b bigint, score double")
    return people, mentions, synonyms, near


@pytest.mark.parametrize("block_rows", [4, 16_384])
def test_candidate_pairs_against_loops(spark, monkeypatch, block_rows):
    monkeypatch.setattr(parts, "BLOCK_ROWS", block_rows)
    people, mentions, synonyms, near = _case(spark)
    declared, close = {tuple(r) for r in synonyms.collect()}, {(r["a"], r["b"]) for r in near.collect()}
    wanted = []
    for x in people:
        for y in people:
            sources = {"neighbour"} if (x[0], y[0]) in close else set()
            if x[0] < y[0]:
                sources |= {s for s, held in (("surface", x[3] and x[3] == y[3]), ("key", set(x[6].items()) & set(y[6].items())), ("synonym", {(x[3], y[3]), (y[3], x[3])} & declared)) if held}
            if sources and x[1] != y[1]:
                wanted.append((x[0], y[0], ",".join(sorted(sources))))
    found = resolution.candidate_pairs(mentions, near, synonyms)
    assert rows(found.select("a", "b", F.array_join("sources", ","))) == sorted(wanted)
    assert rows(resolution.candidate_pairs(mentions, near, synonyms, ",")) == sorted(wanted)


def test_pairs_are_not_shuffled(spark):
    """Each source's pairs leave their join as rows of the result."""
    _, mentions, synonyms, near = _case(spark)
    assert resolution.candidate_pairs(mentions, near, synonyms)._jdf.queryExecution().optimizedPlan().nodeName() == "Union"


def test_resolved_is_resolve_of_all_candidates(spark):
    _, mentions, synonyms, near = _case(spark)
    keys = spark.createDataFrame([("k", ["p", "q"]), ("j", ["q"])], "class string, properties array<string>")
    pairs = resolution.candidate_pairs(mentions, near, synonyms)
    assert rows(resolution.resolved(mentions, near, synonyms, keys, 0.8, 0.5)) == rows(resolution.resolve(pairs, mentions, synonyms, keys, near, 0.8, 0.5))


@pytest.mark.parametrize("left, right, wanted", [("map('p', 'a', 'q', null)", "map('p', 'a', 'q', 'b')", None), ("map('p', 'x', 'q', null)", "map('p', 'a', 'q', 'b')", False), ("map('p', 'a', 'q', 'b')", "map('q', 'b', 'p', 'a')", True), ("map('p', 'a')", "map('p', 'a', 'q', 'b')", None)])
def test_compiled_verdict_is_key_verdict(spark, left, right, wanted):
    one = resolution._keyed(spark.sql(f"select {left} as keys, array('p', 'q') as properties"))
    two = resolution._keyed(spark.sql(f"select {right} as keys"))
    both = one.select([F.col(c).alias(c + "1") for c in one.columns]).crossJoin(two.select([F.col(c).alias(c + "2") for c in two.columns]))
    plain = resolution.key_verdict(F.col("properties1"), F.col("keys1"), F.col("keys2"))
    assert tuple(both.select(resolution._verdict(), plain).first()) == (wanted, wanted)


def test_diff_sends_no_graph_to_all_tasks(spark):
    found = entry.queries()["semantic_diff"](spark, DATA)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    one = spark.createDataFrame([("a", "p", "b"), ("a", "p", None), ("a", "rdfs:label", "x"), ("a", "rdfs:comment", "y"), ("c", "p", "d"), ("c", "p", "d")], "s string, p string, o string")
    two = spark.createDataFrame([("a", "p", "c"), ("a", "p", None), ("a", "rdfs:label", "z"), ("c", "p", "d")], "s string, p string, o string")
    assert rows(graph.diff(one, two)) == [("added", "a", "p", "c"), ("label", "a", "rdfs:label", "x"), ("label", "a", "rdfs:label", "z"), ("removed", "a", "p", "b")]


def test_blank_nodes_of_all_shapes(spark):
    """Nodes with one, two and three alike neighbours are told apart; renaming and reordering change nothing; no table of the rounds is left."""
    ring = [(f"_:r{i}", "next", f"_:r{(i + 1) % 4}") for i in range(4)] + [("_:r0", "name", "a")]
    stars = [(f"_:h{n}", "has", f"_:h{n}x{k}") for n in (1, 2, 3) for k in range(n)] + [(f"_:h{n}", "self", f"_:h{n}") for n in (1, 2, 3)]
    plain = [("x", "p", "y"), ("x", "q", "_:e"), ("_:e", "q", "x"), ("_:e", "q", "x")]
    one = spark.createDataFrame(ring + stars + plain, "s string, p string, o string")
    flip = lambda x: "_:" + x[2:][::-1] + "z" if x.startswith("_:") else x
    two = spark.createDataFrame([(flip(s), p, flip(o)) for s, p, o in reversed(ring + stars + plain)], "s string, p string, o string")
    labels = dict(rows(graph.blank_labels(one)))
    assert len(set(labels.values())) == len(labels) == 14
    assert len({labels[f"_:h{n}"].split(".")[0] for n in (1, 2, 3)}) == 3 and len({labels[f"_:r{i}"] for i in range(4) if "." not in labels[f"_:r{i}"]}) == 4
    assert sorted(labels.values()) == sorted(r["label"] for r in graph.blank_labels(two).collect())
    assert rows(graph.logical(one)) == rows(graph.logical(two)) and graph.diff(one, two).count() == 0
    assert graph.state_hash(one).first() == graph.state_hash(two).first() != graph.state_hash(two.where("p <> 'name'")).first()


def test_renamed_blanks_leaves_little_on_disk(spark, tmp_path):
    folder = spark.sparkContext._jsc.sc().getCheckpointDir()
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    entry.queries()["renamed_blanks"](spark, DATA).collect()
    written = sum(f.stat().st_size for f in tmp_path.rglob("*") if f.is_file())
    if folder.isDefined():
        spark.sparkContext.setCheckpointDir(folder.get())
    assert written < 600_000  # two logics of 4,500 triples and their labels; all rounds of four labellings before


def test_inherited_disjointness_against_loops(spark, monkeypatch):
    monkeypatch.setattr(parts, "BLOCK_ROWS", 2)
    above = {"a": [], "b": [], "c": ["a"], "d": ["b"], "e": ["a", "b"], "f": ["c"], "g": ["d", "h"], "h": [], "i": ["h"], "j": ["f"]}
    disjoint = [("a", "b"), ("h", "a"), ("b", "a"), ("c", "h")]

    def up(x):
        return {x}.union(*[up(y) for y in above[x]])

    wanted = {(x, y) for x in above for y in above if x < y and any((p in up(x) and q in up(y)) or (q in up(x) and p in up(y)) for p, q in disjoint)}
    edges = spark.createDataFrame([(x, y) for x, ys in above.items() for y in ys], "child string, parent string")
    found = graph.incompatible(spark.createDataFrame(disjoint, "a string, b string"), graph.ancestors(edges))
    assert rows(found) == sorted(wanted)
    assert found._jdf.queryExecution().optimizedPlan().nodeName() != "Aggregate"  # each pair is made once


def test_citations_of_one_number_come_out_of_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(parts, "BLOCK_ROWS", 2, raising=False)
    found = entry.queries()["caption_citations"](spark, DATA)
    assert tasks(found, "document_id") > 1


def test_axes_stream_over_decisions(spark):
    rng = random.Random(3)
    conflicts = [(10 * d + c, f"{d}/{rng.randrange(4)}") for d in range(300) for c in range(rng.choice([1, 2, 3])) for _ in range(2)]
    groups = {}
    for c, decision in rows(passages.touching(spark.createDataFrame(conflicts, "conflict bigint, axiom string"))):
        groups.setdefault(decision, []).append(frozenset(a for k, a in conflicts if k == c))
    wanted = [(d, sorted(x)) for d, sets in groups.items() for found in [diagnoses(sets)] if len(found) > 1 for x in found]
    found = passages.axes(spark.createDataFrame(conflicts, "conflict bigint, axiom string"))
    assert rows(found) == sorted(wanted)
    assert "InPandas" not in found._jdf.queryExecution().executedPlan().toString()  # no table of its own for each decision


def test_chunks_stream_over_documents(spark):
    rng = random.Random(4)
    blocks = [(d, o, rng.choice(["paragraph", "table", "caption", "unparsed"]), "x" * rng.randrange(0, 60), rng.random() < 0.1) for d in range(200) for o in range(rng.randrange(1, 12))]
    rng.shuffle(blocks)
    wanted = []
    for d in range(200):
        own = sorted(b for b in blocks if b[0] == d and not b[4] and b[2] != "unparsed" and b[3])
        wanted += [(d, b[1], n) for b, n in zip(own, folds.chunk_rows([b[2] for b in own], [len(b[3]) for b in own], 80, 120))]
    found = folds.chunks(spark.createDataFrame(blocks, "document_id bigint, ordinal int, block_type string, text string, is_boilerplate boolean"), 80, 120)
    assert rows(found) == sorted(wanted)
    assert "InPandas" not in found._jdf.queryExecution().executedPlan().toString()


def _most_tasks(df):
    """The largest number of tasks that the plan deals rows to by itself."""
    return max(int(n) for n in re.findall(r"RepartitionByExpression \[.*\], (\d+)", df._jdf.queryExecution().optimizedPlan().toString()))


def test_histogram_tasks_grow_in_number_with_rows(spark, monkeypatch):
    triples = spark.createDataFrame([("p", i % 40, i % 3) for i in range(400)] + [("q", 1, i) for i in range(400)] + [("q", 2, None)], "p string, s bigint, o bigint")
    monkeypatch.setattr(parts, "TASK_ROWS", 50)
    found = workflow.functional_histogram(triples, spark.createDataFrame([(2,), (2,), (99,)], "s bigint"))
    assert rows(found.select("p", "individuals", F.to_json("distribution"), "excluded")) == [("p", 39, '{"3":39}', 1), ("q", 1, '{"400":1}', 1)]
    assert _most_tasks(found) == 17  # 801 rows by 50


def test_survey_tasks_grow_in_number_with_rows(spark, monkeypatch):
    triples = spark.createDataFrame([("p", i % 40, 7) for i in range(400)] + [("q", 1, i) for i in range(400)], "p string, s bigint, o bigint")
    monkeypatch.setattr(parts, "TASK_ROWS", 50)
    found = graph.functional_survey(triples)
    assert rows(found) == [("p", 40, 1, False), ("q", 1, 400, True)]
    assert _most_tasks(found) == 16


def test_similar_pairs_send_a_row_out_a_bounded_number_of_times(spark, monkeypatch):
    rng = np.random.default_rng(1)
    points = rng.normal(size=(300, 6))
    points[200:] = points[:100]  # copies, whose pairs are many
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    score = np.round(unit @ unit.T, 6)
    wanted = [(i, j) for i in range(300) for j in range(i + 1, 300) if score[i, j] >= 0.8]
    table = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id bigint, v array<double>")
    for name, value in (("BLOCKS", 5), ("LEAST_ROWS", 8), ("MOST_ROWS", 64)):
        monkeypatch.setattr(vectors, name, value, raising=False)
    found = vectors.similar_pairs(table, 0.8)
    assert [(a, b) for a, b, _ in rows(found)] == wanted
    assert [(a, b) for a, b, _ in rows(vectors.similar_pairs(table, 0.8, 7))] == wanted
    assert _most_tasks(found) == 21  # six blocks meet pairwise, once


def test_reranking_meets_by_mention(spark, monkeypatch):
    rng = random.Random(6)
    offered = [(m, f"k{k}") for m in range(100) for k in rng.sample(range(6), 3)] + [(1, "k0"), (1, "k0"), (None, "k1"), (101, None), (102, "k9")]
    scored = [(m, f"k{k}", f"n{n}", rng.randrange(10) / 10) for m in range(100) for k in range(6) for n in range(2)] + [(103, "k1", "n", 0.9), (1, "k5", "n", None)]
    best, wanted = {}, []
    for m, k, _, x in scored:
        if (m, k) in offered and x is not None:
            best[m, k] = max(best.get((m, k), 0.0), x)
    for m in range(100):
        order = sorted((-x, k) for (n, k), x in best.items() if n == m)
        zone = "auto" if -order[0][0] >= 0.9 else "grey" if -order[0][0] >= 0.6 else "discarded"
        wanted.append((m, order[0][1] if zone != "discarded" else None, -order[0][0], zone, order[1][1]))
    monkeypatch.setattr(parts, "TASK_ROWS", 50)
    found = resolution.reranked(spark.createDataFrame(offered, "mention_id bigint, iri string"), spark.createDataFrame(scored, "mention_id bigint, iri string, name string, score double"), 0.9, 0.6)
    assert rows(found) == wanted
    assert _most_tasks(found) == -(-(len(offered) + len(scored) - 2) // 50)


def test_proposals_tasks_grow_in_number_with_rows(spark, monkeypatch):
    scores = [(p, f"l{k}", (p * k) % 7 / 7) for p in range(200) for k in range(5)]
    monkeypatch.setattr(parts, "TASK_ROWS", 50)
    found = resolution.redundant(spark.createDataFrame(scores, "proposal bigint, label string, score double"), 0.7)
    first = [min((r for r in scores if r[0] == p), key=lambda r: (-r[2], r[1])) for p in range(200)]
    assert rows(found) == [r for r in first if r[2] >= 0.7]
    assert _most_tasks(found) == 20
