"""Resolution, passages, SPARQL, blank nodes, ledgers and settings on small cases; folds against loops."""

import random
from difflib import SequenceMatcher

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conceptflow import ledger, settings
from conceptflow.functions import text as tx
from conceptflow.operators import folds, graph, passages, resolution, sparql, workflow

DATA = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("name", [
    "candidate_pairs", "resolved_pairs", "reranked_typings", "located_mentions", "marked_mentions", "coreference_groups", "rejected_markers", "assembled_axioms",
    "touching_conflicts", "axis_branches", "committed_version", "stage_survey", "claimable_jobs", "functional_histogram", "sparql_counts", "sparql_paths", "sparql_optional",
    "renamed_blanks", "model_stage", "split_batches", "label_batches", "screened_questions", "strata_sample", "phrase_presence", "state_digest",
])
def test_twin(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = entry.queries()[name](spark, DATA)
    wanted = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in wanted.description]
    assert sorted(found.columns) == sorted(names)
    text = lambda x: "" if x is None else f"{x:.6f}" if isinstance(x, float) else str(x)
    assert sorted(tuple(map(text, r)) for r in found.select(*[f"`{n}`" for n in names]).collect()) == sorted(tuple(map(text, r)) for r in wanted.fetchall())


def test_key_verdicts(spark):
    maps = spark.sql("select array('a', 'b') as p, map('a', '1', 'b', '2') as x, map('a', '1', 'b', '2') as y, map('a', '1', 'b', '3') as z, map('a', '1') as w")
    verdict = lambda a, b: resolution.key_verdict(F.col("p"), F.col(a), F.col(b))
    assert tuple(maps.select(verdict("x", "y"), verdict("x", "z"), verdict("x", "w")).first()) == (True, False, None)


def test_every_rule_of_resolution_is_met(spark):
    mentions = spark.createDataFrame([
        (1, "A", "Smith Ltd", "smith ltd", "en", "k", {"id": "7"}), (2, "B", "Smith Ltd", "smith ltd", "en", "k", {"id": "7"}), (3, "C", "Smith Ltd", "smith ltd", "en", "k", {"id": "8"}),
        (4, "D", "Smith Ltd", "smith ltd", "es", None, {}), (5, "E", "Smith Ltd", "smith ltd", "en", "j", {}), (6, "F", "Smith Ltd", "smith ltd", "en", "j", {}), (7, "G", "the cell", "the cell", "en", None, {}),
        (8, "H", "the cell", "the cell", "en", None, {}), (9, "I", "Grounded Theory", "grounded theory", "en", None, {}), (10, "J", "GT Method", "gt method", "en", None, {}), (11, "A", "Smith Ltd", "smith ltd", "en", None, {}),
    ], "id bigint, document_id string, text string, surface string, language string, class string, keys map<string,string>")
    synonyms = spark.createDataFrame([("gt method", "grounded theory")], "name string, other string")
    near = spark.createDataFrame([(1, 9, 0.95), (2, 9, 0.7), (3, 9, 0.2), (1, 11, 0.9)], "a bigint, b bigint, score double")
    keys = spark.createDataFrame([("k", ["id"])], "class string, properties array<string>")
    pairs = resolution.candidate_pairs(mentions, near, synonyms)
    found = {(r["a"], r["b"]): r["reason"] for r in resolution.resolve(pairs, mentions, synonyms, keys, near, 0.9, 0.6).collect()}
    assert (1, 11) not in found
    assert found[1, 2] == "declared_key_matches" and found[1, 3] == "declared_key_differs" and found[1, 4] == "cross_language" and found[9, 10] == "synonym_declared_in_ontology"
    assert found[7, 8] == "generic_phrase_cross_document" and found[5, 6] == "identical_proper_name" and found[1, 5] == "identical_name_different_class"
    assert found[1, 9] == "high_similarity" and found[2, 9] == "grey_zone" and found[3, 9] == "low_similarity"
    assert rows(pairs.where("a = 1 and b = 2").select(F.array_join("sources", ","))) == [("key,surface",)]


def test_absolute_offsets(spark):
    placed = passages.layout(spark.createDataFrame([(1, 0, 4, 100), (1, 1, 6, 300)], "chunk_id int, ordinal int, size int, block_start bigint"))
    found = spark.createDataFrame([(1, 2), (1, 6), (1, 7)], "chunk_id int, start bigint")
    assert rows(passages.absolute(found, placed).select("start", "block", "span_start")) == [(2, 0, 102), (6, 1, 300), (7, 1, 301)]


def test_axes_are_minimal_ways_out(spark):
    rows_ = [(1, "a"), (1, "b"), (2, "b"), (2, "c"), (3, "x"), (4, "p"), (4, "q")]
    found = passages.axes(spark.createDataFrame(rows_, "conflict bigint, axiom string"))
    assert rows(found) == [(1, ["b"]), (4, ["p"]), (4, ["q"])] or rows(found) == [(4, ["p"]), (4, ["q"])]


@pytest.mark.parametrize("seed", range(3))
def test_batches_are_those_of_one_list(spark, seed):
    rng = random.Random(seed)
    labels = sorted({"".join(rng.choices("abcdef", k=4)) for _ in range(300)})
    found = {r["label"]: r["batch"] for r in folds.batches(spark.createDataFrame([(x,) for x in labels] * 2, "label string"), 3).collect()}
    numbers = folds.batch_numbers(labels, 3)
    groups = lambda names: {frozenset(x for x, m in zip(labels, names, strict=True) if m == n) for n in names}
    assert groups([found[x] for x in labels]) == groups(numbers)


def test_near_copies_of_questions(spark):
    words = ["what", "is", "a", "cell", "which", "wall", "holds"]
    rng = random.Random(4)
    asked = [("t", i, " ".join(rng.choices(words, k=4)), "SELECT ?x WHERE { ?x a <y> . ?x <p> ?z }", 1, True) for i in range(60)]
    asked[5] = ("t", 5, asked[4][2].upper() + "?", *asked[4][3:])
    kept, verdicts = [], {}
    for _, i, question, *_ in asked:
        same = " ".join(question.lower().strip("?").split())
        if same in [k for k, _ in kept]:
            verdicts[i] = "duplicate"
        elif any(SequenceMatcher(None, question, k).ratio() >= 0.8 for _, k in kept):
            verdicts[i] = "near-duplicate"
        else:
            verdicts[i] = "kept"
            kept.append((same, question))
    frame = spark.createDataFrame(asked, "cq_type string, ordinal int, question string, sparql string, passage int, parses boolean")
    found = {r["ordinal"]: r["verdict"] for r in folds.screened(frame, spark.createDataFrame([("t", 1)], "cq_type string, n int"), 0.8).collect()}
    assert {i: v == "kept" for i, v in found.items()} == {i: v == "kept" for i, v in verdicts.items()} and found[5] == verdicts[5]


def test_sparql_forms_and_errors(spark):
    triples = spark.createDataFrame([("a", "p", "1"), ("b", "p", "20"), ("a", "q", "x y"), ("c", "rdf:type", "k"), ("b", "sub", "a"), ("a", "sub", "r")], "s string, p string, o string")
    one = lambda q: rows(sparql.select(triples, q))
    assert one("SELECT ?s WHERE { ?s <p> ?v FILTER(?v < 5 || ?v >= 20) } ORDER BY DESC(?s) LIMIT 1") == [("b",)]
    assert one("ASK { ?s a <k> }") == [(True,)] and one("ASK { ?s a <none> }") == [(False,)]
    assert one("SELECT ?s WHERE { ?s <p> ?v . FILTER EXISTS { ?s <q> ?w FILTER(CONTAINS(?w, 'y')) } }") == [("a",)]
    assert one("SELECT ?t WHERE { <b> <sub>+ ?t }") == [("a",), ("r",)]
    assert one("SELECT (COUNT(*) AS ?n) WHERE { ?s <p> ?v }") == [(2,)]
    assert one("SELECT ?s WHERE { ?s <p> ?v OPTIONAL { ?s <q> ?w } FILTER(!BOUND(?w)) }") == [("b",)]
    found = sparql.evaluate(triples, [("yes", "SELECT ?s { ?s <p> ?v }"), ("no", "SELECT ?s { ?s <z> ?v }"), ("bad", "SELECT ?s { ?s <p> }"), ("worse", "nonsense")])
    assert [(n, ok, e is None) for n, ok, e in found] == [("yes", True, True), ("no", False, True), ("bad", False, False), ("worse", False, False)]


def test_blank_nodes_in_cycles(spark):
    one = spark.createDataFrame([("_:1", "n", "_:2"), ("_:2", "n", "_:3"), ("_:3", "n", "_:1"), ("_:3", "v", "x")], "s string, p string, o string")
    two = spark.createDataFrame([("_:c", "n", "_:a"), ("_:b", "n", "_:c"), ("_:a", "n", "_:b"), ("_:b", "v", "x")], "s string, p string, o string")
    assert rows(graph.logical(one)) == rows(graph.logical(two)) and graph.diff(one, two).count() == 0
    assert graph.state_hash(one).first()["hash"] == graph.state_hash(two).first()["hash"] != graph.state_hash(two.where("p = 'n'")).first()["hash"]


def test_depths_of_a_dag_and_of_cycles(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("d", "c"), ("x", "y"), ("y", "x"), ("z", "x")], "child string, parent string")
    assert dict(rows(graph.depths(edges))) == {"a": 1, "b": 2, "c": 3, "d": 4}
    chain = spark.createDataFrame([(f"{i:03}", f"{i - 1:03}") for i in range(1, 70)], "child string, parent string")
    assert graph.depths(chain).agg(F.max("depth")).first()[0] == 70


def test_ledger_keys_caches_and_retries(spark, tmp_path):
    units = spark.createDataFrame([("u1", "p1"), ("u2", "p2")], "label string, payload string")
    key = lambda version, model: ledger.keyed(units, "s", version, F.lit(model)).select("key").distinct().collect()
    assert len({r["key"] for args in (("v1", "m"), ("v2", "m"), ("v1", "n")) for r in key(*args)}) == 6
    empty = spark.createDataFrame([], "key string, label string, status string, attempts int, result string")
    plan = ledger.pending(empty, ledger.keyed(units, "s", "v1", F.lit("m")))
    assert rows(plan.groupBy("status").count()) == [("pending", 2)] and ledger.pending(plan, ledger.keyed(units, "s", "v1", F.lit("m"))).count() == 2
    model = ledger.Scripted({"p1": '{"a": 1}', "p2": "none"})
    after, found = ledger.model_stage(empty, units, model, tx.outer_json, "s", "v1", F.lit("m"))
    assert rows(found) == [("u1", "done", '{"a": 1}'), ("u2", "unreadable", None)]
    again, found = ledger.model_stage(after, units, ledger.NoModel(), tx.outer_json, "s", "v1", F.lit("m"))
    assert again.count() == 2 and rows(found.select("label", "status")) == [("u1", "done"), ("u2", "unreadable")]
    failed, _ = ledger.model_stage(empty, units, ledger.NoModel(), tx.outer_json, "s", "v1", F.lit("m"), retries=2, abort_rate=1.0, backoff=0.01)
    assert rows(failed.select("status", "attempts")) == [("failed", 2)] * 2
    assert ledger.payload("{a} and {b}", a=F.lit("x"), b=F.lit(None)) is not None


def test_settings(spark):
    with pytest.raises(ValueError):
        settings.MappingRules(conflict_policy="maybe")
    with pytest.raises(ValueError):
        settings.MappingRules(auto_threshold=0.5, grey_threshold=0.6)
    assert settings.MappingRules(excluded=("b", "a")).rules_hash() == settings.MappingRules(excluded=("a", "b")).rules_hash() != settings.MappingRules().rules_hash()
    spec = settings.StageSpec("match", {"limit": int, "floor": float}, needs_provider=True, step="match")
    assert settings.cleaned(spec, {"limit": 3, "floor": 1}) == {"limit": 3, "floor": 1.0}
    for bad in ({"other": 1}, {"limit": "3"}, {"limit": True}):
        with pytest.raises(ValueError):
            settings.cleaned(spec, bad)
    plan = spark.createDataFrame([("match", "blocked")], "step string, state string")
    assert settings.blocked_by(spec, False, plan) == "no provider" and settings.blocked_by(spec, True, plan) and settings.blocked_by(spec, True, plan.where("false")) is None
    docs = spark.createDataFrame([("d1",), ("d2",)], "document_id string")
    gold = spark.createDataFrame([("d1", "a"), ("d2", "a"), ("d1", "b")], "document_id string, iri string")
    live, kept, inventory = settings.use_case(docs, gold, gold.select("iri").distinct(), {"withheld": ["d2"], "excluded": ["b"]})
    assert rows(live) == [("d1",)] and rows(kept) == [("d1", "a")] and rows(inventory) == [("a",)]
    texts = spark.createDataFrame([("ab",), (None,)], "t string")
    assert rows(texts.select(settings.encoded(F.col("t"), lambda xs: [[len(x), 1] for x in xs]))) == [([0.0, 1.0],), ([2.0, 1.0],)]
    assert rows(texts.select(settings.scored(F.col("t"), F.lit("a"), lambda ps: [float(b in a) for a, b in ps]))) == [(0.0,), (1.0,)]
    votes = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (2, None)], "k int, v string")
    assert rows(votes.groupBy("k").agg(settings.majority()("v"))) == [(1, "b"), (2, None)]


def test_axis_registry(spark):
    settings.AXES.clear()

    @settings.axis("wide", "edges")
    def wide(edges):
        return edges.groupBy("parent").count().where("count > 1")

    edges = spark.createDataFrame([("a", "r"), ("b", "r")], "child string, parent string")
    assert list(settings.applicable({})) == [] and rows(settings.applicable({"edges": edges})["wide"]) == [("r", 2)]
    settings.AXES.clear()


def test_folding_and_names(spark):
    df = spark.createDataFrame([("Éć̣ Ångström ệ ﬁ",)], "t string")
    assert df.select(tx.fold(F.col("t"))).first()[0] == "Ec Angstrom e ﬁ"
    names = spark.createDataFrame([("http://www.w3.org/2002/07/owl#Class", None), ("http://x/y#z", None), ("http://x/y/", "Y")], "iri string, label string")
    assert [r[0] for r in names.select(workflow.short_name(F.col("iri"), F.col("label"))).collect()] == ["owl:Class", "…z", "Y"]


def test_readers_rebuild_and_count(spark, tmp_path):
    from conceptflow.sources import readers

    (tmp_path / "d.tsv").write_text("#T_SP=x\n\n#Text=ab cd\n1-1\t0-2\tab\t_\n1-2\t3-5\tcd\tK[1]\n\n2-1\t7-9\tef\tK[1]\n")
    assert [r["text"] for r in readers.webanno_text(spark, str(tmp_path / "d.tsv")).collect()] == ["ab cd\n\nef"]
    span = '<span start="0" end="1" />'
    (tmp_path / "k.xml").write_text("<annotations>" + "".join(f'<annotation><mention id="m{k}" />{span * k}</annotation>' for k in (1, 2, 0)) + "</annotations>")
    assert readers.knowtator_skipped(spark, str(tmp_path / "k.xml")) == 2
    inventory = spark.createDataFrame([("http://x/CL_0000001",), ("http://x/other",)], "iri string")
    assert rows(readers.curies(inventory)) == [("CL:0000001",), ("other",)]
