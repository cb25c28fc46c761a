"""Small cases of the modelling, decision, layout and evidence operators, with nulls, ties and empty tables."""

import itertools

import pytest
from pyspark.sql import functions as F

from conceptflow.functions import text as tx
from conceptflow.operators import decisions, evidence, layout, modelling


@pytest.fixture
def triples(spark):
    return lambda *rows: spark.createDataFrame(rows, "s string, p string, o string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_pitfalls_of_an_empty_and_a_small_graph(triples):
    assert rows(modelling.pitfalls(triples())) == []
    found = modelling.pitfalls(triples(("a", "rdf:type", "owl:Class"), ("a", "rdfs:label", "A"), ("a", "rdfs:subClassOf", "a"), ("_:b", "rdf:type", "owl:Class"), ("p", "rdf:type", "owl:DatatypeProperty"), ("p", "rdfs:range", "x")))
    assert rows(found) == [("P06", "a", "subClassOf"), ("P08", "a", "definition"), ("P11", "p", "domain")]


def test_targets_prefer_the_preferred_name(triples):
    one = modelling.targets(triples(("a", "rdf:type", "owl:Class"), ("a", "rdfs:label", "plain"), ("a", "skos:prefLabel", "best"), ("a", "skos:altLabel", "plain"), ("b", "rdf:type", "owl:Class")))
    assert [(r.iri, r.label, r.alt_labels, r.gloss) for r in one.collect()] == [("a", "best", ["plain"], None)]


def test_rewrite_keeps_the_old_term_as_a_note(spark, triples):
    out = modelling.rewrite(triples(("a", "p", "a")), spark.createDataFrame([("a", "z")], "old string, new string"))
    assert rows(out) == [("z", "p", "z"), ("z", "skos:historyNote", "a")]


def test_nearest_version_of_equal_and_far_graphs(spark, triples):
    versions = spark.createDataFrame([("v1", "a", "p", "b"), ("v2", "a", "p", "b"), ("v3", "x", "p", "y")], "version_id string, s string, p string, o string")
    assert rows(modelling.nearest_version(versions, triples(("a", "p", "b"), ("a", "rdfs:label", "only a name")), 0.1)) == [("v1", 0.0)]
    assert rows(modelling.nearest_version(versions, triples(("q", "p", "q")), 0.5)) == []


def test_qualified_needs_a_modifier_in_front_and_enough_children(spark):
    proposals = spark.createDataFrame([(1, "Startup Company", "c"), (2, " old COMPANY", "c"), (3, "Company", "c"), (4, "Accompany", "c"), (5, None, "c"), (6, "Red Thing", "t")], "id int, label string, parent string")
    parents = spark.createDataFrame([("c", "Company"), ("t", "thing")], "parent string, parent_label string")
    assert rows(modelling.qualified(proposals, parents)) == [("c", 1, "Startup", 2), ("c", 2, "old", 2)]


def test_cited_drops_only_textual_axioms_without_mentions(spark):
    axioms = spark.createDataFrame([(1, "textual", []), (2, "textual", None), (3, "textual", ["m"]), (4, "model", None), (5, None, None)], "id int, provenance string, support array<string>")
    kept, dropped = modelling.cited(axioms, F.col("support"))
    assert [r.id for r in dropped.orderBy("id").collect()] == [1, 2] and kept.count() == 3


def test_diagnoses_equal_brute_force():
    pool = "abcdef"
    for k in range(40):
        conflicts = [frozenset(c for i, c in enumerate(pool) if (k * 7 + j * 13 + i * i) % 3 == 0) or frozenset("a") for j in range(4)]
        brute = []
        for size in (1, 2, 3):
            brute = [frozenset(c) for c in itertools.combinations(pool, size) if all(set(c) & x for x in conflicts)]
            if brute:
                break
        assert decisions.diagnoses(conflicts) == sorted(brute, key=sorted)
    assert decisions.diagnoses([]) == []
    assert decisions.diagnoses([frozenset({i}) for i in "abcd"]) == []


def test_scores_without_orphans_and_support(spark):
    axioms = spark.createDataFrame([(1, "x", True), (1, "y", True), (2, "z", False)], "branch_id int, axiom_id string, adds boolean")
    support = spark.createDataFrame([("x", "m"), ("y", "m")], "axiom_id string, mention_id string")
    assert rows(decisions.scored(axioms, support, 2, 4)) == [(1, 0.5, 0, 1, 0.5), (2, 0.0, 1, 0, 0.0)]
    assert rows(decisions.scored(axioms, support, 0, 0)) == [(1, 0.0, 0, 1, None), (2, 0.0, 1, 0, None)]


def test_precedents_like_puts_comments_first_among_equals(spark):
    told = spark.createDataFrame([(1, "n", "", 5), (2, "n", "why", 4), (3, "n", None, 9), (4, "", "x", 9)], "id int, normal string, comment string, created_at int")
    assert [r.id for r in decisions.precedents_like(told, F.lit(0.7), 5, 0.5).collect()] == [2, 3, 1]
    assert decisions.precedents_like(told, F.lit(0.4), 5, 0.5).count() == 0


def test_reading_order_of_two_columns_and_a_full_width_block(spark):
    boxes = spark.createDataFrame([("r1", 320.0, 10.0, 590.0), ("l2", 10.0, 30.0, 280.0), ("l1", 10.0, 20.0, 280.0), ("w", 10.0, 40.0, 590.0), ("l3", 10.0, 50.0, 280.0)], "id string, x0 double, y0 double, x1 double")
    placed = layout.reading_order(boxes.withColumns({"document_id": F.lit("d"), "page": F.lit(1)}), 600.0)
    assert [r.id for r in placed.orderBy("place").collect()] == ["l1", "l2", "r1", "w", "l3"]


def test_passages_spread_over_documents(spark):
    blocks = spark.createDataFrame([(1, 0, "An ion is a thing."), (1, 1, "Ion means x"), (2, 0, "we define ion"), (2, 1, None), (3, 0, "lion is a cat")], "document_id int, ordinal int, text string")
    surfaces = spark.createDataFrame([("i", "Ion", 0), ("e", "", 0), ("q", "a.b (c", 0)], "iri string, surface string, place int")
    assert rows(layout.passages(blocks, surfaces, 2)) == [("i", 1, 0, "is a", "Ion"), ("i", 2, 0, "we define", "Ion")]
    assert layout.passages(blocks, surfaces, 9).count() == 3


@pytest.mark.parametrize(("strategy", "n"), [("all", 10), ("none", 4), ("sample", 7)])
def test_reload_always_takes_new_documents(spark, strategy, n):
    ids = spark.range(10).withColumnRenamed("id", "document_id")
    out = evidence.reload(ids, ids.where("document_id < 6"), strategy, 0.5, 1)
    assert out.count() == 10 and out.where("process").count() == n and out.where("document_id >= 6 and not process").count() == 0
    assert rows(out) == rows(evidence.reload(ids, ids.where("document_id < 6"), strategy, 0.5, 1))


def test_hold_out_takes_one_at_least_and_never_all(spark):
    for n, share, taken in ((1, 0.9, 1), (4, 1.0, 3), (4, 0.0, 1), (0, 0.5, 0)):
        assert evidence.hold_out(spark.range(n).select(F.col("id").cast("string").alias("iri")), share, 1).count() == taken


def test_text_scalars(spark):
    one = lambda *columns: tuple(spark.range(1).select(*columns).first())
    assert one(tx.has_phrase(F.lit("a new\n ion trap"), F.lit("ion trap")), tx.has_phrase(F.lit("x"), F.lit("?"))) == (True, False)
    assert one(tx.sentence_around(F.lit("One. Two b c! Three"), F.lit(9), F.lit(10)), tx.sentence_around(F.lit("word " * 300), F.lit(700), F.lit(704), 10)) == ("Two b c!", "word word word word word"[:24].strip())
    assert one(tx.odd_capitals(F.lit("TIene")), tx.odd_capitals(F.lit("fooBar")), tx.odd_capitals(F.lit("USA"))) == ("Tiene", None, None)
    assert one(tx.outer_json(F.lit('x {"a": 1} y')), tx.outer_json(F.lit("none")), tx.outer_json(F.lit(None).cast("string"))) == ('{"a": 1}', None, None)


def test_abbreviations_keep_order_and_first_letter(spark):
    lexicon = spark.createDataFrame([("en", "frm", 1), ("en", "framework", 4), ("en", "farmland", 1), ("en", "mrf", 1), ("es", "frm", 1), ("en", "fr", 1)], "lang string, token string, n int")
    assert rows(evidence.abbreviations(lexicon)) == [("en", "frm", "farmland")]


def test_verified_names_need_their_words_in_a_passage(spark):
    answers = spark.createDataFrame([("a", "Ion Trap"), ("a", "known"), ("a", "?"), ("b", "ion trap")], "iri string, name string")
    passages = spark.createDataFrame([("a", "an ION\n trap"), ("a", None)], "iri string, text string")
    assert rows(evidence.verified_names(answers, passages, spark.createDataFrame([("KNOWN",)], "name string"))) == [("a", "?", False), ("a", "Ion Trap", True), ("b", "ion trap", False)]


def test_split_documents_leaves_neither_side_empty(spark):
    for n, held in ((0, 0), (1, 1), (2, 1), (10, 9)):
        ids = spark.range(n).withColumnRenamed("id", "document_id")
        assert evidence.split_documents(ids, 1.0, 1).where("held_out").count() == held
