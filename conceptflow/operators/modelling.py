"""Checks, targets and edits of an ontology held as triples (s, p, o); a triple table is a set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conceptflow.operators import graph
from conceptflow.operators.state import prefer

# Fixed values: (metaproperty, value of the parent, value of the child) that must not meet in a subsumption.
CONSTRAINTS = [("rigidity", "~R", "+R"), ("identity", "-I", "+I"), ("unity", "~U", "+U"), ("dependence", "+D", "-D")]
# Predicates that name and define a class, the preferred one first.
NAMES = ["skos:prefLabel", "rdfs:label", "skos:altLabel"]
DEFINITIONS = ["skos:definition", "rdfs:comment"]


def _judged(edges: DataFrame, marks: DataFrame) -> DataFrame:
    """Distinct subsumptions with the metaproperties of both ends as structs, null where an end has none."""
    kinds = F.struct(*[name for name, _, _ in CONSTRAINTS])
    below, above = (marks.select(F.col("iri").alias(end), kinds.alias(f"_{end}")) for end in ("child", "parent"))
    return edges.select("child", "parent").distinct().join(below, "child", "left").join(above, "parent", "left")


def ontoclean(edges: DataFrame, marks: DataFrame) -> DataFrame:
    """(child, parent, metaproperty) of subsumptions that break a constraint; ``marks``: (iri, rigidity, identity, unity, dependence)."""
    broken = [F.when((F.col(f"_parent.{name}") == up) & (F.col(f"_child.{name}") == down), name) for name, up, down in CONSTRAINTS]
    return _judged(edges, marks).select("child", "parent", F.explode(F.array_compact(F.array(*broken))).alias("metaproperty"))


def ontoclean_coverage(edges: DataFrame, marks: DataFrame) -> DataFrame:
    """(checked, skipped): subsumptions with both ends judged, and the others."""
    both = F.col("_child").isNotNull() & F.col("_parent").isNotNull()
    return _judged(edges, marks).agg(F.count_if(both).alias("checked"), F.count_if(~both).alias("skipped"))


def pitfalls(triples: DataFrame) -> DataFrame:
    """(pitfall, subject, detail): P08 names, P11 and P19 domain and range, P24 self-definition, in one pass by subject; P06 cycles."""
    p, o = F.col("p"), F.col("o")
    kinds = ("owl:ObjectProperty", "owl:DatatypeProperty")
    facts = triples.where(~F.col("s").startswith("_:")).groupBy("s").agg(
        F.bool_or((p == "rdf:type") & (o == "owl:Class")).alias("is_class"),
        F.bool_or((p == "rdf:type") & o.isin(*kinds)).alias("is_property"),
        F.bool_or(p.isin(*NAMES[:2])).alias("label"),
        F.bool_or(p.isin(*DEFINITIONS)).alias("definition"),
        F.count_if(p == "rdfs:domain").alias("domain"),
        F.count_if(p == "rdfs:range").alias("range"),
        F.bool_or((p == "owl:equivalentClass") & (o == F.col("s"))).alias("self"),
    )
    smell = lambda test, name, detail: F.when(test, F.struct(F.lit(name).alias("pitfall"), F.lit(detail).alias("detail")))
    tests = [smell(F.col("is_class") & ~F.col(c), "P08", c) for c in ("label", "definition")]
    for c in ("domain", "range"):
        tests += [smell(F.col("is_property") & (F.col(c) == 0), "P11", c), smell(F.col("is_property") & (F.col(c) > 1), "P19", c)]
    tests.append(smell(F.col("is_class") & F.col("self"), "P24", "equivalentClass"))
    found = facts.select("s", F.explode(F.array_compact(F.array(*tests))).alias("x")).select("x.pitfall", F.col("s").alias("subject"), "x.detail")
    classes = facts.where("is_class").select(F.col("s").alias("iri"))
    edges = triples.where(p == "rdfs:subClassOf").select(F.col("s").alias("child"), o.alias("parent"))
    loops = graph.cycles(graph.ancestors(edges)).join(classes, "iri", "left_semi")
    return found.unionByName(loops.select(F.lit("P06").alias("pitfall"), F.col("iri").alias("subject"), F.lit("subClassOf").alias("detail")))


def targets(triples: DataFrame) -> DataFrame:
    """(iri, label, alt_labels, gloss, has_key) of every named class with a name; arrays are sorted within each kind of name."""
    p, o = F.col("p"), F.col("o")
    rows = triples.where(~F.col("s").startswith("_:") & p.isin("rdf:type", "owl:hasKey", "skos:definition", "rdfs:comment", *NAMES))
    place = F.when(p == NAMES[0], 0).when(p == NAMES[1], 1).when(p == NAMES[2], 2)
    one = rows.groupBy(F.col("s").alias("iri")).agg(
        F.bool_or((p == "rdf:type") & (o == "owl:Class")).alias("is_class"),
        F.sort_array(F.collect_set(F.when(p.isin(*NAMES), F.struct(place.alias("k"), o.alias("o"))))).alias("names"),
        F.coalesce(F.min(F.when(p == "skos:definition", o)), F.min(F.when(p == "rdfs:comment", o))).alias("gloss"),
        F.sort_array(F.collect_set(F.when(p == "owl:hasKey", o))).alias("has_key"),
    )
    names = F.array_distinct(F.transform("names", lambda x: x["o"]))
    named = one.where(F.col("is_class") & (F.size("names") > 0)).withColumn("n", names)
    return named.select("iri", F.col("n")[0].alias("label"), F.slice("n", 2, F.size("n")).alias("alt_labels"), "gloss", "has_key")


def qualified(proposals: DataFrame, parents: DataFrame, min_group: int = 2) -> DataFrame:
    """(parent, id, qualifier, n): proposals (id, label, parent) that are the parent's label behind a modifier, where a parent has
    ``min_group`` of them; the question is then whether the modifier is a kind or a value. ``parents``: (parent, parent_label)."""
    lower, top = F.lower(F.trim("label")), F.lower(F.trim("parent_label"))
    fits = proposals.join(parents, "parent").where((top != "") & F.endswith(lower, F.concat(F.lit(" "), top)))
    rest = F.trim(F.substring(F.trim("label"), F.lit(1), F.length(F.trim("label")) - F.length(F.trim("parent_label"))))
    rows = fits.select("parent", "id", rest.alias("qualifier"))
    many = rows.groupBy("parent").agg(F.count("*").alias("n")).where(F.col("n") >= min_group)
    return rows.join(many, "parent")


def apply_axioms(triples: DataFrame, axioms: DataFrame) -> DataFrame:
    return triples.select("s", "p", "o").unionByName(axioms.select("s", "p", "o")).distinct()


def redefine(triples: DataFrame, changes: DataFrame) -> DataFrame:
    """All values of the (s, p) that ``changes`` has are replaced by theirs."""
    return triples.select("s", "p", "o").join(changes.select("s", "p").distinct(), ["s", "p"], "left_anti").unionByName(changes.select("s", "p", "o").distinct())


def rewrite(triples: DataFrame, mapping: DataFrame) -> DataFrame:
    """Terms of ``mapping`` (old, new) are replaced in all three positions; a note on each new term keeps the old one."""
    out = triples.select("s", "p", "o")
    for c in ("s", "p", "o"):
        out = out.join(mapping.select(F.col("old").alias(c), F.col("new").alias("_new")), c, "left").withColumn(c, F.coalesce("_new", c)).drop("_new")
    notes = mapping.select(F.col("new").alias("s"), F.lit("skos:historyNote").alias("p"), F.col("old").alias("o"))
    return out.select("s", "p", "o").unionByName(notes).distinct()


def carried(before: DataFrame, after: DataFrame) -> DataFrame:
    """Definitions of ``before`` whose subject is a class of ``after`` and has none there."""
    p = F.col("p")
    old = before.where(p == "skos:definition").select("s", "p", "o")
    classes = after.where((p == "rdf:type") & (F.col("o") == "owl:Class")).select("s")
    return old.join(classes, "s", "left_semi").join(after.where(p == "skos:definition").select("s"), "s", "left_anti")


def minted(root: DataFrame, head: DataFrame) -> DataFrame:
    """(iri): named classes that ``head`` has and ``root`` hasn't."""
    named = lambda t: t.where("p = 'rdf:type' and o = 'owl:Class' and not startswith(s, '_:')").select(F.col("s").alias("iri"))
    return named(head).subtract(named(root))


def nearest_version(versions: DataFrame, current: DataFrame, threshold: float) -> DataFrame:
    """(version_id, distance) of the version whose logic has the least Jaccard distance to ``current``, up to ``threshold``.

    ``versions``: (version_id, s, p, o). Ties go to the smaller id. No row where nothing is near.
    """
    own = graph.logical(current).withColumn("_own", F.lit(1))
    size = own.agg(F.count("*").alias("n_own"))
    logic = versions.where(~F.col("p").isin(graph.ANNOTATIONS)).select("version_id", "s", "p", "o").distinct()
    counts = logic.join(own, ["s", "p", "o"], "left").groupBy("version_id").agg(F.count("*").alias("n"), F.count("_own").alias("both"))
    union = F.col("n") + F.col("n_own") - F.col("both")
    far = counts.join(F.broadcast(size)).select("version_id", (1 - F.col("both") / union).alias("distance"))  # one row
    return far.where(F.col("distance") <= threshold).orderBy("distance", "version_id").limit(1)


def history(versions: DataFrame) -> DataFrame:
    """(seq, added, removed) of each version against the one before, from (seq, s, p, o) with seq gapless; one shuffle of the triples."""
    rows = versions.where(~F.col("p").isin(graph.ANNOTATIONS)).select("seq", "s", "p", "o", F.lit(True).alias("now"))
    before = rows.select((F.col("seq") + 1).alias("seq"), "s", "p", "o", F.lit(False).alias("now"))
    met = rows.unionByName(before).groupBy("seq", "s", "p", "o").agg(F.bool_or("now").alias("now"), F.bool_or(~F.col("now")).alias("was"))
    steps = met.groupBy("seq").agg(F.count_if(F.col("now") & ~F.col("was")).alias("added"), F.count_if(~F.col("now")).alias("removed"))
    return steps.join(versions.select("seq").distinct(), "seq", "left_semi")


def normal_form(axioms: DataFrame, names: DataFrame) -> DataFrame:
    """(id, normal): a proposal's logic with labels for iris, lower-cased and sorted, so it is recognised under other iris.

    ``axioms``: (id, s, p, o), a handful for each proposal; ``names``: (iri, label).
    """
    out = axioms.where(~F.col("p").isin(graph.ANNOTATIONS)).select("id", "s", "p", "o")
    for c in ("s", "o"):
        out = out.join(names.select(F.col("iri").alias(c), F.col("label").alias("_label")), c, "left").withColumn(c, F.lower(F.coalesce("_label", c))).drop("_label")
    return out.groupBy("id").agg(F.array_join(F.sort_array(F.collect_set(F.concat_ws(" ", "s", "p", "o"))), "\n").alias("normal"))


def cited(axioms: DataFrame, support: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): an axiom of textual provenance needs a mention that it rests on; the others need none."""
    bare = F.coalesce((F.col("provenance") == "textual") & (F.coalesce(F.size(support), F.lit(0)) < 1), F.lit(False))
    return axioms.where(~bare), axioms.where(bare)


def latest(versions: DataFrame) -> DataFrame:
    """The newest version of each session: by created_at, then seq."""
    return prefer(versions, ["session_id"], [F.desc("created_at"), F.desc("seq")])


def recurrences(versions: DataFrame) -> DataFrame:
    """(version_id, earlier): versions whose hash stood before in their session, and the oldest with it; ``versions`` has seq."""
    first = versions.groupBy("session_id", "hash").agg(F.min_by("version_id", "seq").alias("earlier"), F.min("seq").alias("_seq"))
    return versions.join(first, ["session_id", "hash"]).where("seq > _seq").select("version_id", "earlier")


def gloss_contexts(triples: DataFrame) -> DataFrame:
    """(iri, relation, other): parents, children and disjoint classes of the named classes without a definition; alone: one row with nulls."""
    p = F.col("p")
    classes = triples.where((p == "rdf:type") & (F.col("o") == "owl:Class") & ~F.col("s").startswith("_:")).select(F.col("s").alias("iri")).distinct()
    bare = classes.join(triples.where(p.isin(*DEFINITIONS)).select(F.col("s").alias("iri")), "iri", "left_anti")
    links = triples.where(p.isin("rdfs:subClassOf", "owl:disjointWith"))
    both = F.array(
        F.struct(F.col("s").alias("iri"), F.when(p == "rdfs:subClassOf", "parent").otherwise("disjoint").alias("relation"), F.col("o").alias("other")),
        F.struct(F.col("o").alias("iri"), F.when(p == "rdfs:subClassOf", "child").otherwise("disjoint").alias("relation"), F.col("s").alias("other")),
    )
    return bare.join(links.select(F.explode(both).alias("x")).select("x.*").distinct(), "iri", "left").select("iri", "relation", "other")
