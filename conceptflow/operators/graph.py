"""Triples and hierarchies: closure, depth, checks, diffs, hashes, blank nodes, graph patterns, individuals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from conceptflow.operators import parts
from conceptflow.session import cut, discard, shelve

# Predicates that annotate and don't count as logic.
ANNOTATIONS = ["rdfs:label", "rdfs:comment", "skos:prefLabel", "skos:altLabel", "skos:definition", "skos:note", "owl:versionInfo", "owl:deprecated"]


def ancestors(edges: DataFrame) -> DataFrame:
    """(child, ancestor) of all chains of (child, parent), by semi-naive steps; cycles are safe (a node may reach itself)."""
    base = edges.select("child", F.col("parent").alias("ancestor")).where("child is not null and ancestor is not null").distinct()
    done = fresh = cut(base)
    while not fresh.isEmpty():
        step = fresh.withColumnRenamed("ancestor", "mid").join(base.withColumnRenamed("child", "mid"), "mid").select("child", "ancestor").distinct()
        fresh = cut(step.join(done, ["child", "ancestor"], "left_anti"))
        done = cut(done.unionByName(fresh))
    return done


def depths(edges: DataFrame) -> DataFrame:
    """(node, depth): the longest chain from a root, roots being 1; nodes on a cycle or below one alone have no root and no row.

    A node gets its depth once all its parents have theirs, so each is visited once.
    """
    own = cut(edges.select("child", "parent").where("child is not null and parent is not null and child <> parent").distinct())
    nodes = own.select(F.col("parent").alias("node")).union(own.select("child")).distinct()
    done = level = cut(nodes.join(own.select(F.col("child").alias("node")), "node", "left_anti").withColumn("depth", F.lit(1)))
    left = own
    while not level.isEmpty():
        # Edges from settled parents; a child is ready if none of its edges comes from another.
        known = left.join(done.select(F.col("node").alias("parent"), "depth"), "parent", "left")
        ready = known.groupBy(F.col("child").alias("node")).agg(F.bool_and(F.col("depth").isNotNull()).alias("all"), (F.max("depth") + 1).alias("depth")).where("all")
        level = cut(ready.select("node", "depth"))
        done = cut(done.unionByName(level))
        left = cut(left.join(level.select(F.col("node").alias("child")), "child", "left_anti"))
    return done


def structure(edges: DataFrame, classes: DataFrame, max_branching: int) -> DataFrame:
    """(kind, subject, n): branching above the limit, levels with one child, classes outside the hierarchy."""
    kids = edges.groupBy("parent").agg(F.countDistinct("child").alias("n"))
    wide = kids.where(F.col("n") > max_branching).select(F.lit("branching").alias("kind"), F.col("parent").alias("subject"), "n")
    single = kids.where("n = 1").select(F.lit("single_child_level").alias("kind"), F.col("parent").alias("subject"), "n")
    linked = edges.select(F.col("child").alias("subject")).union(edges.select("parent"))
    alone = classes.select(F.col("iri").alias("subject")).join(linked, "subject", "left_anti")
    return wide.unionByName(single).unionByName(alone.select(F.lit("orphan_class").alias("kind"), "subject", F.lit(0).cast("bigint").alias("n")))


def cycles(closure: DataFrame) -> DataFrame:
    return closure.where("child = ancestor").select(F.col("child").alias("iri")).distinct()


def incompatible(disjoint: DataFrame, closure: DataFrame) -> DataFrame:
    """(a, b) with a < b: disjointness inherited by all descendants.

    Classes under the same disjoint ones are alike, so kinds of classes are
    compared first; each pair of classes then comes from its one pair of kinds,
    and the pairs are neither shuffled nor compared.
    """
    below = closure.select(F.col("ancestor").alias("top"), F.col("child").alias("iri"))
    own = disjoint.select(F.explode(F.array("a", "b")).alias("top")).where("top is not null").distinct()
    below = below.join(own, "top", "left_semi").unionByName(own.select("top", F.col("top").alias("iri")))
    tops = below.where("iri is not null").groupBy("iri").agg(F.sort_array(F.collect_set("top")).alias("tops"))
    classes = shelve(tops.select("iri", "tops", F.sha2(F.to_json("tops").cast("binary"), 256).alias("kind")))
    kinds = classes.select("kind", "tops").distinct().select("kind", F.explode("tops").alias("top"))
    left, right = kinds.select(F.col("kind").alias("_s"), F.col("top").alias("a")), kinds.select(F.col("kind").alias("_t"), F.col("top").alias("b"))
    met = disjoint.select("a", "b").join(left, "a").join(right, "b").select(F.least("_s", "_t").alias("_s"), F.greatest("_s", "_t").alias("_t")).distinct()
    x, y = (classes.select(F.col("kind").alias(k), F.col("iri").alias(c)).join(met, k) for k, c in (("_s", "x"), ("_t", "y")))
    pairs = parts.paired(x, y, ["_s", "_t"], "x", "y").where((F.col("_s") < F.col("_t")) | (F.col("x") < F.col("y")))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def conflicts(typed: DataFrame, closure: DataFrame) -> DataFrame:
    """(entity, iris): entities typed to several classes none of which follows from another."""
    own = typed.select("entity", "iri").distinct()
    implied = own.join(closure.withColumnRenamed("child", "iri"), "iri").select("entity", F.col("ancestor").alias("iri")).distinct()
    left = own.join(implied, ["entity", "iri"], "left_anti")
    return left.groupBy("entity").agg(F.array_join(F.sort_array(F.collect_set("iri")), ",").alias("iris"), F.count("*").alias("n")).where("n > 1").drop("n")


def _folded(*c) -> list:
    """Aggregates h0 to h3 that tell bags of rows apart, whatever their order: sums of the halves of two hashes of each row, which 2 ** 31 rows can't overflow."""
    halves = [half for k in range(2) for h in [F.xxhash64(F.lit(k), *c)] for half in (h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32))]
    return [F.sum(half).alias(f"h{k}") for k, half in enumerate(halves)]


def blank_labels(triples: DataFrame) -> DataFrame:
    """(node, label) of blank nodes (``_:``), whatever the parser called them.

    A label digests the edges around a node, each with its direction,
    predicate and the other end: the term itself, or the other blank node's label
    of the round before. Rounds go on while they tell more nodes apart; so equal
    graphs get equal labels, cycles of blank nodes included. Nodes that no round
    tells apart stand alike in the graph; they are numbered, in any order.

    Edges are hashed one by one and the hashes folded, so no task holds a node's
    edges. Only edges between blank nodes are read again after the first round,
    and the tables of a round are deleted after the next.
    """
    blank = lambda c: F.col(c).startswith("_:")
    digest = lambda *c: F.substring(F.sha2(F.concat_ws(",", *c).cast("binary"), 256), 1, 32)
    held = ("h0", "h1", "h2", "h3")
    edges = triples.where(blank("s") | blank("o")).select("s", "p", "o").distinct()
    end = lambda node, out, other: F.struct(F.col(node).alias("node"), F.lit(out).alias("out"), "p", F.col(other).alias("other"))
    both = F.array_compact(F.array(F.when(blank("o"), end("o", 0, "s")), F.when(blank("s"), end("s", 1, "o"))))
    around = edges.select(F.explode(both).alias("x")).select("x.*")
    # Whether the other end is null, blank or a term is hashed too: null columns leave a hash as it is.
    shape = F.when(blank("other"), 2).when(F.col("other").isNull(), 1).otherwise(0)
    first = around.groupBy("node").agg(*_folded("out", F.col("p").isNull(), "p", shape, F.when(~blank("other"), F.col("other"))))
    labels = shelve(first.select("node", digest(*held).alias("label")))
    nodes, kinds = labels.agg(F.count("*"), F.countDistinct("label")).first()
    inner = None
    while kinds < nodes:
        if inner is None:
            inner = shelve(around.where(blank("other")))
        told = inner.join(labels.select(F.col("node").alias("other"), "label").hint("merge"), "other")
        # The node's own former label goes in too, so that a class of nodes is only ever split.
        seen = told.groupBy("node").agg(*_folded("out", F.col("p").isNull(), "p", "label"))
        former, labels = labels, shelve(labels.join(seen.hint("merge"), "node", "left").select("node", digest("label", *held).alias("label")))
        discard(former)
        n = labels.agg(F.countDistinct("label")).first()[0]
        if n <= kinds:
            break
        kinds = n
    if inner is not None:
        discard(inner)
    if kinds == nodes:
        return labels
    twin = F.row_number().over(Window.partitionBy("label").orderBy("node")) - 1
    return labels.select("node", F.concat_ws(".", "label", F.when(twin > 0, twin.cast("string"))).alias("label"))


def stable(triples: DataFrame) -> DataFrame:
    """``triples`` (s, p, o) with blank nodes under labels that only depend on the graph."""
    rows = triples.select("s", "p", "o")
    if rows.where(F.col("s").startswith("_:") | F.col("o").startswith("_:")).isEmpty():
        return rows
    names = blank_labels(rows)
    for end in ("s", "o"):
        named = rows.join(names.select(F.col("node").alias(end), "label").hint("merge"), end, "left")
        rows = named.withColumn(end, F.coalesce(F.concat(F.lit("_:"), "label"), end)).select("s", "p", "o")
    return rows


def logical(triples: DataFrame) -> DataFrame:
    """The triples that aren't annotations, once each, blank nodes under stable labels."""
    return stable(triples.where(~F.col("p").isin(ANNOTATIONS))).distinct()


def changes(old: DataFrame, new: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """``diff`` of graphs whose logic, ``old`` and ``new``, is known.

    Both graphs' triples meet in one aggregate by themselves: no side is sent to
    all tasks, however small its file made it look. Annotations are no logic, so
    a predicate tells which of both a triple came from.
    """
    named = ["rdfs:label", "skos:prefLabel"]
    side = lambda rows, was: rows.select("s", "p", "o", F.lit(was).alias("was"), F.lit(not was).alias("now"))
    names = lambda t: t.where(F.col("p").isin(*named))
    every = reduce(DataFrame.unionAll, [side(old, True), side(new, False), side(names(before), True), side(names(after), False)])
    met = every.groupBy("s", "p", "o").agg(F.bool_or("was").alias("was"), F.bool_or("now").alias("now")).where("was <> now")
    change = F.when(F.col("p").isin(*named), "label").when(F.col("now"), "added").otherwise("removed")
    return met.select(change.alias("change"), "s", "p", "o")


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(change, s, p, o): added and removed logic, and labels that differ."""
    return changes(logical(before), logical(after), before, after)


def state_hash(triples: DataFrame) -> DataFrame:
    """(n, hash): an order-free digest of the logic, blind to the names of blank nodes."""
    return digest(logical(triples))


def digest(logic: DataFrame) -> DataFrame:
    """``state_hash`` of a graph whose logic is known.

    A tree of digests: lines by six hex digits of their hashes, those by three,
    those in one. A task holds a sixteen-millionth of the graph, or 4,096 digests.
    """
    line = F.sha2(F.concat_ws(" ", "s", "p", "o").cast("binary"), 256)
    joined = lambda c: F.sha2(F.array_join(c, "\n").cast("binary"), 256)
    sorted_ = lambda: F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"])
    leaves = logic.select(line.alias("h")).groupBy(F.substring("h", 1, 6).alias("b")).agg(joined(F.sort_array(F.collect_list("h"))).alias("h"), F.count("*").alias("n"))
    inner = leaves.groupBy(F.substring("b", 1, 3).alias("t")).agg(joined(sorted_()).alias("h"), F.sum("n").alias("n")).withColumnRenamed("t", "b")
    return inner.agg(F.sum("n").alias("n"), joined(sorted_()).alias("hash"))


def match(triples: DataFrame, patterns: list[tuple[str, str, str]], not_exists: list[tuple[str, str, str]] = ()) -> DataFrame:
    """A basic graph pattern as equi-joins: ``?x`` are variables, a predicate with ``+`` is a chain of one or more.

    ``not_exists``: patterns, each excluded by an anti-join on the variables it shares.
    """

    def one(pattern: tuple[str, str, str]) -> DataFrame:
        s, p, o = pattern
        rows = triples
        if p.endswith("+"):
            edges = triples.where(F.col("p") == p[:-1]).select(F.col("s").alias("child"), F.col("o").alias("parent"))
            rows, p = ancestors(edges).select(F.col("child").alias("s"), F.lit(p).alias("p"), F.col("ancestor").alias("o")), p
        for name, term in (("s", s), ("p", p), ("o", o)):
            if not term.startswith("?"):
                rows = rows.where(F.col(name) == term)
        held: dict[str, str] = {}
        for name, term in (("s", s), ("p", p), ("o", o)):
            if term.startswith("?"):
                if term in held:
                    rows = rows.where(F.col(name) == F.col(held[term]))
                held.setdefault(term, name)
        return rows.select([F.col(name).alias(term[1:]) for term, name in held.items()]).distinct()

    def join(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        return left.join(right, [c for c in left.columns if c in right.columns], how)

    found = reduce(lambda a, b: join(a, b, "inner"), map(one, patterns))
    return reduce(lambda a, b: join(a, b, "left_anti"), map(one, not_exists), found)


def value_counts(triples: DataFrame, name: str) -> DataFrame:
    """(p, s, ``name``): how many values each subject has of each property, in tasks of bounded length; one subject's values are dealt too."""
    n = parts.tasks(triples)
    once = triples.select("p", "s", "o").repartition(n, "p", "s", "o").distinct()
    return once.repartition(n, "s").groupBy("p", "s").agg(F.count("o").alias(name))


def functional_survey(triples: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """(p, individuals, most, refuted): how many values individuals have of each property; unresolved ones are left out."""
    rows = triples if excluded is None else triples.join(excluded, "s", "left_anti")
    per = value_counts(rows, "n")
    return per.groupBy("p").agg(F.count("*").alias("individuals"), F.max("n").alias("most"), (F.max("n") > 1).alias("refuted"))


def labels(triples: DataFrame) -> DataFrame:
    """(iri, label): the preferred label beats the plain one."""
    pick = lambda p: F.min(F.when(F.col("p") == p, F.col("o")))
    rows = triples.where(F.col("p").isin("skos:prefLabel", "rdfs:label"))
    return rows.groupBy(F.col("s").alias("iri")).agg(F.coalesce(pick("skos:prefLabel"), pick("rdfs:label")).alias("label"))


def individuals(typed: DataFrame, marks: DataFrame, policy: str = "flag") -> DataFrame:
    """(s, p, o) of regenerated individuals from (entity, mention_id, iri): marked mentions go first, untyped entities stay.

    policy ``force``: the class with most mentions, the larger iri in a tie;
    ``flag``: all classes, and a flag where they are several.
    """
    live = typed.join(marks, "mention_id", "left_anti")
    support = live.where("iri is not null").groupBy("entity", "iri").agg(F.count("*").alias("n"))
    if policy == "force":
        support = support.groupBy("entity").agg(F.max(F.struct("n", "iri")).alias("m")).select("entity", F.col("m.iri").alias("iri"))
    types = support.select("entity", F.lit("rdf:type").alias("p"), F.col("iri").alias("o"))
    several = support.groupBy("entity").agg(F.count("*").alias("n")).where("n > 1").select("entity", F.lit("flag").alias("p"), F.lit("several_classes").alias("o"))
    sources = live.select("entity", F.lit("prov:mention").alias("p"), F.col("mention_id").cast("string").alias("o"))
    kinds = live.select("entity").distinct().select("entity", F.lit("rdf:type").alias("p"), F.lit("owl:NamedIndividual").alias("o"))
    return types.unionByName(several).unionByName(sources).unionByName(kinds).select(F.col("entity").cast("string").alias("s"), "p", "o")


def provenance(typed: DataFrame, marks: DataFrame) -> DataFrame:
    """(s, p, o, g): the quads of individuals' mentions, in a graph for each document; marked mentions are left out.

    ``typed``: (entity, mention_id, iri, document_id, surface).
    """
    live = typed.join(marks, "mention_id", "left_anti")
    mention = F.concat(F.lit("mention/"), F.col("mention_id").cast("string"))
    fact = lambda s, p, o: F.struct(s.cast("string").alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"))
    facts = F.array(fact(F.col("entity"), "prov:wasDerivedFrom", mention), fact(mention, "nif:anchorOf", F.col("surface")), fact(mention, "itsrdf:taIdentRef", F.col("iri")))
    rows = live.select(F.concat(F.lit("document/"), F.col("document_id").cast("string")).alias("g"), F.explode(facts).alias("x"))
    return rows.select("x.s", "x.p", "x.o", "g").where("o is not null").distinct()


def lineage(versions: DataFrame, tip: str) -> DataFrame:
    """(version_id, steps) from ``tip`` to its root; a loop ends where it closes."""
    edges = versions.select(F.col("version_id").alias("child"), F.col("parent_id").alias("parent"))
    above = ancestors(edges.where("parent is not null")).where(F.col("child") == tip).select(F.col("ancestor").alias("version_id"))
    chain = above.union(versions.where(F.col("version_id") == tip).select("version_id")).distinct()
    return chain.join(versions, "version_id").select("version_id", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("seq"))).alias("steps"))
