"""Queries of the modelling, decision, layout and evidence operators over the driver's tables, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conceptflow import ledger
from conceptflow.functions import text as tx
from conceptflow.operators import decisions, evidence, layout, modelling
from conceptflow.plans.catalog import Tables, query


def _iri(kind: str, key: str | Column) -> Column:
    return F.concat(F.lit(f"{kind}/"), (F.col(key) if isinstance(key, str) else key).cast("string"))


def _pick(values: list[str], at: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.expr(at).cast("int") + 1)


# --- ontology ----------------------------------------------------------------


def _kinds(t: Tables) -> tuple[DataFrame, DataFrame]:
    keys = t.part.selectExpr("cast(p_partkey as bigint) as k", "'p' as kind").union(t.part.selectExpr("cast(p_size % 10 as bigint) as k", "'b' as kind").distinct())
    marks = keys.where("k % 6 <> 0").select(
        F.concat_ws("/", "kind", F.col("k").cast("string")).alias("iri"), _pick(["+R", "-R", "~R"], "k % 3").alias("rigidity"), _pick(["+I", "-I"], "k % 2").alias("identity"),
        _pick(["+U", "~U"], "(k div 2) % 2").alias("unity"), _pick(["+D", "-D"], "k % 5 % 2").alias("dependence"),
    )
    return t.part.select(_iri("p", "p_partkey").alias("child"), _iri("b", F.expr("p_size % 10")).alias("parent")), marks


_KINDS = """k AS (SELECT 'p/' || p_partkey AS child, 'b/' || (p_size % 10) AS parent, p_partkey AS x, p_size % 10 AS y FROM part)"""


@query(f"""WITH {_KINDS} SELECT child, parent, metaproperty FROM (SELECT *, unnest([CASE WHEN y % 3 = 2 AND x % 3 = 0 THEN 'rigidity' END, CASE WHEN y % 2 = 1 AND x % 2 = 0 THEN 'identity' END,
CASE WHEN (y // 2) % 2 = 1 AND (x // 2) % 2 = 0 THEN 'unity' END, CASE WHEN y % 5 % 2 = 0 AND x % 5 % 2 = 1 THEN 'dependence' END]) AS metaproperty FROM k WHERE x % 6 <> 0 AND y % 6 <> 0) WHERE metaproperty IS NOT NULL""")
def ontoclean_violations(t: Tables) -> DataFrame:
    return modelling.ontoclean(*_kinds(t))


@query(f"WITH {_KINDS} SELECT count(*) FILTER (x % 6 <> 0 AND y % 6 <> 0) AS checked, count(*) FILTER (x % 6 = 0 OR y % 6 = 0) AS skipped FROM k")
def ontoclean_coverage(t: Tables) -> DataFrame:
    return modelling.ontoclean_coverage(*_kinds(t))


def _facts(rows: DataFrame, s: Column, facts: list[tuple[str, str, Column | None]]) -> DataFrame:
    """Triples of each row: (predicate, condition, object)."""
    one = [F.when(F.expr(test), F.struct(F.lit(p).alias("p"), o.alias("o"))) for p, test, o in facts]
    return rows.select(s.alias("s"), F.explode(F.array_compact(F.array(*one))).alias("x")).select("s", "x.p", "x.o")


def _ontology(t: Tables) -> DataFrame:
    s = _iri("p", "p_partkey")
    classes = _facts(t.part, s, [
        ("rdf:type", "true", F.lit("owl:Class")), ("rdfs:label", "p_partkey % 3 <> 0", F.col("p_name")), ("skos:prefLabel", "p_partkey % 5 = 0", F.upper("p_name")), ("skos:altLabel", "p_partkey % 2 = 0", F.col("p_type")),
        ("skos:definition", "p_partkey % 4 <> 0", F.col("p_type")), ("owl:hasKey", "p_partkey % 6 = 1", F.col("p_brand")), ("owl:equivalentClass", "p_partkey % 11 = 0", s),
        ("rdfs:subClassOf", "p_partkey % 50 = 1", _iri("p", F.col("p_partkey") + 1)), ("rdfs:subClassOf", "p_partkey % 50 = 2", _iri("p", F.col("p_partkey") - 1)),
    ])
    own = _iri("s", "s_suppkey")
    return classes.unionByName(_facts(t.supplier, own, [
        ("rdf:type", "true", F.lit("owl:ObjectProperty")), ("rdfs:domain", "s_suppkey % 3 <> 0", F.lit("x")), ("rdfs:domain", "s_suppkey % 5 = 0", F.lit("y")), ("rdfs:range", "s_suppkey % 2 = 0", F.lit("x")),
    ]))


@query("""SELECT 'P08' AS pitfall, 'p/' || p_partkey AS subject, 'label' AS detail FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 5 <> 0 UNION ALL SELECT 'P08', 'p/' || p_partkey, 'definition' FROM part WHERE p_partkey % 4 = 0
UNION ALL SELECT 'P24', 'p/' || p_partkey, 'equivalentClass' FROM part WHERE p_partkey % 11 = 0 UNION ALL SELECT 'P06', 'p/' || a.p_partkey, 'subClassOf' FROM part a JOIN part b ON (a.p_partkey % 50 = 1 AND b.p_partkey = a.p_partkey + 1) OR (a.p_partkey % 50 = 2 AND b.p_partkey = a.p_partkey - 1)
UNION ALL SELECT 'P11', 's/' || s_suppkey, 'domain' FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey % 5 <> 0 UNION ALL SELECT 'P19', 's/' || s_suppkey, 'domain' FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 5 = 0
UNION ALL SELECT 'P11', 's/' || s_suppkey, 'range' FROM supplier WHERE s_suppkey % 2 <> 0""")
def pitfalls(t: Tables) -> DataFrame:
    return modelling.pitfalls(_ontology(t))


@query("""WITH n AS (SELECT p_partkey AS k, p_type, p_brand, list_filter([CASE WHEN p_partkey % 5 = 0 THEN upper(p_name) END, CASE WHEN p_partkey % 3 <> 0 THEN p_name END, CASE WHEN p_partkey % 2 = 0 THEN p_type END], lambda x: x IS NOT NULL) AS names FROM part)
SELECT 'p/' || k AS iri, names[1] AS label, array_to_string(names[2:], '|') AS alt_labels, CASE WHEN k % 4 <> 0 THEN p_type END AS gloss, CASE WHEN k % 6 = 1 THEN p_brand ELSE '' END AS has_key FROM n WHERE len(names) > 0""")
def class_targets(t: Tables) -> DataFrame:
    return modelling.targets(_ontology(t)).select("iri", "label", F.array_join("alt_labels", "|").alias("alt_labels"), "gloss", F.array_join("has_key", "|").alias("has_key"))


@query("SELECT parent, id, qualifier, count(*) OVER (PARTITION BY parent) AS n FROM (SELECT p_brand AS parent, p_partkey AS id, p_name AS qualifier FROM part WHERE p_partkey % 2 = 0 AND p_size > 5) QUALIFY count(*) OVER (PARTITION BY parent) >= 4")
def qualified_classes(t: Tables) -> DataFrame:
    label = F.when(F.expr("p_partkey % 2 = 0 and p_size > 5"), F.concat_ws(" ", "p_name", F.upper("p_brand"))).otherwise(F.col("p_brand"))
    parents = t.part.select(F.col("p_brand").alias("parent"), F.col("p_brand").alias("parent_label")).distinct()
    return modelling.qualified(t.part.select(F.col("p_partkey").alias("id"), label.alias("label"), F.col("p_brand").alias("parent")), parents, 4)


def _parts(t: Tables, test: str, o: str = "p_type") -> DataFrame:
    return t.part.where(test).select(_iri("p", "p_partkey").alias("s"), F.lit("skos:definition").alias("p"), F.col(o).alias("o"))


@query("""SELECT 'p/' || p_partkey AS s, 'skos:definition' AS p, p_type AS o FROM part WHERE p_partkey % 3 <> 0 UNION SELECT 'p/' || p_partkey, 'skos:definition', p_type FROM part WHERE p_partkey % 4 = 0
UNION SELECT 'p/' || p_partkey, 'skos:definition', p_brand FROM part WHERE p_partkey % 7 = 0""")
def applied_axioms(t: Tables) -> DataFrame:
    return modelling.apply_axioms(_parts(t, "p_partkey % 3 <> 0"), _parts(t, "p_partkey % 4 = 0").unionByName(_parts(t, "p_partkey % 7 = 0", "p_brand")))


@query("SELECT 'p/' || p_partkey AS s, 'skos:definition' AS p, CASE WHEN p_partkey % 4 = 0 THEN p_brand ELSE p_type END AS o FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 4 = 0")
def redefined_classes(t: Tables) -> DataFrame:
    return modelling.redefine(_parts(t, "p_partkey % 3 <> 0"), _parts(t, "p_partkey % 4 = 0", "p_brand"))


@query("""SELECT 'q/' || p_partkey AS s, 'skos:definition' AS p, CASE p_brand WHEN 'Brand#11' THEN 'b/eleven' ELSE p_brand END AS o FROM part UNION SELECT 'q/' || p_partkey, 'skos:historyNote', 'p/' || p_partkey FROM part
UNION SELECT 'b/eleven', 'skos:historyNote', 'Brand#11'""")
def rewritten_iris(t: Tables) -> DataFrame:
    mapping = t.part.select(_iri("p", "p_partkey").alias("old"), _iri("q", "p_partkey").alias("new")).union(t.spark.createDataFrame([("Brand#11", "b/eleven")], "old string, new string"))
    return modelling.rewrite(_parts(t, "true", "p_brand"), mapping)


@query("SELECT 'p/' || p_partkey AS s, 'skos:definition' AS p, p_type AS o FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 2 = 0 AND p_partkey % 4 <> 0")
def carried_glosses(t: Tables) -> DataFrame:
    classes = t.part.where("p_partkey % 2 = 0").select(_iri("p", "p_partkey").alias("s"), F.lit("rdf:type").alias("p"), F.lit("owl:Class").alias("o"))
    return modelling.carried(_parts(t, "p_partkey % 3 <> 0"), classes.unionByName(_parts(t, "p_partkey % 4 = 0", "p_brand")))


@query("SELECT 'p/' || p_partkey AS iri FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 3 <> 0")
def minted_classes(t: Tables) -> DataFrame:
    classes = lambda test: t.part.where(test).select(_iri("p", "p_partkey").alias("s"), F.lit("rdf:type").alias("p"), F.lit("owl:Class").alias("o"))
    return modelling.minted(classes("p_partkey % 3 = 0"), classes("p_partkey % 2 = 0"))


def _versions(t: Tables) -> DataFrame:
    """Version v lacks the parts whose key is a multiple of v + 2."""
    rows = t.part.select(F.explode(F.sequence(F.lit(0), F.lit(4))).alias("seq"), "p_partkey", "p_type").where("p_partkey % (seq + 2) <> 0")
    return rows.select("seq", _iri("p", "p_partkey").alias("s"), F.lit("made:of").alias("p"), F.col("p_type").alias("o"))


_VERSIONS = "v AS (SELECT CAST(v AS INTEGER) AS v, p_partkey AS k FROM part, range(5) r(v) WHERE p_partkey % (v + 2) <> 0)"


@query(f"""WITH {_VERSIONS}, c AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 3 <> 1), d AS (SELECT v, 1 - count(c.k) / (count(*) + (SELECT count(*) FROM c) - count(c.k)) AS d FROM v LEFT JOIN c USING (k) GROUP BY v)
SELECT v AS version_id, round(d, 6) AS distance FROM d WHERE d <= 0.9 ORDER BY d, v LIMIT 1""")
def nearest_version(t: Tables) -> DataFrame:
    current = t.part.where("p_partkey % 3 <> 1").select(_iri("p", "p_partkey").alias("s"), F.lit("made:of").alias("p"), F.col("p_type").alias("o"))
    return modelling.nearest_version(_versions(t).withColumnRenamed("seq", "version_id"), current, 0.9).select("version_id", F.round("distance", 6).alias("distance"))


@query(f"""WITH {_VERSIONS}, n AS (SELECT DISTINCT v FROM v) SELECT n.v AS seq, (SELECT count(*) FROM v x WHERE x.v = n.v AND NOT EXISTS (SELECT 1 FROM v y WHERE y.v = n.v - 1 AND y.k = x.k)) AS added,
(SELECT count(*) FROM v x WHERE x.v = n.v - 1 AND NOT EXISTS (SELECT 1 FROM v y WHERE y.v = n.v AND y.k = x.k)) AS removed FROM n""")
def version_history(t: Tables) -> DataFrame:
    return modelling.history(_versions(t))


@query("""SELECT l_orderkey AS id, string_agg(x, chr(10) ORDER BY x) AS normal FROM (SELECT DISTINCT l_orderkey, lower(coalesce(p_name, 'p/' || l_partkey)) || ' supplied:by s/' || l_suppkey AS x FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_partkey % 3 <> 0) GROUP BY 1""")
def normal_forms(t: Tables) -> DataFrame:
    axioms = t.lineitem.select(F.col("l_orderkey").alias("id"), _iri("p", "l_partkey").alias("s"), F.lit("supplied:by").alias("p"), _iri("s", "l_suppkey").alias("o"))
    return modelling.normal_form(axioms, t.part.where("p_partkey % 3 <> 0").select(_iri("p", "p_partkey").alias("iri"), F.col("p_name").alias("label")))


@query("SELECT o_orderkey, o_orderstatus = 'F' AND o_orderkey % 3 = 0 AS dropped FROM orders")
def cited_axioms(t: Tables) -> DataFrame:
    support = F.when(F.col("o_orderkey") % 3 > 0, F.array("o_custkey")).otherwise(F.array().cast("array<bigint>"))
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "textual").otherwise("model").alias("provenance"), support.alias("support"))
    kept, dropped = modelling.cited(rows, F.col("support"))
    return kept.select("o_orderkey", F.lit(False).alias("dropped")).unionByName(dropped.select("o_orderkey", F.lit(True).alias("dropped")))


# --- decisions ---------------------------------------------------------------

_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'chosen' WHEN 'O' THEN 'not_chosen' ELSE 'invalid' END"


@query(f"""SELECT axis, option, CAST(sum(CASE {_STATUS} WHEN 'chosen' THEN 1 WHEN 'not_chosen' THEN -1 ELSE -2 END) AS BIGINT) AS weight
FROM (SELECT o_orderstatus, unnest([o_orderpriority, 'customer']) AS axis, unnest([CAST(o_orderkey % 3 AS VARCHAR), CAST(o_custkey % 4 AS VARCHAR)]) AS option FROM orders) GROUP BY ALL""")
def option_record(t: Tables) -> DataFrame:
    pair = lambda axis, option: F.struct(axis.alias("axis"), F.expr(option).cast("string").alias("option"))
    axes = F.array(pair(F.col("o_orderpriority"), "o_orderkey % 3"), pair(F.lit("customer"), "o_custkey % 4"))
    return decisions.record(t.orders.select(F.expr(_STATUS).alias("status"), axes.alias("axes")))


@query("""WITH a AS (SELECT l_orderkey AS b, l_partkey AS x, l_linenumber % 3 <> 0 AS adds FROM lineitem), n AS (SELECT b, count(*) FILTER (NOT adds) AS reorg, count(*) FILTER (adds) AS kept FROM a GROUP BY 1),
c AS (SELECT b, count(DISTINCT p_size) AS n FROM a JOIN part ON p_partkey = x WHERE adds GROUP BY 1)
SELECT b AS branch_id, round(coalesce(n, 0) / 50, 6) AS coverage, reorg AS reorg_cost, CAST(coalesce(n, 0) AS BIGINT) AS regen_cost, round(kept / 200, 6) AS parsimony FROM n LEFT JOIN c USING (b)""")
def branch_scores(t: Tables) -> DataFrame:
    axioms = t.lineitem.selectExpr("l_orderkey as branch_id", "l_partkey as axiom_id", "l_linenumber % 3 <> 0 as adds")
    found = decisions.scored(axioms, t.part.selectExpr("p_partkey as axiom_id", "p_size as mention_id"), 50, 200)
    return found.select("branch_id", F.round("coverage", 6).alias("coverage"), "reorg_cost", "regen_cost", F.round("parsimony", 6).alias("parsimony"))


@query("SELECT o_orderkey AS branch_id FROM orders ORDER BY o_orderkey % 10 / 10 DESC, o_custkey % 6 + o_custkey % 3, coalesce(CASE WHEN o_custkey % 2 = 0 THEN o_orderkey % 4 END, 0) DESC, o_orderkey LIMIT 25")
def branch_ranking(t: Tables) -> DataFrame:
    rows = t.orders.selectExpr("o_orderkey as branch_id", "o_orderkey % 10 / 10 as coverage", "o_custkey % 6 as reorg_cost", "o_custkey % 3 as regen_cost", "case when o_custkey % 2 = 0 then cast(o_orderkey % 4 as double) end as affinity")
    return decisions.ranked(rows, 25).select("branch_id")


@query("""SELECT o_custkey AS decision_id, o_orderkey AS branch_id, CASE WHEN o_custkey % 3 = 0 AND o_orderkey = min(o_orderkey) OVER (PARTITION BY o_custkey) THEN 'chosen' WHEN o_orderkey % 7 = 0 THEN 'invalid' WHEN o_custkey % 3 = 0 THEN 'not_chosen' ELSE 'open' END AS status FROM orders""")
def settled_branches(t: Tables) -> DataFrame:
    branches = t.orders.select(F.col("o_custkey").alias("decision_id"), F.col("o_orderkey").alias("branch_id"), F.lit("open").alias("status"))
    chosen = branches.where("decision_id % 3 = 0").groupBy("decision_id").agg(F.min("branch_id").alias("branch_id"))
    return decisions.settle(branches, chosen, branches.where("branch_id % 7 = 0").select("branch_id"))


def _decided(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("normal"), F.expr(_STATUS).alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("axis"))


@query("SELECT CAST(o_custkey AS VARCHAR) AS normal, o_orderkey AS id FROM orders WHERE o_orderstatus <> 'F' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'O', o_orderdate DESC, o_orderkey DESC) = 1")
def strongest_rejections(t: Tables) -> DataFrame:
    return decisions.rejections(_decided(t)).select("normal", "id")


@query("SELECT axis, id, CAST(rank AS INTEGER) AS rank FROM (SELECT o_orderpriority AS axis, o_orderkey AS id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank FROM orders) WHERE rank <= 5")
def recent_precedents(t: Tables) -> DataFrame:
    return decisions.precedents(_decided(t), 5).select("axis", "id", "rank")


_COLLIDE = "c AS (SELECT DISTINCT o_custkey AS e, o_orderpriority AS i FROM orders), p AS (SELECT x.e, x.i AS a, y.i AS b FROM c x JOIN c y ON x.e = y.e AND x.i < y.i)"


@query(f"WITH {_COLLIDE} SELECT a, b, count(*) AS n FROM p GROUP BY ALL")
def conflict_pairs(t: Tables) -> DataFrame:
    return decisions.by_pair(t.orders.select(F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("iri")))


@query(f"""WITH {_COLLIDE} SELECT 'factual_conflict' AS kind, CAST(e AS VARCHAR) AS subject, CAST(NULL AS VARCHAR) AS other, count(*) AS n FROM p WHERE (a LIKE '1%' AND b LIKE '5%') OR (a LIKE '2%' AND b LIKE '3%') GROUP BY e
UNION ALL SELECT 'conflict_pattern', a, b, count(*) FROM p GROUP BY a, b HAVING count(*) >= 60""")
def conflict_findings(t: Tables) -> DataFrame:
    typed = t.orders.select(F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("iri"))
    classes = typed.select("iri").distinct()
    low = classes.select(F.col("iri").alias("a"), F.when(F.col("iri").startswith("1"), "5").when(F.col("iri").startswith("2"), "3").alias("to")).where("to is not null")
    return decisions.conflict_findings(typed, low.join(classes.select(F.col("iri").alias("b"), F.substring("iri", 1, 1).alias("to")), "to").select("a", "b"), 60)


@query("SELECT q AS cq_type, 300 - count(event_id) AS missing FROM (SELECT unnest(['click', 'view', 'inferential']) AS q) LEFT JOIN events ON event_type = q GROUP BY q HAVING count(event_id) < 300")
def quota_shortfall(t: Tables) -> DataFrame:
    quota = t.spark.createDataFrame([("click", 300), ("view", 300), ("inferential", 300)], "cq_type string, n bigint")
    return decisions.shortfall(t.events.select(F.col("event_type").alias("cq_type")), quota)


@query("""SELECT unnest(['competency questions', 'novelty saturation', 'accumulation curve', 'budget']) AS criterion, unnest(['primary', 'secondary', 'diagnostic', 'hard']) AS role,
unnest([CASE WHEN r >= 0.4 THEN 'met' ELSE 'not_met' END, CASE WHEN s < 0.1 THEN 'met' ELSE 'not_met' END, 'unknown', CASE WHEN n >= 10 THEN 'met' ELSE 'not_met' END]) AS state
FROM (SELECT avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END) AS r, count(DISTINCT user_id) / count(*) AS s, count(*) AS n FROM events)""")
def stopping_criteria(t: Tables) -> DataFrame:
    facts = t.events.agg(F.avg((F.col("value") > 50).cast("double")).alias("pass_rate"), (F.countDistinct("user_id") / F.count("*")).alias("slope"), F.count("*").alias("iteration"))
    return decisions.stopping(facts.withColumns({"settled": F.lit(True), "early_slope": F.lit(None).cast("double")}), 0.4, 0.1, 10)


# --- layout ------------------------------------------------------------------

_BOX = "SELECT l_orderkey AS document_id, l_suppkey % 2 AS page, l_linenumber AS id, l_partkey * 37 % 400 AS x0, l_partkey * 37 % 400 + l_suppkey * 53 % 400 + 20 AS x1, l_linenumber % 3 AS y0 FROM lineitem"


@query(f"""WITH b AS ({_BOX}), w AS (SELECT *, x0 < 270 AND x1 > 330 AS wide FROM b), g AS (SELECT *, sum(CASE WHEN wide THEN 1 ELSE 0 END) OVER (PARTITION BY document_id, page ORDER BY y0, x0, id, x1) AS band FROM w)
SELECT document_id, page, id, CAST(row_number() OVER (PARTITION BY document_id, page ORDER BY band, CASE WHEN wide THEN 0 WHEN (x0 + x1) / 2 <= 300 THEN 1 ELSE 2 END, y0, x0, id, x1) AS INTEGER) AS place FROM g""")
def reading_order(t: Tables) -> DataFrame:
    boxes = t.lineitem.selectExpr(*[c.strip() for c in _BOX.removeprefix("SELECT ").removesuffix(" FROM lineitem").split(",")], "l_linenumber % 3 + 1 as y1")
    return layout.reading_order(boxes, 600.0).select("document_id", "page", "id", "place")


def _cited_blocks(t: Tables) -> DataFrame:
    line, k = F.col("c_name"), F.col("c_custkey")
    text = F.when(k % 4 == 0, F.concat(F.lit("Table "), (k % 7).cast("string"), F.lit(". "), line)).when(k % 4 == 1, F.concat(line, F.lit(" see table "), (k % 7).cast("string"), F.lit(" and Tabla "), (k % 3).cast("string"))).otherwise(line)
    kind = F.when(k % 4 == 0, "caption").when((k % 4 == 2) & (k % 8 == 2), "table").otherwise("paragraph")
    return t.customer.select(F.col("c_nationkey").alias("document_id"), k.alias("ordinal"), (k % 5).alias("page"), kind.alias("block_type"), text.alias("text"), (k % 9 == 0).alias("is_boilerplate"))


@query("""SELECT DISTINCT a.c_nationkey AS document_id, a.c_custkey AS caption, b.c_custkey AS paragraph FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey % 4 = 0 AND b.c_custkey % 4 = 1 AND (a.c_custkey % 7 = b.c_custkey % 7 OR a.c_custkey % 7 = b.c_custkey % 3)""")
def caption_citations(t: Tables) -> DataFrame:
    return layout.citations(_cited_blocks(t))


@query("SELECT DISTINCT c_nationkey AS document_id, c_custkey % 5 AS page FROM customer WHERE c_custkey % 4 = 0 EXCEPT SELECT c_nationkey, c_custkey % 5 FROM customer WHERE c_custkey % 8 = 2")
def table_gaps(t: Tables) -> DataFrame:
    return layout.table_gaps(_cited_blocks(t))


@query("SELECT c_nationkey AS document_id, CASE WHEN c_custkey % 4 = 0 THEN 'caption' WHEN c_custkey % 8 = 2 THEN 'table' ELSE 'paragraph' END AS block_type, count(*) AS blocks, count(*) FILTER (c_custkey % 9 = 0) AS boilerplate FROM customer GROUP BY ALL")
def block_summary(t: Tables) -> DataFrame:
    return layout.summary(_cited_blocks(t))


@query("""WITH h AS (SELECT 'n/' || n_nationkey AS iri, c_custkey % 50 AS document_id, c_custkey AS ordinal, ['is a', 'means', 'es un'][c_custkey % 4 + 1] AS cue, n_name AS surface FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 4 < 3),
r AS (SELECT *, row_number() OVER (PARTITION BY iri, document_id ORDER BY ordinal) AS turn FROM h), o AS (SELECT *, row_number() OVER (PARTITION BY iri ORDER BY turn, document_id) AS n FROM r WHERE turn <= 6)
SELECT iri, document_id, ordinal, cue, surface FROM o WHERE n <= 6""")
def definitional_passages(t: Tables) -> DataFrame:
    cue = _pick([" is\na place", " means trade", " es un lugar", " elsewhere"], "c_custkey % 4")
    blocks = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).select(F.expr("c_custkey % 50").alias("document_id"), F.col("c_custkey").alias("ordinal"), F.concat(F.lit("Here "), F.initcap("n_name"), cue).alias("text"))
    return layout.passages(blocks, t.nation.select(_iri("n", "n_nationkey").alias("iri"), F.col("n_name").alias("surface"), F.lit(0).alias("place")), 6)


# --- evidence ----------------------------------------------------------------


@query("""SELECT o_orderkey AS mention_id, 1 AS version_id, 'old' AS iri, 'auto' AS zone FROM orders WHERE o_orderkey % 3 = 0 UNION ALL
SELECT o_orderkey, 2, CASE WHEN o_custkey % 2 = 0 AND o_orderkey % 5 = 0 THEN 'said' ELSE o_orderpriority END, CASE WHEN o_custkey % 2 = 0 AND o_orderkey % 5 = 0 THEN 'answered' WHEN o_custkey % 2 = 0 THEN 'grey' ELSE 'auto' END FROM orders""")
def persisted_typings(t: Tables) -> DataFrame:
    row = lambda v, iri, zone: t.orders.select(F.col("o_orderkey").alias("mention_id"), F.lit(v).alias("version_id"), iri.alias("iri"), zone.alias("zone"))
    current = row(1, F.lit("old"), F.lit("auto")).where("mention_id % 3 = 0").unionByName(row(2, F.lit("old"), F.lit("auto")))
    new = row(2, F.col("o_orderpriority"), F.when(F.col("o_custkey") % 2 == 0, "grey").otherwise("auto"))
    return evidence.persisted(current, new, t.orders.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("mention_id"), F.lit("said").alias("iri")))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'e/' || c_nationkey ELSE c_name END AS entity, CASE WHEN c_custkey % 6 = 0 THEN 'merged' ELSE c_mktsegment END AS status FROM customer")
def updated_entities(t: Tables) -> DataFrame:
    current = t.customer.select("c_custkey", F.col("c_name").alias("entity"), F.col("c_mktsegment").alias("status"))
    changes = t.customer.where("c_custkey % 3 = 0").select("c_custkey", _iri("e", "c_nationkey").alias("entity"), F.when(F.col("c_custkey") % 2 == 0, "merged").alias("status"))
    return evidence.updated(current, changes, "c_custkey", ["entity", "status"])


@query("SELECT o_orderkey AS mention_id, o_orderpriority AS iri, o_custkey AS document_id FROM orders WHERE (o_orderpriority, o_custkey) IN (SELECT o_orderpriority, o_custkey FROM orders WHERE o_orderkey % 4 = 0)")
def circular_matches(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderkey").alias("mention_id"), F.col("o_orderpriority").alias("iri"), F.col("o_custkey").alias("document_id"))
    return evidence.circular(rows, rows, rows.where("mention_id % 4 = 0"))


@query("""WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY sha1('7:' || doc_id), doc_id) AS k, count(*) OVER () AS n FROM documents WHERE doc_id % 3 > 0)
SELECT doc_id AS document_id, true AS process FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, k <= round_even(n * 0.3, 0) FROM o""")
def reload_choice(t: Tables) -> DataFrame:
    ids = t.documents.select(F.col("doc_id").alias("document_id"))
    return evidence.reload(ids, ids.where("document_id % 3 > 0"), "sample", 0.3, 7)


@query("WITH k AS (SELECT DISTINCT p_brand AS iri FROM part), r AS (SELECT iri, row_number() OVER (ORDER BY sha1('3:' || iri), iri) AS k, count(*) OVER () AS n FROM k) SELECT iri FROM r WHERE k <= greatest(1, least(n - 1, round_even(n * 0.2, 0)))")
def held_out_classes(t: Tables) -> DataFrame:
    return evidence.hold_out(t.part.select(F.col("p_brand").alias("iri")), 0.2, 3)


@query("""WITH g AS (SELECT o_orderkey AS m, o_orderpriority AS iri FROM orders), p AS (SELECT m, x.iri FROM g, (SELECT DISTINCT o_orderpriority AS iri FROM orders) x WHERE x.iri <> g.iri AND (m + CAST(x.iri[1] AS INTEGER)) % 2 = 0)
SELECT m AS mention_id, iri, true AS positive FROM g UNION ALL SELECT m, iri, false FROM p QUALIFY row_number() OVER (PARTITION BY m ORDER BY sha1('5:' || m || '/' || iri), iri) <= 2""")
def training_examples(t: Tables) -> DataFrame:
    gold = t.orders.select(F.col("o_orderkey").alias("mention_id"), F.col("o_orderpriority").alias("iri"))
    classes = t.orders.select(F.col("o_orderpriority").alias("iri")).distinct().select("iri", (F.substring("iri", 1, 1).cast("int") % 2).alias("side"))
    pool = gold.select("mention_id", (F.col("mention_id") % 2).alias("side")).join(classes, "side")
    return evidence.examples(gold, pool, 2, 5)


@query("WITH n AS (SELECT DISTINCT p_brand AS iri, p_name AS a FROM part) SELECT DISTINCT x.a, y.a AS b FROM n x JOIN n y ON x.iri = y.iri AND x.a <> y.a")
def synonym_index(t: Tables) -> DataFrame:
    return evidence.synonyms(t.part.select(F.col("p_brand").alias("iri"), F.col("p_name").alias("name")))


@query("SELECT DISTINCT unnest([l_partkey, l_suppkey]) AS mention_id FROM lineitem WHERE l_returnflag = 'R'")
def unresolved_duplicates(t: Tables) -> DataFrame:
    return evidence.unresolved(t.lineitem.select(F.col("l_partkey").alias("l"), F.col("l_suppkey").alias("r"), F.when(F.col("l_returnflag") == "R", "ask").otherwise("merge").alias("action")))


@query("SELECT lang, token, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS token FROM documents) GROUP BY ALL")
def label_lexicon(t: Tables) -> DataFrame:
    return evidence.lexicon(t.documents.select("lang", "text"), F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1))


@query("SELECT 's/' || s_suppkey AS iri, (SELECT count(*) FROM supplier WHERE s_suppkey % 5 > 0) AS conforming, (SELECT count(*) FROM supplier) AS properties FROM supplier WHERE s_suppkey % 5 = 0")
def unconforming_properties(t: Tables) -> DataFrame:
    label = _pick(["made by", "is part of", "hasKey", "have seen", "is_in"], "s_suppkey % 5")
    return evidence.unconforming(t.supplier.select(_iri("s", "s_suppkey").alias("iri"), label.alias("label")), tx.tokens(F.col("label"))[0])


# --- text --------------------------------------------------------------------


@query(r"""WITH w AS (SELECT p_partkey, p_name, p_type, p_name || '. ' || p_type || CASE p_partkey % 3 WHEN 0 THEN '! ' WHEN 1 THEN chr(10) ELSE ' ' END || p_brand AS text, p_brand FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_type || '!' WHEN p_partkey % 3 = 1 THEN p_type ELSE p_type || ' ' || p_brand END AS sentence FROM w""")
def sentences_around(t: Tables) -> DataFrame:
    text = F.concat(F.col("p_name"), F.lit(". "), F.col("p_type"), _pick(["! ", "\n", " "], "p_partkey % 3"), F.col("p_brand"))
    start = F.length("p_name") + 2
    return t.part.select("p_partkey", tx.sentence_around(text, start, start + F.lit(2)).alias("sentence"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'Sobre ' ELSE 'sobre ' END || p_name AS fixed, CASE WHEN p_partkey % 3 = 0 THEN 'Tiene' END AS capital FROM part""")
def corrected_labels(t: Tables) -> DataFrame:
    label = F.concat(F.when(F.col("p_partkey") % 2 == 0, "Subre ").otherwise("subre "), "p_name")
    word = F.when(F.col("p_partkey") % 3 == 0, "TIene").when(F.col("p_partkey") % 3 == 1, "camelCase").otherwise("USA")
    return t.part.select("p_partkey", tx.corrected(label, F.create_map(F.lit("subre"), F.lit("sobre"))).alias("fixed"), tx.odd_capitals(word).alias("capital"))


@query("SELECT o_orderkey, o_orderkey % 4 = 0 AS single, CASE WHEN o_orderkey % 2 = 0 THEN '{\"a\": {\"b\": ' || o_custkey || '}}' END AS answer FROM orders")
def answer_forms(t: Tables) -> DataFrame:
    asked = _pick(["SELECT ?x WHERE { ?x a :Part }", "SELECT ?x WHERE { ?x a :Part . ?x :of ?y }", "SELECT ?x WHERE { ?x :sub+ ?y }", "ASK WHERE { ?x a :Part FILTER(?x > 1) }"], "o_orderkey % 4")
    said = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit('Well: {"a": {"b": '), F.col("o_custkey").cast("string"), F.lit("}} so."))).otherwise(F.lit("Well: {no} so."))
    return t.orders.select("o_orderkey", tx.single_triple(asked).alias("single"), tx.outer_json(said).alias("answer"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'fr' WHEN o_orderkey % 3 = 0 THEN 'es' WHEN o_orderkey % 2 = 0 THEN 'de' WHEN o_custkey % 2 = 0 THEN 'es' ELSE 'en' END AS lang FROM orders""")
def label_languages(t: Tables) -> DataFrame:
    is_ = lambda n, value: F.when(F.col("o_orderkey") % n == 0, value)
    text = F.when(F.col("o_custkey") % 2 == 0, "medición").otherwise("measure")
    return t.orders.select("o_orderkey", tx.language_of(is_(5, "fr"), is_(3, "(es_MX)"), is_(2, "de"), text).alias("lang"))


# --- versions, ledger, vocabulary --------------------------------------------


@query("SELECT o_custkey AS session_id, o_orderkey AS version_id FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_versions(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("version_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("seq"))
    return modelling.latest(rows).select("session_id", "version_id")


@query("SELECT * FROM (SELECT o_orderkey AS version_id, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) AS earlier FROM orders) WHERE version_id > earlier")
def version_recurrences(t: Tables) -> DataFrame:
    return modelling.recurrences(t.orders.select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("version_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("hash")))


@query("""WITH b AS (SELECT 'n/' || n_nationkey AS iri, n_nationkey AS k, n_regionkey AS r FROM nation WHERE n_nationkey % 3 <> 0)
SELECT iri, 'parent' AS relation, 'r/' || r AS other FROM b WHERE k % 7 <> 0 UNION ALL SELECT iri, 'child', 's/' || s_suppkey FROM b JOIN supplier ON s_nationkey = k UNION ALL SELECT iri, 'disjoint', 'n/0' FROM b WHERE k % 5 = 0
UNION ALL SELECT iri, NULL, NULL FROM b WHERE k % 7 = 0 AND k % 5 > 0 AND k NOT IN (SELECT s_nationkey FROM supplier)""")
def gloss_contexts(t: Tables) -> DataFrame:
    own = _iri("n", "n_nationkey")
    nations = _facts(t.nation, own, [
        ("rdf:type", "true", F.lit("owl:Class")), ("skos:definition", "n_nationkey % 3 = 0", F.col("n_name")), ("rdfs:subClassOf", "n_nationkey % 7 <> 0", _iri("r", "n_regionkey")),
        ("owl:disjointWith", "n_nationkey % 5 = 0 and n_nationkey > 0", F.lit("n/0")),
    ])
    return modelling.gloss_contexts(nations.unionByName(_facts(t.supplier, _iri("s", "s_suppkey"), [("rdfs:subClassOf", "true", _iri("n", "s_nationkey"))])))


@query("SELECT event_type AS stage, count(*) FILTER (event_id % 13 = 0 AND event_type <> 'click') = 0 AS clear FROM events GROUP BY 1")
def stage_barrier(t: Tables) -> DataFrame:
    waits = (F.col("event_id") % 13 == 0) & (F.col("event_type") != "click")
    return ledger.barrier(t.events.select(F.col("event_type").alias("stage"), F.when(waits, "pending").otherwise("done").alias("status")))


_LEXICON = "x AS (SELECT lower(replace(n_name, ' ', '')) AS w FROM nation), l AS (SELECT w AS token, 5 AS n FROM x UNION SELECT w[1] || w[3] || w[5], 1 FROM x)"


@query(f"""WITH {_LEXICON} SELECT 'en' AS lang, s.token, min(g.token) AS suggestion FROM l s JOIN l g ON s.token[1] = g.token[1] AND s.n = 1 AND length(s.token) BETWEEN 3 AND 6 AND length(g.token) >= length(s.token) + 3
WHERE regexp_matches(g.token, '^.*' || s.token[1] || '.*' || s.token[2] || '.*' || s.token[3]) GROUP BY s.token""")
def truncated_abbreviations(t: Tables) -> DataFrame:
    word = F.lower(F.replace("n_name", F.lit(" "), F.lit("")))
    long = t.nation.select(word.alias("token"), F.lit(5).alias("n"))
    short = t.nation.select(F.concat(F.substring(word, 1, 1), F.substring(word, 3, 1), F.substring(word, 5, 1)).alias("token"), F.lit(1).alias("n"))
    return evidence.abbreviations(long.union(short).distinct().withColumn("lang", F.lit("en")))


@query("""WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY sha1('11:' || doc_id), doc_id) AS k, count(*) OVER () AS n FROM documents) SELECT doc_id AS document_id, k <= greatest(1, least(n - 1, round_even(n * 0.2, 0))) AS held_out FROM o""")
def document_split(t: Tables) -> DataFrame:
    return evidence.split_documents(t.documents.select(F.col("doc_id").alias("document_id")), 0.2, 11)


@query("""WITH a AS (SELECT DISTINCT p_brand AS iri, p_name AS name FROM part WHERE lower(p_name) NOT IN (SELECT lower(p_name) FROM part WHERE p_partkey % 50 = 0)), g AS (SELECT DISTINCT p_brand AS iri, lower(p_name) AS text FROM part WHERE p_partkey % 3 = 0)
SELECT iri, name, coalesce(bool_or(contains(text, lower(name))), false) AS kept FROM a LEFT JOIN g USING (iri) GROUP BY ALL""")
def verified_names(t: Tables) -> DataFrame:
    passages = t.part.where("p_partkey % 3 = 0").select(F.col("p_brand").alias("iri"), F.concat(F.lit("The "), F.replace("p_name", F.lit(" "), F.lit("\n ")), F.lit(".")).alias("text"))
    return evidence.verified_names(t.part.select(F.col("p_brand").alias("iri"), F.col("p_name").alias("name")), passages, t.part.where("p_partkey % 50 = 0").select(F.col("p_name").alias("name")))


@query("SELECT o_orderkey AS cq_id, CASE WHEN o_orderkey % 2 = 0 THEN 'passing' ELSE 'failing' END AS change FROM orders WHERE (o_orderkey % 2 = 0) <> (o_orderkey % 3 = 0 AND o_orderkey % 5 > 0)")
def question_delta(t: Tables) -> DataFrame:
    row = lambda test: F.expr(test).alias("passed")
    key = F.col("o_orderkey").alias("cq_id")
    return evidence.delta(t.orders.select(key, row("o_orderkey % 2 = 0")), t.orders.where("o_orderkey % 5 > 0").select(key, row("o_orderkey % 3 = 0")))


@query("SELECT left(list_min(string_split_regex(lower(p_name), '[^a-z0-9]+')), 4) AS key, count(*) AS n FROM part GROUP BY 1")
def surface_blocks(t: Tables) -> DataFrame:
    return t.part.groupBy(tx.block_key(F.col("p_name")).alias("key")).agg(F.count("*").alias("n"))
