"""Queries of resolution, passages, versions, surveys, jobs and SPARQL over the driver's tables, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptflow import ledger
from conceptflow.functions import text as tx
from conceptflow.operators import decisions, graph, parts, passages, resolution, sparql, workflow
from conceptflow.plans.catalog import Tables, query
from conceptflow.session import shelve
from conceptflow.sources import writers

# --- resolution --------------------------------------------------------------

_NAME = "array_to_string(regexp_extract_all(lower(p_name), '\\p{L}+'), ' ')"
_MENTIONS = f"m AS (SELECT p_partkey AS id, p_brand AS doc, p_name AS text, {_NAME} AS surface, p_size % 7 AS language, p_type AS class, p_size AS size FROM part)"
_SYNONYMS = f"syn AS (SELECT DISTINCT {_NAME} AS name, array_to_string(regexp_extract_all(lower(p_type), '\\p{{L}}+'), ' ') AS other FROM part WHERE p_size % 10 = 0)"
_NEAR = "near AS (SELECT a.vec_id AS a, b.vec_id AS b, (a.vec_id * 7 + b.vec_id) % 100 / 100 AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 + a.vec_id % 3)"
_CANDIDATES = f"""{_MENTIONS}, {_SYNONYMS}, {_NEAR}, e AS (SELECT a, b, 'neighbour' AS source FROM near
UNION SELECT x.id, y.id, 'surface' FROM m x JOIN m y ON x.surface = y.surface AND x.id < y.id UNION SELECT x.id, y.id, 'key' FROM m x JOIN m y ON x.size = y.size AND x.size % 25 = 0 AND y.size % 25 = 0 AND x.id < y.id
UNION SELECT least(x.id, y.id), greatest(x.id, y.id), 'synonym' FROM m x JOIN syn ON x.surface = name JOIN m y ON y.surface = other AND x.id <> y.id),
c AS (SELECT a, b, string_agg(source, ',' ORDER BY source) AS sources FROM e JOIN m x ON x.id = a JOIN m y ON y.id = b WHERE x.doc <> y.doc GROUP BY ALL)"""


def _mentions(t: Tables) -> DataFrame:
    keys = F.when(F.col("p_size") % 25 == 0, F.create_map(F.lit("size"), F.col("p_size").cast("string"))).otherwise(F.expr("cast(map() as map<string, string>)"))
    return t.part.select(
        F.col("p_partkey").cast("bigint").alias("id"), F.col("p_brand").alias("document_id"), F.col("p_name").alias("text"), tx.normalized(F.col("p_name")).alias("surface"),
        (F.col("p_size") % 7).alias("language"), F.col("p_type").alias("class"), keys.alias("keys"),
    )


def _synonyms(t: Tables) -> DataFrame:
    return t.part.where("p_size % 10 = 0").select(tx.normalized(F.col("p_name")).alias("name"), tx.normalized(F.col("p_type")).alias("other")).distinct()


def _near(t: Tables) -> DataFrame:
    ids = t.embeddings.select("vec_id")
    pairs = ids.selectExpr("vec_id as a", "vec_id + 1 + vec_id % 3 as b").join(ids.withColumnRenamed("vec_id", "b"), "b", "left_semi")
    return pairs.selectExpr("a", "b", "(a * 7 + b) % 100 / 100 as score")


@query(f"WITH {_CANDIDATES} SELECT * FROM c")
def candidate_pairs(t: Tables) -> DataFrame:
    return resolution.candidate_pairs(_mentions(t), _near(t), _synonyms(t), ",")


_GENERIC = r"(regexp_matches({0}, '(?i)^\s*(the|this|that|these|those|el|la|los|las|este|esta)\s') OR (len(string_split(array_to_string(regexp_extract_all(lower({0}), '\p{{L}}+'), ' '), ' ')) = 1 AND trim({0}) = lower(trim({0}))))"


@query(f"""WITH {_CANDIDATES}, f AS (SELECT c.a, c.b, x.class = y.class AS same_class, x.class = y.class AND x.class LIKE '%A%' AND x.size % 25 = 0 AND y.size % 25 = 0 AS has_key, x.size = y.size AS equal, x.language AS l1, y.language AS l2,
EXISTS (SELECT 1 FROM syn WHERE (name = x.surface AND other = y.surface) OR (name = y.surface AND other = x.surface)) AS synonym, {_GENERIC.format('x.text')} OR {_GENERIC.format('y.text')} AS generic,
x.surface = y.surface AS same_name, len(list_filter(string_split_regex(x.text, '\\s+'), lambda w: w <> '' AND NOT regexp_matches(w, '^(\\p{{Lu}}|[^\\p{{L}}])'))) = 0 AS proper, coalesce(n.score, 0) AS score
FROM c JOIN m x ON x.id = c.a JOIN m y ON y.id = c.b LEFT JOIN near n ON n.a = c.a AND n.b = c.b),
r AS (SELECT a, b, CASE WHEN has_key AND equal THEN 'merge:declared_key_matches' WHEN has_key THEN 'separate:declared_key_differs' WHEN l1 <> l2 THEN 'ask:cross_language' WHEN synonym THEN 'merge:synonym_declared_in_ontology'
WHEN generic THEN 'separate:generic_phrase_cross_document' WHEN same_name AND proper AND same_class THEN 'merge:identical_proper_name' WHEN same_name AND proper THEN 'ask:identical_name_different_class'
WHEN score >= 0.8 THEN 'merge:high_similarity' WHEN score >= 0.5 THEN 'ask:grey_zone' ELSE 'separate:low_similarity' END AS d FROM f) SELECT a, b, string_split(d, ':')[1] AS action, string_split(d, ':')[2] AS reason FROM r""")
def resolved_pairs(t: Tables) -> DataFrame:
    mentions, synonyms, near = _mentions(t), _synonyms(t), _near(t)
    keys = t.part.where("p_type like '%A%'").select(F.col("p_type").alias("class"), F.array(F.lit("size")).alias("properties")).distinct()
    return resolution.resolved(mentions, near, synonyms, keys, 0.8, 0.5)


_NAMED = "o AS (SELECT DISTINCT l_orderkey AS mention_id, 'p/' || (l_partkey % 50) AS iri FROM lineitem), s AS (SELECT mention_id, iri, (mention_id * 13 + CAST(substr(iri, 3) AS BIGINT) * (7 + k)) % 101 / 100 AS score FROM o, (SELECT unnest([0, 1, 2]) AS k))"


def _offered(t: Tables) -> tuple[DataFrame, DataFrame]:
    every = t.lineitem.select(F.col("l_orderkey").alias("mention_id"), F.concat(F.lit("p/"), (F.col("l_partkey") % 50).cast("string")).alias("iri"))
    offered = parts.dealt(every, "mention_id").distinct()
    names = offered.withColumn("k", F.explode(F.array(*map(F.lit, (0, 1, 2)))))
    return offered, names.selectExpr("mention_id", "iri", "cast(k as string) as name", "(mention_id * 13 + cast(substring(iri, 3) as bigint) * (7 + k)) % 101 / 100 as score")


@query(f"""WITH {_NAMED}, b AS (SELECT mention_id, iri, max(score) AS score FROM s GROUP BY ALL), r AS (SELECT *, row_number() OVER w AS n, lead(iri) OVER w AS runner_up FROM b WINDOW w AS (PARTITION BY mention_id ORDER BY score DESC, iri))
SELECT mention_id, CASE WHEN score >= 0.6 THEN iri END AS iri, score, CASE WHEN score >= 0.9 THEN 'auto' WHEN score >= 0.6 THEN 'grey' ELSE 'discarded' END AS zone, runner_up FROM r WHERE n = 1""")
def reranked_typings(t: Tables) -> DataFrame:
    return resolution.reranked(*_offered(t), 0.9, 0.6)


@query("""SELECT count(*) AS n, round(avg(CASE WHEN b <= 1 THEN 1 ELSE 0 END), 6) AS base_at_1, round(avg(CASE WHEN b <= 5 THEN 1 ELSE 0 END), 6) AS base_at_5, round(avg(CASE WHEN b IS NOT NULL AND u <= 1 THEN 1 ELSE 0 END), 6) AS tuned_at_1,
round(avg(CASE WHEN b IS NOT NULL AND u <= 5 THEN 1 ELSE 0 END), 6) AS tuned_at_5, round(avg(CASE WHEN b IS NOT NULL THEN 1 ELSE 0 END), 6) AS ceiling FROM (SELECT CASE WHEN p_size % 4 > 0 THEN p_size % 9 + 1 END AS b, p_size % 7 + 1 AS u FROM part)""")
def ranking_comparison(t: Tables) -> DataFrame:
    offered = F.col("p_size") % 4 > 0
    found = resolution.comparison(t.part.select(F.when(offered, F.col("p_size") % 9 + 1).alias("base"), F.when(offered, F.col("p_size") % 7 + 1).alias("tuned")))
    return found.select("n", *[F.round(c, 6).alias(c) for c in found.columns[1:]])


_SCORES = "s AS (SELECT p_name AS surface, p_partkey AS mention_id, 'b/' || b AS iri, (p_partkey * (b + 3)) % 97 / 100 AS score FROM part, (SELECT unnest(range(8)) AS b))"


def _scores(t: Tables) -> DataFrame:
    rows = t.part.select("p_name", "p_partkey", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("b"))
    return rows.selectExpr("p_name as surface", "p_partkey as mention_id", "concat('b/', cast(b as string)) as iri", "(p_partkey * (b + 3)) % 97 / 100 as score")


@query(f"""WITH {_SCORES}, u AS (SELECT surface, count(DISTINCT mention_id) AS support FROM s GROUP BY 1), b AS (SELECT surface, iri, max(score) AS score FROM s GROUP BY ALL HAVING max(score) >= 0.5)
SELECT surface, iri, score, CAST(rank AS INTEGER) AS rank, support FROM (SELECT *, row_number() OVER (PARTITION BY surface ORDER BY score DESC, iri) AS rank FROM b) JOIN u USING (surface) WHERE rank <= 3""")
def orphan_candidates(t: Tables) -> DataFrame:
    return resolution.orphan_candidates(_scores(t), 0.5, 3)


@query(f"WITH {_SCORES} SELECT mention_id AS proposal, iri AS label, score FROM (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, iri) AS n FROM s) WHERE n = 1 AND score >= 0.9")
def redundant_proposals(t: Tables) -> DataFrame:
    return resolution.redundant(_scores(t).select(F.col("mention_id").alias("proposal"), F.col("iri").alias("label"), "score"), 0.9)


# --- passages ----------------------------------------------------------------



@query("""WITH RECURSIVE c AS (SELECT doc_id AS chunk_id, k AS ordinal, CASE WHEN k % 4 = 3 THEN '--' ELSE string_split(text, ' ')[k % 3 + 1] END AS surface, text FROM documents, (SELECT unnest(range(9)) AS k) WHERE text <> ''),
n AS (SELECT *, coalesce(trim(surface) <> '' AND NOT regexp_matches(trim(surface), '^[^\\p{L}]+$') AND len(string_split_regex(trim(surface), '\\s+')) <= 8, false) AS good, row_number() OVER (PARTITION BY chunk_id, surface ORDER BY ordinal) AS nth FROM c),
r AS (SELECT chunk_id, ordinal, text, surface, nth, 0 AS step, CAST(0 AS BIGINT) AS pos FROM n WHERE good UNION ALL
SELECT chunk_id, ordinal, text, surface, nth, step + 1, CASE WHEN strpos(substr(text, pos + 1), surface) = 0 THEN -1 ELSE pos + strpos(substr(text, pos + 1), surface) END FROM r WHERE step < nth AND pos >= 0),
f AS (SELECT chunk_id, ordinal, arg_max(pos, step) AS pos FROM r GROUP BY ALL)
SELECT chunk_id, ordinal, surface, CASE WHEN NOT good THEN 'rejected' WHEN pos > 0 THEN 'located' ELSE 'unlocatable' END AS status, CASE WHEN pos > 0 THEN pos - 1 END AS start FROM n LEFT JOIN f USING (chunk_id, ordinal)""")
def located_mentions(t: Tables) -> DataFrame:
    words = F.split("text", " ")
    rows = t.documents.where("text <> ''").select(F.col("doc_id").alias("chunk_id"), "text", words.alias("w"), F.explode(F.expr("sequence(0L, 8L)")).alias("ordinal"))
    surface = F.when(F.col("ordinal") % 4 == 3, "--").otherwise(F.get("w", (F.col("ordinal") % 3).cast("int")))
    return passages.located(rows.select("chunk_id", "ordinal", surface.alias("surface")), t.documents.select(F.col("doc_id").alias("chunk_id"), "text"))


@query("""WITH b AS (SELECT doc_id AS chunk_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ordinal FROM documents)
SELECT chunk_id, CAST(ordinal AS INTEGER) AS ordinal, CAST(coalesce(sum(length(line) + 2) OVER (PARTITION BY chunk_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, 100 * ordinal AS block_start FROM b""")
def chunk_layout(t: Tables) -> DataFrame:
    lines = t.documents.select(F.col("doc_id").alias("chunk_id"), F.posexplode(F.split("text", "\n")).alias("ordinal", "line"))
    return passages.layout(lines.select("chunk_id", "ordinal", F.length("line").alias("size"), (F.lit(100) * F.col("ordinal")).cast("bigint").alias("block_start")))


@query("""WITH d AS (SELECT doc_id, text, list_filter(range(5), lambda k: 20 * k + 7 <= length(text)) AS k FROM documents)
SELECT doc_id AS document_id, CASE WHEN len(k) = 0 THEN text ELSE array_to_string(list_transform(k, lambda x: substr(text, CASE WHEN x = 0 THEN 1 ELSE 20 * x - 12 END, CASE WHEN x = 0 THEN 7 ELSE 20 END) || '[M' || x || ']'), '') || substr(text, 20 * len(k) - 12) END AS text,
array_to_string(list_transform(k, lambda x: doc_id * 10 + x), ',') AS "order" FROM d""")
def marked_mentions(t: Tables) -> DataFrame:
    spans = t.documents.select("doc_id", F.length("text").alias("n"), F.explode(F.expr("sequence(0L, 4L)")).alias("k")).where("20 * k + 7 <= n")
    mentions = spans.selectExpr("doc_id as document_id", "doc_id * 10 + k as id", "20 * k + 2 as span_start", "20 * k + 7 as span_end")
    found = passages.marked(t.documents.select(F.col("doc_id").alias("document_id"), "text"), mentions)
    return found.select("document_id", "text", F.array_join(F.col("order").cast("array<string>"), ",").alias("order"))


_GROUPS = """g AS (SELECT o_custkey AS document_id, o_orderkey AS "group", [o_orderkey % 7, o_orderkey % 11, o_orderkey % 3 + 4] AS ms FROM orders),
e AS (SELECT document_id, "group", unnest(ms) AS m, unnest([0, 1, 2]) AS pos FROM g), j AS (SELECT *, row_number() OVER (PARTITION BY document_id, m ORDER BY "group", pos) AS claim FROM e)"""


def _coreference(t: Tables) -> tuple[DataFrame, DataFrame]:
    k = F.col("o_orderkey")
    markers = F.transform(F.array(k % 7, k % 11, k % 3 + 4), lambda m: F.concat(F.lit("M"), m.cast("string")))
    groups = t.orders.select(F.col("o_custkey").alias("document_id"), k.alias("group"), markers.alias("markers"))
    order = t.customer.selectExpr("c_custkey as document_id", "transform(sequence(0L, 7L), x -> c_custkey * 100 + x) as order")
    return passages.coreference(groups, order)


@query(f"""WITH {_GROUPS} SELECT document_id, "group", string_agg(CAST(document_id * 100 + m AS VARCHAR), ',' ORDER BY pos) AS members FROM j WHERE m < 8 AND claim = 1 GROUP BY ALL HAVING count(*) > 1""")
def coreference_groups(t: Tables) -> DataFrame:
    return _coreference(t)[0].select("document_id", "group", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


@query(f"WITH {_GROUPS} SELECT document_id, 'M' || m AS marker, CASE WHEN m >= 8 THEN 'unknown' ELSE 'duplicated' END AS reason FROM j WHERE m >= 8 OR claim > 1")
def rejected_markers(t: Tables) -> DataFrame:
    return _coreference(t)[1]


_PROPOSALS = "p AS (SELECT p_partkey AS k, 'new/' || p_partkey AS s, p_name AS label, CASE WHEN p_size % 3 > 0 THEN p_type END AS gloss, CASE WHEN p_size % 5 = 0 THEN p_brand END AS criterion, p_size % 4 AS n, p_size % 3 AS rel, 'Brand#' || (p_size % 60) AS parent FROM part), l AS (SELECT p_brand AS parent, min('b/' || p_brand) AS o FROM part GROUP BY 1)"


def _assembled(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = t.part.selectExpr("p_partkey as proposal", "concat('new/', p_partkey) as iri", "p_name as label", "if(p_size % 3 > 0, p_type, null) as gloss", "if(p_size % 5 = 0, p_brand, null) as criterion", "p_size % 4 as n_mentions")
    judged = t.part.selectExpr("p_partkey as proposal", "element_at(array('instance_of', 'subclass_of', 'unrelated'), cast(p_size % 3 + 1 as int)) as relation", "concat('Brand#', p_size % 60) as candidate")
    return passages.assembled(rows, judged, t.part.selectExpr("p_brand as label", "concat('b/', p_brand) as iri").distinct())


@query(f"""WITH {_PROPOSALS}, j AS (SELECT p.*, o FROM p LEFT JOIN l USING (parent) WHERE rel = 2 OR (rel = 1 AND o IS NOT NULL)),
f AS (SELECT *, unnest([{{'p': 'type', 'v': 'owl:Class', 'kind': 'iri'}}, {{'p': 'prefLabel', 'v': label, 'kind': 'literal'}}, {{'p': 'definition', 'v': gloss, 'kind': 'literal'}}, {{'p': 'scopeNote', 'v': criterion, 'kind': 'literal'}}, {{'p': 'subClassOf', 'v': CASE WHEN rel = 1 THEN o END, 'kind': 'iri'}}]) AS x FROM j)
SELECT k AS proposal, s, x.p AS p, x.v AS o, x.kind AS kind, CASE WHEN n > 0 THEN 'textual' ELSE 'world_knowledge' END AS provenance FROM f WHERE coalesce(x.v, '') <> ''""")
def assembled_axioms(t: Tables) -> DataFrame:
    return _assembled(t)[0]


@query(f"WITH {_PROPOSALS} SELECT k AS proposal, CASE WHEN rel = 0 THEN 'an example, not a kind' ELSE 'unknown parent' END AS why FROM p LEFT JOIN l USING (parent) WHERE rel = 0 OR (rel = 1 AND o IS NULL)")
def rejected_proposals(t: Tables) -> DataFrame:
    return _assembled(t)[1]


_CONFLICTS = "c AS (SELECT l_orderkey AS conflict, CASE WHEN l_linenumber = 1 THEN l_orderkey // (1 + l_orderkey % 2 * 3) ELSE -l_orderkey END AS axiom FROM lineitem)"


def _conflicts(t: Tables) -> DataFrame:
    return t.lineitem.selectExpr("cast(l_orderkey as bigint) as conflict", "if(l_linenumber = 1, l_orderkey div (1 + l_orderkey % 2 * 3), -l_orderkey) as axiom")


@query(f"""WITH RECURSIVE {_CONFLICTS}, e AS (SELECT DISTINCT x.conflict AS a, y.conflict AS b FROM c x JOIN c y USING (axiom)), r(n, m) AS (SELECT conflict, conflict FROM (SELECT DISTINCT conflict FROM c) UNION SELECT r.n, e.b FROM r JOIN e ON r.m = e.a)
SELECT n AS conflict, min(m) AS decision FROM r GROUP BY n""")
def touching_conflicts(t: Tables) -> DataFrame:
    return passages.touching(_conflicts(t))


@query()
def logical_axes(t: Tables) -> DataFrame:
    return passages.axes(_conflicts(t).withColumn("axiom", F.col("axiom").cast("string"))).select("decision", F.array_join("option", ",").alias("option"))


@query("""SELECT 'a=' || a || ';b=' || b || ';c=' || c AS branch FROM (SELECT DISTINCT n_regionkey AS a FROM nation), (SELECT DISTINCT 'x' || (r_regionkey % 3) AS b FROM region), (SELECT DISTINCT r_name AS c FROM region) ORDER BY CAST(a AS VARCHAR), b, c LIMIT 40""")
def axis_branches(t: Tables) -> DataFrame:
    one = lambda axis, option: t.region.selectExpr(f"'{axis}' as axis", f"cast({option} as string) as option").distinct()
    found = passages.branches(one("a", "r_regionkey").unionByName(one("b", "concat('x', r_regionkey % 3)")).unionByName(one("c", "r_name")), 40)
    return found.select(F.array_join(F.transform("branch", lambda x: F.concat(x["axis"], F.lit("="), x["option"])), ";").alias("branch"))


# --- reviews, versions, surveys, jobs ----------------------------------------



@query("""SELECT p_partkey AS id, CASE p_size % 4 WHEN 1 THEN 'accepted' WHEN 2 THEN 'rejected' ELSE 'open' END AS status, CASE WHEN p_size % 4 IN (1, 2) THEN nullif(CASE WHEN p_size % 3 = 0 THEN '' ELSE p_name END, '') ELSE p_type END AS comment,
CASE WHEN p_size % 4 IN (1, 2) THEN 'day ' || p_size END AS resolved_at FROM part""")
def resolved_reviews(t: Tables) -> DataFrame:
    items = t.part.selectExpr("p_partkey as id", "'open' as status", "p_type as comment", "cast(null as string) as resolved_at")
    status = "element_at(array('noted', 'accepted', 'rejected', 'open'), cast(p_size % 4 + 1 as int)) as status"
    return workflow.resolved(items, t.part.selectExpr("p_partkey as id", status, "if(p_size % 3 = 0, '', p_name) as comment", "concat('day ', p_size) as at"))


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'brand=' || p_brand || ';name=new;size=' || p_size ELSE 'brand=' || p_brand || ';name=' || p_name END AS payload FROM part""")
def annotated_reviews(t: Tables) -> DataFrame:
    items = t.part.select(F.col("p_partkey").alias("id"), F.create_map(F.lit("brand"), "p_brand", F.lit("name"), "p_name").alias("payload"))
    patches = t.part.where("p_size % 2 = 0").select(F.col("p_partkey").alias("id"), F.create_map(F.lit("name"), F.lit("new"), F.lit("size"), F.col("p_size").cast("string")).alias("patch"))
    entries = F.array_sort(F.transform(F.map_entries("payload"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return workflow.annotated(items, patches).select("id", F.array_join(entries, ";").alias("payload"))


@query("SELECT user_id AS session_id, count(*) AS seq, user_id || ':v' || count(*) AS version_id FROM events GROUP BY 1")
def next_versions(t: Tables) -> DataFrame:
    return workflow.ordinals(t.events.select(F.col("user_id").alias("session_id")))


@query("""WITH f AS (SELECT 'p/' || p_partkey AS s, 'made:of' AS p, p_type AS o FROM part UNION ALL SELECT 'p/' || p_partkey, 'has:size', CAST(p_size AS VARCHAR) FROM part),
h AS (SELECT DISTINCT sha256(s || ' ' || p || ' ' || o) AS h FROM f), a AS (SELECT left(h, 6) AS b, sha256(string_agg(h, chr(10) ORDER BY h)) AS h, count(*) AS n FROM h GROUP BY 1), b AS (SELECT left(b, 3) AS b, sha256(string_agg(h, chr(10) ORDER BY b)) AS h, sum(n) AS n FROM a GROUP BY ALL),
v AS (SELECT count(*) AS seq FROM events WHERE user_id = 7) SELECT '7:v' || seq AS version_id, '7' AS session_id, 'root' AS parent_id, hash AS state_hash, n AS n_axioms, 'first' AS note, seq FROM v, (SELECT CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(h, chr(10) ORDER BY b)) AS hash FROM b)""")
def committed_version(t: Tables) -> DataFrame:
    s = F.concat(F.lit("p/"), F.col("p_partkey").cast("string"))
    facts = F.array(F.struct(F.lit("made:of").alias("p"), F.col("p_type").alias("o")), F.struct(F.lit("has:size").alias("p"), F.col("p_size").cast("string").alias("o")))
    triples = t.part.select(s.alias("s"), F.explode(facts).alias("x")).select("s", "x.p", "x.o")
    return workflow.commit(t.events.select(F.col("user_id").cast("string").alias("session_id")), triples, "7", "root", "first")[0]


@query("SELECT o_orderkey AS version_id, 'h' || (o_custkey % 2) AS rules_hash, CASE WHEN o_orderkey % 5 = 0 THEN true ELSE o_custkey % 2 <> o_orderkey % 2 END AS changed FROM orders WHERE o_orderkey % 3 = 0")
def stamped_rules(t: Tables) -> DataFrame:
    versions = t.orders.selectExpr("o_orderkey as version_id", "if(o_orderkey % 5 = 0, null, concat('h', o_orderkey % 2)) as rules_hash")
    return workflow.stamped(versions, t.orders.where("o_orderkey % 3 = 0").selectExpr("o_orderkey as version_id", "concat('h', o_custkey % 2) as rules_hash"))


@query("""WITH b AS (SELECT string_agg(DISTINCT CAST(o_orderkey AS VARCHAR), ',' ORDER BY CAST(o_orderkey AS VARCHAR)) AS m FROM orders WHERE o_orderkey % 3 > 0 GROUP BY o_custkey HAVING count(*) > 1),
a AS (SELECT string_agg(DISTINCT CAST(o_orderkey AS VARCHAR), ',' ORDER BY CAST(o_orderkey AS VARCHAR)) AS m FROM orders GROUP BY o_custkey HAVING count(*) > 1) SELECT m AS members FROM a EXCEPT SELECT m FROM b""")
def declared_merges(t: Tables) -> DataFrame:
    rows = t.orders.selectExpr("o_custkey as group", "cast(o_orderkey as string) as member", "o_orderkey % 3 > 0 as before")
    return workflow.merges(rows.where("before"), rows).select(F.array_join("members", ",").alias("members"))


_COUNTS = """n AS (SELECT (SELECT count(*) FROM pages) AS blocks, (SELECT count(*) FROM events) AS mentions, (SELECT count(*) FROM events WHERE event_type = 'purchase') AS grouped, count(*) FILTER (e.event_id IS NOT NULL) AS typed,
count(*) FILTER (e.event_id IS NOT NULL AND o_orderkey % 5 = 0) AS grey, count(*) FILTER (e.event_id IS NOT NULL AND o_orderkey % 7 = 0) AS orphans, count(*) FILTER (e.event_id IS NULL) AS stale FROM orders LEFT JOIN events e ON event_id = o_orderkey)"""


def _counts(t: Tables) -> DataFrame:
    mentions = t.events.select(F.col("event_id").alias("mention_id"))
    typed = workflow.typing_counts(t.orders.selectExpr("o_orderkey as mention_id", "if(o_orderkey % 5 = 0, 'grey', 'auto') as zone", "if(o_orderkey % 7 = 0, null, 'x') as iri"), mentions)
    return typed.crossJoin(t.pages.agg(F.count("*").alias("blocks"))).crossJoin(t.events.agg(F.count("*").alias("mentions"), F.count_if(F.col("event_type") == "purchase").alias("grouped")))


@query(f"WITH {_COUNTS} SELECT typed, grey, orphans, stale FROM n")
def typing_counts(t: Tables) -> DataFrame:
    return _counts(t).select("typed", "grey", "orphans", "stale")


_PLAN = f"""{_COUNTS}, s AS (SELECT unnest([
{{'place': 0, 'step': 'ingest', 'state': CASE WHEN blocks > 0 THEN 'done' ELSE 'ready' END}},
{{'place': 1, 'step': 'extract', 'state': CASE WHEN mentions > 0 THEN 'done' WHEN blocks = 0 THEN 'blocked' ELSE 'ready' END}},
{{'place': 2, 'step': 'coref', 'state': CASE WHEN grouped > 0 THEN 'done' WHEN mentions = 0 THEN 'blocked' ELSE 'ready' END}},
{{'place': 3, 'step': 'match', 'state': CASE WHEN typed > 0 THEN 'done' WHEN mentions = 0 THEN 'blocked' ELSE 'ready' END}},
{{'place': 4, 'step': 'grey zone', 'state': CASE WHEN grey = 0 THEN 'done' WHEN typed = 0 THEN 'blocked' ELSE 'waiting' END}},
{{'place': 5, 'step': 'bridge', 'state': CASE WHEN orphans = 0 THEN 'blocked' ELSE 'ready' END}},
{{'place': 6, 'step': 'induce', 'state': 'blocked'}}, {{'place': 7, 'step': 'axiomatize', 'state': 'blocked'}}, {{'place': 8, 'step': 'branch', 'state': 'blocked'}}, {{'place': 9, 'step': 'label check', 'state': 'ready'}},
{{'place': 10, 'step': 'review', 'state': 'waiting'}}, {{'place': 11, 'step': 'regenerate', 'state': CASE WHEN typed > 0 THEN 'ready' ELSE 'blocked' END}},
{{'place': 12, 'step': 'competency questions', 'state': 'blocked'}}, {{'place': 13, 'step': 'stop?', 'state': 'ready'}}], recursive := true) FROM n)"""


def _plan(t: Tables) -> DataFrame:
    rest = "0L as bridged", "0L as proposals", "0L as axioms", "0L as open_branches", "0L as verified", "3L as open_reviews", "0L as questions"
    return workflow.survey(_counts(t).selectExpr("*", *rest))


@query(f"WITH {_PLAN} SELECT place, step, state FROM s")
def stage_survey(t: Tables) -> DataFrame:
    return _plan(t)


@query(f"WITH {_PLAN} SELECT place, step, state FROM s WHERE state IN ('waiting', 'ready') ORDER BY state <> 'waiting', place LIMIT 1")
def next_step(t: Tables) -> DataFrame:
    return workflow.next_step(_plan(t))


@query("SELECT (SELECT count(*) FROM events WHERE user_id = 7) AS mentions, (SELECT count(*) FROM orders WHERE o_custkey = 7) AS versions")
def reopening_impact(t: Tables) -> DataFrame:
    return workflow.left_behind("7", mentions=t.events.select(F.col("user_id").cast("string").alias("session_id")), versions=t.orders.select(F.col("o_custkey").cast("string").alias("session_id")))


@query("SELECT lang AS class, source AS reason, count(*) AS n FROM documents GROUP BY ALL")
def page_tally(t: Tables) -> DataFrame:
    return workflow.tally(t.documents.select(F.col("lang").alias("class"), F.col("source").alias("reason")))


_JOBS = "j AS (SELECT event_id AS job_id, user_id AS session_id, CASE event_type WHEN 'purchase' THEN 'running' WHEN 'click' THEN 'queued' ELSE 'done' END AS status, ts AS created_at, ts + INTERVAL 1 MINUTE AS beat_at FROM events), k AS (SELECT max(ts) AS now FROM events)"


def _jobs(t: Tables) -> DataFrame:
    status = F.when(F.col("event_type") == "purchase", "running").when(F.col("event_type") == "click", "queued").otherwise("done")
    return t.events.select(F.col("event_id").alias("job_id"), F.col("user_id").alias("session_id"), status.alias("status"), F.col("ts").alias("created_at"), (F.col("ts") + F.expr("INTERVAL 1 MINUTE")).alias("beat_at"), F.lit(None).cast("string").alias("worker"))


@query(f"""WITH {_JOBS}, live AS (SELECT DISTINCT session_id FROM j, k WHERE status = 'running' AND beat_at >= now - INTERVAL 2 DAY)
SELECT session_id, arg_min(job_id, (created_at, job_id)) AS job_id FROM j WHERE status = 'queued' AND session_id NOT IN (SELECT session_id FROM live) GROUP BY 1""")
def claimable_jobs(t: Tables) -> DataFrame:
    now = F.lit(t.events.agg(F.max("ts").alias("now")).first()["now"])
    return workflow.claimable(_jobs(t), now, "INTERVAL 2 DAYS")


@query(f"SELECT job_id, CASE WHEN status = 'queued' AND job_id % 3 = 0 THEN 'running' ELSE status END AS status, CASE WHEN status = 'queued' AND job_id % 3 = 0 THEN 'w' || (job_id % 2) END AS worker FROM (WITH {_JOBS} SELECT * FROM j)")
def claimed_jobs(t: Tables) -> DataFrame:
    claims = t.events.where("event_id % 3 = 0").selectExpr("event_id as job_id", "explode(array(concat('w', event_id % 2), 'w7')) as worker")
    return workflow.claimed(_jobs(t), claims, F.current_timestamp()).select("job_id", "status", "worker")


@query(f"WITH {_JOBS} SELECT job_id, CASE WHEN status = 'running' AND beat_at < now - INTERVAL 2 DAY THEN 'queued' ELSE status END AS status FROM j, k")
def swept_jobs(t: Tables) -> DataFrame:
    now = F.lit(t.events.agg(F.max("ts").alias("now")).first()["now"])
    return workflow.swept(_jobs(t), now, "INTERVAL 2 DAYS").select("job_id", "status")


# --- reports, names, batches -------------------------------------------------


@query("""WITH x AS (SELECT 'o:part' AS p, l_orderkey AS s, l_partkey AS o FROM lineitem UNION ALL SELECT 'o:status', o_orderkey, o_custkey FROM orders), c AS (SELECT p, s, count(DISTINCT o) AS k, s % 10 = 0 AS u FROM x GROUP BY ALL),
h AS (SELECT p, k, count(*) AS n FROM c WHERE NOT u GROUP BY ALL) SELECT p, CAST(sum(n) AS BIGINT) AS individuals, string_agg(k || ':' || n, ',' ORDER BY k) AS distribution, (SELECT count(*) FROM c WHERE u AND c.p = h.p) AS excluded FROM h GROUP BY p""")
def functional_histogram(t: Tables) -> DataFrame:
    found = workflow.functional_histogram(_facts(t), t.orders.where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("s")))
    pairs = F.array_sort(F.transform(F.map_entries("distribution"), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("n"))))
    return found.select("p", "individuals", F.array_join(F.transform(pairs, lambda e: F.concat_ws(":", e["k"].cast("string"), e["n"].cast("string"))), ",").alias("distribution"), "excluded")


def _facts(t: Tables) -> DataFrame:
    parts = t.lineitem.selectExpr("'o:part' as p", "l_orderkey as s", "l_partkey as o")
    return parts.unionByName(t.orders.selectExpr("'o:status' as p", "o_orderkey as s", "o_custkey as o"))


@query("SELECT 'o:status' AS p, count(*) FILTER (o_orderkey % 10 <> 0) AS individuals, count(*) FILTER (o_orderkey % 10 = 0) AS excluded FROM orders")
def functional_findings(t: Tables) -> DataFrame:
    return workflow.functional_findings(workflow.functional_histogram(_facts(t), t.orders.where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("s"))), 20)


@query("""WITH p AS (SELECT p_name AS label, p_size % 4 AS documents FROM part) SELECT count(*) AS classes, count(*) FILTER (documents = 0) AS absent, count(*) FILTER (documents = 1) AS single_document,
count(*) FILTER (len(string_split_regex(trim(label), '\\s+')) > 1) AS multiword, round(1 - count(*) FILTER (documents = 0) / count(*), 6) AS coverage FROM p""")
def alignment_report(t: Tables) -> DataFrame:
    found = workflow.alignment(t.part.select(F.col("p_name").alias("label"), (F.col("p_size") % 4).alias("documents")))
    return found.withColumn("coverage", F.round("coverage", 6))


@query("""WITH l AS (SELECT l_orderkey AS iri, CASE WHEN l_orderkey % 9 > 0 THEN l_orderkey % 2 END AS a, CASE WHEN l_linenumber % 5 > 0 THEN l_linenumber % 2 END AS b, (l_partkey + l_suppkey) % 100 / 100 AS score FROM lineitem)
SELECT iri, CASE WHEN bool_or(a IS NULL OR b IS NULL) OR NOT bool_or(a IS NOT DISTINCT FROM b) THEN 'cross_language_unverified' ELSE 'same_language_mismatch' END AS reason FROM l GROUP BY iri HAVING max(score) < 0.6""")
def label_divergences(t: Tables) -> DataFrame:
    return workflow.divergences(t.lineitem.selectExpr("l_orderkey as iri", "if(l_orderkey % 9 > 0, l_orderkey % 2, null) as language", "if(l_linenumber % 5 > 0, l_linenumber % 2, null) as declared_language", "(l_partkey + l_suppkey) % 100 / 100 as score"), 0.6)


@query("""WITH n AS (SELECT 'p/' || p_partkey AS s, p_name AS o, 'en' AS lang FROM part UNION ALL SELECT 'p/' || p_partkey, p_type, 'es' FROM part), f AS (SELECT 'p/' || p_partkey AS s, p_name AS o, 'en' AS lang FROM part)
SELECT s, 'rdfs:label' AS p, o, lang FROM n UNION SELECT s, 'skos:prefLabel', o, lang FROM f UNION SELECT s, 'skos:altLabel', o, lang FROM n UNION SELECT s, 'skos:altLabel', o, lang FROM f""")
def written_labels(t: Tables) -> DataFrame:
    one = lambda text, lang: t.part.selectExpr("concat('p/', p_partkey) as iri", f"{text} as text", f"'{lang}' as lang")
    return workflow.label_triples(one("p_name", "en").unionByName(one("p_type", "es")), one("p_name", "en"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '## ' || text WHEN 1 THEN '![figure p' || (doc_id % 9) || '](a/' || doc_id || ')' WHEN 2 THEN '<!-- page ' || (doc_id % 9) || ': ' || text || ' -->' ELSE text END AS rendered,
CASE WHEN doc_id % 3 = 0 THEN source ELSE source || '. ' || lang END AS mention FROM documents""")
def rendered_blocks(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, ("heading", "figure", "unparsed", "paragraph"))), (d % 4 + 1).cast("int"))
    mention = workflow.mention_text(F.col("source"), F.when(d % 3 > 0, F.col("lang")), True)
    return t.documents.select("doc_id", workflow.rendered(kind, F.col("text"), d % 9, F.concat(F.lit("a/"), d.cast("string"))).alias("rendered"), mention.alias("mention"))


@query("""SELECT p_partkey AS line_id, CASE WHEN p_size % 2 = 0 THEN p_name ELSE '…' || p_partkey END || ' rdfs:subClassOf …x' || p_size || ' .' AS line FROM part""")
def readable_lines(t: Tables) -> DataFrame:
    iri = F.concat(F.lit("http://example.org/p/"), F.col("p_partkey").cast("string"))
    line = F.concat(F.lit("<"), iri, F.lit("> <http://www.w3.org/2000/01/rdf-schema#subClassOf> <http://example.org/o#x"), F.col("p_size").cast("string"), F.lit("> ."))
    return workflow.readable(t.part.select(F.col("p_partkey").alias("line_id"), line.alias("line")), t.part.where("p_size % 2 = 0").select(iri.alias("iri"), F.col("p_name").alias("label")))


# --- SPARQL and blank nodes --------------------------------------------------


def _graph(t: Tables) -> DataFrame:
    n = lambda kind, c: F.concat(F.lit(f"http://example.org/{kind}/"), F.col(c).cast("string"))
    fact = lambda rows, s, p, o: rows.select(s.alias("s"), F.lit(f"http://example.org/{p}" if ":" not in p else p).alias("p"), o.alias("o"))
    c, nation = n("c", "c_custkey"), n("n", "n_nationkey")
    parts = [
        fact(t.customer, c, "rdf:type", F.lit("http://example.org/Customer")), fact(t.customer, c, "in", n("n", "c_nationkey")), fact(t.customer, c, "segment", F.col("c_mktsegment")),
        fact(t.customer, c, "balance", F.col("c_acctbal").cast("string")), fact(t.nation, nation, "in", n("r", "n_regionkey")), fact(t.nation, nation, "name", F.col("n_name")),
        fact(t.orders, n("c", "o_custkey"), "placed", n("o", "o_orderkey")), fact(t.orders.where("o_orderstatus = 'F'"), n("o", "o_orderkey"), "status", F.lit("final")),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


_PREFIX = "PREFIX : <http://example.org/>\n"


@query("""SELECT n_name AS name, count(DISTINCT c_custkey) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE CAST(CAST(c_acctbal AS VARCHAR) AS DOUBLE) > 1000 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1""")
def sparql_counts(t: Tables) -> DataFrame:
    return sparql.select(_graph(t), _PREFIX + """SELECT ?name (COUNT(DISTINCT ?c) AS ?n) WHERE {
      ?c a :Customer ; :in ?nation ; :balance ?b . ?nation :name ?name .
      FILTER(?b > 1000) FILTER NOT EXISTS { ?c :placed ?o . ?o :status "final" } } GROUP BY ?name""")


@query("""SELECT DISTINCT 'http://example.org/c/' || c_custkey AS c, 'http://example.org/r/' || n_regionkey AS r, c_mktsegment AS s FROM customer JOIN nation ON c_nationkey = n_nationkey
WHERE regexp_matches(c_mktsegment, '^[AB]') OR c_mktsegment = 'MACHINERY' UNION SELECT DISTINCT 'http://example.org/c/' || c_custkey, 'http://example.org/n/' || c_nationkey, c_mktsegment FROM customer WHERE regexp_matches(c_mktsegment, '^[AB]') OR c_mktsegment = 'MACHINERY'""")
def sparql_paths(t: Tables) -> DataFrame:
    return sparql.select(_graph(t), _PREFIX + """SELECT DISTINCT ?c ?r ?s WHERE { ?c :in+ ?r . ?c a :Customer ; :segment ?s . FILTER(REGEX(?s, "^[AB]") || ?s = "MACHINERY") }""")


@query("""SELECT 'http://example.org/c/' || c_custkey AS c, CASE WHEN o_orderkey IS NOT NULL THEN 'http://example.org/o/' || o_orderkey END AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F'
WHERE c_mktsegment IN ('BUILDING', 'FURNITURE')""")
def sparql_optional(t: Tables) -> DataFrame:
    return sparql.select(_graph(t), _PREFIX + """SELECT ?c ?o WHERE { { ?c :segment "BUILDING" } UNION { ?c :segment "FURNITURE" } OPTIONAL { ?c :placed ?o . ?o :status "final" } }""")


def _blank(t: Tables, name: str) -> DataFrame:
    node = lambda c: F.concat(F.lit(f"_:{name}"), c.cast("string"))
    o = F.col("o_orderkey")
    first = t.orders.select(F.concat(F.lit("c/"), F.col("o_custkey").cast("string")).alias("s"), F.lit("has").alias("p"), node(o if name == "a" else o * 7 + 1).alias("o"))
    second = t.orders.select(node(o if name == "a" else o * 7 + 1).alias("s"), F.lit("of").alias("p"), F.concat(F.lit("k/"), o.cast("string")).alias("o"))
    third = t.orders.select(node(o if name == "a" else o * 7 + 1).alias("s"), F.lit("self").alias("p"), node(o if name == "a" else o * 7 + 1).alias("o"))
    return first.unionByName(second).unionByName(third)


@query("SELECT 3 * count(*) AS n, true AS same, 0 AS changes FROM orders")
def renamed_blanks(t: Tables) -> DataFrame:
    one, two = _blank(t, "a"), _blank(t, "b")
    old, new = (shelve(graph.logical(x)) for x in (one, two))
    both = graph.digest(old).withColumnRenamed("hash", "h").crossJoin(graph.digest(new).select(F.col("hash").alias("g")))  # one row each
    return both.crossJoin(graph.changes(old, new, one, two).agg(F.count("*").cast("int").alias("changes"))).select("n", (F.col("h") == F.col("g")).alias("same"), "changes")


# --- model stages ------------------------------------------------------------


@query("""SELECT p_partkey AS label, CASE WHEN p_size % 5 = 0 THEN 'unreadable' ELSE 'done' END AS status, CASE WHEN p_size % 5 > 0 THEN CAST(length(p_name) + length(p_brand) + 6 AS VARCHAR) END AS parsed FROM part""")
def model_stage(t: Tables) -> DataFrame:
    prompt = ledger.payload("Name {name} of {brand}", name=F.col("p_name"), brand=F.col("p_brand"))
    units = t.part.select(F.col("p_partkey").cast("string").alias("label"), F.concat(prompt, F.when(F.col("p_size") % 5 == 0, "?").otherwise("")).alias("payload"))
    empty = t.spark.createDataFrame([], "key string, label string, status string, attempts int, result string")
    answer = lambda text: "no idea" if text.endswith("?") else '{"n": %d}' % (len(text) - 3)
    _, found = ledger.model_stage(empty, units, answer, lambda c: F.get_json_object(tx.outer_json(c), "$.n"), "naming", "v1", F.lit("scripted"))
    return found.withColumn("label", F.col("label").cast("int"))


@query("SELECT DISTINCT p_type AS item, CASE WHEN p_type LIKE '%X%' THEN NULL ELSE upper(p_type) || '!' END AS result FROM part")
def split_batches(t: Tables) -> DataFrame:
    def answer(items: list[str]) -> list[str]:
        if any("X" in x for x in items):
            raise ValueError("mangled")
        return [x.upper() + "!" for x in items]

    return ledger.split_batches(t.part.select("p_type"), answer, 16)


# --- small joins and filters -------------------------------------------------


@query("""SELECT doc_id AS document_id, CAST(o - 1 AS INTEGER) AS ordinal, line AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS o FROM documents WHERE source = 'src3' AND doc_id % 10 <> 0)
WHERE trim(line) <> '' AND NOT contains(line, ' | ')""")
def corpus_blocks(t: Tables) -> DataFrame:
    lines = t.documents.select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("ordinal", "text"))
    blocks = lines.withColumn("block_type", F.when(F.contains("text", F.lit(" | ")), "figure").otherwise("paragraph")).withColumn("is_boilerplate", F.trim("text") == "")
    documents = t.documents.select(F.col("doc_id").alias("document_id"), F.col("source").alias("session_id"), (F.col("doc_id") % 10 == 0).alias("held_out"))
    return workflow.corpus_blocks(blocks, documents, "src3").select("document_id", "ordinal", "text")


@query("SELECT l_partkey AS mention_id, min(l_orderkey) AS bridge_id, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F' GROUP BY 1")
def bridged_mentions(t: Tables) -> DataFrame:
    bridges = t.orders.selectExpr("o_orderkey as bridge_id", "if(o_orderstatus = 'F', 'rejected', 'open') as status")
    return workflow.bridged(t.lineitem.selectExpr("l_partkey as mention_id", "l_orderkey as bridge_id"), bridges)


@query("SELECT event_id AS mention_id, event_type AS iri, user_id AS entity FROM events WHERE event_id % 3 = 0 OR (event_id % 3 = 1 AND event_id % 2 = 0)")
def accepted_types(t: Tables) -> DataFrame:
    zone = F.when(F.col("event_id") % 3 == 0, "auto").when(F.col("event_id") % 3 == 1, "grey").otherwise("discarded")
    typed = t.events.select(F.col("event_id").alias("mention_id"), F.col("event_type").alias("iri"), F.col("user_id").alias("entity"), zone.alias("zone"))
    return workflow.accepted_types(typed, t.events.where("event_id % 2 = 0").select(F.col("event_id").alias("mention_id"))).select("mention_id", "iri", "entity")


@query("""WITH m AS (SELECT conv_id AS d, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, conv_id || '/' || turn AS id, CASE WHEN turn % 3 > 0 THEN role END AS iri, turn AS a, turn + length(text) AS z, text, turn % 2 = 0 AS known, CASE WHEN turn % 4 > 0 THEN role END AS entity FROM conversations),
c AS (SELECT d, entity, list('T' || n ORDER BY n) AS m, min(n) AS f FROM m WHERE entity IS NOT NULL GROUP BY ALL), e AS (SELECT d, entity AS name, m[1] AS t FROM c UNION ALL SELECT d, id, 'T' || n FROM m),
r AS (SELECT conv_id AS d, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, role AS s, conv_id || '/' || (turn - 1) AS o FROM conversations)
SELECT d AS document_id, 0 AS part, n AS place, 'T' || n || chr(9) || coalesce(iri, 'Unassigned') || ' ' || a || ' ' || z || chr(9) || text AS value FROM m
UNION ALL SELECT d, 1, n, 'A' || row_number() OVER (PARTITION BY d ORDER BY n) || chr(9) || 'InInventory T' || n FROM m WHERE known
UNION ALL SELECT r.d, 2, r, 'R' || r || chr(9) || 'follows Arg1:' || x.t || ' Arg2:' || y.t FROM r JOIN e x ON x.d = r.d AND x.name = s JOIN e y ON y.d = r.d AND y.name = o
UNION ALL SELECT d, 3, f, '*' || chr(9) || 'Coreference ' || array_to_string(m, ' ') FROM c WHERE len(m) > 1""")
def brat_documents(t: Tables) -> DataFrame:
    rows = t.conversations.selectExpr(
        "conv_id as document_id", "turn as ordinal", "concat_ws('/', conv_id, turn) as id", "if(turn % 3 > 0, role, null) as iri", "turn as start", "turn + length(text) as stop", "text", "turn % 2 = 0 as known", "if(turn % 4 > 0, role, null) as entity"
    )
    relations = t.conversations.selectExpr("conv_id as document_id", "turn as ordinal", "role as subject", "'follows' as predicate", "concat_ws('/', conv_id, turn - 1) as object")
    return writers.brat_document(rows, relations)


@query("SELECT 'documents' AS part, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'labels', count(*) FROM labels WHERE toxic = 1")
def export_manifest(t: Tables) -> DataFrame:
    return writers.manifest(documents=t.documents, pages=t.pages, labels=t.labels.where("toxic = 1"))


_CHOICES = "c AS (SELECT o_custkey AS branch_id, 'x' || (o_orderkey % 5) AS axis, o_orderpriority AS option FROM orders), h AS (SELECT 'x' || (p_size % 7) AS axis, ['1-URGENT', '2-HIGH', '3-MEDIUM'][p_size % 3 + 1] AS option, sum(p_size % 5 - 2) AS weight FROM part GROUP BY ALL)"


@query(f"""WITH {_CHOICES} SELECT branch_id, CASE WHEN count(*) FILTER (weight <> 0) > 0 THEN round(count(*) FILTER (weight > 0) / count(*), 6) END AS affinity FROM c LEFT JOIN h USING (axis, option) GROUP BY 1""")
def branch_affinity(t: Tables) -> DataFrame:
    choices = t.orders.selectExpr("o_custkey as branch_id", "concat('x', o_orderkey % 5) as axis", "o_orderpriority as option")
    history = t.part.selectExpr("concat('x', p_size % 7) as axis", "element_at(array('1-URGENT', '2-HIGH', '3-MEDIUM'), cast(p_size % 3 + 1 as int)) as option", "p_size % 5 - 2 as w")
    found = decisions.affinity(choices, history.groupBy("axis", "option").agg(F.sum("w").alias("weight")))
    return found.select("branch_id", F.round("affinity", 6).alias("affinity"))


@query("""SELECT o_orderkey || ':' || axis AS id, o_orderkey AS branch_id, status, string_split(axis, ':')[1] AS axis, coalesce(note, '') AS comment FROM (SELECT o_orderkey, ['chosen', 'not_chosen', 'invalid'][o_orderkey % 4 + 1] AS status, CASE WHEN o_custkey % 2 = 0 THEN o_orderpriority END AS note,
unnest(CASE o_orderkey % 3 WHEN 0 THEN [''] WHEN 1 THEN ['kind:a'] ELSE ['kind:a', 'grain'] END) AS axis FROM orders WHERE o_orderkey % 4 < 3)""")
def decision_record(t: Tables) -> DataFrame:
    axes = "transform(case o_orderkey % 3 when 0 then array() when 1 then array('kind:a') else array('kind:a', 'grain') end, x -> named_struct('axis', x, 'option', 'o')) as axes"
    rows = t.orders.selectExpr("o_orderkey as branch_id", "element_at(array('chosen', 'not_chosen', 'invalid', 'proposed'), cast(o_orderkey % 4 + 1 as int)) as status", "if(o_custkey % 2 = 0, o_orderpriority, null) as note", axes)
    return decisions.decided(rows)


@query("""WITH h AS (SELECT o_custkey % 200 AS decision_id, o_orderkey AS branch_id, CASE WHEN o_custkey % 3 = 0 THEN 'chosen' ELSE 'proposed' END AS status FROM orders WHERE o_orderkey % 2 = 0), f AS (SELECT o_custkey % 300 AS decision_id, -o_orderkey AS branch_id, 'proposed' AS status FROM orders WHERE o_orderkey % 5 = 0),
c AS (SELECT DISTINCT decision_id FROM h WHERE status = 'chosen') SELECT * FROM h WHERE decision_id IN (SELECT * FROM c) OR decision_id NOT IN (SELECT decision_id FROM f) UNION ALL SELECT * FROM f WHERE decision_id NOT IN (SELECT * FROM c)""")
def persisted_branches(t: Tables) -> DataFrame:
    held = t.orders.where("o_orderkey % 2 = 0").selectExpr("o_custkey % 200 as decision_id", "o_orderkey as branch_id", "if(o_custkey % 3 = 0, 'chosen', 'proposed') as status")
    return decisions.unsettled(held, t.orders.where("o_orderkey % 5 = 0").selectExpr("o_custkey % 300 as decision_id", "-o_orderkey as branch_id", "'proposed' as status"))


@query("""WITH f AS (SELECT * FROM events WHERE event_id % 9 > 0), x AS (SELECT 'document/' || user_id AS g, unnest([{'s': CAST(user_id % 50 AS VARCHAR), 'p': 'prov:wasDerivedFrom', 'o': 'mention/' || event_id}, {'s': 'mention/' || event_id, 'p': 'nif:anchorOf', 'o': event_type},
{'s': 'mention/' || event_id, 'p': 'itsrdf:taIdentRef', 'o': CASE WHEN event_id % 4 > 0 THEN 'k/' || (event_id % 7) END}]) AS t FROM f) SELECT DISTINCT t.s AS s, t.p AS p, t.o AS o, g FROM x WHERE t.o IS NOT NULL""")
def mention_quads(t: Tables) -> DataFrame:
    typed = t.events.selectExpr("user_id % 50 as entity", "event_id as mention_id", "if(event_id % 4 > 0, concat('k/', event_id % 7), null) as iri", "user_id as document_id", "event_type as surface")
    return graph.provenance(typed, t.events.where("event_id % 9 = 0").select(F.col("event_id").alias("mention_id")))


@query("""WITH l AS (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, event_type AS kind, CAST(event_id AS VARCHAR) AS summary FROM events WHERE event_id % 2 = 0),
n AS (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type, CAST(event_id AS VARCHAR)) AS n, event_type AS kind, CAST(event_id AS VARCHAR) AS summary FROM events WHERE event_id % 2 = 1)
SELECT * FROM l UNION ALL SELECT session_id, coalesce((SELECT max(seq) FROM l WHERE l.session_id = n.session_id), 0) + n, kind, summary FROM n""")
def session_log(t: Tables) -> DataFrame:
    log = t.events.where("event_id % 2 = 0").selectExpr("user_id as session_id", "cast(row_number() over (partition by user_id order by event_id) as bigint) as seq", "event_type as kind", "cast(event_id as string) as summary")
    return workflow.logged(log, t.events.where("event_id % 2 = 1").selectExpr("user_id as session_id", "event_type as kind", "cast(event_id as string) as summary", "ts as at"))
