"""One query for each group of operators, over the driver's tables, and its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from conceptflow import ledger
from conceptflow.functions import text as tx
from conceptflow.operators import folds, graph, parts, relational, state, vectors
from conceptflow.sources import writers
from conceptflow.streaming import arrivals

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
AUTO, GREY = 0.45, 0.35


class Tables:
    """The driver's tables as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function of ``Tables`` under its name, with its twin."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- typing by vectors -------------------------------------------------------


def _mentions(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("mention_id"), F.col("embedding").cast("array<double>").alias("v"), "label")


def _names(t: Tables) -> DataFrame:
    rows = t.embeddings.select("label", (F.col("vec_id") % 3).alias("k"), F.posexplode("embedding").alias("i", "x"))
    means = rows.groupBy("label", "k", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))
    lists = means.groupBy("label", "k").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    return lists.select(F.concat(F.lit("class/"), F.col("label").cast("string")).alias("iri"), "v")


def _ranked(t: Tables, top_k: int = 5) -> DataFrame:
    return vectors.rank_targets(_mentions(t), _names(t), top_k)


def _typed(t: Tables) -> DataFrame:
    gold = t.embeddings.select(F.col("vec_id").alias("mention_id"), F.concat(F.lit("class/"), F.col("label").cast("string")).alias("gold"))
    return vectors.typings(_ranked(t), AUTO, GREY).join(gold, "mention_id")


_RANKED = """
names AS (SELECT label, list(x ORDER BY i) AS v FROM (
  SELECT label, vec_id % 3 AS k, i, round(avg(CAST(x AS DOUBLE)), 6) AS x
  FROM (SELECT label, vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL) GROUP BY label, k),
scored AS (SELECT vec_id AS mention_id, 'class/' || n.label AS iri, max(round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 6)) AS score,
  any_value('class/' || e.label) AS gold FROM embeddings e, names n GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, iri) AS rank FROM scored),
typed AS (SELECT mention_id, gold, max(iri) FILTER (rank = 1) AS best, max(score) FILTER (rank = 1) AS score, max(iri) FILTER (rank = 2) AS runner_up FROM ranked GROUP BY ALL),
zoned AS (SELECT *, CASE WHEN score >= 0.45 THEN 'auto' WHEN score >= 0.35 THEN 'grey' ELSE 'discarded' END AS zone FROM typed)
"""
_WITH = f"WITH {_RANKED}"


@query(f"{_WITH} SELECT mention_id, CASE WHEN zone <> 'discarded' THEN best END AS iri, score, zone, runner_up FROM zoned")
def typing_zones(t: Tables) -> DataFrame:
    return _typed(t).drop("gold")


@query(f"{_WITH} SELECT mention_id, iri, score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 3")
def typing_top_k(t: Tables) -> DataFrame:
    return _ranked(t, 3)


@query(f"{_WITH} SELECT count(*) FILTER (zone = 'auto') AS typed, count(*) FILTER (zone = 'grey') AS grey, count(*) FILTER (zone = 'discarded') AS orphan, round(avg(CASE WHEN zone = 'discarded' THEN 1.0 ELSE 0.0 END), 6) AS orphan_rate FROM zoned")
def orphan_split(t: Tables) -> DataFrame:
    is_ = lambda z: F.col("zone") == z
    return _typed(t).agg(F.count_if(is_("auto")).alias("typed"), F.count_if(is_("grey")).alias("grey"), F.count_if(is_("discarded")).alias("orphan"), F.round(F.avg(is_("discarded").cast("double")), 6).alias("orphan_rate"))


@query(f"""{_WITH} SELECT *, round(CASE WHEN accepted > 0 THEN correct / accepted ELSE 0 END, 6) AS precision, round(correct / n, 6) AS recall, round(false_orphans / n, 6) AS false_orphan_rate
FROM (SELECT count(*) AS n, count(*) FILTER (zone <> 'discarded') AS accepted, count(*) FILTER (zone <> 'discarded' AND best = gold) AS correct, count(*) FILTER (zone = 'discarded') AS false_orphans FROM zoned)""")
def orphan_report(t: Tables) -> DataFrame:
    kept = F.col("iri").isNotNull()
    one = _typed(t).agg(F.count("*").alias("n"), F.count_if(kept).alias("accepted"), F.count_if(kept & (F.col("iri") == F.col("gold"))).alias("correct"), F.count_if(~kept).alias("false_orphans"))
    precision = F.when(F.col("accepted") > 0, F.col("correct") / F.col("accepted")).otherwise(0.0)
    return one.select("*", F.round(precision, 6).alias("precision"), F.round(F.col("correct") / F.col("n"), 6).alias("recall"), F.round(F.col("false_orphans") / F.col("n"), 6).alias("false_orphan_rate"))


def _scores(t: Tables) -> DataFrame:
    gold = t.embeddings.select(F.col("vec_id").alias("mention_id"), F.concat(F.lit("class/"), F.col("label").cast("string")).alias("gold"))
    return _ranked(t).where("rank = 1").join(gold, "mention_id").select("score", (F.col("iri") == F.col("gold")).alias("correct"))


@query(f"""{_WITH}, th AS (SELECT unnest([0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]) AS threshold),
c AS (SELECT CAST(threshold AS DOUBLE) AS threshold, count(*) FILTER (score >= threshold) AS accepted, count(*) FILTER (score >= threshold AND best = gold) AS "right", count(*) AS n FROM typed, th GROUP BY ALL),
p AS (SELECT threshold, accepted, "right", CASE WHEN accepted > 0 THEN "right" / accepted ELSE 0 END AS precision, "right" / n AS recall FROM c)
SELECT threshold, accepted, "right", round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM p""")
def threshold_sweep(t: Tables) -> DataFrame:
    found = relational.sweep(_scores(t), [k / 100 for k in range(30, 100, 5)])
    return found.select("threshold", "accepted", "right", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"{_WITH} SELECT round((median(score) FILTER (best = gold) - median(score) FILTER (best <> gold)) / stddev_pop(score), 4) AS separation FROM typed")
def score_separation(t: Tables) -> DataFrame:
    return relational.separation(_scores(t)).select(F.round("separation", 4).alias("separation"))


@query(f"{_WITH}, g AS (SELECT mention_id, min(rank) FILTER (iri = gold) AS place FROM ranked GROUP BY 1) SELECT k, round(avg(CASE WHEN place <= k THEN 1.0 ELSE 0.0 END), 6) AS recall FROM g, (SELECT unnest([1, 3, 5]) AS k) GROUP BY k")
def recall_at_k(t: Tables) -> DataFrame:
    gold = t.embeddings.select(F.col("vec_id").alias("mention_id"), F.concat(F.lit("class/"), F.col("label").cast("string")).alias("iri"))
    place = gold.join(_ranked(t, 5), ["mention_id", "iri"], "left").select("rank", F.explode(F.array(*map(F.lit, (1, 3, 5)))).alias("k"))
    return place.groupBy("k").agg(F.round(F.avg(F.coalesce((F.col("rank") <= F.col("k")).cast("double"), F.lit(0.0))), 6).alias("recall"))


@query(f"{_WITH} SELECT mention_id, best AS iri, score FROM zoned WHERE zone = 'grey' AND mention_id % 7 <> 0 ORDER BY score DESC, mention_id LIMIT 20")
def grey_queue(t: Tables) -> DataFrame:
    answered = t.embeddings.where("vec_id % 7 = 0").select(F.col("vec_id").alias("mention_id"))
    return _typed(t).where("zone = 'grey'").join(answered, "mention_id", "left_anti").select("mention_id", "iri", "score").orderBy(F.desc("score"), "mention_id").limit(20)


@query(f"{_WITH} SELECT mention_id, best AS offered, gold = best AS accepted FROM zoned WHERE zone = 'grey' AND mention_id % 7 = 0")
def tuning_labels(t: Tables) -> DataFrame:
    answers = t.embeddings.where("vec_id % 7 = 0").select(F.col("vec_id").alias("mention_id"))
    return _typed(t).where("zone = 'grey'").join(answers, "mention_id").select("mention_id", F.col("iri").alias("offered"), (F.col("gold") == F.col("iri")).alias("accepted"))


_PAIRS = "pairs AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE score >= 0.45)"


def _points(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


@query(f"WITH {_PAIRS} SELECT * FROM pairs")
def similarity_pairs(t: Tables) -> DataFrame:
    return vectors.similar_pairs(_points(t), 0.45)


@query(f"""WITH RECURSIVE {_PAIRS}, e AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
r(n, m) AS (SELECT a, a FROM e UNION SELECT r.n, e.b FROM r JOIN e ON r.m = e.a),
c AS (SELECT n, min(m) AS least FROM r GROUP BY n)
SELECT sha1(string_agg(CAST(n AS VARCHAR), ',' ORDER BY n)) AS cluster_id, count(*) AS size, least FROM c GROUP BY least HAVING count(*) >= 2""")
def single_link_clusters(t: Tables) -> DataFrame:
    return vectors.single_link(_points(t), 0.45, 2)


# --- text --------------------------------------------------------------------

_LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS ordinal FROM documents)"


def _lines(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "line"))


def _blocks(t: Tables) -> DataFrame:
    kind = F.when(F.col("line").contains(" | "), "table").when(F.length("line") < 40, "caption").otherwise("paragraph")
    return _lines(t).select(F.col("doc_id").alias("document_id"), "ordinal", (F.col("ordinal") / 3).cast("int").alias("page"), F.col("line").alias("text"), kind.alias("block_type"), (F.trim("line") == "").alias("is_boilerplate"))


@query(r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(name, '[_\-]+', ' ', 'g'), '([\p{Ll}0-9])(\p{Lu})', '\1 \2', 'g'), '\s+', ' ', 'g')) AS words,
array_to_string(regexp_extract_all(lower(p_name), '\p{L}+'), ' ') AS plain, replace(p_brand, '#', '') || '_' || p_partkey AS local, replace(p_brand, '#', '') || ':' || p_partkey AS curie,
len(string_split(trim(p_name), ' ')) <= 2 AS admissible FROM (SELECT *, p_brand || '_' || p_type || 'Kind' AS name FROM part)""")
def term_functions(t: Tables) -> DataFrame:
    name = F.concat_ws("_", "p_brand", F.concat("p_type", F.lit("Kind")))
    iri = F.concat(F.lit("http://example.org/onto/"), F.concat_ws("_", F.replace("p_brand", F.lit("#"), F.lit("")), F.col("p_partkey").cast("string")))
    return t.part.select(
        "p_partkey", tx.denormalize(name).alias("words"), tx.normalized(F.col("p_name")).alias("plain"), tx.local_name(iri).alias("local"),
        tx.curie(F.concat(F.lit("http://example.org/onto/"), F.regexp_replace(tx.local_name(iri), "_", ":"))).alias("curie"), tx.admissible(F.col("p_name"), 2).alias("admissible"),
    )


def _in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


@query(f"""WITH {_LINES}, w AS (SELECT doc_id, ordinal, regexp_extract_all(lower(line), '\\p{{L}}+') AS w FROM lines),
h AS (SELECT *, len(list_filter(w, lambda x: x IN {_in(tx.MARKERS['es'])})) AS es, len(list_filter(w, lambda x: x IN {_in(tx.MARKERS['en'])})) AS en FROM w)
SELECT doc_id, ordinal, CASE WHEN len(w) < 8 THEN NULL WHEN es > en AND es >= 2 THEN 'es' WHEN en > es AND en >= 2 THEN 'en' END AS lang FROM h""")
def block_language(t: Tables) -> DataFrame:
    return _lines(t).select("doc_id", "ordinal", tx.detect_language(F.col("line")).alias("lang"))


@query("""WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL)
SELECT source, arg_max(lang, lpad(CAST(n AS VARCHAR), 12, '0') || lang) AS lang FROM c GROUP BY source""")
def majority_language(t: Tables) -> DataFrame:
    counts = t.documents.groupBy("source", "lang").agg(F.count("*").alias("n"))
    return counts.groupBy("source").agg(F.max_by("lang", F.struct("n", "lang")).alias("lang"))


_TEMPLATE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(line)), '\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b', '<ip>', 'g'), '\b[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\b|\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\b', '<date>', 'g'), '[0-9]+', '<n>', 'g'), '\s+', ' ', 'g')"


@query(f"""WITH {_LINES}, p AS (SELECT doc_id, CAST(floor(ordinal / 3) AS INTEGER) AS page, line FROM lines),
n AS (SELECT doc_id, count(DISTINCT page) AS n FROM p GROUP BY 1 HAVING count(DISTINCT page) >= 3),
g AS (SELECT doc_id, {_TEMPLATE} AS template, count(DISTINCT page) AS pages, count(*) AS k FROM p WHERE trim(line) <> '' AND length(line) <= 200 GROUP BY ALL)
SELECT doc_id AS document_id, template, pages FROM g JOIN n USING (doc_id) WHERE pages / n > 0.4 AND k > 1""")
def boilerplate_templates(t: Tables) -> DataFrame:
    return folds.boilerplate(_blocks(t), tx.template(F.col("text")), 0.4, 200)


_VOWELS = "[aeiouyáéíóúüàèìòùâêîôûäöëï]"


@query(f"""WITH w AS (SELECT doc_id, n_chars, regexp_extract_all(text, '\\p{{L}}+') AS w FROM documents),
g AS (SELECT doc_id, n_chars, CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: (length(x) > 3 AND NOT regexp_matches(lower(x), '{_VOWELS}')) OR (substr(x, 2) <> lower(substr(x, 2)) AND substr(x, 2) <> upper(substr(x, 2))))) / len(w) ELSE 0 END AS ratio FROM w),
c AS (SELECT *, CASE WHEN n_chars > 0 AND ratio >= 0.35 THEN 1 WHEN doc_id % 5 > 0 AND doc_id % 10 >= 8 THEN 2 WHEN n_chars < 40 AND doc_id % 3 = 0 AND doc_id % 7 < 5 THEN 3 WHEN n_chars < 40 THEN 4
  WHEN doc_id % 5 = 0 AND doc_id % 3 = 0 THEN 5 WHEN doc_id % 5 = 0 AND doc_id % 2 > 0 AND doc_id % 10 < 8 THEN 6 ELSE 7 END AS r FROM g)
SELECT doc_id, round(ratio, 6) AS garbled, CASE WHEN r IN (1, 2, 4) THEN 'scan' WHEN r IN (3, 5, 6) THEN 'born_digital' ELSE 'uncertain' END AS class,
  ['garbled_text', 'ocr_layer_over_page_image', 'empty_page', 'no_extractable_text', 'base_heuristic', 'embedded_fonts_with_figures', 'unresolved_signals'][r] AS reason FROM c""")
def page_classes(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    rows = t.documents.withColumn("garbled", tx.garbled_ratio(F.col("text")))
    kind, reason = tx.page_class(F.col("n_chars"), d % 5, d % 3, (d % 10) / 10, d % 7, d % 2, F.col("garbled"))
    return rows.select("doc_id", F.round("garbled", 6).alias("garbled"), kind.alias("class"), reason.alias("reason"))


@query(f"""WITH {_LINES}, s AS (SELECT doc_id, ordinal, length(line) AS n, trim(line) = '' AS b, sum(CASE WHEN trim(line) = '' THEN 0 ELSE length(line) + 2 END) OVER (PARTITION BY doc_id ORDER BY ordinal) - 2 AS e FROM lines)
SELECT doc_id AS document_id, ordinal, CAST(CASE WHEN NOT b THEN e - n END AS BIGINT) AS span_start, CAST(CASE WHEN NOT b THEN e END AS BIGINT) AS span_end FROM s""")
def markdown_spans(t: Tables) -> DataFrame:
    return folds.markdown_spans(_blocks(t)).select("document_id", "ordinal", "span_start", "span_end")


@query(f"""WITH {_LINES}, s AS (SELECT doc_id, ordinal, length(line) + 2 AS n, sum(length(line) + 2) OVER (PARTITION BY doc_id ORDER BY ordinal) AS e FROM lines)
SELECT d.doc_id, max(ordinal) AS ordinal FROM documents d JOIN s ON s.doc_id = d.doc_id AND s.e - s.n <= d.n_chars // 2 GROUP BY 1""")
def offset_to_block(t: Tables) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    starts = _lines(t).select("doc_id", "ordinal", F.coalesce(F.sum(F.length("line") + 2).over(order), F.lit(0)).alias("start"))
    asked = t.documents.select("doc_id", F.expr("n_chars div 2").alias("at"))
    return asked.join(starts, "doc_id").where("start <= at").groupBy("doc_id").agg(F.max("ordinal").alias("ordinal"))


_STRATUM = "CASE WHEN contains(line, ' | ') THEN 'tables' " + " ".join(f"WHEN regexp_matches(lower(line), '{'|'.join(cues)}') THEN '{name}'" for name, cues in tx.STRATA.items()) + " END"


@query(f"""WITH {_LINES}, s AS (SELECT l.doc_id, ordinal, lang, {_STRATUM} AS stratum FROM lines l JOIN documents USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, stratum ORDER BY sha1('7:' || doc_id || '/' || ordinal), doc_id || '/' || ordinal) AS k FROM s WHERE stratum IS NOT NULL)
SELECT lang, stratum, doc_id, ordinal FROM r WHERE k <= 5""")
def strata_sample(t: Tables) -> DataFrame:
    rows = _lines(t).join(t.documents.select("doc_id", "lang"), "doc_id").withColumn("stratum", tx.stratum(F.col("line"), F.col("line").contains(" | ")))
    key = F.concat_ws("/", F.col("doc_id").cast("string"), F.col("ordinal").cast("string"))
    return relational.sample_per(rows.where("stratum is not null"), ["lang", "stratum"], 5, key, 7).select("lang", "stratum", "doc_id", "ordinal")


@query(r"""WITH p AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS w FROM benchmark),
q AS (SELECT 'item/' || item_id AS iri, w, '(?:^|[^\p{L}\p{N}_])' || array_to_string(w, '\s+') || '(?:$|[^\p{L}\p{N}_])' AS pattern FROM p),
t AS MATERIALIZED (SELECT lower(coalesce(text, '')) AS t FROM documents),
c AS (SELECT iri, CASE WHEN contains(t, coalesce(w[1], '')) AND contains(t, coalesce(w[2], '')) AND contains(t, coalesce(w[3], '')) AND contains(t, coalesce(w[4], '')) AND contains(t, coalesce(w[5], '')) THEN len(regexp_extract_all(t, pattern)) ELSE 0 END AS n FROM q, t)
SELECT iri, CAST(sum(n) AS BIGINT) AS occurrences, count(*) FILTER (n > 0) AS documents FROM c GROUP BY iri""")
def phrase_presence(t: Tables) -> DataFrame:
    return relational.presence(t.benchmark.select(F.concat(F.lit("item/"), F.col("item_id").cast("string")).alias("iri"), F.col("text").alias("label")), t.documents)


@query("""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(p_name), '\\p{L}+')) AS w FROM part)
SELECT a.w AS a, b.w AS b, CAST(levenshtein(a.w, b.w) AS INTEGER) AS distance FROM w a JOIN w b ON a.w < b.w AND left(a.w, 1) = left(b.w, 1) AND abs(length(a.w) - length(b.w)) <= 1 WHERE levenshtein(a.w, b.w) <= 2""")
def near_misses(t: Tables) -> DataFrame:
    words = t.part.select(F.explode(F.regexp_extract_all(F.lower("p_name"), F.lit(r"(\p{L}+)"), 1)).alias("a")).distinct().withColumn("k", F.substring("a", 1, 1))
    pairs = words.join(words.withColumnRenamed("a", "b"), "k").where("a < b and abs(length(a) - length(b)) <= 1")
    return pairs.select("a", "b", tx.bounded_levenshtein(F.col("a"), F.col("b")).alias("distance")).where("distance <= 2")


@query("""WITH h AS (SELECT c_custkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(c_name)) AS d FROM customer)
SELECT c_custkey, d[1:8] || '-' || d[9:12] || '-5' || d[14:16] || '-' || substr('89ab89ab89ab89ab', strpos('0123456789abcdef', d[17]), 1) || d[18:20] || '-' || d[21:32] AS iri FROM h""")
def minted_iris(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", tx.uuid5(F.col("c_name")).alias("iri"))


@query("""SELECT event_id, sha256('{"payload":' || user_id || ',"stage":"' || event_type || '"}') AS key FROM events""")
def unit_keys(t: Tables) -> DataFrame:
    return t.events.select("event_id", tx.unit_key(F.col("user_id").alias("payload"), F.col("event_type").alias("stage")).alias("key"))


@query("SELECT page_id, nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '') AS title, length(regexp_replace(html, '<[^>]*>', '', 'g')) AS n_text FROM pages")
def page_titles(t: Tables) -> DataFrame:
    title = F.nullif(F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)), F.lit(""))
    return t.pages.select("page_id", title.alias("title"), F.length(F.regexp_replace("html", "<[^>]*>", "")).cast("bigint").alias("n_text"))


@query(f"""WITH RECURSIVE {_LINES}, u AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) AS i, ordinal, CASE WHEN contains(line, ' | ') THEN 'table' WHEN length(line) < 40 THEN 'caption' ELSE 'paragraph' END AS kind, length(line) AS n FROM lines WHERE trim(line) <> ''),
p AS (SELECT *, lead(kind) OVER w AS k2, lead(n) OVER w AS n2 FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, i, CASE WHEN least(kind, k2) = 'caption' AND greatest(kind, k2) = 'table' THEN 2 ELSE 1 END AS w, CASE WHEN least(kind, k2) = 'caption' AND greatest(kind, k2) = 'table' THEN n + n2 ELSE n END AS s FROM p),
r AS (SELECT doc_id, i, w, 0 AS chunk, CASE WHEN s >= 800 THEN 1 ELSE 0 END AS next, CASE WHEN s >= 800 THEN 0 ELSE s END AS held FROM g WHERE i = 1
UNION ALL SELECT doc_id, i, w, c AS chunk, CASE WHEN h + s >= 800 THEN c + 1 ELSE c END AS next, CASE WHEN h + s >= 800 THEN 0 ELSE h + s END AS held
FROM (SELECT g.doc_id, g.i, g.w, g.s, r.next + CASE WHEN r.held > 0 AND r.held + g.s > 1200 THEN 1 ELSE 0 END AS c, CASE WHEN r.held > 0 AND r.held + g.s > 1200 THEN 0 ELSE r.held END AS h FROM r JOIN g ON g.doc_id = r.doc_id AND g.i = r.i + r.w))
SELECT u.doc_id AS document_id, u.ordinal, CAST(chunk AS INTEGER) AS chunk FROM r JOIN u ON u.doc_id = r.doc_id AND u.i >= r.i AND u.i < r.i + r.w""")
def chunked_blocks(t: Tables) -> DataFrame:
    return folds.chunks(_blocks(t), 800, 1200)


@query("""WITH l AS (SELECT DISTINCT p_name AS label FROM part), h AS (SELECT label, coalesce(sum(CASE WHEN (strpos('0123456789abcdef', substr(sha1(label), 8, 1)) - 1) % 8 = 0 THEN 1 ELSE 0 END) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM l),
p AS (SELECT label, row_number() OVER (PARTITION BY k ORDER BY label) - 1 AS place, min(label) OVER (PARTITION BY k) AS f FROM h) SELECT label, f || '#' || (place // 16) AS batch, place % 16 AS place FROM p""")
def label_batches(t: Tables) -> DataFrame:
    return folds.batches(t.part.select(F.col("p_name").alias("label")), 8)


@query("""WITH r AS (SELECT source AS cq_type, doc_id AS ordinal, array_to_string(regexp_extract_all(lower(substr(text, 1, 25)), '\\p{L}+'), ' ') AS same, CASE WHEN doc_id % 4 = 0 THEN 'no passage' WHEN doc_id % 11 = 0 THEN 'does not parse' WHEN doc_id % 9 = 0 THEN 'a single triple' END AS shape FROM documents WHERE text IS NOT NULL),
e AS (SELECT *, count(*) FILTER (shape IS NULL) OVER (PARTITION BY same ORDER BY cq_type, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM r)
SELECT cq_type, ordinal, CASE WHEN shape = 'no passage' THEN shape WHEN earlier > 0 THEN 'duplicate' ELSE coalesce(shape, 'kept') END AS verdict FROM e""")
def screened_questions(t: Tables) -> DataFrame:
    """Without the near-copy rule, which is a fold; tests compare that one with a loop."""
    d = F.col("doc_id")
    sparql = F.when(d % 9 == 0, "SELECT ?x WHERE { ?x a <y> }").otherwise("SELECT ?x WHERE { ?x a <y> . ?x <p> ?z }")
    rows = t.documents.where("text is not null").select(F.col("source").alias("cq_type"), d.alias("ordinal"), F.substring("text", 1, 25).alias("question"), sparql.alias("sparql"), (d % 4).cast("int").alias("passage"), (d % 11 > 0).alias("parses"))
    return folds.screened(rows, t.documents.select(F.col("source").alias("cq_type"), F.lit(3).alias("n")).distinct(), 1.01)


@query()
def term_similarity(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.round(tx.similarity(tx.normalized(F.col("p_name")), tx.normalized(F.col("p_type"))), 6).alias("ratio"))


# --- state -------------------------------------------------------------------


@query("SELECT e.event_type AS stage, count(*) AS units, count(*) FILTER (event_id % 3 = 0) AS done, count(*) FILTER (event_id % 11 = 1 AND event_id % 3 <> 0) AS failed, CAST(sum(CAST(floor(coalesce(value, 0)) AS BIGINT)) AS BIGINT) AS in_tokens, CAST(sum(user_id) AS BIGINT) AS out_tokens FROM events e GROUP BY 1")
def stage_report(t: Tables) -> DataFrame:
    status = F.when(F.col("event_id") % 3 == 0, "done").when(F.col("event_id") % 11 == 1, "failed").otherwise("pending")
    return ledger.report(t.events.select(F.col("event_type").alias("stage"), status.alias("status"), F.floor("value").alias("in_tokens"), F.col("user_id").alias("out_tokens")))


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END) AS rate FROM events GROUP BY 1),
l AS (SELECT *, lag(rate, 1) OVER (ORDER BY day) AS p1, lag(rate, 2) OVER (ORDER BY day) AS p2 FROM d)
SELECT CAST(day AS VARCHAR) AS iteration, round(rate, 6) AS pass_rate, coalesce(rate >= 0.3 AND rate <= p1 AND p1 <= p2, false) AS stop FROM l""")
def pass_rates(t: Tables) -> DataFrame:
    days = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.avg((F.col("value") > 50).cast("double")).alias("rate"))
    order = Window.partitionBy(F.lit(1)).orderBy("day")  # a row for each iteration
    rows = days.select("day", "rate", F.lag("rate", 1).over(order).alias("p1"), F.lag("rate", 2).over(order).alias("p2"))
    return rows.select(F.col("day").cast("string").alias("iteration"), F.round("rate", 6).alias("pass_rate"), F.coalesce(F.expr("rate >= 0.3 and rate <= p1 and p1 <= p2"), F.lit(False)).alias("stop"))


_ITEMS = "CASE WHEN p_partkey % 5 = 0 THEN 'superseded' WHEN p_partkey % 5 = 1 THEN 'accepted' ELSE 'open' END AS status"


@query(f"""WITH old AS (SELECT p_partkey AS id, p_brand AS kind, {_ITEMS} FROM part WHERE p_partkey % 3 <> 0), new AS (SELECT p_partkey AS id, p_brand AS kind FROM part WHERE p_partkey % 4 <> 0)
SELECT coalesce(o.id, n.id) AS id, coalesce(o.kind, n.kind) AS kind, CASE WHEN o.status IS NULL THEN 'open' WHEN n.id IS NOT NULL AND o.status = 'superseded' THEN 'open'
WHEN n.id IS NULL AND o.status = 'open' AND o.kind IN ('Brand#11', 'Brand#12', 'Brand#13') THEN 'superseded' ELSE o.status END AS status FROM old o FULL JOIN new n ON o.id = n.id""")
def review_sync(t: Tables) -> DataFrame:
    items = t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("kind"), F.expr(_ITEMS))
    return state.merge_sync(items.where("id % 3 <> 0"), items.where("id % 4 <> 0"), ["Brand#11", "Brand#12", "Brand#13"])


@query(f"SELECT p_brand AS kind, {_ITEMS}, count(*) AS n FROM part GROUP BY ALL")
def review_counts(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_brand").alias("kind"), F.expr(_ITEMS)).groupBy("kind", "status").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE source END AS source, doc_id % 10 = 0 AS held_out FROM documents WHERE doc_id % 2 = 0
UNION ALL SELECT doc_id, 'new', false FROM documents WHERE doc_id % 2 = 1 AND doc_id % 3 = 0""")
def upserted_documents(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "source", (F.col("doc_id") % 10 == 0).alias("held_out"))
    changes = rows.where("doc_id % 3 = 0").select("doc_id", F.lit("new").alias("source"), F.lit(False).alias("held_out"))
    return state.upsert(rows.where("doc_id % 2 = 0"), changes, ["doc_id"], keep=("held_out",))


@query("""SELECT o_orderkey, o_custkey, 'old' AS origin FROM orders WHERE o_custkey % 4 <> 1 UNION ALL SELECT o_orderkey, o_custkey, 'new' FROM orders WHERE o_custkey % 4 = 1 AND o_orderkey % 2 = 0
UNION ALL SELECT o_orderkey, o_custkey, 'old' FROM orders WHERE o_custkey % 4 = 1 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 4 = 1 AND o_orderkey % 2 = 0)""")
def replaced_groups(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_custkey", F.lit("old").alias("origin"))
    return state.replace_group(rows, rows.where("o_custkey % 4 = 1 and o_orderkey % 2 = 0").withColumn("origin", F.lit("new")), ["o_custkey"])


@query("SELECT c_custkey, c_mktsegment, 'kept' AS origin FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, c_mktsegment, 'added' FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 2 = 0")
def inserted_absent(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", "c_mktsegment", F.lit("kept").alias("origin"))
    return state.insert_absent(rows.where("c_custkey % 3 = 0"), rows.where("c_custkey % 2 = 0").withColumn("origin", F.lit("added")), ["c_custkey"])


@query("""SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, event_id DESC) AS n FROM events) WHERE n = 1""")
def precedence(t: Tables) -> DataFrame:
    order = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    return state.prefer(t.events, ["user_id"], [order, F.desc("event_id")]).select("user_id", "event_type", "event_id")


# --- order -------------------------------------------------------------------

_CURVE = """WITH f AS (SELECT l_partkey, min(l_orderkey) AS o FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1), n AS (SELECT o, count(*) AS new FROM f GROUP BY 1),
c AS (SELECT o_orderkey AS seq, CAST(coalesce(new, 0) AS BIGINT) AS new, CAST(sum(coalesce(new, 0)) OVER (ORDER BY o_orderkey) AS BIGINT) AS total FROM orders LEFT JOIN n ON o = o_orderkey)"""


def _curve(t: Tables) -> DataFrame:
    order = t.orders.select(F.col("o_orderkey").alias("seq"), F.col("o_orderkey").alias("document_id"))
    return relational.accumulation(order, t.lineitem.select(F.col("l_orderkey").alias("document_id"), F.col("l_partkey").alias("concept")))


@query(f"{_CURVE} SELECT seq, seq AS document_id, new, total FROM c")
def accumulation_curve(t: Tables) -> DataFrame:
    return _curve(t)


@query(f"{_CURVE} SELECT CASE WHEN count(*) >= 50 THEN round(avg(new), 6) END AS slope FROM (SELECT * FROM c ORDER BY seq DESC LIMIT 50)")
def novelty_slope(t: Tables) -> DataFrame:
    return relational.tail_slope(_curve(t), 50).select(F.round("slope", 6).alias("slope"))


@query("SELECT o_custkey, o_orderkey, k FROM (SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS k FROM orders) ORDER BY k, o_custkey LIMIT 100")
def round_robin(t: Tables) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return t.orders.select("o_custkey", "o_orderkey", k.alias("k")).orderBy("k", "o_custkey").limit(100)


@query("SELECT conv_id, string_agg('[M' || (turn + 1) || '] ' || role, ' ' ORDER BY turn) AS marked, count(*) AS turns FROM conversations GROUP BY conv_id")
def marked_turns(t: Tables) -> DataFrame:
    piece = F.format_string("[M%d] %s", F.col("turn") + 1, F.col("role"))
    found = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", piece.alias("p")))).alias("a"), F.count("*").alias("turns"))
    return found.select("conv_id", F.array_join(F.transform("a", lambda x: x["p"]), " ").alias("marked"), "turns")


@query("SELECT CASE WHEN role = 'user' THEN 'user' ELSE 'other' END AS side, count(DISTINCT conv_id) AS conversations, count(*) AS turns FROM conversations GROUP BY ALL")
def conversation_sides(t: Tables) -> DataFrame:
    side = F.when(F.col("role") == "user", "user").otherwise("other")
    return t.conversations.groupBy(side.alias("side")).agg(F.countDistinct("conv_id").alias("conversations"), F.count("*").alias("turns"))


@query("SELECT conv_id, turn, printf('T%d\tturn/%s %d %d\t%s', turn + 1, role, 0, length(text), regexp_replace(text, '\\s+', ' ', 'g')) AS value FROM conversations")
def brat_export(t: Tables) -> DataFrame:
    rows = t.conversations.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("ordinal"), F.concat(F.lit("turn/"), "role").alias("iri"), F.lit(0).alias("start"), F.length("text").alias("stop"), "text")
    return writers.brat_lines(rows).select(F.col("document_id").alias("conv_id"), F.col("ordinal").alias("turn"), "value")


# --- resolution --------------------------------------------------------------

_CASCADE = """WITH m AS (SELECT p_partkey AS id, p_name AS name, p_brand AS doc, p_type AS type, p_size AS size FROM part),
p AS (SELECT a.id AS l, b.id AS r, a.type = b.type AS same_type, a.size AS s1, b.size AS s2, a.name AS name FROM m a JOIN m b ON a.name = b.name AND a.doc < b.doc)"""


@query(f"""{_CASCADE} SELECT l, r, CASE WHEN same_type THEN CASE WHEN s1 = s2 THEN 'merge' ELSE 'separate' END WHEN s1 % 2 <> s2 % 2 THEN 'ask' WHEN s1 > 40 THEN 'merge' WHEN length(name) < 6 THEN 'separate'
WHEN (s1 + s2) % 7 >= 6 THEN 'merge' WHEN (s1 + s2) % 7 >= 3 THEN 'ask' ELSE 'separate' END AS action FROM p""")
def decision_cascade(t: Tables) -> DataFrame:
    m = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("doc"), F.col("p_type").alias("type"), F.col("p_size").alias("size"))
    other = m.select(*[F.col(c).alias(c if c == "name" else f"{c}2") for c in m.columns])
    pairs = parts.paired(m, other, ["name"], "id", "id2").where("doc < doc2")
    pairs = pairs.selectExpr(
        "id as l", "id2 as r", "case when type = type2 then size = size2 end as same_key", "size % 2 as left_language", "size2 % 2 as right_language", "size > 40 as synonym",
        "length(name) < 6 as generic", "true as same_name", "false as proper", "false as same_class", "(size + size2) % 7 as score",
    )
    return relational.decide(pairs, 6, 3).select("l", "r", "action")


@query("""WITH m AS (SELECT p_partkey AS k, p_size > 10 AS merges FROM part), g AS (SELECT k, sum(CASE WHEN coalesce(p, false) THEN 0 ELSE 1 END) OVER (ORDER BY k) AS run FROM (SELECT k, lag(merges) OVER (ORDER BY k) AS p FROM m))
SELECT k AS mention_id, min(k) OVER (PARTITION BY run) AS entity FROM g""")
def merged_entities(t: Tables) -> DataFrame:
    pairs = t.part.where("p_size > 10").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b"))
    mentions = t.part.select(F.col("p_partkey").alias("mention_id"))
    return vectors.entities(pairs.join(mentions.withColumnRenamed("mention_id", "b"), "b", "left_semi").select("a", "b"), mentions)


@query("SELECT c_custkey FROM customer WHERE c_acctbal < 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def unbridged_orphans(t: Tables) -> DataFrame:
    return t.customer.where("c_acctbal < 0").join(t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("""SELECT DISTINCT o_orderkey AS document_id, 'part/' || l_partkey AS concept FROM orders JOIN lineitem ON l_orderkey = o_orderkey
UNION SELECT o_orderkey, 'nation/' || c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey""")
def concepts_by_document(t: Tables) -> DataFrame:
    parts = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderkey").alias("document_id"), F.concat(F.lit("part/"), F.col("l_partkey").cast("string")).alias("concept"))
    nations = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("document_id"), F.concat(F.lit("nation/"), F.col("c_nationkey").cast("string")).alias("concept"))
    return parts.unionByName(nations).distinct()


# --- graph -------------------------------------------------------------------

_EDGES = """edges AS (SELECT 'n/' || n_nationkey AS child, 'r/' || n_regionkey AS parent FROM nation UNION ALL SELECT 'c/' || c_custkey, 'n/' || c_nationkey FROM customer UNION ALL SELECT 's/' || s_suppkey, 'n/' || s_nationkey FROM supplier)"""
_CLOSURE = f"WITH RECURSIVE {_EDGES}, up(child, ancestor) AS (SELECT child, parent FROM edges UNION SELECT up.child, e.parent FROM up JOIN edges e ON up.ancestor = e.child)"


def _edges(t: Tables) -> DataFrame:
    one = lambda rows, a, k, b, p: rows.select(F.concat(F.lit(a), F.col(k).cast("string")).alias("child"), F.concat(F.lit(b), F.col(p).cast("string")).alias("parent"))
    return one(t.nation, "n/", "n_nationkey", "r/", "n_regionkey").unionByName(one(t.customer, "c/", "c_custkey", "n/", "c_nationkey")).unionByName(one(t.supplier, "s/", "s_suppkey", "n/", "s_nationkey"))


@query(f"{_CLOSURE} SELECT child, ancestor FROM up")
def hierarchy_closure(t: Tables) -> DataFrame:
    return graph.ancestors(_edges(t))


@query(f"WITH {_EDGES}, n AS (SELECT parent AS node FROM edges UNION SELECT child FROM edges) SELECT node, CASE left(node, 1) WHEN 'r' THEN 1 WHEN 'n' THEN 2 ELSE 3 END AS depth FROM n")
def hierarchy_depth(t: Tables) -> DataFrame:
    return graph.depths(_edges(t))


@query(f"""WITH {_EDGES}, k AS (SELECT parent AS subject, count(DISTINCT child) AS n FROM edges GROUP BY 1)
SELECT 'branching' AS kind, subject, n FROM k WHERE n > 50 UNION ALL SELECT 'single_child_level', subject, n FROM k WHERE n = 1
UNION ALL SELECT 'orphan_class', 'p/' || p_partkey, 0 FROM part""")
def structural_findings(t: Tables) -> DataFrame:
    edges = _edges(t)
    classes = edges.select(F.col("child").alias("iri")).union(t.part.select(F.concat(F.lit("p/"), F.col("p_partkey").cast("string"))))
    return graph.structure(edges, classes, 50)


@query(f"""{_CLOSURE}, below AS (SELECT ancestor AS top, child AS iri FROM up WHERE child NOT LIKE 'c/%' UNION SELECT 'r/' || r_regionkey, 'r/' || r_regionkey FROM region)
SELECT DISTINCT least(x.iri, y.iri) AS a, greatest(x.iri, y.iri) AS b FROM below x JOIN below y ON x.top = 'r/0' AND y.top = 'r/1'""")
def inherited_disjointness(t: Tables) -> DataFrame:
    closure = graph.ancestors(_edges(t).where("child not like 'c/%'"))  # classes are nations and suppliers here
    return graph.incompatible(t.spark.createDataFrame([("r/0", "r/1")], "a string, b string"), closure)


_TYPED = "typed AS (SELECT o_custkey AS entity, 'n/' || (o_orderkey % 25) AS iri FROM orders UNION SELECT o_custkey, 'r/' || (o_orderkey % 5) FROM orders)"


@query(f"""WITH {_TYPED}, own AS (SELECT DISTINCT entity, iri FROM typed), implied AS (SELECT DISTINCT entity, 'r/' || n_regionkey AS iri FROM own JOIN nation ON iri = 'n/' || n_nationkey),
left_ AS (SELECT * FROM own EXCEPT SELECT * FROM implied) SELECT entity, string_agg(iri, ',' ORDER BY iri) AS iris FROM left_ GROUP BY entity HAVING count(*) > 1""")
def entity_conflicts(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    typed = t.orders.select(F.col("o_custkey").alias("entity"), F.explode(F.array(F.concat(F.lit("n/"), (key % 25).cast("string")), F.concat(F.lit("r/"), (key % 5).cast("string")))).alias("iri"))
    return graph.conflicts(typed, graph.ancestors(_edges(t)))


def _triples(t: Tables) -> DataFrame:
    s = F.concat(F.lit("p/"), F.col("p_partkey").cast("string"))
    pair = lambda p, o: F.struct(F.lit(p).alias("p"), o.alias("o"))
    facts = F.array(pair("rdf:type", F.col("p_brand")), pair("rdfs:label", F.col("p_name")), pair("made:of", F.col("p_type")), pair("has:size", F.col("p_size").cast("string")))
    return t.part.select(s.alias("s"), F.explode(facts).alias("x")).select("s", "x.p", "x.o")


def _changed(t: Tables) -> DataFrame:
    number = F.substring_index("s", "/", -1).cast("bigint")
    rows = _triples(t).where(~((number % 10 == 0) & (F.col("p") == "made:of")))
    return rows.withColumn("o", F.when((number % 7 == 0) & F.col("p").isin("has:size", "rdfs:label"), F.concat(F.col("o"), F.lit("x"))).otherwise(F.col("o")))


_FACTS = """facts AS (SELECT 'p/' || p_partkey AS s, p_partkey AS k, 'rdf:type' AS p, p_brand AS o FROM part UNION ALL SELECT 'p/' || p_partkey, p_partkey, 'rdfs:label', p_name FROM part
UNION ALL SELECT 'p/' || p_partkey, p_partkey, 'made:of', p_type FROM part UNION ALL SELECT 'p/' || p_partkey, p_partkey, 'has:size', CAST(p_size AS VARCHAR) FROM part)"""


@query(f"""WITH {_FACTS} SELECT 'removed' AS change, s, p, o FROM facts WHERE (k % 10 = 0 AND p = 'made:of') OR (k % 7 = 0 AND p = 'has:size')
UNION ALL SELECT 'added', s, p, o || 'x' FROM facts WHERE k % 7 = 0 AND p = 'has:size' UNION ALL SELECT 'label', s, p, o FROM facts WHERE k % 7 = 0 AND p = 'rdfs:label'
UNION ALL SELECT 'label', s, p, o || 'x' FROM facts WHERE k % 7 = 0 AND p = 'rdfs:label'""")
def semantic_diff(t: Tables) -> DataFrame:
    return graph.diff(_triples(t), _changed(t))


@query(f"""WITH {_FACTS}, h AS (SELECT DISTINCT sha256(s || ' ' || p || ' ' || o) AS h FROM facts WHERE p <> 'rdfs:label'), a AS (SELECT left(h, 6) AS b, sha256(string_agg(h, chr(10) ORDER BY h)) AS h, count(*) AS n FROM h GROUP BY 1),
b AS (SELECT left(b, 3) AS b, sha256(string_agg(h, chr(10) ORDER BY b)) AS h, sum(n) AS n FROM a GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(h, chr(10) ORDER BY b)) AS hash FROM b""")
def state_digest(t: Tables) -> DataFrame:
    return graph.state_hash(_triples(t))


@query("SELECT 'size' AS p, 0 AS individuals, 0 AS most, false AS refuted WHERE false UNION ALL SELECT 'o:part', count(*), max(n), max(n) > 1 FROM (SELECT l_orderkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1) UNION ALL SELECT 'o:status', count(*), max(n), max(n) > 1 FROM (SELECT o_orderkey, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY 1)")
def functional_survey(t: Tables) -> DataFrame:
    parts = t.lineitem.select(F.col("l_orderkey").alias("s"), F.lit("o:part").alias("p"), F.col("l_partkey").cast("string").alias("o"))
    status = t.orders.select(F.col("o_orderkey").alias("s"), F.lit("o:status").alias("p"), F.col("o_orderstatus").alias("o"))
    return graph.functional_survey(parts.unionByName(status))


@query(f"{_CLOSURE} SELECT child AS c, ancestor AS r FROM up WHERE child LIKE 'c/%' AND ancestor LIKE 'r/%' AND child NOT IN (SELECT 'c/' || o_custkey FROM orders WHERE o_orderkey % 7 = 0)")
def graph_pattern(t: Tables) -> DataFrame:
    edges = _edges(t).select(F.col("child").alias("s"), F.lit("sub").alias("p"), F.col("parent").alias("o"))
    kinds = t.customer.select(F.concat(F.lit("c/"), F.col("c_custkey").cast("string")).alias("s"), F.lit("a").alias("p"), F.lit("customer").alias("o"))
    regions = t.region.select(F.concat(F.lit("r/"), F.col("r_regionkey").cast("string")).alias("s"), F.lit("a").alias("p"), F.lit("region").alias("o"))
    bought = t.orders.where("o_orderkey % 7 = 0").select(F.concat(F.lit("c/"), F.col("o_custkey").cast("string")).alias("s"), F.lit("bought").alias("p"), F.lit("yes").alias("o"))
    triples = edges.unionByName(kinds).unionByName(regions).unionByName(bought)
    return graph.match(triples, [("?c", "a", "customer"), ("?c", "sub+", "?r"), ("?r", "a", "region")], [("?c", "bought", "yes")]).select("c", "r")


_LIVE = "live AS (SELECT o_custkey AS entity, o_orderkey AS m, CASE WHEN o_orderkey % 5 > 0 THEN 'k/' || o_orderpriority END AS iri FROM orders WHERE o_orderkey % 9 > 0)"


@query(f"""WITH {_LIVE}, s AS (SELECT entity, iri, count(*) AS n FROM live WHERE iri IS NOT NULL GROUP BY ALL), b AS (SELECT entity, arg_max(iri, lpad(CAST(n AS VARCHAR), 9, '0') || iri) AS iri FROM s GROUP BY 1)
SELECT CAST(entity AS VARCHAR) AS s, 'rdf:type' AS p, iri AS o FROM b UNION ALL SELECT CAST(entity AS VARCHAR), 'prov:mention', CAST(m AS VARCHAR) FROM live UNION ALL SELECT DISTINCT CAST(entity AS VARCHAR), 'rdf:type', 'owl:NamedIndividual' FROM live""")
def regenerated_individuals(t: Tables) -> DataFrame:
    iri = F.when(F.col("o_orderkey") % 5 > 0, F.concat(F.lit("k/"), "o_orderpriority"))
    typed = t.orders.select(F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("mention_id"), iri.alias("iri"))
    return graph.individuals(typed, t.orders.where("o_orderkey % 9 = 0").select(F.col("o_orderkey").alias("mention_id")), "force")


# --- relational surface and streams ------------------------------------------


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_counts(t: Tables) -> DataFrame:
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersection(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("nation")).intersect(t.supplier.select("s_nationkey"))


_WINDOWS = "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"


@query(_WINDOWS)
def event_windows(t: Tables) -> DataFrame:
    return arrivals.windowed(t.events)


@query(_WINDOWS)
def streamed_windows(t: Tables) -> DataFrame:
    stream = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    return arrivals.once(arrivals.windowed(stream), "streamed_windows")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS b FROM events),
s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(t: Tables) -> DataFrame:
    return arrivals.sessions(t.events)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions typed against the inventory by exact vector search, with zones."""
    return QUERIES["typing_zones"](spark, sf_dir)
