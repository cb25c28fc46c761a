r"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of a text is a blob, named by its SHA-256. The ledger says which
(blob, rule, rule version) have been scanned and what they hold, so a run scans
each unseen combination once and joins the findings back to every path. Only
DataFrame functions are used. Place of matches: ``split`` by a rule gives the
text between its leftmost non-overlapping matches, ``regexp_extract_all`` the
matches; their lengths, summed alternately, are the starts (code points).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptflow.llm.skew import free, spread_join
from conceptflow.session import cut, table


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: The group whose length decides, and its least length; matches below are dropped.
    group: int = 0
    least: int = 1
    version: int = 1
    #: A cheap necessary condition that spares most texts the pattern.
    hint: str | None = None


#: The patterns of the contract, then well-known token formats.
BASE_RULES = (
    Rule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
        hint=r"""[:=]""",
    ),
    # The least lengths stand in the next two patterns: a greedy run either has them or nothing in it has.
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20, hint="AKIA"),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, hint="[0-9a-f]{24}"),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", hint="PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", hint="gh[pousr]_"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{20,}", hint="xox[abprs]-"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hint=r"eyJ"),
)
RULES = BASE_RULES + MORE_RULES

SPANS = "array<struct<start: bigint, place: int, kind: string, stop: bigint>>"


def spans(text: Column, rule: Rule, place: int) -> Column:
    """Sorted array of (start, place, kind, stop) of a rule's matches in a text; empty if none, null if null."""
    pattern = F.lit(rule.pattern)
    between = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x).cast("bigint"))
    whole = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda x: F.length(x).cast("bigint"))
    held = whole if not rule.group else F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda x: F.length(x).cast("bigint"))
    steps = F.arrays_zip(between.alias("gap"), whole.alias("size"), held.alias("held"))
    empty = F.expr(f"named_struct('at', 0L, 'found', cast(array() as {SPANS}))")

    def take(state: Column, step: Column) -> Column:
        start = state["at"] + step["gap"]
        size = F.coalesce(step["size"], F.lit(0).cast("bigint"))
        hit = F.struct(start.alias("start"), F.lit(place).alias("place"), F.lit(rule.kind).alias("kind"), (start + size).alias("stop"))
        found = F.when(step["held"] >= rule.least, F.concat(state["found"], F.array(hit))).otherwise(state["found"])
        return F.struct((start + size).alias("at"), found.cast(SPANS).alias("found"))

    found = F.aggregate(steps, empty, take, lambda s: s["found"])
    return F.when(text.rlike(rule.hint), found).otherwise(F.expr(f"cast(array() as {SPANS})")) if rule.hint else found


def names(rules: tuple[Rule, ...]) -> list[str]:
    """kind:version of each rule, as the ledger has them."""
    return [f"{r.kind}:{r.version}" for r in rules]


def blobs(versions: DataFrame, text: str = "text") -> DataFrame:
    """(blob, text): every distinct content once. Null is empty; a hot text is combined before the shuffle."""
    body = F.coalesce(F.col(text), F.lit(""))
    return versions.select(F.sha2(body.cast("binary"), 256).alias("blob"), body.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(findings per row, the new ledger rows).

    ``versions``: any columns and ``text``; findings are these columns and two
    more at the end, ``blob`` and ``spans`` (sorted by start, then the rules'
    order), with underscores appended while ``versions`` has a column of the name.
    ``ledger``: (blob, rules, spans) of former runs, rules as kind:version; pairs
    of blob and rule version that it has are not scanned, and a blob with all of
    them is not read. Null texts are empty, without spans; repeated rows share one
    blob, and rows of a hot blob are dealt over several tasks; an empty table
    gives two empty results.
    """
    wanted = names(rules)
    none = F.expr(f"cast(array() as {SPANS})")
    blob, held = free("blob", versions.columns), free("spans", versions.columns)
    fresh = blobs(versions).withColumn("seen", F.expr("cast(array() as array<string>)"))
    if ledger is not None:
        seen = ledger.select("blob", F.explode("rules").alias("rule")).where(F.col("rule").isin(wanted)).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        fresh = fresh.drop("seen").join(seen, "blob", "left").withColumn("seen", F.coalesce("seen", F.expr("cast(array() as array<string>)")))
        fresh = fresh.where(F.size("seen") < len(wanted))
    found = [F.when(F.array_contains("seen", name), none).otherwise(spans(F.col("text"), rule, k)) for k, (rule, name) in enumerate(zip(rules, wanted, strict=True))]
    todo = F.array_except(F.array(*map(F.lit, wanted)), F.col("seen"))
    added = cut(fresh.select("blob", todo.alias("rules"), F.array_sort(F.concat(*found)).alias("spans")))
    known = added.select("blob", "spans")
    if ledger is not None:
        places = F.create_map(*[F.lit(x) for k, rule in enumerate(rules) for x in (rule.kind, k)])
        versions_of = F.create_map(*[F.lit(x) for rule, name in zip(rules, wanted, strict=True) for x in (rule.kind, name)])
        current = F.filter("spans", lambda x: F.array_contains(F.col("rules"), versions_of[x["kind"]]))
        former = F.transform(current, lambda x: F.struct(x["start"].alias("start"), places[x["kind"]].alias("place"), x["kind"].alias("kind"), x["stop"].alias("stop")))
        both = known.unionByName(ledger.select("blob", former.alias("spans")))
        known = both.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    hits = known.where(F.size("spans") > 0).select(F.col("blob").alias(blob), F.col("spans").alias(held))
    named = versions.withColumn(blob, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    sizes = cut(named.groupBy(blob).agg(F.count("*").alias("n")).where("n > 1"))
    salt_by = [name for name, kind in versions.dtypes if name != "text" and not kind.startswith("map")]
    found = spread_join(named, hits, [blob], sizes, "left", salt_by)
    return found.select(*[F.col(f"`{c}`") for c in versions.columns], blob, F.coalesce(held, none).alias(held)), added


def merged(found: Column) -> Column:
    """Sorted spans with overlaps united: array of (start, stop)."""
    kind = "array<struct<start: bigint, stop: bigint>>"

    def take(state: Column, x: Column) -> Column:
        last = F.element_at(state, -1)
        one = F.array(F.struct(x["start"].alias("start"), x["stop"].alias("stop")))
        wider = F.array(F.struct(last["start"].alias("start"), F.greatest(last["stop"], x["stop"]).alias("stop")))
        joined = F.when((F.size(state) > 0) & (F.try_element_at(state, F.lit(-1))["stop"] > x["start"]), F.concat(F.slice(state, 1, F.size(state) - 1), wider))
        return joined.otherwise(F.concat(state, one)).cast(kind)

    return F.aggregate(found, F.expr(f"cast(array() as {kind})"), take)


def redacted(text: Column, found: Column, mark: str = "[REDACTED]") -> Column:
    """The text with each united span replaced by ``mark``; null stays null."""
    start = F.expr("named_struct('at', 0L, 'out', '')")

    def take(state: Column, x: Column) -> Column:
        piece = F.substr(text, (state["at"] + 1).cast("int"), (x["start"] - state["at"]).cast("int"))
        return F.struct(x["stop"].alias("at"), F.concat(state["out"], piece, F.lit(mark)).alias("out"))

    done = lambda s: F.concat(s["out"], F.substr(text, (s["at"] + 1).cast("int")))
    return F.when(F.size(found) > 0, F.aggregate(merged(found), start, take, done)).otherwise(text)


def joined(found: Column) -> Column:
    """kind:start:end of each span, comma-joined; empty string if none."""
    return F.concat_ws(",", F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint")
    base = F.filter("spans", lambda x: x["place"] < len(BASE_RULES))
    return found.select(
        "doc_id",
        *[count(rule.kind).alias(f"n_{rule.kind}") for rule in BASE_RULES],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


QUERIES = {"op6_secrets": op6_secrets}


def _sql_spans(rule: Rule, place: int) -> str:
    """DuckDB: the rule's spans of ``text``, by the text between matches and the matches, as ``spans`` makes them."""
    quoted = rule.pattern.replace("(?i:", "(?i:").replace("'", "''")
    gaps = f"list_transform(string_split_regex(t, '{quoted}'), lambda x: length(x))"
    whole = f"list_transform(regexp_extract_all(t, '{quoted}', 0), lambda x: length(x))"
    held = f"list_transform(regexp_extract_all(t, '{quoted}', {rule.group}), lambda x: length(x))"
    at = "list_sum(g[1:i]) + coalesce(list_sum(w[1:i - 1]), 0)"
    return (
        f"SELECT doc_id, n, {place} AS place, '{rule.kind}' AS kind, CAST({at} AS BIGINT) AS start, CAST({at} + w[i] AS BIGINT) AS stop FROM ("
        f"SELECT doc_id, n, g, w, h, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, n, {gaps} AS g, {whole} AS w, {held} AS h FROM d)) WHERE h[i] >= {rule.least}"
    )


_LINE = "kind || ':' || start || ':' || stop"
ORACLES = {
    "op6_secrets": f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
s AS MATERIALIZED ({" UNION ALL ".join(_sql_spans(rule, k) for k, rule in enumerate(RULES))}),
a AS (
  SELECT n, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access, count(*) FILTER (place = 2) AS n_hex,
         coalesce(string_agg({_LINE}, ',' ORDER BY start, place) FILTER (place < 3), '') AS base, string_agg({_LINE}, ',' ORDER BY start, place) AS spans
  FROM s GROUP BY n
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (n)
"""
}
