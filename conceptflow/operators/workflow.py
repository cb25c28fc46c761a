"""State of a run: reviews, versions, stage surveys, jobs, reports, rendering and readable names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from conceptflow.operators import graph

# Prefixes of standard vocabularies.
PREFIXES = {
    "http://www.w3.org/2002/07/owl#": "owl",
    "http://www.w3.org/2000/01/rdf-schema#": "rdfs",
    "http://www.w3.org/1999/02/22-rdf-syntax-ns#": "rdf",
    "http://www.w3.org/2004/02/skos/core#": "skos",
    "http://www.w3.org/2001/XMLSchema#": "xsd",
}


# --- reviews -----------------------------------------------------------------


def resolved(items: DataFrame, answers: DataFrame) -> DataFrame:
    """``items`` (id, status, comment, ...) with the answers (id, status, comment, at); only accepted and rejected count, an empty comment is none."""
    valid = answers.where(F.col("status").isin("accepted", "rejected")).select("id", F.col("status").alias("s_"), F.nullif("comment", F.lit("")).alias("c_"), F.col("at").alias("a_"))
    joined = items.join(valid, "id", "left")
    answered = F.col("s_").isNotNull()
    out = joined.withColumn("status", F.coalesce("s_", "status")).withColumn("comment", F.when(answered, F.col("c_")).otherwise(F.col("comment")))
    return out.withColumn("resolved_at", F.when(answered, F.col("a_")).otherwise(F.col("resolved_at"))).select(items.columns)


def annotated(items: DataFrame, patches: DataFrame) -> DataFrame:
    """``items`` with payload (map) updated by patches (id, patch: map): the patch's entries win, the rest stays."""
    joined = items.join(patches, "id", "left")
    kept = F.map_filter("payload", lambda k, _: ~F.map_contains_key("patch", k))
    return joined.withColumn("payload", F.when(F.col("patch").isNull(), F.col("payload")).otherwise(F.map_concat(kept, "patch"))).select(items.columns)


def logged(log: DataFrame, events: DataFrame) -> DataFrame:
    """The session log (session_id, seq, kind, summary) with events (session_id, kind, summary, at) added after what it holds, by their times."""
    last = log.groupBy("session_id").agg(F.max("seq").alias("last"))
    order = Window.partitionBy("session_id").orderBy("at", "kind", "summary")
    new = events.withColumn("n", F.row_number().over(order)).join(last, "session_id", "left")
    return log.unionByName(new.select("session_id", (F.coalesce("last", F.lit(0)) + F.col("n")).cast("bigint").alias("seq"), "kind", "summary"))


# --- versions ----------------------------------------------------------------


def ordinals(versions: DataFrame) -> DataFrame:
    """(session_id, seq, version_id): what the next version of each session is called."""
    return versions.groupBy("session_id").agg(F.count("*").alias("seq")).select("session_id", "seq", F.concat(F.col("session_id").cast("string"), F.lit(":v"), F.col("seq").cast("string")).alias("version_id"))


def commit(versions: DataFrame, triples: DataFrame, session_id: str, parent_id: str | None = None, note: str = "") -> tuple[DataFrame, DataFrame]:
    """(the new version row, its triples): the whole graph under the session's next id, with its state hash and its place."""
    own = versions.where(F.col("session_id") == session_id).agg(F.count("*").alias("seq"))
    row = graph.state_hash(triples).crossJoin(own).select(  # one row each
        F.concat(F.lit(f"{session_id}:v"), F.col("seq").cast("string")).alias("version_id"), F.lit(session_id).alias("session_id"),
        F.lit(parent_id).cast("string").alias("parent_id"), F.col("hash").alias("state_hash"), F.col("n").alias("n_axioms"), F.lit(note).alias("note"), "seq",
    )
    return row, triples.crossJoin(F.broadcast(row.select("version_id"))).select("version_id", "s", "p", "o")


def stamped(versions: DataFrame, stamps: DataFrame) -> DataFrame:
    """(version_id, rules_hash, changed) of the stamped versions (version_id, rules_hash): nothing changes where the hash is the same."""
    new = stamps.select("version_id", F.col("rules_hash").alias("new_"))
    return versions.join(new, "version_id").select("version_id", F.col("new_").alias("rules_hash"), (~F.col("rules_hash").eqNullSafe(F.col("new_"))).alias("changed"))


def merges(before: DataFrame, after: DataFrame) -> DataFrame:
    """(members): groups (group, member) of ``after`` with several members that ``before`` didn't have, as sorted arrays."""
    groups = lambda rows: rows.groupBy("group").agg(F.sort_array(F.collect_set("member")).alias("members")).where("size(members) > 1").select("members")
    return groups(after).subtract(groups(before))


# --- surveys -----------------------------------------------------------------

#: What a stage needs: (stage, done if, ready if, a decision if), as SQL over the counts.
STEPS = (
    ("ingest", "blocks > 0", "true", "false"),
    ("extract", "mentions > 0", "blocks > 0", "false"),
    ("coref", "grouped > 0", "mentions > 0", "false"),
    ("match", "typed > 0", "mentions > 0", "false"),
    ("grey zone", "grey = 0", "typed > 0", "grey > 0"),
    ("bridge", "bridged > 0", "orphans > 0", "false"),
    ("induce", "proposals > 0", "bridged > 0", "false"),
    ("axiomatize", "axioms > 0", "proposals > 0", "false"),
    ("branch", "false", "axioms > 0", "open_branches > 0"),
    ("label check", "verified > 0", "true", "false"),
    ("review", "open_reviews = 0", "true", "open_reviews > 0"),
    ("regenerate", "false", "typed > 0", "false"),
    ("competency questions", "false", "questions > 0", "false"),
    ("stop?", "false", "true", "false"),
)


def typing_counts(typings: DataFrame, mentions: DataFrame) -> DataFrame:
    """(typed, grey, orphans, stale) of one version's typings: only live mentions count, the rest is stale."""
    live = typings.join(mentions.select("mention_id", F.lit(True).alias("live")), "mention_id", "left")
    on = F.col("live").isNotNull()
    return live.agg(F.count_if(on).alias("typed"), F.count_if(on & (F.col("zone") == "grey")).alias("grey"), F.count_if(on & F.col("iri").isNull()).alias("orphans"), F.count_if(~on).alias("stale"))


def survey(counts: DataFrame) -> DataFrame:
    """(place, step, state): done, blocked, waiting (for a decision) or ready, from one row of counts."""
    state = lambda done, ready, decision: F.expr(f"case when {done} then 'done' when not ({ready}) then 'blocked' when {decision} then 'waiting' else 'ready' end")
    rows = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(name).alias("step"), state(*rules).alias("state")) for k, (name, *rules) in enumerate(STEPS)])
    return counts.select(F.inline(rows))


def next_step(plan: DataFrame) -> DataFrame:
    """The step to take: a waiting decision outranks what can run, the earliest first."""
    return plan.where(F.col("state").isin("waiting", "ready")).orderBy(F.col("state") != "waiting", "place").limit(1)


def left_behind(session_id: str, **tables: DataFrame) -> DataFrame:
    """One row: how many rows of each table a reopened session leaves behind."""
    parts = [rows.where(F.col("session_id") == session_id).agg(F.count("*").alias(name)) for name, rows in tables.items()]
    return reduce(DataFrame.crossJoin, parts)  # one row each


def tally(pages: DataFrame) -> DataFrame:
    """(class, reason, n), most first."""
    return pages.groupBy("class", "reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "class", "reason")


def corpus_blocks(blocks: DataFrame, documents: DataFrame, session_id: str) -> DataFrame:
    """Blocks of a session's documents that aren't held out, boilerplate or figures, in order."""
    own = documents.where((F.col("session_id") == session_id) & ~F.col("held_out")).select("document_id")
    return blocks.where(~F.col("is_boilerplate") & (F.col("block_type") != "figure")).join(own, "document_id", "left_semi").orderBy("document_id", "ordinal")


def bridged(members: DataFrame, bridges: DataFrame) -> DataFrame:
    """(mention_id, bridge_id, n): the first and the number of bridges, not rejected, that each mention (mention_id, bridge_id) has."""
    live = bridges.where(F.coalesce(F.col("status") != "rejected", F.lit(True))).select("bridge_id")
    return members.join(live, "bridge_id").groupBy("mention_id").agg(F.min("bridge_id").alias("bridge_id"), F.count("*").alias("n"))


def accepted_types(typings: DataFrame, answered: DataFrame) -> DataFrame:
    """Typings that may type an entity: automatic ones, and grey ones that a person answered (mention_id)."""
    seen = typings.join(answered.select("mention_id", F.lit(True).alias("a_")).distinct(), "mention_id", "left")
    kept = (F.col("zone") == "auto") | ((F.col("zone") == "grey") & F.col("a_").isNotNull())
    return seen.where(kept).select(typings.columns)


# --- jobs --------------------------------------------------------------------


def claimable(jobs: DataFrame, now: Column, stale_after: str = "INTERVAL 5 MINUTES") -> DataFrame:
    """(session_id, job_id) of the oldest queued job of every session without a live one; a running job whose beat is too old isn't live.

    ``jobs``: (job_id, session_id, status, created_at, beat_at).
    """
    live = jobs.where((F.col("status") == "running") & (F.col("beat_at") >= now - F.expr(stale_after))).select("session_id").distinct()
    waiting = jobs.where("status = 'queued'").join(live, "session_id", "left_anti")
    return waiting.groupBy("session_id").agg(F.min_by("job_id", F.struct("created_at", "job_id")).alias("job_id"))


def claimed(jobs: DataFrame, claims: DataFrame, now: Column) -> DataFrame:
    """``jobs`` after the claims (job_id, worker): only queued ones change hands, the smallest worker wins."""
    first = claims.groupBy("job_id").agg(F.min("worker").alias("w_"))
    mine = (F.col("status") == "queued") & F.col("w_").isNotNull()
    out = jobs.join(first, "job_id", "left").withColumn("m_", mine)
    out = out.withColumn("status", F.when(F.col("m_"), "running").otherwise(F.col("status"))).withColumn("worker", F.when(F.col("m_"), F.col("w_")).otherwise(F.col("worker")))
    return out.withColumn("beat_at", F.when(F.col("m_"), now).otherwise(F.col("beat_at"))).select(jobs.columns)


def swept(jobs: DataFrame, now: Column, stale_after: str = "INTERVAL 5 MINUTES") -> DataFrame:
    """``jobs`` with stale running ones queued again, without worker."""
    stale = (F.col("status") == "running") & (F.col("beat_at") < now - F.expr(stale_after))
    out = jobs.withColumn("s_", stale)
    return out.withColumn("status", F.when(F.col("s_"), "queued").otherwise(F.col("status"))).withColumn("worker", F.when(~F.col("s_"), F.col("worker"))).select(jobs.columns)


# --- reports -----------------------------------------------------------------


def functional_histogram(triples: DataFrame, unresolved: DataFrame) -> DataFrame:
    """(p, individuals, distribution: map of values -> individuals, excluded): unresolved subjects (s) are counted apart."""
    per = graph.value_counts(triples, "k").join(unresolved.select("s", F.lit(True).alias("u")).distinct().hint("merge"), "s", "left")
    counts = per.groupBy("p", F.when(F.col("u").isNull(), F.col("k")).alias("k")).agg(F.count("*").alias("n"))
    kept = F.filter(F.array_sort(F.collect_list(F.struct("k", "n"))), lambda x: x["k"].isNotNull())
    total = F.coalesce(F.sum(F.when(F.col("k").isNotNull(), F.col("n"))), F.lit(0).cast("bigint"))
    return counts.groupBy("p").agg(total.alias("individuals"), F.map_from_entries(kept).alias("distribution"), F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("n"))), F.lit(0).cast("bigint")).alias("excluded"))


def functional_findings(histogram: DataFrame, min_individuals: int) -> DataFrame:
    """(p, individuals, excluded) of properties with one value on every one of enough individuals."""
    single = F.forall(F.map_keys("distribution"), lambda k: k <= 1)
    return histogram.where(single & (F.col("individuals") >= min_individuals)).select("p", "individuals", "excluded")


def alignment(presence: DataFrame) -> DataFrame:
    """(classes, absent, single_document, multiword, coverage) of (label, documents)."""
    zero = F.col("documents") == 0
    counts = presence.agg(F.count("*").alias("classes"), F.count_if(zero).alias("absent"), F.count_if(F.col("documents") == 1).alias("single_document"), F.count_if(F.size(F.split(F.trim("label"), r"\s+")) > 1).alias("multiword"))
    return counts.withColumn("coverage", F.when(F.col("classes") > 0, 1 - F.col("absent") / F.col("classes")).otherwise(0.0))


def divergences(labels: DataFrame, threshold: float) -> DataFrame:
    """(iri, reason) of entities whose derived label is like none of the declared ones.

    ``labels``: (iri, language, declared_language, score), a row for each declared
    label; a null language is undetermined. Without one of the same language the
    pair is only unverified.
    """
    unlike = labels.groupBy("iri").agg(
        F.max("score").alias("best"), F.bool_or(F.col("language").isNull() | F.col("declared_language").isNull()).alias("open"), F.bool_or(F.col("language").eqNullSafe(F.col("declared_language"))).alias("same")
    )
    reason = F.when(F.col("open") | ~F.col("same"), "cross_language_unverified").otherwise("same_language_mismatch")
    return unlike.where(F.col("best") < threshold).select("iri", reason.alias("reason"))


def label_triples(names: DataFrame, preferred: DataFrame) -> DataFrame:
    """(s, p, o, lang): every name (iri, text, lang) as label and alternative, the preferred (iri, text, lang) as preferred and alternative."""
    rows = [(names, "rdfs:label"), (preferred, "skos:prefLabel"), (names, "skos:altLabel"), (preferred, "skos:altLabel")]
    return reduce(DataFrame.unionByName, [x.select(F.col("iri").alias("s"), F.lit(p).alias("p"), F.col("text").alias("o"), "lang") for x, p in rows]).distinct()


# --- rendering and names -----------------------------------------------------


def rendered(kind: Column, text: Column, page: Column, asset: Column) -> Column:
    """A block as Markdown."""
    n = page.cast("string")
    figure = F.concat(F.lit("![figure p"), n, F.lit("]("), F.coalesce(asset, F.lit("None")), F.lit(")"))
    return F.when(kind == "heading", F.concat(F.lit("## "), text)).when(kind == "figure", figure).when(kind == "unparsed", F.concat(F.lit("<!-- page "), n, F.lit(": "), text, F.lit(" -->"))).otherwise(text)


def mention_text(text: Column, context: Column, with_sentence: bool) -> Column:
    """The bare phrase, or the phrase and its sentence behind it."""
    return F.when(F.coalesce(context, F.lit("")) != "", F.concat(text, F.lit(". "), context)).otherwise(text) if with_sentence else text


def short_name(iri: Column, label: Column) -> Column:
    """The label, else a prefixed name of a standard vocabulary, else the last part behind an ellipsis."""
    out = F.when(label.isNotNull(), label)
    for namespace, prefix in PREFIXES.items():
        out = out.when(iri.startswith(namespace), F.concat(F.lit(f"{prefix}:"), F.substr(iri, F.lit(len(namespace) + 1))))
    tail = F.substring_index(F.substring_index(F.rtrim(iri, F.lit("/#")), "/", -1), "#", -1)
    return out.otherwise(F.concat(F.lit("…"), tail))


def readable(lines: DataFrame, labels: DataFrame) -> DataFrame:
    """(line_id, line) with every <iri> of the lines replaced by its short name; ``labels``: (iri, label)."""
    parts = lines.select("line_id", F.posexplode(F.regexp_extract_all("line", F.lit(r"(<[^<>\s]+>|[^<]+|<)"), 1)).alias("at", "part"))
    token = parts.withColumn("iri", F.when(F.col("part").rlike(r"^<[^<>\s]+>$"), F.expr("substring(part, 2, length(part) - 2)")))
    named = token.join(labels.select("iri", "label"), "iri", "left")
    piece = F.when(F.col("iri").isNotNull(), short_name(F.col("iri"), F.col("label"))).otherwise(F.col("part"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", piece.alias("piece")))), lambda x: x["piece"]), "")
    return named.groupBy("line_id").agg(whole.alias("line"))
