"""What mentions prove: persisted typings, circular matches, reload and hold-out choices, training examples, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from conceptflow.functions import text as tx
from conceptflow.operators import state


def _draw(seed: int, key: Column) -> Column:
    return F.sha1(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary"))


def persisted(current: DataFrame, typings: DataFrame, answers: DataFrame) -> DataFrame:
    """Typings (version_id, mention_id, iri, zone) after a run replaced those of its version; an answer (mention_id, iri) overrides a grey row."""
    said = answers.select("mention_id", F.col("iri").alias("_iri"), F.lit(True).alias("_said"))
    grey = (F.col("zone") == "grey") & F.col("_said")
    rows = typings.join(said, "mention_id", "left").withColumn("iri", F.when(grey, F.col("_iri")).otherwise(F.col("iri")))
    rows = rows.withColumn("zone", F.when(grey, "answered").otherwise(F.col("zone"))).select(current.columns)
    return state.replace_group(current, rows, ["version_id"])


def updated(current: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``current`` with ``columns`` taken from ``changes`` where it has the key and a value."""
    new = changes.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    rows = current.join(new, key, "left")
    return rows.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in current.columns])


def circular(typings: DataFrame, mentions: DataFrame, contributions: DataFrame) -> DataFrame:
    """Typed mentions whose own document helped to write the class: (mention_id, iri, document_id), one row each."""
    own = typings.where("iri is not null").select("mention_id", "iri").join(mentions.select("mention_id", "document_id"), "mention_id")
    return own.join(contributions.select("iri", "document_id"), ["iri", "document_id"], "left_semi").dropDuplicates(["mention_id"]).select("mention_id", "iri", "document_id")


def _share(rows: DataFrame, key: str, share: float, seed: int, clamp: bool = False) -> DataFrame:
    """``rows`` (one for each key) with ``_in``: a seeded share of exact size; ``clamp``: one at least, and one of several stays out.

    Hashes order the rows within 4,096 ranges of hashes, and only the ranges' counts meet in one place.
    """
    drawn = rows.withColumn("_draw", _draw(seed, F.col(key))).withColumn("_range", F.substring("_draw", 1, 3))
    before = Window.partitionBy(F.lit(1)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.sum("n").over(Window.partitionBy(F.lit(1)))
    take = F.bround(whole * share)
    if clamp:
        take = F.greatest(F.lit(1), F.least(whole - 1, take))
    ranges = drawn.groupBy("_range").agg(F.count("*").alias("n")).select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"), take.alias("_take"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy("_draw", key))
    placed = drawn.withColumn("_n", place).join(ranges, "_range")
    return placed.withColumn("_in", F.col("_base") + F.col("_n") <= F.col("_take")).drop("_draw", "_range", "_n", "_base", "_take")


def reload(candidates: DataFrame, done: DataFrame, strategy: str, share: float, seed: int) -> DataFrame:
    """(document_id, process): documents not processed before always; others all, none, or a seeded ``share`` (strategy ``sample``)."""
    if strategy not in ("all", "none", "sample"):
        raise ValueError(f"unknown strategy {strategy!r}")
    ids, seen = candidates.select("document_id").distinct(), done.select("document_id").distinct()
    new = ids.join(seen, "document_id", "left_anti").select("document_id", F.lit(True).alias("process"))
    old = ids.join(seen, "document_id", "left_semi")
    if strategy == "sample":
        return new.unionByName(_share(old, "document_id", share, seed).select("document_id", F.col("_in").alias("process")))
    return new.unionByName(old.select("document_id", F.lit(strategy == "all").alias("process")))


def hold_out(classes: DataFrame, share: float, seed: int) -> DataFrame:
    """(iri) of the withheld classes: a seeded ``share``, at least one, and one of several stays."""
    return _share(classes.select("iri").distinct(), "iri", share, seed, clamp=True).where("_in").select("iri")


def split_documents(documents: DataFrame, share: float, seed: int) -> DataFrame:
    """(document_id, held_out): a seeded ``share`` of the documents held out, neither side empty where there are several."""
    return _share(documents.select("document_id").distinct(), "document_id", share, seed, clamp=True).select("document_id", F.col("_in").alias("held_out"))


def examples(gold: DataFrame, pool: DataFrame, negatives: int, seed: int) -> DataFrame:
    """(mention_id, iri, positive): the gold class (mention_id, iri) and ``negatives`` seeded others of its pool (mention_id, iri)."""
    other = pool.select("mention_id", "iri").distinct().join(gold, ["mention_id", "iri"], "left_anti").join(gold.select("mention_id"), "mention_id", "left_semi")
    order = Window.partitionBy("mention_id").orderBy(_draw(seed, F.concat_ws("/", F.col("mention_id").cast("string"), "iri")), "iri")
    wrong = other.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= negatives)
    return gold.select("mention_id", "iri", F.lit(True).alias("positive")).unionByName(wrong.select("mention_id", "iri", F.lit(False).alias("positive")))


def synonyms(names: DataFrame) -> DataFrame:
    """(a, b) of different names (iri, name; normalized) of one class, both ways; a class has few names."""
    one = names.where("name <> ''").select("iri", F.col("name").alias("a")).distinct()
    return one.join(one.withColumnRenamed("a", "b"), "iri").where("a <> b").select("a", "b").distinct()


def unresolved(decisions: DataFrame) -> DataFrame:
    """(mention_id): both ends of every pair left to ask."""
    return decisions.where("action = 'ask'").select(F.explode(F.array("l", "r")).alias("mention_id")).distinct()


def lexicon(labels: DataFrame, tokens: Column) -> DataFrame:
    """(lang, token, n) over labels."""
    return labels.select("lang", F.explode(tokens).alias("token")).groupBy("lang", "token").agg(F.count("*").alias("n"))


def unconforming(properties: DataFrame, first: Column, least: int = 5, share: float = 0.6) -> DataFrame:
    """Properties (iri, …; a row for each label) none of whose labels starts with is, has or have, where a ``share`` of at least ``least`` does."""
    one = properties.groupBy("iri").agg(F.bool_or(F.coalesce(first.isin("is", "has", "have"), F.lit(False))).alias("_fits"))
    house = one.agg(F.count("*").alias("n"), F.count_if("_fits").alias("k")).where((F.col("n") >= least) & (F.col("k") / F.col("n") >= share))
    return one.where("not _fits").join(F.broadcast(house)).select("iri", F.col("k").alias("conforming"), F.col("n").alias("properties"))  # at most one row


def verdicts(derived: DataFrame, declared: DataFrame, score: Column, threshold: float) -> DataFrame:
    """(iri, label, similarity, agrees): for each entity the declared label nearest to the derived one; the smaller label in a tie.

    ``derived``: (iri, derived); ``declared``: (iri, label); ``score`` compares the two.
    """
    rows = derived.join(declared, "iri").withColumn("_s", score)
    best = rows.groupBy("iri").agg(F.max(F.col("_s")).alias("similarity"), F.min(F.struct((-F.col("_s")).alias("s"), "label")).alias("m"))
    return best.select("iri", F.col("m.label").alias("label"), "similarity", (F.col("similarity") >= threshold).alias("agrees"))


def abbreviations(lexicon: DataFrame) -> DataFrame:
    """(lang, token, suggestion): rare tokens of three to six letters that keep the order and first letter of a word longer by three or more.

    ``lexicon``: (lang, token, n). The smallest such word is suggested.
    """
    key = F.substring("token", 1, 1).alias("_first")
    short = lexicon.where("length(token) between 3 and 6 and n <= 1").select("lang", "token", key)
    long = lexicon.where("length(token) >= 6").select("lang", F.col("token").alias("word"), key)
    near = short.join(long, ["lang", "_first"]).where("length(word) >= length(token) + 3")
    return near.where(tx.is_subsequence(F.col("token"), F.col("word"))).groupBy("lang", "token").agg(F.min("word").alias("suggestion"))


def verified_names(answers: DataFrame, passages: DataFrame, known: DataFrame) -> DataFrame:
    """(iri, name, kept) of proposed names that no class has yet; kept where a passage of the class holds the words.

    ``answers``: (iri, name); ``passages``: (iri, text); ``known``: (name).
    """
    lower = F.lower("name")
    new = answers.select("iri", "name").distinct().withColumn("_key", lower).join(known.select(lower.alias("_key")), "_key", "left_anti")
    held = tx.has_phrase(F.lower("text"), F.col("_key"))
    return new.join(passages.select("iri", "text"), "iri", "left").groupBy("iri", "name").agg(F.bool_or(F.coalesce(held, F.lit(False))).alias("kept"))


def delta(now: DataFrame, before: DataFrame) -> DataFrame:
    """(cq_id, change): questions that newly pass or fail against the evaluation before; new questions count as failed before."""
    both = now.join(before.select("cq_id", F.col("passed").alias("_was")), "cq_id", "left").withColumn("_was", F.coalesce("_was", F.lit(False)))
    return both.where("passed <> _was").select("cq_id", F.when(F.col("passed"), "passing").otherwise("failing").alias("change"))
