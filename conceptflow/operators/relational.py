"""Resolution cascades, reports, ordered windows and deterministic samples, as declarative plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from conceptflow.functions.text import phrase_pattern


def decide(pairs: DataFrame, auto: float, grey: float) -> DataFrame:
    """``pairs`` with action and reason: key, language, synonym, generic phrase, proper name, similarity, in this order.

    Columns: same_key (null: no key to compare), left_language, right_language,
    synonym, generic, same_name, proper, same_class, score.
    """
    rules = [
        (F.col("same_key"), "merge", "declared_key_matches"),
        (~F.col("same_key"), "separate", "declared_key_differs"),
        (F.col("left_language") != F.col("right_language"), "ask", "cross_language"),
        (F.col("synonym"), "merge", "synonym_declared_in_ontology"),
        (F.col("generic"), "separate", "generic_phrase_cross_document"),
        (F.col("same_name") & F.col("proper") & F.col("same_class"), "merge", "identical_proper_name"),
        (F.col("same_name") & F.col("proper"), "ask", "identical_name_different_class"),
        (F.col("score") >= auto, "merge", "high_similarity"),
        (F.col("score") >= grey, "ask", "grey_zone"),
    ]
    action = reason = F
    for test, a, r in rules:
        action, reason = action.when(test, a), reason.when(test, r)
    return pairs.withColumn("action", action.otherwise("separate")).withColumn("reason", reason.otherwise("low_similarity"))


def accumulation(order: DataFrame, concepts: DataFrame) -> DataFrame:
    """(seq, document_id, new, total): distinct concepts in processing order.

    The running sum is taken within blocks of documents, whose bases are summed
    apart, so no task orders the whole corpus.
    """
    firsts = concepts.join(order, "document_id").groupBy("concept").agg(F.min_by("document_id", "seq").alias("document_id"))
    new = firsts.groupBy("document_id").agg(F.count("*").alias("new"))
    rows = order.join(new, "document_id", "left").select("seq", "document_id", F.coalesce("new", F.lit(0)).cast("bigint").alias("new"), F.expr("seq div 4096").alias("block"))
    before = Window.partitionBy(F.lit(1)).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("block").agg(F.sum("new").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("block").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_n", F.sum("new").over(within)).join(bases, "block").select("seq", "document_id", "new", (F.col("_n") + F.col("base")).alias("total"))


def tail_slope(curve: DataFrame, window: int) -> DataFrame:
    """(slope): mean of new over the last ``window`` documents; null if there are fewer."""
    last = curve.orderBy(F.desc("seq")).limit(window)
    return last.agg(F.when(F.count("*") >= window, F.avg("new")).alias("slope"))


def separation(scores: DataFrame) -> DataFrame:
    """(separation): distance of the medians of right and wrong scores in units of their common spread; 0 if unknown."""
    right, wrong = F.when(F.col("correct"), F.col("score")), F.when(~F.col("correct"), F.col("score"))
    spread = F.stddev_pop("score")
    value = F.when((F.count(right) >= 2) & (F.count(wrong) >= 2) & (spread > 0), (F.median(right) - F.median(wrong)) / spread).otherwise(0.0)
    return scores.agg(value.alias("separation"))


def sweep(scores: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, accepted, right, precision, recall, f1) of one ranking at every threshold, in one pass over the rows."""
    exploded = scores.select("score", "correct", F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"))
    hit = F.col("score") >= F.col("threshold")
    counts = exploded.groupBy("threshold").agg(
        F.count_if(hit).alias("accepted"), F.count_if(hit & F.col("correct")).alias("right"), F.count("*").alias("n")
    )
    p = F.when(F.col("accepted") > 0, F.col("right") / F.col("accepted")).otherwise(0.0)
    r = F.when(F.col("n") > 0, F.col("right") / F.col("n")).otherwise(0.0)
    return counts.select("threshold", "accepted", "right", p.alias("precision"), r.alias("recall")).withColumn(
        "f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    )


def sample_per(rows: DataFrame, by: list[str], n: int, key: Column, seed: int) -> DataFrame:
    """``n`` rows of each group, the same at every run: those whose seeded hash is smallest."""
    draw = F.sha1(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary"))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(draw, key))).where(F.col("_n") <= n).drop("_n")


def presence(phrases: DataFrame, docs: DataFrame, first: int = 5) -> DataFrame:
    """(iri, occurrences, documents) of phrases (iri, label) in all texts (doc_id, text); doc_id names a document.

    A phrase's first words (``first``, or all it has) meet the texts' word runs by
    an equi-join; its pattern, which allows any space between words, only runs on
    texts that hold all its words one after another, which a byte search tells.
    """
    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    named = phrases.select("iri", words(F.col("label")).alias("w"))
    keyed = named.where("size(w) > 0").select(
        "iri", F.array_join("w", " ").alias("whole"), phrase_pattern(F.array_join("w", " ")).alias("pattern"), F.least(F.size("w"), F.lit(first)).alias("width"), F.array_join(F.slice("w", 1, first), " ").alias("gram")
    )
    widths = sorted(r["width"] for r in keyed.select("width").distinct().collect())  # ``first`` at most
    texts = docs.select("doc_id", F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"\s+", " ").alias("t"))
    # A run of k words has k - 1 spaces, so runs of different widths never meet.
    runs = lambda w, k: F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - k + 1, F.lit(0))), lambda x, i: F.concat_ws(" ", x, *[F.get(w, i + j) for j in range(1, k)]))
    none = F.expr("cast(array() as array<string>)")
    # The word list is bound once: inside the inner lambda its expression would be evaluated anew for every word.
    every = F.flatten(F.transform(F.array(words(F.col("t"))), lambda w: F.concat(none, *[runs(w, k) for k in widths])))
    grams = texts.select("doc_id", F.explode(every).alias("gram"))
    held = grams.join(keyed.drop("width"), "gram").select("doc_id", "iri", "whole", "pattern").distinct()
    counts = held.join(texts, "doc_id").where(F.contains("t", F.col("whole"))).withColumn("n", F.regexp_count("t", F.col("pattern"))).where("n > 0")
    found = counts.groupBy("iri").agg(F.sum("n").alias("occurrences"), F.count("*").alias("documents"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return named.select("iri").join(found, "iri", "left").select("iri", zero("occurrences"), zero("documents"))
