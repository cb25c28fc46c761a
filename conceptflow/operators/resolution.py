"""Cross-document entity resolution, composed: candidate pairs from all sources, key verdicts, decisions; rankings and their comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from conceptflow.functions import text as tx
from conceptflow.operators import parts
from conceptflow.operators.relational import decide
from conceptflow.session import shelve


def matched(mentions: DataFrame, near: DataFrame, synonyms: DataFrame, left: DataFrame | None = None, separator: str | None = None) -> DataFrame:
    """Candidate pairs in different documents, once each, with both mentions' columns under names that end in 1 and 2, ``sources``, ``synonym`` (declared either way) and ``near``'s other columns.

    ``mentions``: (id, document_id, surface, keys: map<string, string>, ...),
    surface normalised; ``near``: (a, b, ...) at or above the similarity floor;
    ``synonyms``: (name, other), normalised; ``left``: the mentions as they stand
    on the left side, if they have more columns there. A pair comes from near, one
    surface, one key value or declared synonyms, in this order, and the first of
    these that holds makes its row: what else holds is read off the two mentions,
    so the pairs, which may be as many as the square of the mentions, are neither
    shuffled nor compared with each other. Null surfaces and keys pair with nothing.
    Sources are a sorted array, or a string with ``separator`` between them.
    """
    listed = lambda *names: F.array(*map(F.lit, names)) if separator is None else F.lit(separator.join(names))
    none = lambda c, kind: F.coalesce(c, F.expr(f"cast(array() as array<{kind}>)"))
    others = synonyms.where("name is not null").groupBy(F.col("name").alias("surface")).agg(F.collect_set("other").alias("_others"))
    met = near.where("a < b").groupBy(F.col("a").alias("id")).agg(F.collect_set("b").alias("_near"))
    values = F.array_distinct(F.transform(F.map_entries("keys"), lambda e: F.concat_ws("=", e["key"], e["value"])))

    def side(rows: DataFrame, n: int) -> DataFrame:
        full = rows.join(others, "surface", "left").join(met.hint("merge"), "id", "left")
        full = full.withColumns({"_others": none(F.col("_others"), "string"), "_near": none(F.col("_near"), dict(met.dtypes)["_near"][6:-1]), "_values": none(values, "string")})
        held = shelve(full.drop("_near") if n == 2 else full)
        return held.select([F.col(c).alias(f"{c}{n}") for c in held.columns])

    one, two = side(mentions if left is None else left, 1), side(mentions, 2)
    both = (F.size("_values1") > 0) & (F.size("_values2") > 0)
    shared = both & F.arrays_overlap("_values1", "_values2")
    same = F.coalesce(F.col("surface1") == F.col("surface2"), F.lit(False))
    ahead, back = (F.coalesce((F.size(f"_others{x}") > 0) & F.array_contains(f"_others{x}", F.col(f"surface{y}")), F.lit(False)) for x, y in ((1, 2), (2, 1)))
    fresh = (F.col("id1") < F.col("id2")) & (F.col("document_id1") != F.col("document_id2")) & ~((F.size("_near1") > 0) & F.array_contains("_near1", F.col("id2")))
    of = lambda a, b, test, sources, told: parts.paired(a, b, ["_k"], "id1", "id2").where(fresh & test).withColumns({"sources": sources, "synonym": told}).drop("_k")
    at = lambda rows, c: rows.withColumn("_k", F.col(c))
    each = lambda rows, c: rows.withColumn("_k", F.explode(c))
    # A pair that shares several values meets at the least of them.
    least = (F.size("_values1") == 1) | (F.size("_values2") == 1) | (F.col("_k") == F.array_min(F.array_intersect("_values1", "_values2")))
    rows = [
        of(at(one, "surface1"), at(two, "surface2"), F.lit(True), F.when(shared, F.when(ahead, listed("key", "surface", "synonym")).otherwise(listed("key", "surface"))).otherwise(F.when(ahead, listed("surface", "synonym")).otherwise(listed("surface"))), ahead),
        of(each(one, "_values1"), each(two, "_values2"), ~same & least, F.when(ahead | back, listed("key", "synonym")).otherwise(listed("key")), ahead | back),
        of(each(one, "_others1"), at(two, "surface2"), ~same & ~shared, listed("synonym"), F.lit(True)),
        of(at(one, "surface1"), each(two, "_others2"), ~same & ~shared & ~ahead, listed("synonym"), F.lit(True)),
    ]
    beside = near.join(one.hint("merge"), F.col("a") == F.col("id1")).join(two.hint("merge"), F.col("b") == F.col("id2")).where("document_id1 <> document_id2")
    forth = F.col("a") < F.col("b")
    found = F.array_compact(F.array(F.when(forth & shared, "key"), F.lit("neighbour"), F.when(forth & same, "surface"), F.when(forth & (ahead | back), "synonym")))
    beside = beside.withColumns({"sources": found if separator is None else F.array_join(found, separator), "synonym": ahead | back})
    extra = {c: F.lit(None).cast(t) for c, t in near.dtypes if c not in ("a", "b")}
    return reduce(DataFrame.unionByName, [beside.drop("a", "b"), *[r.withColumns(extra) for r in rows]]).drop(*[f"{c}{n}" for c in ("_others", "_near", "_values") for n in (1, 2)])


def candidate_pairs(mentions: DataFrame, near: DataFrame, synonyms: DataFrame, separator: str | None = None) -> DataFrame:
    """(a, b, sources) of pairs in different documents; ``near``: (a, b) at or above the similarity floor; sources: sorted array, or joined by ``separator``."""
    found = matched(mentions.select("id", "document_id", "surface", "keys"), near.select("a", "b").distinct(), synonyms, separator=separator)
    return found.select(F.col("id1").alias("a"), F.col("id2").alias("b"), "sources")


def key_verdict(properties: Column, left: Column, right: Column) -> Column:
    """True if all key properties agree, false if all are there and one differs, null if there are none or one is missing."""
    there = F.forall(properties, lambda p: F.map_contains_key(left, p) & F.map_contains_key(right, p))
    return F.when((F.size(properties) > 0) & there, F.forall(properties, lambda p: left[p] == right[p]))


def _told(mentions: DataFrame) -> DataFrame:
    """``mentions`` with what a decision needs of each text, told once a mention and not once a pair."""
    return mentions.withColumns({"generic": tx.is_generic(F.col("text")), "proper": tx.is_proper_name(F.col("text"))})


def _keyed(mentions: DataFrame) -> DataFrame:
    """``mentions`` with names and values of their keys that aren't null; the left side's ``declared`` (null: not all there) and those of it that aren't null."""
    pair = lambda p: F.concat_ws("\0", p, F.col("keys")[p])
    there = F.filter(F.map_keys("keys"), lambda p: F.col("keys")[p].isNotNull())
    out = mentions.withColumns({"held": F.map_keys("keys"), "names": there, "pairs": F.transform(there, pair)})
    if "properties" not in mentions.columns:
        return out
    whole = (F.size("properties") > 0) & F.forall("properties", lambda p: F.map_contains_key("keys", p))
    known = F.array_distinct(F.filter("properties", lambda p: F.col("keys")[p].isNotNull()))
    return out.withColumns({"declared": F.when(whole, F.array_distinct("properties")), "names": known, "pairs": F.transform(known, pair)})


def _verdict() -> Column:
    """``key_verdict`` of two mentions of one class from what ``_keyed`` told of each, in functions that compile for large joins."""
    both, equal = F.size(F.array_intersect("names1", "names2")), F.size(F.array_intersect("pairs1", "pairs2"))
    value = F.when(both > equal, F.lit(False)).when(equal == F.size("declared1"), F.lit(True))
    return F.when(F.col("declared1").isNotNull() & (F.size("held2") > 0), F.when(F.size(F.array_except("declared1", "held2")) == 0, value))


def _decided(both: DataFrame, same_key: Column, auto: float, grey: float) -> DataFrame:
    """(a, b, action, reason) of pairs with both mentions' columns, ``synonym`` and ``score``; ``same_key`` counts within one class."""
    same_class = F.coalesce(F.col("class1") == F.col("class2"), F.lit(False))
    facts = both.select(
        "a", "b", F.when(same_class, same_key).alias("same_key"),
        F.col("language1").alias("left_language"), F.col("language2").alias("right_language"), F.coalesce("synonym", F.lit(False)).alias("synonym"),
        (F.col("generic1") | F.col("generic2")).alias("generic"), (F.col("surface1") == F.col("surface2")).alias("same_name"),
        F.col("proper1").alias("proper"), same_class.alias("same_class"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
    return decide(facts, auto, grey).select("a", "b", "action", "reason")


_SIDE = ("text", "surface", "language", "class", "keys", "generic", "proper")


def resolve(pairs: DataFrame, mentions: DataFrame, synonyms: DataFrame, keys: DataFrame, scores: DataFrame, auto: float, grey: float) -> DataFrame:
    """(a, b, action, reason) of given candidate pairs.

    ``mentions``: (id, text, surface, language, class, keys); ``keys``: (class,
    properties: array) of the declared keys; ``scores``: (a, b, score), 0 where missing.
    """
    told = _told(mentions)
    side = lambda k, n: told.select(F.col("id").alias(k), *[F.col(c).alias(c + n) for c in _SIDE])
    both = pairs.select("a", "b").join(side("a", "1"), "a").join(side("b", "2"), "b")
    declared = synonyms.select(F.col("name").alias("surface1"), F.col("other").alias("surface2"))
    declared = declared.union(declared.select("surface2", "surface1")).distinct().withColumn("synonym", F.lit(True))
    both = both.join(declared, ["surface1", "surface2"], "left").join(keys.withColumnRenamed("class", "class1"), "class1", "left").join(scores.select("a", "b", "score"), ["a", "b"], "left")
    return _decided(both, F.when(F.col("properties").isNotNull(), key_verdict(F.col("properties"), F.col("keys1"), F.col("keys2"))), auto, grey)


def resolved(mentions: DataFrame, near: DataFrame, synonyms: DataFrame, keys: DataFrame, auto: float, grey: float) -> DataFrame:
    """(a, b, action, reason) of all candidate pairs: ``resolve`` of ``candidate_pairs``, without a shuffle of the pairs.

    ``mentions`` as there, with document_id; ``near``: (a, b, score), 0 for other pairs.
    """
    told = _told(mentions).select("id", "document_id", *_SIDE)
    left = _keyed(told.join(keys.select("class", "properties"), "class", "left"))
    both = matched(_keyed(told), near.select("a", "b", "score"), synonyms, left).withColumnsRenamed({"id1": "a", "id2": "b"})
    return _decided(both, _verdict(), auto, grey)


def reranked(offered: DataFrame, scored: DataFrame, auto: float, grey: float) -> DataFrame:
    """(mention_id, iri, score, zone, runner_up) after a second ranking of the offered classes.

    ``offered``: (mention_id, iri); ``scored``: (mention_id, iri, name, score), a
    row for each name of a class; a class has its best name's score, ties go to the smaller iri.
    """
    # Both lists meet by mention, in tasks of bounded length: one shuffle, no join of all names.
    one = offered.select("mention_id", "iri", F.lit(True).alias("_offered"), F.lit(None).cast(dict(scored.dtypes)["score"]).alias("score"))
    both = one.unionAll(scored.select("mention_id", "iri", F.lit(False).alias("_offered"), "score")).where("mention_id is not null and iri is not null")
    met = parts.dealt(both, "mention_id").groupBy("mention_id", "iri").agg(F.max("score").alias("score"), F.max("_offered").alias("_offered"), F.min("_offered").alias("_unscored"))
    best = met.where("_offered and not _unscored").select("mention_id", "iri", "score")
    order = Window.partitionBy("mention_id").orderBy(F.desc("score"), "iri")
    ranked = best.withColumn("rank", F.row_number().over(order)).withColumn("runner_up", F.lead("iri").over(order)).where("rank = 1")
    zone = F.when(F.col("score") >= auto, "auto").when(F.col("score") >= grey, "grey").otherwise("discarded")
    return ranked.select("mention_id", F.when(zone != "discarded", F.col("iri")).alias("iri"), "score", zone.alias("zone"), "runner_up")


def comparison(ranks: DataFrame) -> DataFrame:
    """(n, base_at_1, base_at_5, tuned_at_1, tuned_at_5, ceiling) over the same mentions; ``ranks``: (base, tuned), the right class's places, null if not offered."""
    share = lambda test: F.avg(F.coalesce(test.cast("double"), F.lit(0.0)))
    at = lambda name, k: share(F.col(name) <= k).alias(f"{name}_at_{k}")
    return ranks.agg(F.count("*").alias("n"), at("base", 1), at("base", 5), at("tuned", 1), at("tuned", 5), share(F.col("base").isNotNull()).alias("ceiling"))


def redundant(scores: DataFrame, threshold: float) -> DataFrame:
    """(proposal, label, score): proposals whose best existing label reaches the threshold, ties to the smaller label."""
    order = Window.partitionBy("proposal").orderBy(F.desc("score"), "label")
    return parts.dealt(scores.select("proposal", "label", "score"), "proposal").withColumn("n", F.row_number().over(order)).where((F.col("n") == 1) & (F.col("score") >= threshold)).select("proposal", "label", "score")


def orphan_candidates(scores: DataFrame, floor: float, n: int) -> DataFrame:
    """(surface, iri, score, rank, support): the ``n`` best classes of each orphan surface at or above ``floor``.

    ``scores``: (surface, mention_id, iri, score); support counts a surface's mentions.
    """
    support = scores.groupBy("surface").agg(F.countDistinct("mention_id").alias("support"))
    best = scores.groupBy("surface", "iri").agg(F.max("score").alias("score")).where(F.col("score") >= floor)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("surface").orderBy(F.desc("score"), "iri"))).where(F.col("rank") <= n)
    return ranked.join(support, "surface")
