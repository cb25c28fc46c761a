"""Branches, decisions and conflicts: scores, ranks, precedents, settlement and diagnoses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from conceptflow.operators.state import prefer

# What a settled branch adds to the record of its options.
WEIGHTS = {"chosen": 1, "not_chosen": -1, "invalid": -2}


def record(branches: DataFrame) -> DataFrame:
    """(axis, option, weight) over settled branches (status, axes: array of (axis, option))."""
    weight = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    rows = branches.where(F.col("status").isin(*WEIGHTS)).select(weight[F.col("status")].alias("w"), F.explode("axes").alias("x"))
    return rows.groupBy("x.axis", "x.option").agg(F.sum("w").alias("weight"))


def scored(axioms: DataFrame, support: DataFrame, orphans: int, entities: int) -> DataFrame:
    """(branch_id, coverage, reorg_cost, regen_cost, parsimony) of branches.

    ``axioms``: (branch_id, axiom_id, adds boolean); ``support``: (axiom_id,
    mention_id). A mention behind several axioms of a branch counts once.
    """
    sizes = axioms.groupBy("branch_id").agg(F.count_if(~F.col("adds")).alias("reorg_cost"), F.count_if("adds").alias("kept"))
    covered = axioms.where("adds").join(support, "axiom_id").select("branch_id", "mention_id").distinct().groupBy("branch_id").agg(F.count("*").alias("n"))
    both = sizes.join(covered, "branch_id", "left").withColumn("regen_cost", F.coalesce("n", F.lit(0)).cast("bigint"))
    share = lambda c, whole: (F.col(c) / F.lit(whole)) if whole else None
    coverage, parsimony = share("regen_cost", orphans), share("kept", entities)
    return both.select(
        "branch_id", (F.lit(0.0) if coverage is None else coverage).alias("coverage"), "reorg_cost", "regen_cost",
        (F.lit(None).cast("double") if parsimony is None else parsimony).alias("parsimony"),
    )


def affinity(choices: DataFrame, history: DataFrame) -> DataFrame:
    """(branch_id, affinity): the share of a branch's choices that were decided for before; null if none was decided at all.

    ``choices``: (branch_id, axis, option); ``history``: (axis, option, weight) as ``record`` makes it.
    """
    seen = choices.join(history, ["axis", "option"], "left")
    decided = F.count_if(F.coalesce(F.col("weight") != 0, F.lit(False)))
    return seen.groupBy("branch_id").agg(F.when(decided > 0, F.count_if(F.coalesce(F.col("weight") > 0, F.lit(False))) / F.count("*")).alias("affinity"))


def decided(settled: DataFrame) -> DataFrame:
    """(id, branch_id, status, axis, comment): a row of the record for each axis of a settled branch, one with an empty axis if it has none.

    ``settled``: (branch_id, status, note, axes: array of (axis, option)). What is
    still proposed gives no row; an axis' category is what stands before its colon.
    """
    none = F.expr("array(named_struct('axis', '', 'option', ''))")
    each = settled.where(F.col("status").isin(*WEIGHTS)).withColumn("x", F.explode(F.when(F.size("axes") > 0, F.col("axes")).otherwise(none)))
    name = F.concat_ws(":", F.col("branch_id").cast("string"), "x.axis")
    return each.select(name.alias("id"), "branch_id", "status", F.substring_index("x.axis", ":", 1).alias("axis"), F.coalesce("note", F.lit("")).alias("comment"))


def unsettled(held: DataFrame, fresh: DataFrame) -> DataFrame:
    """Branches (decision_id, branch_id, status, ...) after new ones are persisted: settled decisions stay as they are, proposals of the others are replaced."""
    closed = held.where(F.col("status").isin(*WEIGHTS)).select("decision_id").distinct()
    new = fresh.join(closed, "decision_id", "left_anti")
    kept = held.join(closed, "decision_id", "left_semi").unionByName(held.join(closed, "decision_id", "left_anti").join(fresh.select("decision_id").distinct(), "decision_id", "left_anti"))
    return kept.unionByName(new.select(held.columns))


def ranked(branches: DataFrame, limit: int) -> DataFrame:
    """The best branches: coverage, then cost, then affinity (null: 0), then id."""
    cost, affinity = F.col("reorg_cost") + F.col("regen_cost"), F.coalesce("affinity", F.lit(0.0))
    return branches.orderBy(F.desc("coverage"), cost, affinity.desc(), "branch_id").limit(limit)


def settle(branches: DataFrame, chosen: DataFrame, invalid: DataFrame) -> DataFrame:
    """Branches (decision_id, branch_id, status, …) after answers: of decisions with a choice the chosen one and the others, invalid
    ones as such; the rest stay. ``chosen``: (decision_id, branch_id), one each; ``invalid``: (branch_id)."""
    picks = chosen.select("decision_id", F.col("branch_id").alias("_pick"))
    bad = invalid.select("branch_id", F.lit(True).alias("_bad")).distinct()
    rows = branches.join(picks, "decision_id", "left").join(bad, "branch_id", "left")
    status = F.when(F.col("_bad") & F.coalesce(F.col("_pick") != F.col("branch_id"), F.lit(True)), "invalid").when(F.col("_pick") == F.col("branch_id"), "chosen").when(F.col("_pick").isNotNull(), "not_chosen")
    return rows.withColumn("status", F.coalesce(status, "status")).select(branches.columns)


def rejections(decisions: DataFrame) -> DataFrame:
    """For each normal form the strongest decision against it: invalid before not_chosen, then the newest, then the larger id."""
    against = decisions.where("normal <> '' and status in ('not_chosen', 'invalid')")
    return prefer(against, ["normal"], [F.when(F.col("status") == "invalid", 0).otherwise(1), F.desc("created_at"), F.desc("id")])


def precedents(decisions: DataFrame, limit: int) -> DataFrame:
    """The newest decisions of each category, with their rank."""
    newest = Window.partitionBy("axis").orderBy(F.desc("created_at"), F.desc("id"))
    return decisions.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= limit)


def precedents_like(decisions: DataFrame, similarity: Column, limit: int, minimum: float) -> DataFrame:
    """The most similar decisions with a normal form, those with a comment first among equals; ``similarity`` is a column of ``decisions``."""
    near = decisions.where("normal <> ''").withColumn("similarity", similarity).where(F.col("similarity") >= minimum)
    silent = F.coalesce(F.col("comment") == "", F.lit(True))
    return near.orderBy(F.desc("similarity"), silent, F.desc("created_at"), F.desc("id")).limit(limit)


def by_pair(conflicts: DataFrame) -> DataFrame:
    """(a, b, n): entities over which two classes collide; ``conflicts``: (entity, iri), the few classes of one entity."""
    one = conflicts.select("entity", F.col("iri").alias("a")).distinct()
    return one.join(one.withColumnRenamed("a", "b"), "entity").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def conflict_findings(conflicts: DataFrame, incompatible: DataFrame, pattern: int) -> DataFrame:
    """(kind, subject, other, n): entities typed to incompatible classes (n pairs), and pairs of classes that collide ``pattern`` times."""
    one = conflicts.select("entity", F.col("iri").alias("a")).distinct()
    hit = incompatible.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = one.join(hit, "a").join(one.select("entity", F.col("a").alias("b")), ["entity", "b"])
    broken = pairs.groupBy("entity").agg(F.count("*").alias("n"))
    cases = broken.select(F.lit("factual_conflict").alias("kind"), F.col("entity").cast("string").alias("subject"), F.lit(None).cast("string").alias("other"), "n")
    return cases.unionByName(by_pair(conflicts).where(F.col("n") >= pattern).select(F.lit("conflict_pattern").alias("kind"), F.col("a").alias("subject"), F.col("b").alias("other"), "n"))


def diagnoses(conflicts: list[frozenset[str]], max_size: int = 3) -> list[frozenset[str]]:
    """The smallest sets of axioms that meet every conflict of one decision, up to ``max_size``; empty if none does.

    A set that misses a conflict can only grow by one of that conflict's axioms,
    so each round widens only by members of the first conflict missed.
    """
    open_ = {frozenset()} if conflicts else set()
    for _ in range(max_size):
        open_ = {held | {axiom} for held in open_ for axiom in next(c for c in conflicts if not c & held)}
        if done := [held for held in open_ if all(c & held for c in conflicts)]:
            return sorted(done, key=sorted)
    return []


def shortfall(kept: DataFrame, quota: DataFrame) -> DataFrame:
    """(cq_type, missing) of the types below their quota (cq_type, n)."""
    have = kept.groupBy("cq_type").agg(F.count("*").alias("_have"))
    missing = F.col("n") - F.coalesce("_have", F.lit(0))
    return quota.join(have, "cq_type", "left").select("cq_type", missing.alias("missing")).where("missing > 0")


def stopping(facts: DataFrame, target: float, threshold: float, most: int) -> DataFrame:
    """(criterion, role, state) from one row (pass_rate, settled, slope, early_slope, iteration): met, not_met, or unknown for lack of data."""
    state = lambda known, met: F.when(~known, "unknown").when(met, "met").otherwise("not_met")
    rate, slope, early = F.col("pass_rate"), F.col("slope"), F.col("early_slope")
    climbing = (early != 0) & (slope > early * 0.5)
    rows = [
        ("competency questions", "primary", state(rate.isNotNull(), (rate >= target) & F.col("settled"))),
        ("novelty saturation", "secondary", state(slope.isNotNull(), slope < threshold)),
        ("accumulation curve", "diagnostic", state(slope.isNotNull() & early.isNotNull(), ~climbing)),
        ("budget", "hard", state(F.lit(True), F.col("iteration") >= most)),
    ]
    return facts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("criterion"), F.lit(r).alias("role"), s.alias("state")) for c, r, s in rows])).alias("x")).select("x.*")
