"""Mentions in chunks, markers and coreference groups, axioms from judgements, conflicts that belong together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from conceptflow.functions import text as tx
from conceptflow.operators import parts
from conceptflow.operators.components import connected_components
from conceptflow.operators.decisions import diagnoses


def layout(blocks: DataFrame) -> DataFrame:
    """(chunk_id, ordinal, start, block_start) from (chunk_id, ordinal, size, block_start): where each rendered block begins in its chunk, two characters apart."""
    order = Window.partitionBy("chunk_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select("chunk_id", "ordinal", F.coalesce(F.sum(F.col("size") + 2).over(order), F.lit(0)).cast("bigint").alias("start"), "block_start")


def located(candidates: DataFrame, chunks: DataFrame, max_words: int = 8) -> DataFrame:
    """(chunk_id, ordinal, surface, status, start) of candidates (chunk_id, ordinal, surface), in order.

    A repeated surface takes the next occurrence, which may overlap the last one;
    status: located, unlocatable (no occurrence left) or rejected (not admissible).
    """
    good = F.coalesce(tx.admissible(F.col("surface"), max_words), F.lit(False))
    nth = F.row_number().over(Window.partitionBy("chunk_id", "surface").orderBy("ordinal"))
    placed = candidates.withColumn("nth", nth).join(chunks.select("chunk_id", "text"), "chunk_id", "left")
    found = F.expr("aggregate(sequence(1, nth), 0, (at, k) -> if(at < 0, at, coalesce(nullif(locate(surface, text, at + 1), 0), -1)))")
    rows = placed.withColumn("at", F.when(good & F.col("text").isNotNull(), found))
    status = F.when(~good, "rejected").when(F.col("at") > 0, "located").otherwise("unlocatable")
    return rows.select("chunk_id", "ordinal", "surface", status.alias("status"), F.when(F.col("at") > 0, F.col("at") - 1).cast("bigint").alias("start"))


def absolute(found: DataFrame, placed: DataFrame) -> DataFrame:
    """``found`` (chunk_id, start, ...) with the block (largest start at or before) and the offset in the document; ``placed`` is a layout."""
    starts = placed.select("chunk_id", F.col("start").alias("block_at"), F.col("ordinal").alias("block"), "block_start")
    met = found.join(starts, "chunk_id").where("block_at <= start")
    best = met.groupBy(*found.columns).agg(F.max(F.struct("block_at", "block", "block_start")).alias("b"))
    return best.select(*found.columns, F.col("b.block").alias("block"), (F.col("b.block_start") + F.col("start") - F.col("b.block_at")).alias("span_start"))


def marked(texts: DataFrame, mentions: DataFrame) -> DataFrame:
    """(document_id, text, order): ``[Mn]`` after each mention, n from 0 by span_start, and the mentions' ids in that order.

    ``mentions``: (document_id, id, span_start, span_end). The text is cut at the
    spans' ends; a later end never stands before an earlier one's mark.
    """
    number = F.row_number().over(Window.partitionBy("document_id").orderBy("span_start", "id")) - 1
    own = mentions.select("document_id", "id", "span_end", number.alias("n"))
    lists = own.groupBy("document_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("span_end").alias("e"), (-F.col("n")).alias("r"), F.col("n").alias("n")))).alias("m"),
        F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda x: x["id"]).alias("order"),
    )
    both = texts.select("document_id", "text").join(lists, "document_id", "left")
    piece = "concat(substring(text, if(i = 0, 0L, m[i - 1].e) + 1, cast(x.e - if(i = 0, 0L, m[i - 1].e) as int)), '[M', cast(x.n as string), ']')"
    whole = F.expr(f"concat(array_join(transform(m, (x, i) -> {piece}), ''), substring(text, cast(element_at(m, -1).e + 1 as int)))")
    return both.select("document_id", F.when(F.col("m").isNull(), F.col("text")).otherwise(whole).alias("text"), F.coalesce("order", F.expr("array()").cast("array<bigint>")).alias("order"))


def coreference(groups: DataFrame, order: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((document_id, group, members), (document_id, marker, reason)) from the groups (document_id, group, markers) a model named.

    ``order``: (document_id, order: array of mention ids). A marker that is none
    of the text's is unknown; one that was claimed before is duplicated; a group
    of one links nothing.
    """
    each = groups.select("document_id", "group", F.posexplode("markers").alias("at", "marker")).join(order, "document_id")
    index = F.when(F.col("marker").rlike(r"^M[0-9]{1,9}$"), F.substring("marker", 2, 9).cast("int"))
    known = each.withColumn("index", index).withColumn("id", F.get("order", F.col("index")))
    claim = F.row_number().over(Window.partitionBy("document_id", "marker").orderBy("group", "at"))
    judged = known.withColumn("claim", claim)
    reason = F.when(F.col("id").isNull(), "unknown").when(F.col("claim") > 1, "duplicated")
    members = F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"])
    kept = judged.where(reason.isNull()).groupBy("document_id", "group").agg(members.alias("members")).where("size(members) > 1")
    return kept, judged.select("document_id", "marker", reason.alias("reason")).where("reason is not null")


def assembled(proposals: DataFrame, judgements: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((proposal, s, p, o, kind, provenance), (proposal, why)): axioms of judged proposals, and those that give none.

    ``proposals``: (proposal, iri, label, gloss, criterion, n_mentions);
    ``judgements``: (proposal, relation, candidate); ``labels``: (label, iri).
    An instance is no class; a subclass of an unknown parent is dropped with all
    its axioms; an unrelated one is a root. Without mentions it is world knowledge.
    """
    parents = labels.groupBy("label").agg(F.min("iri").alias("parent")).withColumnRenamed("label", "candidate")
    judged = proposals.join(judgements, "proposal").join(parents, "candidate", "left")
    why = F.when(F.col("relation") == "instance_of", "an example, not a kind").when((F.col("relation") == "subclass_of") & F.col("parent").isNull(), "unknown parent")
    rejected = judged.select("proposal", why.alias("why")).where("why is not null")
    fact = lambda p, o, kind: F.struct(F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("kind"))
    facts = F.array(
        fact("type", F.lit("owl:Class"), "iri"), fact("prefLabel", F.col("label"), "literal"), fact("definition", F.col("gloss"), "literal"),
        fact("scopeNote", F.col("criterion"), "literal"), fact("subClassOf", F.when(F.col("relation") == "subclass_of", F.col("parent")), "iri"),
    )
    provenance = F.when(F.coalesce("n_mentions", F.lit(0)) > 0, "textual").otherwise("world_knowledge")
    rows = judged.where(why.isNull()).select("proposal", F.col("iri").alias("s"), provenance.alias("provenance"), F.explode(facts).alias("f"))
    return rows.select("proposal", "s", "f.p", "f.o", "f.kind", "provenance").where("coalesce(o, '') <> ''"), rejected


def touching(conflicts: DataFrame) -> DataFrame:
    """(conflict, decision): conflicts (conflict bigint, axiom) that share an axiom are one decision, named by its smallest conflict."""
    firsts = conflicts.groupBy("axiom").agg(F.min("conflict").alias("first"), F.max("conflict").alias("last")).where("first < last")
    links = conflicts.join(firsts, "axiom").select(F.col("conflict").alias("a"), F.col("first").alias("b"))
    roots = connected_components(links)
    names = roots.groupBy("root").agg(F.least(F.min("node"), F.min("root")).alias("decision"))
    named = roots.join(names, "root").select(F.col("node").alias("conflict"), "decision")
    return conflicts.select("conflict").distinct().join(named, "conflict", "left").select("conflict", F.coalesce("decision", "conflict").alias("decision"))


def _ways(rows: list[tuple]) -> list[tuple]:
    """The options of one decision's rows (decision, conflict, axiom)."""
    held: dict[int, set] = {}
    for _, conflict, axiom in rows:
        held.setdefault(conflict, set()).add(axiom)
    if len(held) == 1:
        found = [[axiom] for axiom in next(iter(held.values())) if axiom is not None]  # a conflict on its own is settled by any one of its axioms
    else:
        found = sorted(sorted(x) for x in diagnoses([frozenset(c) for c in held.values()]))
    return [(rows[0][0], option) for option in found] if len(found) > 1 else []


def axes(conflicts: DataFrame) -> DataFrame:
    """(decision, option: array<string>): the smallest sets of axioms that settle a decision's conflicts, where there are two ways out or more.

    One decision's conflicts, which share axioms, are folded in one task, and a task streams over its decisions.
    """
    rows = conflicts.select("conflict", "axiom").distinct()
    named = rows.join(touching(rows), "conflict").select("decision", F.col("conflict").cast("bigint").alias("conflict"), "axiom")
    return parts.folded(named, "decision", ["conflict", "axiom"], _ways, "decision bigint, option array<string>")


def branches(options: DataFrame, most: int) -> DataFrame:
    """(branch: array<struct<axis, option>>): one option of every axis (axis, option), the first ``most`` in the options' order.

    Axes are few; after each of them no more than ``most`` combinations go on,
    which are the first of the product as the axes are taken in order.
    """
    names = [r["axis"] for r in options.select("axis").distinct().orderBy("axis").limit(64).collect()]
    pick = lambda name: options.where(F.col("axis") == name).select(F.struct("axis", "option").alias("x"))
    if not names:
        return options.sparkSession.createDataFrame([], "branch array<struct<axis:string,option:string>>")
    first = pick(names[0]).select(F.array("x").alias("branch"))
    return reduce(lambda held, name: held.crossJoin(F.broadcast(pick(name))).select(F.concat("branch", F.array("x")).alias("branch")).orderBy("branch").limit(most), names[1:], first.orderBy("branch").limit(most))
