"""Connected components of a link table by randomized contraction.

Each round maps every node to the neighbour (or itself) with the smallest
pseudo-random rank and relabels the links; the expected number of nodes that
still have links falls by a constant factor, so rounds grow with the logarithm
of the input. Only min-aggregates and equi-joins are used, every round is shelved
as a Parquet table, and nothing but whether links are left reaches the driver.

A checkpoint would hand the planner's size estimate on, and that of a join is
the product of its sides: the number's digits would treble with every round and
fill the driver's heap after some 15. A table's size is that of its files.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptflow.session import cut, discard, shelve


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace each block of links by a star forest with the same components."""
    for batch in batches:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while (up := parent.setdefault(root, root)) != root:
                root = up
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        stars = [(x, r) for x in parent if (r := find(x)) != x]
        if stars:
            yield pa.RecordBatch.from_arrays([pa.array([s[k] for s in stars], pa.int64()) for k in (0, 1)], ["a", "b"])


def connected_components(links: DataFrame) -> DataFrame:
    """``links``: two bigint columns. Returns (node, root) for every node with a link to another.

    ``root`` is one node of the component, the same for all its nodes. Links of
    a node to itself, repeated links and nulls are ignored; no links: no rows.
    """
    a, b = links.columns
    edges = shelve(
        links.select(F.col(a).alias("a"), F.col(b).alias("b"))
        .where("a is not null and b is not null and a <> b")
        .mapInArrow(_forest, "a bigint, b bigint")
    )
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.lit(len(maps)), c).alias("r"), F.col(c).alias("v"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(rank("b")).alias("m"), F.first(rank("a")).alias("own"))
        step = shelve(best.select(F.col("a").alias("node"), F.least("m", "own")["v"].alias("to")))
        maps.append(step)
        left = step.select(F.col("node").alias("a"), F.col("to").alias("x"))
        right = step.select(F.col("node").alias("b"), F.col("to").alias("y"))
        done, edges = edges, shelve(
            edges.join(left, "a").join(right, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        )
        discard(done)
    discard(edges)
    if not maps:
        return links.sparkSession.createDataFrame([], "node bigint, root bigint")
    last = maps.pop()
    root = last.select(F.col("node"), F.col("to").alias("root"))
    while maps:
        step = maps.pop()
        later = root.select(F.col("node").alias("to"), F.col("root"))
        done, last = (last, step), shelve(step.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root")))
        root = last
        discard(*done)
    root = cut(root)
    discard(last)
    return root
