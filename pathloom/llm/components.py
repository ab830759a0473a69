"""Connected components of an edge table without a driver-side graph.

Alternating large-star and small-star steps (Kiveris et al. 2014) shrink the edges to stars around the smallest vertex.
Before the first step, and in each step, edges are first contracted to a forest within each partition, so what is
shuffled is bounded by vertices rather than links. Every step is cut by a reliable checkpoint, in as many partitions as its edges fill.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Edges of a partition that are contracted together.
FOREST_EDGES = 1_000_000


def forest(pairs: Iterator[tuple[int, int]]) -> dict[int, int]:
    """Vertex to smallest vertex of its component, by union-find, for the vertices that aren't smallest."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
            up.setdefault(min(a, b), min(a, b))
    return {x: t for x in list(up) if (t := top(x)) != x}


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (u, v) replaced, partition by partition, by stars with the same components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int]] = []
        for batch in batches:
            held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            if len(held) > FOREST_EDGES:
                held = list(forest(iter(held)).items())
                if len(held) > FOREST_EDGES // 2:
                    yield packed(held)
                    held = []
        yield packed(list(forest(iter(held)).items()))

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def stars(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(u, v): every vertex of an edge that isn't the smallest of its component, with the smallest."""
    now = common.cut(contracted(edges).where("u <> v").distinct())
    size = now.count()  # steps make no more edges than this, but for stars of one vertex
    now = common.snug(now, size)
    for _ in range(limit):
        # large-star: neighbours above a vertex are linked to the smallest neighbour, itself included
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # minima are written first: a join then deals its left side apart from the sum, so that adaptive execution can split a hot vertex
        least = common.cut(common.snug(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), size))
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small-star: neighbours below a vertex, and itself, are linked to the smallest of them
        down = common.cut(contracted(common.snug(large, size)).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v"))
        least = common.cut(common.snug(down.groupBy("u").agg(F.min("v").alias("m")), size))
        small = down.join(least.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        new = common.cut(common.snug(small.where("u <> v").distinct(), size))
        tops = new.select("u").intersect(new.select("v")).limit(1)  # done when no vertex is both below and above
        many = new.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1)
        if not tops.count() and not many.count():
            return new
        now = new
    raise RuntimeError("components did not converge")
