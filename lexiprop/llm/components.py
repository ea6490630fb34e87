"""Connected components of a large edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiprop.llm.common import stored

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges ``(a, b)`` with ``a > b``.

    The smallest neighbour comes from an aggregation and is joined back, so that a node
    with very many neighbours is split by the engine's skew handling.
    """
    if large:
        near = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = near.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        near = edges.toDF("u", "v")
        least = near.groupBy("u").agg(F.min("v").alias("m"))
        moved = near.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a > b")
        moved = moved.union(least.select("u", "m"))
    return moved.filter("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)``: the smallest node of its component, for each node of ``edges(a, b)``.

    Each round is written to the shared folder; the rounds needed grow with the logarithm
    of the longest chain.
    """
    now = stored(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "edges"
    )
    mark = None
    for _ in range(MAX_ROUNDS):
        now = stored(_star(_star(now, True), False), "edges")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % F.lit(1 << 40))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select("b", "b").distinct())
