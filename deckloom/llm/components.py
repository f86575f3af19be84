"""Connected components of a graph that is never collected: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deckloom.llm.common import stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % F.lit(1 << 31))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the least node it knows."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hands itself and its smaller neighbours to the least of them. Edges point to the smaller node."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def least_nodes(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node with an edge: the least node that its edges reach.

    ``edges``: ``a, b`` (bigint), in any direction, repeated or not. Every round is written to the shared
    folder; the number of rounds grows with the logarithm of the longest path.
    """
    directed = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    held = stored(directed, "edges")
    before, now = None, _state(held)
    while now != before:
        held = stored(_small_star(stored(_large_star(held), "edges")), "edges")
        before, now = now, _state(held)
    roots = held.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return held.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
