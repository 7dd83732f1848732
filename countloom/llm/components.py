"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countloom.llm.common import saved


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the node's least neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of the component) for each node of ``edges``
    (columns a and b, comparable, undirected; loops are ignored).

    Each round is written to the shared folder; rounds grow with the logarithm of
    the longest path. The edges end as stars, at most one edge a node, so a hub is
    never gathered: its neighbours are only aggregated to a minimum. An empty table
    gives an empty result.
    """
    edges = saved(edges.select("a", "b").where("a <> b").distinct(), "edges")
    mark = _mark(edges)
    while mark[0]:
        edges = saved(_small_star(_large_star(edges)), "edges")
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free hash of the edges: equal when a round changed nothing."""
    hashed = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(hashed), F.lit(0)), F.coalesce(F.sum(F.shiftright(hashed, 24)), F.lit(0))).first())
