"""Connected components by alternating stars, for graphs that only Spark holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetlake.session import checkpointed, drop_scratch


def _least_neighbours(edges: DataFrame, node: str, other: str) -> DataFrame:
    """Stored, so that the join with it can be split where one node has very many edges."""
    return checkpointed(edges.groupBy(F.col(node).alias("node")).agg(F.min(other).alias("least")))


def component_roots(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of the links ``a, b`` that is not its component's smallest.

    Each round joins every larger neighbour of a node to the node's smallest
    neighbour (or itself), then every smaller neighbour likewise. Both keep the
    components, and repeated they end in stars around the smallest nodes after
    about the square of the logarithm of the longest path. Every round is stored
    in the shared folder and the one before it is removed.
    """
    edges = checkpointed(links.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        found = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("a") % 1000003)).first()
        if found == state or not found[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = found
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = _least_neighbours(both, "u", "v")
        large = checkpointed(both.join(least, both["u"] == least["node"]).where("v > u").select(
            F.col("v").alias("a"), F.least("u", "least").alias("b")).distinct())
        least_small = _least_neighbours(large, "a", "b")
        moved = large.join(least_small, large["a"] == least_small["node"]).where("b <> least").select(
            F.col("b").alias("a"), F.col("least").alias("b"))
        following = checkpointed(moved.union(least_small.select("node", "least")).distinct())
        for done in (least, large, least_small, edges):
            drop_scratch(done)
        edges = following
