"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspark.session import through_table

MAX_ROUNDS = 60


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of every node to the least node among them and itself.

    The large star links those above the node, the small star the node itself and those below.
    The least neighbour comes from a partial aggregation and is joined back, so a node with a
    large share of all edges is a skewed join, which adaptive execution splits.
    """
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    joined = both.join(least.select("a", F.least("m", "a").alias("m")), "a")
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.least("m", "a").alias("b")))
    return moved.where("a <> b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge down, to a node that has none: then that node is the least of its component.

    The counts of a node come from a partial aggregation; one row reaches the driver.
    """
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("down")).union(edges.select(F.col("b").alias("id"), F.lit(0).alias("down")))
    nodes = ends.groupBy("id").agg(F.sum("down").alias("down"), F.min("down").alias("least"))
    return nodes.where("down > 1 or (down > 0 and least = 0)").agg(F.count("*")).first()[0] == 0


def connected_components(edges: DataFrame) -> DataFrame:
    """``id`` and ``component`` (the least id reachable) of every node of ``edges`` (columns ``a`` and ``b``).

    Every round is written to the shared folder; rounds grow with the logarithm of the number
    of nodes, and edges that are stars already need none. Loops and repeated edges are
    harmless; an empty table gives an empty one.
    """
    edges = through_table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    for left in reversed(range(MAX_ROUNDS + 1)):
        if _settled(edges):
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        if left:
            edges = through_table(_stars(_stars(edges, True), False), "edges")
    raise RuntimeError("components did not settle")
