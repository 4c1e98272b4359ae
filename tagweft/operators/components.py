"""Connected components of an edge table by alternating star contractions.

Nodes are of any type that has an order. Each round is two joins on DataFrames; rows
of one node are combined before they are shuffled. A round's edges go to the shared
folder, and those of the round before are deleted, so rounds grow with the logarithm
of the longest path, and disk does not grow with rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import release, stored


def _least(edges: DataFrame) -> DataFrame:
    """Each node ``a`` with the smallest of its neighbours ``b``."""
    return edges.groupBy("a").agg(F.min("b").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(_least(both), "a")
    return near.where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges have a > b here."""
    near = edges.join(_least(edges), "a")
    return near.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(near.select("a", F.col("m").alias("b")))


def _settled(edges: DataFrame) -> bool:
    """Whether every node is a root or has one edge, to a root."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node it reaches.

    Loops and repeated edges are allowed; an empty table gives an empty one.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stored(edges, "edges")
    for _ in range(rounds):
        if _settled(edges):
            break
        after = stored(_small_star(_large_star(edges).distinct()).distinct(), "edges")
        release(edges)
        edges = after
    else:
        raise RuntimeError("components did not settle")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
