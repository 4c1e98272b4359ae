"""UMI correction inside each (category, cell, feature): cluster, adjacency, directional (JN5, AGG8-13, WIN1, WIN3).

UMIs are ordered by reads, most first, then by the reversed string; ``rank`` is a
struct in that order, so that no window has to number a group. Neighbours differ in
one place. Undirected components are contracted as stars; the directed graph's labels
spread in rounds of joins, and a path halves its counts or is one of single reads.
Both keep only the last round's table in the shared folder. UMIs without neighbours
never enter a round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dna import wildcard
from ..storage import release, stored
from .components import components

GROUP = ["category", "cell_id", "feature_id"]


def rank(reads: str | Column = "reads", umi: str | Column = "umi") -> Column:
    reads, umi = (F.col(x) if isinstance(x, str) else x for x in (reads, umi))
    return F.struct((-reads).alias("less"), F.reverse(umi).alias("mirror"))


def numbered(molecules: DataFrame) -> DataFrame:
    """WIN1: ``rk`` from 1 within each group, for reports."""
    order = Window.partitionBy(*GROUP).orderBy(F.desc("reads"), F.reverse("umi"))
    return molecules.withColumn("rk", F.row_number().over(order).cast("bigint"))


def neighbours(molecules: DataFrame) -> DataFrame:
    """JN5: (group, umi_a, reads_a, umi_b, reads_b) for each ordered pair that differs in one place."""
    keyed = molecules.select(*GROUP, "umi", "reads", F.explode(F.sequence(F.lit(1), F.length("umi"))).alias("place")).withColumn("star", wildcard(F.col("umi"), F.col("place")))
    a = keyed.select(*GROUP, "star", F.col("umi").alias("umi_a"), F.col("reads").alias("reads_a"))
    b = keyed.select(*GROUP, "star", F.col("umi").alias("umi_b"), F.col("reads").alias("reads_b"))
    return a.join(b, [*GROUP, "star"]).where("umi_a <> umi_b").drop("star")


def spread(edges: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(group, umi, label): for each end of the directed ``edges`` the least rank that reaches it, itself included."""
    ends = edges.select(*GROUP, F.col("umi_a").alias("umi"), F.col("reads_a").alias("reads")).union(edges.select(*GROUP, "umi_b", "reads_b")).distinct()
    labels = stored(ends.select(*GROUP, "umi", rank().alias("label"), F.lit(True).alias("fresh")), "umi-labels")
    for _ in range(rounds):
        moving = labels.where("fresh").select(*GROUP, F.col("umi").alias("umi_a"), "label")
        given = edges.join(moving, [*GROUP, "umi_a"]).groupBy(*GROUP, F.col("umi_b").alias("umi")).agg(F.min("label").alias("given"))
        after = labels.drop("fresh").join(given, [*GROUP, "umi"], "left")
        better = F.coalesce(F.col("given") < F.col("label"), F.lit(False))
        after = stored(after.select(*GROUP, "umi", F.when(better, F.col("given")).otherwise(F.col("label")).alias("label"), better.alias("fresh")), "umi-labels")
        release(labels)
        labels = after
        if labels.where("fresh").isEmpty():
            return labels.drop("fresh")
    raise RuntimeError("labels did not settle")


def connected(edges: DataFrame) -> DataFrame:
    """AGG13: (group, umi, label): for each end of the ``edges``, both ways, the least rank of its component."""

    def node(end: str) -> Column:
        return F.struct(*GROUP, rank(f"reads_{end}", f"umi_{end}").alias("rank"))

    found = components(edges.select(node("a").alias("a"), node("b").alias("b")))
    return found.select(*[F.col(f"node.{c}").alias(c) for c in GROUP], F.reverse("node.rank.mirror").alias("umi"), F.col("root.rank").alias("label"))


def _collapsed(molecules: DataFrame, targets: DataFrame) -> DataFrame:
    """AGG12: reads summed under ``targets.target`` (group, umi, target), or the UMI itself."""
    moved = molecules.join(targets, [*GROUP, "umi"], "left").withColumn("umi", F.coalesce("target", "umi"))
    return moved.groupBy(*GROUP, "umi").agg(F.sum("reads").alias("reads"))


def cluster(molecules: DataFrame) -> DataFrame:
    """AGG9: connected components, under their first UMI."""
    edges = stored(neighbours(molecules), "umi-edges")
    return _collapsed(molecules, connected(edges).select(*GROUP, "umi", F.reverse("label.mirror").alias("target")))


def directional(molecules: DataFrame) -> DataFrame:
    """AGG11: a -> b if a has at least twice b's reads less one, or both have one; under the first UMI that reaches it."""
    a, b = F.col("reads_a"), F.col("reads_b")
    edges = stored(neighbours(molecules).where(((a > 1) & (a >= 2 * b - 1)) | ((a == 1) & (b == 1))), "umi-edges")
    return _collapsed(molecules, spread(edges).select(*GROUP, "umi", F.reverse("label.mirror").alias("target")))


def adjacency(molecules: DataFrame) -> DataFrame:
    """AGG10: in each component the UMIs up to the last one needed as a best neighbour stay, the others join theirs."""
    edges = stored(neighbours(molecules), "umi-edges")
    parts = connected(edges)
    ends = edges.select(*GROUP, F.col("umi_b").alias("umi"), rank("reads_b", "umi_b").alias("own"), rank("reads_a", "umi_a").alias("near"))
    best = ends.groupBy(*GROUP, "umi").agg(F.first("own").alias("own"), F.min("near").alias("near"))
    best = best.withColumn("edge", F.least("own", "near")).join(parts, [*GROUP, "umi"])
    last = best.groupBy(*GROUP, "label").agg(F.max("edge").alias("last"))
    joined = best.join(last, [*GROUP, "label"]).where(F.col("own") > F.col("last"))
    return _collapsed(molecules, joined.select(*GROUP, "umi", F.reverse("edge.mirror").alias("target")))


def correct(molecules: DataFrame, method: str = "directional") -> DataFrame:
    """AGG8: any unknown method name means directional."""
    return {"cluster": cluster, "adjacency": adjacency}.get(method, directional)(molecules)
