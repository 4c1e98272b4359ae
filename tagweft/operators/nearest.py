"""JN2: nearest-match join against a barcode list, with ambiguous hits rejected.

A key matches if its smallest Hamming distance to any listed barcode is within the
radius and one barcode alone has it. The radius shrinks to k if some string has its
smallest distance k, below the largest allowed, to two barcodes or more. The ball of
all strings around the list is never built to match: only keys without an exact hit
are expanded, to strings with starred places that both sides share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dna import ALPHABET, hamming, wildcards


def check_unique(listed: DataFrame) -> None:
    """Raises if a barcode is listed twice."""
    twice = listed.groupBy("barcode").count().where("count > 1").head()
    if twice:
        raise ValueError(f"barcode {twice.barcode} is listed more than once")


def ball(listed: DataFrame, length: int, radius: int) -> DataFrame:
    """(key, id, dist): each string within ``radius`` of each barcode, over five letters, once a barcode."""
    level = listed.select(F.upper("barcode").alias("key"), "id", F.lit(0).alias("dist"), F.lit(0).alias("last"))
    out = level
    letters = F.array(*[F.lit(c) for c in ALPHABET])
    for k in range(1, radius + 1):
        spots = level.where(F.col("last") < length).withColumn("place", F.explode(F.sequence(F.col("last") + 1, F.lit(length))))
        level = spots.withColumn("letter", F.explode(letters)).where(F.substring("key", F.col("place"), F.lit(1)) != F.col("letter"))
        level = level.select(F.concat(F.substring("key", F.lit(1), F.col("place") - 1), "letter", F.substring("key", F.col("place") + 1, F.lit(length))).alias("key"), "id", F.lit(k).alias("dist"), F.col("place").alias("last"))
        out = out.union(level)
    return out.drop("last")


def nearest_of(candidates: DataFrame) -> DataFrame:
    """(key, dist, ids, id): the smallest distance of each key and how many barcodes have it."""
    at = candidates.groupBy("key", "dist").agg(F.count_distinct("id").alias("ids"), F.min("id").alias("id"))
    best = at.groupBy("key").agg(F.min(F.struct("dist", "ids", "id")).alias("best"))
    return best.select("key", "best.dist", "best.ids", "best.id")


def radius_of(listed: DataFrame, length: int, max_mismatch: int) -> int:
    """The radius that collisions leave; needs the ball one short of the largest."""
    if max_mismatch < 2:
        return max_mismatch
    ties = nearest_of(ball(listed, length, max_mismatch - 1)).where("ids > 1 AND dist > 0")
    least = ties.agg(F.min("dist")).first()[0]
    return max_mismatch if least is None else int(least)


def index(listed: DataFrame, length: int, max_mismatch: int) -> DataFrame:
    """(key, id): all strings that match one barcode alone, as :func:`match` would; for joins with a stream."""
    radius = radius_of(listed, length, max_mismatch)
    return nearest_of(ball(listed, length, radius)).where("ids = 1").select("key", "id")


def ambiguity(listed: DataFrame, length: int, max_mismatch: int) -> DataFrame:
    """AGG15: (n_keys, n_ambiguous) over all strings within the radius."""
    radius = radius_of(listed, length, max_mismatch)
    return nearest_of(ball(listed, length, radius)).agg(F.count("*").alias("n_keys"), F.count_if(F.col("ids") > 1).alias("n_ambiguous"))


def list_facts(listed: DataFrame, length: int, max_mismatch: int) -> DataFrame:
    """RPT7: one row: barcodes, length, keys of the index, and how many of them are ambiguous, with their share."""
    share = F.round(100.0 * F.col("n_ambiguous") / F.nullif("n_keys", F.lit(0)), 2)
    facts = ambiguity(listed, length, max_mismatch)
    return facts.select(F.lit(listed.count()).cast("bigint").alias("barcodes"), F.lit(length).alias("length"), "n_keys", "n_ambiguous", share.alias("ambiguous_share"))


def match(keys: DataFrame, listed: DataFrame, length: int, max_mismatch: int, radius: int | None = None) -> DataFrame:
    """(barcode, id, dist) of the distinct ``keys.barcode`` that match ``listed`` (id, barcode).

    ``listed`` must be free of repeats (:func:`check_unique`). Keys of another length match nothing.
    """
    radius = radius_of(listed, length, max_mismatch) if radius is None else radius
    listed = listed.select("id", F.upper("barcode").alias("listed"))
    keys = keys.select("barcode").distinct()
    exact = keys.join(listed, F.upper("barcode") == F.col("listed")).select("barcode", "id", F.lit(0).alias("dist"))
    if radius == 0:
        return exact
    misses = keys.join(listed, F.upper("barcode") == F.col("listed"), "left_anti").where(F.length("barcode") == length)
    ours = misses.select("barcode", F.explode(wildcards(F.upper("barcode"), length, radius)).alias("star"))
    theirs = listed.select("id", "listed", F.explode(wildcards(F.col("listed"), length, radius)).alias("star"))
    pairs = ours.join(theirs, "star").select("barcode", "id", "listed").distinct()
    near = nearest_of(pairs.select(F.col("barcode").alias("key"), "id", hamming(F.upper("barcode"), F.col("listed")).alias("dist")))
    found = near.where("ids = 1").select(F.col("key").alias("barcode"), "id", F.col("dist").cast("int").alias("dist"))
    return exact.union(found)
