"""From reads to molecules: substrings, joins, filters and counts (PRJ2-5, FLT1-4, AGG1, AGG3)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dna import strict_substr
from ..storage import stored
from . import nearest


#: Rows of (barcode, id, category), under 100 bytes each, that are broadcast at most; parts of a barcode's reads beyond.
BROADCAST, SALT = 1_000_000, 64


@dataclass(frozen=True)
class Layout:
    """Where barcodes lie in reads."""

    cell_length: int
    umi_length: int
    feature_length: int
    feature_start: int = 0
    cell_mismatch: int = 1
    feature_mismatch: int = 2


def pieces(reads: DataFrame, layout: Layout, feature: Column | None = None, more: Sequence[Column] = ()) -> DataFrame:
    """(cell_barcode, feature_barcode, read1) of each read, and ``more``; ``feature`` replaces the fixed position (null: not found)."""
    fixed = strict_substr(F.col("read2"), layout.feature_start, layout.feature_length)
    return reads.select(strict_substr(F.col("read1"), 0, layout.cell_length).alias("cell_barcode"), (fixed if feature is None else feature).alias("feature_barcode"), "read1", *more)


def assigned(parts: DataFrame, cells: DataFrame, features: DataFrame, layout: Layout, exact: bool = False) -> DataFrame:
    """Reads with cell_id, feature_id (null: no valid match) and category; ``n`` reads that are alike are one row.

    ``cells`` has id and barcode, ``features`` also category. Alike reads are
    combined on the map side and stored once, so the source is read and parsed once;
    matching works on distinct barcodes, and one join each brings the ids back. Features
    have few distinct barcodes, each with very many reads: they are broadcast if a count
    finds few enough, and joined on salted keys beyond; reads without a feature barcode
    skip that join.
    """
    parts = stored(parts.groupBy("cell_barcode", "feature_barcode", "read1").agg(F.count("*").alias("n")), "reads")
    c = nearest.match(parts.select(F.col("cell_barcode").alias("barcode")), cells, layout.cell_length, 0 if exact else layout.cell_mismatch)
    f = nearest.match(parts.where("feature_barcode IS NOT NULL").select(F.col("feature_barcode").alias("barcode")), features, layout.feature_length, 0 if exact else layout.feature_mismatch)
    f = f.join(features.select("id", "category"), "id")
    c = stored(c.select(F.col("barcode").alias("cell_barcode"), F.col("id").alias("cell_id")), "cell-ids")
    f = f.select(F.col("barcode").alias("feature_barcode"), F.col("id").alias("feature_id"), "category")
    named = parts.where("feature_barcode IS NOT NULL").join(c, "cell_barcode", "left")
    none = [F.lit(None).cast(f.schema[name].dataType).alias(name) for name in ("feature_id", "category")]
    lost = parts.where("feature_barcode IS NULL").join(c, "cell_barcode", "left").select("*", *none)
    return _spread_join(named, stored(f, "feature-ids")).unionByName(lost)


def _spread_join(reads: DataFrame, known: DataFrame) -> DataFrame:
    """Left join on feature_barcode; no task gets all reads of a barcode."""
    if known.count() <= BROADCAST:
        return reads.join(F.broadcast(known), "feature_barcode", "left")
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return reads.withColumn("salt", F.pmod(F.xxhash64("read1"), F.lit(SALT)).cast("int")).join(salted, ["feature_barcode", "salt"], "left").drop("salt")


def umi_of(read1: Column, layout: Layout, umi_length: int | None = None) -> Column:
    """PRJ3."""
    return F.substring(read1, layout.cell_length + 1, layout.umi_length if umi_length is None else umi_length)


def shortest_umi(reads: DataFrame, layout: Layout) -> int:
    """OPT3: one UMI length for all reads, as long as the shortest read1 with a valid cell and feature allows."""
    both = reads.where("cell_id IS NOT NULL AND feature_id IS NOT NULL")
    least = both.agg(F.min(F.length("read1"))).first()[0]
    return layout.umi_length if least is None else max(0, min(layout.umi_length, least - layout.cell_length))


def molecules(reads: DataFrame, layout: Layout, umi_length: int | None = None, by: Sequence[Column] = ()) -> DataFrame:
    """AGG1: (category, cell_id, feature_id, umi, reads), and ``by``; an upper-case N drops the read, before upper-casing."""
    umi = umi_of(F.col("read1"), layout, umi_length)
    valid = reads.where(F.col("cell_id").isNotNull() & F.col("feature_id").isNotNull() & ~F.contains(umi, F.lit("N")))
    return valid.groupBy(*by, "category", "cell_id", "feature_id", F.upper(umi).alias("umi")).agg(F.sum("n").alias("reads"))


def counters(reads: DataFrame, layout: Layout, umi_length: int | None = None) -> DataFrame:
    """AGG3: one row of counts, in one pass."""
    cell, feature = F.col("cell_id").isNotNull(), F.col("feature_id").isNotNull()
    umi = ~F.contains(umi_of(F.col("read1"), layout, umi_length), F.lit("N"))

    def total(which: Column) -> Column:
        return F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0)).cast("bigint")

    return reads.agg(
        total(F.lit(True)).alias("n_reads"),
        total(cell).alias("n_valid_cell"),
        total(feature).alias("n_valid_feature"),
        total(cell & feature).alias("n_valid"),
        total(cell & feature & umi).alias("n_valid_umi"),
    )
