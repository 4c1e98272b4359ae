"""FLT5, FLT6: the chimeric filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def count_cutoff(molecules: DataFrame, cutoff: int) -> DataFrame:
    """FLT5: molecules of more than ``cutoff`` reads; all of them if it is not above zero."""
    return molecules.where(F.col("reads") > cutoff) if cutoff > 0 else molecules


def share_filter(molecules: DataFrame, ratio: float) -> DataFrame:
    """FLT6: molecules with more than ``ratio`` of their UMI's reads in the cell, in single precision."""
    total = F.sum("reads").over(Window.partitionBy("category", "cell_id", "umi"))
    least = F.lit(ratio).cast("float") * F.col("total").cast("float")
    return molecules.withColumn("total", total).where(F.col("reads").cast("float") > least).drop("total")


def chimeric_filter(molecules: DataFrame, cutoff: int = 0, ratio: float = 0.5) -> DataFrame:
    """Cutoff, then share. A ratio of zero skips both, as users of such filters expect."""
    if not 0 <= ratio < 1:
        raise ValueError("the read ratio must lie in [0, 1)")
    return molecules if ratio < 1e-6 else share_filter(count_cutoff(molecules, cutoff), ratio)
