"""Count matrices and reports (AGG4-7, SRT2-5, FLT7, RPT2-5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored


def counts(molecules: DataFrame) -> DataFrame:
    """AGG6: (category, cell_id, feature_id, n)."""
    return molecules.groupBy("category", "cell_id", "feature_id").agg(F.count("*").alias("n"))


#: Cells in a row of list order that one task numbers: 2 to this power.
SPAN = 12


def _before(rows: DataFrame, value: str) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over the smaller cell ids of the category.

    Sums of spans of ids are added up first, so no task gets a whole category.
    """
    span = F.shiftright("cell_id", SPAN)
    spans = rows.groupBy("category", span.alias("span")).agg(F.sum(value).alias("total"))
    order = Window.partitionBy("category").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("category", "span", F.coalesce(F.sum("total").over(order), F.lit(0)).alias("start"))
    within = Window.partitionBy("category", "span").orderBy("cell_id").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.withColumn("span", span).withColumn("inner", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return parts.join(spans, ["category", "span"]).withColumn("before", (F.col("start") + F.col("inner")).cast("bigint")).drop("span", "start", "inner")


def dense(matrix: DataFrame) -> DataFrame:
    """SRT4: adds ``cell_idx``, from 0 over the cells present, in list order, within each category.

    Numbers come from the distinct cells; the entries only join them. The matrix is
    stored first, as it is read three times.
    """
    matrix = stored(matrix, "matrix")
    cells = matrix.select("category", "cell_id").distinct().withColumn("one", F.lit(1).cast("bigint"))
    return matrix.join(_before(cells, "one").select("category", "cell_id", F.col("before").alias("cell_idx")), ["category", "cell_id"])


def row_pointers(matrix: DataFrame) -> DataFrame:
    """CSR row ends: (category, cell_idx, indptr), indptr counting the entries of all rows up to this one."""
    rows = stored(matrix.groupBy("category", "cell_id").agg(F.count("*").alias("entries"), F.lit(1).cast("bigint").alias("one")), "matrix-rows")
    placed = _before(rows, "entries").withColumn("indptr", F.col("before") + F.col("entries")).drop("before")
    return _before(placed, "one").select("category", F.col("before").alias("cell_idx"), "indptr")


def summary(molecules: DataFrame, step: str) -> DataFrame:
    """RPT2-4: cells, reads, UMIs, means and saturation of each category at a step; null where there is nothing to divide by."""
    sums = molecules.groupBy("category").agg(F.count_distinct("cell_id").alias("cells"), F.sum("reads").alias("reads"), F.count("*").alias("umis"))
    cells, reads = F.nullif("cells", F.lit(0)), F.nullif("reads", F.lit(0))
    return sums.select(
        F.lit(step).alias("step"), "category", "cells", "umis", "reads",
        F.round(F.col("reads") / cells, 2).alias("reads_per_cell"),
        F.round(F.col("umis") / cells, 2).alias("umis_per_cell"),
        F.round(100.0 - 100.0 * F.col("umis") / reads, 2).alias("saturation"),
    )


def kept_ratios(raw: DataFrame, step: DataFrame) -> DataFrame:
    """RPT5: percentage of raw UMIs and cells that a later step keeps, from two summaries."""
    before = raw.select("category", F.col("umis").alias("raw_umis"), F.col("cells").alias("raw_cells"))
    both = before.join(step.select("category", "step", "umis", "cells"), "category")
    return both.select("category", "step", F.round(100.0 * F.col("umis") / F.col("raw_umis"), 2).alias("umis_kept"), F.round(100.0 * F.col("cells") / F.col("raw_cells"), 2).alias("cells_kept"))


def require_rows(molecules: DataFrame) -> DataFrame:
    """FLT7: raises for a table without molecules."""
    if molecules.isEmpty():
        raise ValueError("no molecules are left")
    return molecules
