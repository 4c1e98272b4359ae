"""Barcode and feature lists (SRC5-8, SCL10, SRT3, JN3, JN7, RPT7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dna import trim_space


def parse_lines(lines: DataFrame) -> DataFrame:
    """(ordinal, barcode, name) of the non-blank lines of (line_no, line).

    A byte order mark on the first line goes. A line splits at its first comma or
    tab; without one, the name is the barcode. There is no header.
    """
    line = F.when(F.col("line_no") == 0, F.regexp_replace("line", "^(\\uFEFF|\\uFFFD\\uFFFD)", "")).otherwise(F.col("line"))
    split = F.split(line, "[,\t]", 2)
    barcode = trim_space(F.get(split, F.lit(0)))
    name = F.when(F.size(split) > 1, trim_space(F.get(split, F.lit(1)))).otherwise(barcode)
    rows = lines.where(trim_space(F.col("line")) != "").select("line_no", barcode.alias("barcode"), name.alias("name"))
    order = Window.orderBy("line_no")
    return rows.select((F.row_number().over(order) - 1).cast("int").alias("ordinal"), "barcode", "name")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of a text file, gzip or not; a list is small enough for one task, which keeps its order."""
    rows = spark.read.text(path).coalesce(1)
    return rows.select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))


def checked(listed: DataFrame) -> DataFrame:
    """Raises unless all barcodes have one length and none is listed twice."""
    facts = listed.agg(F.min(F.length("barcode")), F.max(F.length("barcode")), F.count("*"), F.count_distinct("barcode")).first()
    if facts[0] != facts[1]:
        raise ValueError("barcodes differ in length")
    if facts[2] != facts[3]:
        raise ValueError("a barcode is listed more than once")
    return listed


def cell_list(spark: SparkSession, path: str) -> DataFrame:
    """(id, barcode, name): barcodes match by the first column and are reported by the second."""
    return checked(parse_lines(read_lines(spark, path))).withColumnRenamed("ordinal", "id")


def with_categories(listed: DataFrame, default: str) -> DataFrame:
    """(id, barcode, name, category): categories follow the first comma of a name, untrimmed.

    The first row decides whether there are any; then every row must have one. Ids
    follow the category, and the list within it.
    """
    first = listed.orderBy("ordinal").select("name").first()
    if first is not None and "," in first.name:
        split = F.split("name", ",", 2)
        lacking = F.raise_error(F.concat(F.lit("no category: "), F.col("name"))).cast("string")
        listed = listed.select("ordinal", "barcode", F.get(split, F.lit(0)).alias("name"), F.coalesce(F.get(split, F.lit(1)), lacking).alias("category"))
    else:
        listed = listed.withColumn("category", F.lit(default))
    return renumbered(listed)


def renumbered(listed: DataFrame) -> DataFrame:
    """SRT3, JN7: ids by category, then list order."""
    order = Window.orderBy("category", "ordinal")
    return listed.select((F.row_number().over(order) - 1).cast("int").alias("id"), "barcode", "name", "category")


def feature_list(spark: SparkSession, path: str, default_category: str) -> DataFrame:
    return with_categories(checked(parse_lines(read_lines(spark, path))), default_category)
