"""Reads derived from the shared ``lineitem`` table, where no FASTQ files are at hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

N_CELLS, N_FEATURES, N_UMIS = 32, 8, 40
CELL, UMI, FEATURE = 16, 12, 15
SCAFFOLD = "GTTTAAGAGCTAAGCTGGAA"


def dna(text: Column) -> Column:
    """32 bases from a text's MD5."""
    return F.translate(F.md5(text), "0123456789abcdef", "ACGTACGTACGTACGT")


def _tag(prefix: str, number: Column, length: int) -> Column:
    return F.substring(dna(F.concat(F.lit(prefix), number.cast("string"))), 1, length)


def _numbered_tag(prefix: str, number: Column, count: int, length: int) -> Column:
    """The tag of ``number % count``: looked up, as those from 0 on are made once, when the query is planned."""
    number = number % count
    known = F.array(*(_tag(prefix, F.lit(i), length) for i in range(count)))
    return F.coalesce(F.get(known, number.cast("int")), _tag(prefix, number, length))


def _put(text: Column, place: Column, base: Column) -> Column:
    return F.concat(F.substring(text, F.lit(1), place - 1), base, F.substring(text, place + 1, F.length(text)))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_key, line_no, read1, read2): cell barcode and UMI, and feature barcode, with planted errors."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    k, line = F.col("l_orderkey"), F.col("l_linenumber")
    # The table can be one row group, and so one task; the tags are columns first, so that each is looked up once.
    tags = rows.repartition(spark.sparkContext.defaultParallelism).select(
        k.alias("read_key"),
        line.alias("line_no"),
        F.substring(F.lit("ACGTN"), (k % 5 + 1).cast("int"), F.lit(1)).alias("base"),
        _numbered_tag("cell", F.col("l_suppkey"), N_CELLS, CELL).alias("cell"),
        _numbered_tag("umi", k * 7 + line, N_UMIS, UMI).alias("umi"),
        _numbered_tag("feat", F.col("l_partkey"), N_FEATURES, FEATURE).alias("feature"),
    )
    k, line = F.col("read_key"), F.col("line_no")

    def spoiled(name: str, every: int, shift: int) -> Column:
        return F.when(k % every == 0, _put(F.col(name), line + shift, F.col("base"))).otherwise(F.col(name))

    return tags.select("read_key", "line_no", F.concat(spoiled("cell", 7, 1), spoiled("umi", 3, 2)).alias("read1"), spoiled("feature", 6, 3).alias("read2"))


def cells(spark: SparkSession) -> DataFrame:
    """(id, barcode, name)."""
    ids = spark.range(N_CELLS).select(F.col("id").cast("int").alias("id"))
    return ids.select("id", _tag("cell", F.col("id"), CELL).alias("barcode"), F.concat(F.lit("name"), F.col("id").cast("string")).alias("name"))


def features(spark: SparkSession) -> DataFrame:
    """(id, barcode, name, category), with two categories."""
    ids = spark.range(N_FEATURES).select(F.col("id").cast("int").alias("id"))
    return ids.select("id", _tag("feat", F.col("id"), FEATURE).alias("barcode"), F.concat(F.lit("tag"), F.col("id").cast("string")).alias("name"), F.when(F.col("id") % 2 == 0, "hash").otherwise("guide").alias("category"))


def scaffold_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_key, line_no, read2): ten bases, the feature barcode, and a scaffold: whole, short of a base, with one more, or with one wrong."""
    scaffold = F.lit(SCAFFOLD)
    k, line = F.col("read_key"), F.col("line_no").cast("int")
    shape = (
        F.when(k % 4 == 0, scaffold)
        .when(k % 4 == 1, F.concat(F.substring(scaffold, F.lit(1), line + 2), F.substring(scaffold, line + 4, F.lit(20))))
        .when(k % 4 == 2, F.concat(F.substring(scaffold, F.lit(1), line + 2), F.lit("C"), F.substring(scaffold, line + 3, F.lit(20))))
        .otherwise(_put(scaffold, line + 3, F.lit("T")))
    )
    prefix = F.substring(dna(F.concat(F.lit("pre"), (k % 64).cast("string"))), 1, 10)
    return reads(spark, sf_dir).select("read_key", "line_no", F.concat(prefix, "read2", shape).alias("read2"))
