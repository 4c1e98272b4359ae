"""Molecule tables, matrices and reports on disk (SNK1-5)."""

from __future__ import annotations

import gzip

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dna import type_label
from ..operators.matrix import counts, dense
from ..storage import stored


def write_molecules(molecules: DataFrame, path: str) -> None:
    """SNK2: Parquet by step and category."""
    molecules.write.mode("overwrite").partitionBy("step", "category").option("compression", "zstd").parquet(path)


def write_matrix(molecules: DataFrame, cells: DataFrame, features: DataFrame, path: str, genome: str = "") -> None:
    """SNK1 in long form: entries, barcodes in row order, and features with their labels; an empty genome is allowed."""
    matrix = stored(dense(counts(molecules)), "matrix")
    matrix.select("category", "cell_idx", "feature_id", "n").write.mode("overwrite").partitionBy("category").option("compression", "zstd").parquet(f"{path}/entries")
    matrix.select("category", "cell_idx", "cell_id").distinct().join(cells.select(F.col("id").alias("cell_id"), "name"), "cell_id").select("category", "cell_idx", "name").write.mode("overwrite").partitionBy("category").parquet(f"{path}/barcodes")
    features.select("id", "barcode", "name", "category", type_label(F.col("category")).alias("feature_type"), F.lit(genome).alias("genome")).coalesce(1).write.mode("overwrite").parquet(f"{path}/features")


def write_market(molecules: DataFrame, cells: DataFrame, features: DataFrame, folder: str) -> list[str]:
    """MatrixMarket folders of each category (SRT5: entries in row order): barcodes, features and, in parts, the matrix.

    The matrix is stored once. Sorted parts are written by tasks, as ``matrix.mtx/part-*.gz``,
    and a header before them, as a gzip file whose name sorts first: put end to end in
    the order of their names they are one MatrixMarket file.
    """
    spark = molecules.sparkSession
    out = []
    place = features.groupBy("category").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # a feature list is a small table
    place = place.select("category", F.posexplode("ids").alias("at", "feature_id"))
    matrix = stored(dense(counts(molecules)).join(F.broadcast(place), ["category", "feature_id"]), "market")
    sizes = {r.category: r for r in matrix.groupBy("category").agg(F.count("*").alias("entries"), F.count_distinct("cell_idx").alias("cells")).collect()}
    for category, own in sorted(features.groupBy("category").count().collect()):
        at = f"{folder}/{category}"
        here = matrix.where(F.col("category") == category)
        size = sizes.get(category)
        rows = here.select("cell_idx", "cell_id").distinct().join(cells.select(F.col("id").alias("cell_id"), "name"), "cell_id")
        _lines(rows.orderBy("cell_idx").select("name"), f"{at}/barcodes.tsv")
        listed = features.where(F.col("category") == category).orderBy("id")
        _lines(listed.select(F.concat_ws("\t", "barcode", "name", "category")), f"{at}/features.tsv")
        head = f"%%MatrixMarket matrix coordinate integer general\n{own} {size.cells if size else 0} {size.entries if size else 0}\n"
        entry = F.concat_ws(" ", F.col("at") + 1, F.col("cell_idx") + 1, "n")
        _lines(here.orderBy("cell_idx", "feature_id").select(entry), f"{at}/matrix.mtx")
        put_bytes(spark, f"{at}/matrix.mtx/header.txt.gz", gzip.compress(head.encode(), mtime=0))
        out.append(at)
    return out


def _lines(text: DataFrame, path: str) -> None:
    """One column as gzip text, in parts that are in order."""
    text.toDF("value").write.mode("overwrite").option("compression", "gzip").text(path)


def put_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file, through Hadoop's file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where)
    out.write(data)
    out.close()


def list_text(name: str, facts: dict) -> list[str]:
    """RPT7: a barcode list in one line."""
    share = "" if facts["ambiguous_share"] is None else f" ({facts['ambiguous_share']:.2f}%)"
    return [f"{name}: {facts['barcodes']} barcodes of {facts['length']} bases; {facts['n_ambiguous']} of {facts['n_keys']} index keys are ambiguous{share}"]


def report_text(header: dict[str, float], sections: list[dict], kept: list[dict] = (), lists: list[str] = (), seconds: dict[str, float] | None = None) -> str:
    """RPT1-7: lists, counters, and then a section per category and step with what the step keeps, in text."""
    total = header["n_reads"]
    lines = [*lists, f"Number of reads: {total}"]
    for name, label in (("n_valid_cell", "valid cell barcodes"), ("n_valid_feature", "valid feature barcodes"), ("n_valid", "valid cell and feature barcodes"), ("n_valid_umi", "valid barcodes and UMI")):
        share = f" ({100 * header[name] / total:.2f}%)" if total else ""
        lines.append(f"Reads with {label}: {header[name]}{share}")
    shares = {(k["category"], k["step"]): k for k in kept}
    for s in sections:
        lines += ["", f"[{s['category']}] {s['step']}"]
        s = s | {k: v for k, v in shares.get((s["category"], s["step"]), {}).items()}
        lines += [f"{k}: {v:.2f}" if isinstance(v, float) else f"{k}: {v}" for k, v in s.items() if k not in ("category", "step") and v is not None]
    if seconds:
        lines += ["", *(f"seconds of {name}: {spent:.2f}" for name, spent in seconds.items())]
    return "\n".join(lines) + "\n"
