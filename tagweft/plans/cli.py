"""Command line: lists and FASTQ directories in, tables and a report out (OPT1, OPT2).

    python -m tagweft.plans.cli CELL_LISTS TYPE FEATURES FASTQ_DIRS OUTPUT [options]

TYPE is hashing, citeseq, adt (both in one sample), cmo or crispr. All paths may be
addresses of any file system that Spark reads.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chemistry, molecules, nearest
from ..operators.scaffold import anchored
from ..sinks import tables
from ..sources import fastq, lists
from . import run as plan


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("cell_lists", "feature_type", "features", "fastq_dirs", "output"):
        p.add_argument(name)
    p.add_argument("-p", type=int, dest="parts", help="parts that reads are dealt to; by default four a core")
    p.add_argument("--genome", default="")
    p.add_argument("--chemistry", default="auto")
    p.add_argument("--max-mismatch-feature", type=int, default=2)
    p.add_argument("--umi-correct-method", default="directional")
    p.add_argument("--umi-count-cutoff", type=int, default=0)
    p.add_argument("--read-ratio-cutoff", type=float, default=0.5)
    p.add_argument("--barcode-pos", type=int, default=-1)
    p.add_argument("--scaffold-sequence", default="")
    return p


def vote(spark: SparkSession, sample: DataFrame, names: list[str], cell_lists: str) -> str:
    """DEC4, DEC5: the chemistry whose list the first reads match."""
    every, length = None, 0
    for n in names:
        own = lists.cell_list(spark, f"{cell_lists}/{chemistry.LISTS[n]}")
        length = own.select(F.length("barcode")).first()[0]
        own = own.select(F.lit(n).alias("chem"), "barcode")
        every = own if every is None else every.union(own)
    votes = {r.chem: r.n_match for r in chemistry.votes(sample, every, length).collect()}
    return chemistry.decide({n: votes[n] for n in names})


def detect(spark: SparkSession, features: DataFrame, feature_length: int, args: argparse.Namespace) -> chemistry.Chemistry:
    """Chemistry, barcode lengths and feature position, from the first reads where the options leave them open."""
    if args.feature_type not in chemistry.FEATURE_TYPES:
        raise ValueError(f"unknown feature type {args.feature_type}")
    names = chemistry.candidates(args.chemistry)
    open_name = args.chemistry in chemistry.COMPOUND
    may_vote = any(chemistry.needs_position_vote(n, args.feature_type, args.barcode_pos) for n in names)
    sample = None
    if open_name or may_vote:
        sample = fastq.read_pairs(spark, args.fastq_dirs, chemistry.SAMPLE).select("read1", "read2").persist()
    name = vote(spark, sample, names, args.cell_lists) if open_name else names[0]
    counts = (0, 0)
    if chemistry.needs_position_vote(name, args.feature_type, args.barcode_pos):
        v = chemistry.position_votes(sample, features, feature_length, args.max_mismatch_feature).first()
        counts = (v.n_pos0, v.n_pos10)
    if sample is not None:
        sample.unpersist()
    return chemistry.resolved(name, args.feature_type, args.barcode_pos, args.scaffold_sequence, *counts)


def main(argv: list[str] | None = None) -> None:
    """Flags that are not known are passed over."""
    args, _ = parser().parse_known_args(argv)
    if not 0 <= args.read_ratio_cutoff < 1:
        raise SystemExit("--read-ratio-cutoff must lie in [0, 1)")
    spark = SparkSession.builder.appName("tagweft").getOrCreate()
    clock = plan.Clock(tell=True)
    with clock.phase("lists and detection"):
        features = lists.feature_list(spark, args.features, args.feature_type)
        length = features.select(F.length("barcode")).first()[0]
        found = detect(spark, features, length, args)
        cells = lists.cell_list(spark, f"{args.cell_lists}/{chemistry.LISTS[found.name]}")
        cell_length = cells.select(F.length("barcode")).first()[0]
    layout = molecules.Layout(cell_length, found.umi_length, length, max(found.feature_start, 0), found.cell_mismatch, args.max_mismatch_feature)
    options = plan.Options(args.umi_correct_method, args.umi_count_cutoff, args.read_ratio_cutoff, args.genome)
    reads = fastq.read_pairs(spark, args.fastq_dirs).select("read1", "read2")
    reads = reads.repartition(args.parts or spark.sparkContext.defaultParallelism * 4)
    feature = None
    if args.feature_type == "crispr" and args.scaffold_sequence:
        reads, feature = anchored(reads, args.scaffold_sequence, length, args.max_mismatch_feature), F.col("feature_barcode")
    result = plan.run(reads, cells, features, layout, options, feature, clock)
    with clock.phase("writing"):
        tables.write_molecules(result.molecules, f"{args.output}/molecules")
        for step in ("raw", "umi_correct", "chimeric_filtered"):
            tables.write_matrix(result.molecules.where(F.col("step") == step), cells, features, f"{args.output}/matrix.{step}", args.genome)
        facts = [
            ("Features", nearest.list_facts(features, length, args.max_mismatch_feature)),
            ("Cells", nearest.list_facts(cells, cell_length, found.cell_mismatch)),
        ]
        known = [line for name, frame in facts for line in tables.list_text(name, frame.first().asDict())]
    rows = lambda frame: [r.asDict() for r in frame.orderBy("category").collect()]
    text = tables.report_text(result.counters.first().asDict(), rows(result.summaries), rows(result.kept), known, clock.seconds)
    spark.createDataFrame([(text.rstrip("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(f"{args.output}/report")


if __name__ == "__main__":
    main()
