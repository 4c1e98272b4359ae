"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. ``run`` writes each stage's rows to the shared
folder before the next one reads them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweft.llm import decontaminate, exact_dedup, near_copies, packing, quality
from tagweft.llm.catalogue import VOCABULARY, table
from tagweft.llm.shared import private, release, stored


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier scores 0.5 or more."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    (score,) = private(docs, "score")
    return quality.scored(docs, model, column=score).where(F.col(score) >= 0.5).drop(score)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts, the first."""
    return exact_dedup.deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts at a five-word Jaccard similarity of 0.8 or more, the row with the smallest id, by SimHashes and vantage-point trees first."""
    return near_copies.deduplicated(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def harmonic_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows, packed into sequences."""
    return packing.packed(docs, VOCABULARY).drop("ids")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark_leaks),
    ("packing", harmonic_packing),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, before = stored(stage(spark, docs, sf_dir), name), docs
        if name != STAGES[0][0]:
            release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
