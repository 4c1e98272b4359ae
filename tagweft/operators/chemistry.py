"""Chemistry and position detection (DEC1-11, JN4, LIM1, TOP1, AGG16)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 10_000

# Names, the barcode lists they stand for, and the compound names.
LISTS = {
    "10x_v2": "737K-august-2016.txt.gz", "SC3Pv2": "737K-august-2016.txt.gz", "SC5Pv2": "737K-august-2016.txt.gz",
    "SC3Pv3:Poly-A": "3M-february-2018_TRU.txt.gz", "SC3Pv3:CS1": "3M-february-2018_NXT.txt.gz",
    "SC3Pv4:Poly-A": "3M-3pgex-may-2023_TRU.txt.gz", "SC3Pv4:CS1": "3M-3pgex-may-2023_NXT.txt.gz",
    "SC5Pv3": "3M-5pgex-jan-2023.txt.gz", "multiome": "737K-arc-v1.txt.gz",
}
COMPOUND = {
    "auto": ["10x_v2", "SC3Pv3:Poly-A", "SC3Pv3:CS1", "SC3Pv4:Poly-A", "SC3Pv4:CS1", "SC5Pv3", "multiome"],
    "threeprime": ["10x_v2", "SC3Pv3:Poly-A", "SC3Pv3:CS1", "SC3Pv4:Poly-A", "SC3Pv4:CS1"],
    "fiveprime": ["10x_v2", "SC5Pv3"],
    "SC3Pv3": ["SC3Pv3:Poly-A", "SC3Pv3:CS1"],
    "SC3Pv4": ["SC3Pv4:Poly-A", "SC3Pv4:CS1"],
}
V2 = frozenset({"10x_v2", "SC3Pv2", "SC5Pv2"})
FEATURE_TYPES = ("hashing", "citeseq", "adt", "cmo", "crispr")
ANTIBODY = frozenset({"hashing", "citeseq", "adt"})


@dataclass(frozen=True)
class Chemistry:
    """What detection decides."""

    name: str
    umi_length: int
    cell_mismatch: int
    totalseq: str = ""
    feature_start: int = 0


def candidates(name: str) -> list[str]:
    """DEC1, DEC3."""
    if name in COMPOUND:
        return COMPOUND[name]
    if name not in LISTS or name == "10x_v2":
        raise ValueError(f"unknown chemistry {name}")
    return [name]


def lengths(name: str) -> tuple[int, int]:
    """DEC6, DEC7: UMI length and allowed cell mismatches."""
    return (10 if name in V2 else 12), (1 if name in V2 or name == "multiome" else 0)


def first_reads(reads: DataFrame, n: int = SAMPLE) -> DataFrame:
    """LIM1: the first ``n`` reads in file, then record order (file_id, ordinal)."""
    return reads.orderBy("file_id", "ordinal").limit(n)


def votes(sample: DataFrame, lists: DataFrame, length: int) -> DataFrame:
    """JN4, TOP1: (chem, n_match, rank): reads whose first ``length`` bases stand in each list (chem, barcode)."""
    keys = sample.select(F.substring("read1", 1, length).alias("barcode")).groupBy("barcode").agg(F.count("*").alias("reads"))
    every = lists.select("chem", "barcode").distinct()
    hits = keys.join(every, "barcode").groupBy("chem").agg(F.sum("reads").alias("n_match"))
    all_ = every.select("chem").distinct().join(hits, "chem", "left").select("chem", F.coalesce("n_match", F.lit(0)).cast("bigint").alias("n_match"))
    return all_.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n_match"), "chem")).cast("bigint"))


def decide(counts: dict[str, int], sample: int = SAMPLE) -> str:
    """DEC5: the chemistry that the votes name; shares are of ``sample`` reads even if there were fewer."""
    order = sorted((name for name, n in counts.items() if n > 0), key=lambda name: -counts[name])
    if not order:
        raise ValueError("no chemistry matches the reads")
    if len(order) > 1:
        most, second = counts[order[0]], counts[order[1]]
        if most / sample < 0.05 or (most - second) / sample < 0.1:
            raise ValueError(f"cannot tell the chemistry from {counts}")
    return order[0]


def position_votes(sample: DataFrame, features: DataFrame, length: int, max_mismatch: int, positions: tuple[int, ...] = (0, 10)) -> DataFrame:
    """DEC8: one row, n_pos<p>: reads whose feature barcode matches at each position of read2."""
    from . import nearest

    spots = sample.select(F.explode(F.array(*[F.struct(F.lit(p).alias("at"), F.when(F.length("read2") >= p + length, F.substring("read2", p + 1, length)).alias("barcode")) for p in positions])).alias("x")).select("x.*")
    counts = spots.where("barcode IS NOT NULL").groupBy("at", "barcode").agg(F.count("*").alias("n"))
    hit = counts.join(nearest.match(counts.select("barcode"), features, length, max_mismatch), "barcode")
    return hit.agg(*[F.coalesce(F.sum(F.when(F.col("at") == p, F.col("n"))), F.lit(0)).cast("bigint").alias(f"n_pos{p}") for p in positions])


def needs_position_vote(name: str, feature_type: str, given: int) -> bool:
    """DEC8: whether reads must tell the type of antibody tags; a given position leaves it open."""
    return feature_type in ANTIBODY and ":" not in name and name != "SC5Pv3" and given < 0


def totalseq(name: str, n_pos0: int = 0, n_pos10: int = 0) -> str:
    """DEC8: A, B or C."""
    if ":" in name:
        return "A" if name.endswith(":Poly-A") else "B"
    if name == "SC5Pv3":
        return "C"
    if n_pos0 < 10 and n_pos10 < 10:
        raise ValueError("too few feature barcodes at either position")
    return "A" if n_pos0 > n_pos10 else "C"


def settled(name: str, kind: str) -> str:
    """The kit that the shared version-2 list stands for, by the type of its feature tags."""
    return ("SC3Pv2" if kind == "A" else "SC5Pv2") if name == "10x_v2" else name


def feature_position(feature_type: str, kind: str = "", given: int = -1, scaffold: str = "") -> int:
    """DEC9, DEC10. An antibody's type decides even where a position was given."""
    if feature_type in ANTIBODY:
        return 0 if kind == "A" else 10
    if feature_type == "cmo":
        return 0
    if feature_type == "crispr":
        return given if given >= 0 else (0 if not scaffold else -1)
    raise ValueError(f"unknown feature type {feature_type}")


def resolved(name: str, feature_type: str, given: int = -1, scaffold: str = "", n_pos0: int = 0, n_pos10: int = 0) -> Chemistry:
    """DEC6-10 for a chemistry that is named, or that :func:`decide` has found.

    The two counts are those of :func:`position_votes`, and count only where
    :func:`needs_position_vote` asks for them.
    """
    umi_length, cell_mismatch = lengths(name)
    kind = ""
    if needs_position_vote(name, feature_type, given) or (feature_type in ANTIBODY and (":" in name or name == "SC5Pv3")):
        kind = totalseq(name, n_pos0, n_pos10)
    at = feature_position(feature_type, kind, given, scaffold)
    return Chemistry(settled(name, kind) if kind else name, umi_length, cell_mismatch, kind, at)
