"""The whole run: reads and lists in, molecules of each step, matrices and a report out."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import chimera, matrix, molecules, umi
from ..storage import stored


@dataclass(frozen=True)
class Options:
    """OPT2."""

    umi_method: str = "directional"
    count_cutoff: int = 0
    read_ratio: float = 0.5
    genome: str = ""
    crispr: frozenset[str] = field(default_factory=lambda: frozenset({"crispr"}))


@dataclass
class Result:
    """``kept`` has the shares of raw UMIs and cells that each later step keeps (RPT5); ``seconds`` those of each phase (SNK9)."""

    counters: DataFrame
    molecules: DataFrame  # step, category, cell_id, feature_id, umi, reads
    summaries: DataFrame
    kept: DataFrame
    seconds: dict[str, float] = field(default_factory=dict)


class Clock:
    """SNK9: seconds of named phases, each told when it ends."""

    def __init__(self, tell: bool = False):
        self.seconds: dict[str, float] = {}
        self.tell = tell

    @contextmanager
    def phase(self, name: str) -> Iterator[None]:
        began = time.monotonic()
        yield
        self.seconds[name] = self.seconds.get(name, 0.0) + time.monotonic() - began
        if self.tell:
            print(f"{name}: {self.seconds[name]:.2f} s", flush=True)


def run(reads: DataFrame, cells: DataFrame, features: DataFrame, layout: molecules.Layout, options: Options = Options(), feature: Column | None = None, clock: Clock | None = None) -> Result:
    """All steps over ``reads`` (read1, read2). Each step's table is stored once and read by all that follows."""
    clock = clock or Clock()
    with clock.phase("reads to molecules"):
        parts = molecules.pieces(reads, layout, feature)
        assigned = stored(molecules.assigned(parts, cells, features, layout), "assigned")
        length = molecules.shortest_umi(assigned, layout)
        raw = stored(molecules.molecules(assigned, layout, length), "molecules")
        matrix.require_rows(raw)
    with clock.phase("UMI correction"):
        corrected = stored(umi.correct(raw, options.umi_method), "corrected")
    steps = [("raw", raw), ("umi_correct", corrected)]
    with clock.phase("chimeric filter"):
        crispr = corrected.where(F.col("category").isin(*options.crispr))
        steps.append(("chimeric_filtered", stored(chimera.chimeric_filter(crispr, options.count_cutoff, options.read_ratio), "chimeric-filtered")))
    table, summaries, kept = None, None, None
    first = stored(matrix.summary(raw, "raw"), "summary")
    for name, step in steps:
        rows = step.select(F.lit(name).alias("step"), "category", "cell_id", "feature_id", "umi", "reads")
        table = rows if table is None else table.union(rows)
        summary = first if name == "raw" else stored(matrix.summary(step, name), "summary")
        summaries = summary if summaries is None else summaries.union(summary)
        if name != "raw":
            share = matrix.kept_ratios(first, summary)
            kept = share if kept is None else kept.union(share)
    return Result(molecules.counters(assigned, layout, length), table, summaries, kept, clock.seconds)
