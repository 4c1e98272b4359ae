"""Molecules from reads as they arrive, with Structured Streaming.

Reads match the lists as in a batch run: a stream cannot be matched key by key, so the
strings around each barcode are made once, as a static table that reads join. Counts
(AGG1) are kept up to date by a stateful aggregation. UMI correction is not part of the
stream, as a late read can change a neighbour's count and so an edge; ``on_batch`` gets
the changed counts, and can correct their groups from all counts so far.

Without an event time, state grows with the molecules of the run. With one, counts are
those of windows of time, and the watermark drops windows that are over, with their
state; reads that come later than ``delay`` are lost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import molecules as m
from ..operators import nearest


def molecule_stream(reads: DataFrame, cells: DataFrame, features: DataFrame, layout: m.Layout, event_time: str | None = None, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Running counts (category, cell_id, feature_id, umi, reads) of a stream of (read1, read2), and of each ``window`` of ``event_time``."""
    timed = [] if event_time is None else [F.col(event_time).alias("at")]
    parts = m.pieces(reads, layout) if event_time is None else m.pieces(reads.withWatermark(event_time, delay), layout, None, timed)
    c = nearest.index(cells, layout.cell_length, layout.cell_mismatch).select("key", F.col("id").alias("cell_id"))
    f = nearest.index(features, layout.feature_length, layout.feature_mismatch).join(features.select("id", "category"), "id")
    f = f.select("key", F.col("id").alias("feature_id"), "category")
    found = parts.join(c, F.upper("cell_barcode") == c["key"]).drop("key").join(f, F.upper("feature_barcode") == f["key"]).drop("key")
    found = found.withColumn("n", F.lit(1).cast("bigint"))
    return m.molecules(found, layout, None, [] if event_time is None else [F.window("at", window).alias("window")])


def start(stream: DataFrame, checkpoint: str, on_batch: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Give each micro-batch's changed counts to ``on_batch``; they replace earlier ones of the same molecule."""
    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(on_batch).start()
