"""Lines as Arrow arrays, and the lines of a BGZF file by as many tasks as it has splits."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks.fastq import BLOCK_HEAD
from ..storage import ship

#: Bytes of text that make one Arrow batch of lines.
TEXT = 1 << 20


def line_array(text: bytes) -> pa.Array:
    """The lines of a text, without their ends; the last one may lack its end."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10)
    if text and not text.endswith(b"\n"):
        ends = np.append(ends, len(text))
    # lines and their ends take turns; every other one is taken
    bounds = np.zeros(2 * len(ends) + 1, np.int32)
    bounds[1::2], bounds[2::2] = ends, np.minimum(ends + 1, len(text))
    both = pa.StringArray.from_buffers(2 * len(ends), pa.py_buffer(bounds), pa.py_buffer(text))
    return both.take(pa.array(np.arange(0, 2 * len(ends), 2)))


def inflated(tail: bytes) -> bytes:
    """The text of a BGZF block, given without its fixed head."""
    if len(tail) < 12 or int.from_bytes(tail[:2], "little") + 1 != len(tail) + len(BLOCK_HEAD):
        raise ValueError("not a BGZF block")
    text = zlib.decompress(tail[2:-8], -15)
    if tail[-8:] != zlib.crc32(text).to_bytes(4, "little") + len(text).to_bytes(4, "little"):
        raise ValueError("a BGZF block is damaged")
    return text


def _texts(arrived: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[bytes]]]:
    """(start, texts of its blocks) of each split of a task."""
    rows = ((start, tail.as_py()) for batch in arrived for start, tail in zip(batch.column(0).to_pylist(), batch.column(1)))
    for start, own in groupby(rows, lambda r: r[0]):
        # what precedes the first head of the file is empty
        yield start, (inflated(tail) for n, (_, tail) in enumerate(own) if tail or n or start)


def _ends(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(start, number of line ends, text up to the first one, text after the last one) of each split; without any, all is in the first text."""
    for start, texts in _texts(arrived):
        n, head, tail = 0, [], []
        for text in texts:
            own = text.count(b"\n")
            if not n:
                head.append(text[: text.find(b"\n") + 1] if own else text)
            if own:
                tail = []
            if n or own:
                tail.append(text[text.rfind(b"\n") + 1 :])
            n += own
        yield pa.record_batch([pa.array([start]), pa.array([n]), pa.array([b"".join(head)], pa.binary()), pa.array([b"".join(tail)], pa.binary())], names=["start", "n", "head", "tail"])


def placed(splits: list[tuple[int, int, bytes, bytes]]) -> dict[int, tuple[int, bool, bytes]]:
    """start: (line ends before the split, whether a line is open there, what its own last line goes on with), of :func:`_ends`' rows in order."""
    places, before, still = {}, 0, False
    for start, n, head, tail in splits:
        places[start] = (before, still)
        before, still = before + n, bool(tail) if n else still or bool(head)
    following: bytes = b""
    for start, n, head, _ in reversed(splits):
        places[start] += (following,)
        following = head if n else head + following
    return places


def bgzf_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of a BGZF file; lines end with a line feed, as in FASTQ.

    Spark's text reader splits the file at the blocks' fixed heads, so its name must not
    end in ``.gz``: such a file goes to one task, as any gzip. A first pass counts the
    line ends of each split, a second one numbers the lines: each is given by the split
    in which it starts.
    """
    ship(spark)
    raw = spark.read.option("lineSep", BLOCK_HEAD.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    raw = raw.select(F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("tail"))
    splits = raw.mapInArrow(_ends, "start long, n long, head binary, tail binary").collect()  # a row a split
    places = placed(sorted((r.start, r.n, bytes(r.head), bytes(r.tail)) for r in splits))

    def numbered(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for start, texts in _texts(arrived):
            number, skip, following = places[start]
            held: list[bytes] = []

            def lines(text: bytes) -> Iterator[pa.RecordBatch]:
                nonlocal number, skip
                if skip:
                    cut = text.find(b"\n") + 1
                    if not cut:
                        return
                    text, skip, number = text[cut:], False, number + 1
                if text:
                    found = line_array(text)
                    yield pa.record_batch([pa.array(np.arange(number, number + len(found))), found], names=["line_no", "line"])
                    number += len(found)

            size = 0
            for text in texts:
                held.append(text)
                size += len(text)
                if size >= TEXT and b"\n" in text:
                    whole = b"".join(held)
                    cut = whole.rfind(b"\n") + 1
                    yield from lines(whole[:cut])
                    held, size = [whole[cut:]], len(whole) - cut
            rest = b"".join(held)
            open_end = not rest.endswith(b"\n") and bool(rest) and not (skip and b"\n" not in rest)
            yield from lines(rest + following if open_end else rest)

    return raw.mapInArrow(numbered, "line_no long, line string")
