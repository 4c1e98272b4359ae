"""Substring dedup by level-wise doubling of repeated word windows.

A window is ``length`` consecutive words (runs of bytes other than the six ASCII
white-space bytes). A word is removed if some window over it also starts in a
document with a smaller id; all is judged on the input.

Documents with equal word sequences are one for the search, under their smallest id:
all but that lose whatever windows cover. Level one takes windows of half the length,
picked by content so that any window of the full length holds at least one of those
picked (the least hash of every ``length/2 + 1`` in a row). Those that repeat in another
sequence alone are extended to twice the length, that is, to all full windows around
them; these decide what is removed. Full windows that repeat are doubled on: two that
follow each other and both repeat make one of twice the length, and those that repeat
again go on, until no candidates survive. The last level of each sequence is its
``longest_repeat``.

Windows are compared by two 64-bit hashes made from two unlike hashes of their words.
Ids are integers. Null text has no words; a null id is larger than all others, so it
proves nothing to them. Rows with the same id do not remove each other's words. An
empty table gives an empty one, texts of any length are taken whole, and other columns
may have any name. No step depends on the table's size: texts of candidates are found by
a bitmap filter of bounded size, and others are not shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .shared import possibly, release, stored

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
TEXT_KEY = F.xxhash64


def other_hashes(block: words.Block) -> np.ndarray:
    """A hash of each word's bytes by another rule than :func:`words.word_hashes`."""
    digest, data = xxhash.xxh64_intdigest, block.data.tobytes()
    return np.fromiter((digest(data[a:b], 5) for a, b in zip(block.starts.tolist(), block.ends.tolist())), np.uint64, len(block.starts))


def window_hashes(block: words.Block, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the windows of ``length`` words that begin at ``starts``."""
    hashed = (words.word_hashes(block), other_hashes(block))
    return tuple(words.mix(words.span_sums(h, starts, starts + length, base)) for h, base in zip(hashed, _BASES))


def anchors(block: words.Block, hashed: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of text, first word, hash) of the picked half-length windows of a block.

    Of every ``length - half + 1`` half windows in a row, the last one with the least hash is picked.
    """
    half = length // 2
    span = length - half + 1
    n = len(hashed) - half + 1
    if n < span:
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    h = words.mix(words.span_sums(hashed, np.arange(n), np.arange(n) + half, _BASES[0]))
    # least value of each run of ``span`` by doubling; ties go to the later place
    least, place, width = h.copy(), np.arange(n), 1
    while width < span:
        step = min(width, span - width)
        a, b = least[:-step], least[step:]
        later = b <= a
        place = np.where(later, place[step:], place[:-step])
        least = np.where(later, b, a)
        width += step
    start = np.arange(len(place))  # the full window that begins here
    doc = block.doc_of_word()
    inside = doc[start] == doc[np.minimum(start + length - 1, len(doc) - 1)]
    picked = np.unique(place[inside])
    return doc[picked], picked - block.bounds[doc[picked]], h[picked]


def documents_table(documents: DataFrame, length: int) -> DataFrame:
    """One row per document: doc_id, key (of the text as it is), n_words, sha (of its words), at and anchor (lists)."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, shas, places, marks, sizes = [], [], [], [], []
            for block in words.blocks(batch.column("text")):
                doc, place, h = anchors(block, words.word_hashes(block), length)
                data, starts, ends = words.joined(block)
                for a, b in zip(block.bounds[:-1], block.bounds[1:]):
                    shas.append(hashlib.sha256(data[starts[a] : ends[b - 1]] if b > a else b"").hexdigest())
                counts.append(block.counts())
                places.append(place)
                marks.append(h.view(np.int64))
                sizes.append(np.bincount(doc, minlength=block.n_docs))
            at = np.concatenate([[0], np.cumsum(np.concatenate([*sizes, np.zeros(0, np.int64)]))]).astype(np.int32)
            flat = [np.concatenate([*x, np.zeros(0, np.int64)]).astype(k) for x, k in ((places, np.int32), (marks, np.int64))]
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("key"), pa.array(np.concatenate([*counts, np.zeros(0, np.int64)]).astype(np.int64)), pa.array(shas, pa.string()), *(pa.ListArray.from_arrays(pa.array(at), pa.array(x)) for x in flat)],
                names=["doc_id", "key", "n_words", "sha", "at", "anchor"],
            )

    return documents.select("doc_id", TEXT_KEY("text").alias("key"), "text").mapInArrow(scan, f"doc_id {kind}, key long, n_words long, sha string, at array<int>, anchor array<long>")


LAST = 2**63 - 1


def _rank() -> Column:
    """The id as a number, with null last."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))


def windows(candidates: DataFrame, length: int) -> DataFrame:
    """(row_no, rank, start, h1, h2) of all windows of ``length`` words around the half windows at each candidate's places.

    ``candidates`` has row_no, rank, text and places.
    """
    reach = length - length // 2

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("places")
            for block in words.blocks(batch.column("text")):
                rows, starts = [], []
                for i, n in enumerate(block.counts()):
                    place = np.asarray(lists[block.first + i].values, np.int64)
                    wanted = np.zeros(n + 2, np.int64)
                    np.add.at(wanted, np.maximum(place - reach, 0), 1)
                    np.add.at(wanted, np.minimum(place, n) + 1, -1)
                    own = np.flatnonzero(np.cumsum(wanted)[: max(0, n - length + 1)] > 0)
                    starts.append(own + block.bounds[i])
                    rows.append(np.full(len(own), i))
                start, row = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (starts, rows))
                h1, h2 = window_hashes(block, start, length)
                take = pa.array(row + block.first)
                yield pa.record_batch(
                    [batch.column("row_no").take(take), batch.column("rank").take(take), pa.array((start - block.bounds[row]).astype(np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))],
                    names=["row_no", "rank", "start", "h1", "h2"],
                )

    return candidates.select("row_no", "rank", "text", "places").mapInArrow(make, "row_no long, rank long, start int, h1 long, h2 long")


def repeated(found: DataFrame) -> DataFrame:
    """The windows that stand in two sequences or more, with ``lost``: whether one has a smaller id.

    The repeats are written first: both sides of the join are then plain tables,
    and Spark can split a passage that very many documents share.
    """
    first = found.groupBy("h1", "h2").agg(F.min("rank").alias("first"), F.max("rank").alias("last")).where("first < last").drop("last")
    first = stored(first, "substr-first")
    out = stored(found.join(first, ["h1", "h2"]).select("row_no", "rank", "start", "h1", "h2", (F.col("first") < F.col("rank")).alias("lost")), "substr-repeated")
    release(first)
    release(found)
    return out


def doubled(found: DataFrame, length: int) -> DataFrame:
    """Windows of twice the ``length`` from pairs of repeated ones, the second of which begins where the first ends."""
    after = found.select("row_no", (F.col("start") - length).alias("start"), F.col("h1").alias("g1"), F.col("h2").alias("g2"))
    both = found.join(after, ["row_no", "start"])
    return both.select("row_no", "rank", "start", F.xxhash64("h1", "g1").alias("h1"), F.xxhash64(F.lit(1), "h2", "g2").alias("h2"))


def grown(found: DataFrame, length: int) -> DataFrame:
    """(row_no, longest): the last level at which a window of each candidate repeats."""
    reached, level = None, length
    while not found.isEmpty():
        rows = stored(found.select("row_no").distinct().withColumn("level", F.lit(level)), "substr-reached")
        reached = rows if reached is None else reached.union(rows)
        wider = stored(doubled(found, level), "substr-windows")
        if level > length:
            release(found)
        found, level = repeated(wider), 2 * level
    if reached is None:
        return found.select("row_no", F.lit(0).alias("longest"))
    return reached.groupBy("row_no").agg(F.max("level").alias("longest"))


def candidate_places(table: DataFrame) -> DataFrame:
    """(sha, places): the picked half windows that stand in more than one word sequence."""
    mark = F.xxhash64("sha")
    marks = table.select("sha", mark.alias("mark"), F.explode(F.arrays_zip("at", "anchor")).alias("z")).select("sha", "mark", F.col("z.at").alias("at"), F.col("z.anchor").alias("anchor"))
    shared = stored(marks.groupBy("anchor").agg(F.min("mark").alias("a"), F.max("mark").alias("b")).where("a < b").select("anchor"), "substr-anchors")
    return marks.join(shared, "anchor").groupBy("sha").agg(F.collect_set("at").alias("places"))


def search(documents: DataFrame, length: int = 50) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The table of documents, each word sequence's keeper, the candidates with texts, and the repeated windows.

    A sequence's text is found by its hash and its smallest id.
    """
    table = stored(documents_table(documents, length), "substr-documents")
    keepers = stored(table.groupBy("sha").agg(F.min(_rank()).alias("keeper")), "substr-keepers")
    known = table.join(keepers, "sha")
    own = known.where(_rank() == F.col("keeper")).where(F.size("anchor") > 0).groupBy("sha").agg(F.first("keeper").alias("rank"), F.min("key").alias("key"), F.first("at").alias("at"), F.first("anchor").alias("anchor"))
    own = stored(own, "substr-own")
    places = stored(candidate_places(own).join(own.select("sha", "rank", "key"), "sha"), "substr-places")
    wanted = stored(places.select(F.xxhash64("key", "rank").alias("both")), "substr-wanted")
    texts = documents.select(TEXT_KEY("text").alias("key"), _rank().alias("rank"), "text")
    texts = possibly(texts, F.xxhash64("key", "rank"), wanted).groupBy("key", "rank").agg(F.first("text").alias("text"))
    candidates = texts.join(places, ["key", "rank"]).select(F.monotonically_increasing_id().alias("row_no"), "rank", "sha", "text", "places")
    candidates = stored(candidates, "substr-candidates")
    found = repeated(stored(windows(candidates, length), "substr-windows"))
    release(own)
    return table.select("doc_id", "n_words", "sha"), keepers, candidates, found


def removed(documents: DataFrame, length: int = 50) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, longest_repeat."""
    table, keepers, candidates, found = search(documents, length)
    starts = found.where("lost").groupBy("row_no").agg(F.collect_set("start").alias("starts"))
    cut = candidates.select("row_no", "sha", "text").join(starts, "row_no").drop("row_no")

    def trim(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for sha, text, starts in zip(batch.sha, batch.text, batch.starts):
                own = (text or "").encode().split()
                covered = np.zeros(len(own) + 1, np.int64)
                at = np.asarray(starts, np.int64)
                np.add.at(covered, at, 1)
                np.add.at(covered, at + length, -1)
                gone = np.cumsum(covered[:-1]) > 0
                kept = [w for w, g in zip(own, gone) if not g]
                out.append((sha, int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield pd.DataFrame(out, columns=["sha", "lost", "left"])

    changed = stored(cut.mapInPandas(trim, "sha string, lost long, left string"), "substr-changed")
    longest = candidates.select("row_no", "sha").join(grown(found, length), "row_no").select("sha", F.col("longest").cast("long").alias("longest"))
    known = stored(keepers.join(changed, "sha", "left").join(longest, "sha", "left"), "substr-known")
    first = _rank() == F.col("keeper")
    whole = F.col("n_words") >= length
    return table.join(known, "sha").select(
        "doc_id",
        "n_words",
        F.when(first, F.coalesce("lost", F.lit(0))).when(whole, F.col("n_words")).otherwise(0).cast("long").alias("n_removed"),
        F.when(first, F.coalesce("left", "sha")).when(whole, F.sha2(F.lit(""), 256)).otherwise(F.col("sha")).alias("kept_sha256"),
        F.coalesce("longest", F.lit(0)).alias("longest_repeat"),
    )
