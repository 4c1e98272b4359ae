"""Quality classifier: hashed word n-grams, logistic regression, FTRL-proximal updates.

A text's features are hashes of its words, of its word pairs, and of the same two
with each word replaced by its outline (kinds of its first two characters and its
last, and its length class); a word that repeats its predecessor hashes to one
shared pair. A value is a feature's count over the square root of all counts.

Only training is bounded (``Settings.sample_rows``); every row is scored whole, of any
length. Null and empty texts have no features and get the bias alone. Rows are scored
one by one, so repeated rows and repeated ids score alike; training takes one text of an
id, the least, and none of a null id. Ids are of any type. Other columns of the input
pass through :func:`scored` untouched; an empty table gives an empty one, and training
on nothing gives scores of one half.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words


@dataclass(frozen=True)
class Settings:
    """``sample_rows`` bounds the labelled rows that training sees, and so its memory."""

    bits: int = 20
    sample_rows: int = 6000
    epochs: int = 3
    alpha: float = 0.15
    beta: float = 1.0
    l1: float = 0.3
    l2: float = 1.0
    seed: int = 7


#: Kinds of bytes in an outline: lower case or part of a longer character, upper case, digit, or the byte itself.
_KIND = np.arange(256, dtype=np.uint64)
_KIND[97:123] = _KIND[128:] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3


def features(block: words.Block, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature indexes of all texts of a block, end to end, and where each text's begin."""
    whole = words.word_hashes(block)
    size = block.ends - block.starts
    second = np.minimum(block.starts + 1, block.ends - 1)
    outline = _KIND[block.data[block.starts]] << np.uint64(32)
    outline |= _KIND[block.data[second]] << np.uint64(24)
    outline |= _KIND[block.data[block.ends - 1]] << np.uint64(16)
    outline |= np.minimum(np.log2(np.maximum(size, 1)).astype(np.uint64), np.uint64(8))
    outline = words.mix(outline + np.uint64(0xABCD) * np.uint64(1 << 40))
    n, counts = len(whole), block.counts()
    out = np.zeros(4 * n, np.uint64)
    head = np.zeros(n, bool)  # a text's first word pairs with nothing
    head[block.bounds[:-1][counts > 0]] = True
    for k, h in enumerate((whole, outline)):
        pair = np.full(n, np.uint64(k + 1))
        pair[1:] = np.where(whole[1:] == whole[:-1], np.uint64(99 + k), h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
        pair[head] = h[head] + np.uint64(5)
        out[2 * k :: 4] = words.mix(h + np.uint64(k))
        out[2 * k + 1 :: 4] = words.mix(pair + np.uint64(17 + k))
    return (out >> np.uint64(64 - bits)).astype(np.int32), 4 * block.bounds


def _sparse(column: pa.Array, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each text's distinct indexes and their values."""
    for block in words.blocks(column):
        index, at = features(block, bits)
        for a, b in zip(at[:-1], at[1:]):
            own, n = np.unique(index[a:b], return_counts=True)
            yield own, (n / np.sqrt(max(b - a, 1))).astype(np.float32)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], settings: Settings) -> tuple[np.ndarray, float]:
    """Weights and bias after ``epochs`` passes of per-coordinate FTRL-proximal updates."""
    s = settings
    z, n = np.zeros(1 << s.bits), np.zeros(1 << s.bits)
    bias = rate = 0.0
    random = np.random.default_rng(s.seed)
    share = np.mean([y for _, _, y in rows]) if rows else 0.5
    bias = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    for _ in range(s.epochs):
        for i in random.permutation(len(rows)):
            index, value, y = rows[i]
            zi, ni = z[index], n[index]
            w = np.where(np.abs(zi) <= s.l1, 0.0, -(zi - np.sign(zi) * s.l1) / ((s.beta + np.sqrt(ni)) / s.alpha + s.l2))
            p = 1 / (1 + np.exp(-np.clip(w @ value + bias, -35, 35)))
            g = (p - y) * value
            step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / s.alpha
            z[index] = zi + g - step * w
            n[index] = ni + g * g
            rate += (p - y) ** 2
            bias -= s.alpha * (p - y) / (s.beta + np.sqrt(rate))
    w = np.where(np.abs(z) <= s.l1, 0.0, -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))
    return w.astype(np.float32), bias


def train(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> tuple[np.ndarray, float]:
    """Fit on the labelled rows whose crc32(doc_id) mod 3 is not 1, ``sample_rows`` of them at most.

    ``labels`` has doc_id and quality (0 or 1; others are ignored). Which rows are
    taken follows a hash of the id, so all partitions give alike. Features are made
    where the texts are; one task gets the bounded sample of sparse vectors and
    returns the weights.
    """
    kept = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    chosen = kept.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.sample_rows)
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("y").alias("y"), F.min("text").alias("text"))
    texts = texts.select(F.xxhash64(F.col("doc_id").cast("string")).alias("key"), "y", "text")
    bits = settings.bits

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = list(_sparse(batch.column("text"), bits))
            yield pa.record_batch([batch.column("key"), batch.column("y"), pa.array([a.tobytes() for a, _ in made], pa.binary()), pa.array([v.tobytes() for _, v in made], pa.binary())], names=["key", "y", "index", "value"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(np.frombuffer(a, np.int32), np.frombuffer(v, np.float32), y) for b in batches for a, v, y in zip(*(b.column(c).to_pylist() for c in ("index", "value", "y")))]
        weights, bias = ftrl(rows, settings)
        yield pa.record_batch([pa.array([weights.tobytes()], pa.binary()), pa.array([float(bias)])], names=["weights", "bias"])

    sparse = texts.mapInArrow(vectors, "key long, y int, index binary, value binary")
    one = sparse.repartition(1).sortWithinPartitions("key", F.xxhash64("index"))
    got = one.drop("key").mapInArrow(fit, "weights binary, bias double").collect()
    if not got:
        return np.zeros(1 << bits, np.float32), 0.0
    return np.frombuffer(got[0].weights, np.float32), got[0].bias


def held_out(doc_id: F.Column) -> F.Column:
    """True where crc32 of the id as text has remainder 1 modulo 3; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def scored(documents: DataFrame, model: tuple[np.ndarray, float], bits: int = Settings.bits, column: str = "quality_score") -> DataFrame:
    """``documents`` and each whole text's score, in one pass without a shuffle.

    The weights (4 * 2**bits bytes) are broadcast; ``column`` must be a new name.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    names = documents.columns
    where = names.index("text")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            parts = []
            for block in words.blocks(batch.column(where)):
                index, at = features(block, bits)
                total = np.zeros(len(index) + 1)
                np.cumsum(weights[index], dtype=np.float64, out=total[1:])
                parts.append((total[at[1:]] - total[at[:-1]]) / np.sqrt(np.maximum(np.diff(at), 1)))
            x = np.concatenate([*parts, np.zeros(0)]) + bias
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(x, -35, 35))))], names=[*names, column])

    return documents.mapInArrow(add, T.StructType([*documents.schema.fields, T.StructField(column, T.DoubleType())]))
