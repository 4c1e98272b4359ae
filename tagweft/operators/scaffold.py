"""PRJ5-7: find a scaffold in read2 and take the feature barcode before it.

Reads are compared an Arrow batch at a time, as a matrix of bytes: a place can start
the scaffold within ``BUDGET`` edits only where one of BUDGET + 1 segments of it
stands whole, moved by BUDGET places at most; at those places alone a banded
alignment runs, for all of them at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import ship

BUDGET = 2
WIDTH = 2 * BUDGET + 1
#: Bytes of padded reads that are compared at once.
BLOCK = 4 << 20


def costs(text: np.ndarray, length: np.ndarray, pattern: bytes, read: np.ndarray, start: np.ndarray) -> np.ndarray:
    """PRJ6: edits that align all of ``pattern`` with ``read`` from ``start`` on, at most BUDGET + 1.

    ``text`` has a padded row of bytes a read. Column j of the band is the read's place
    start + i + j - BUDGET for the pattern's place i. The read's end is free, and no
    base of it may come before the pattern's first step.
    """
    over = np.int8(BUDGET + 1)
    band = np.full((len(read), WIDTH), over)
    band[:, BUDGET] = 0
    shift = np.arange(WIDTH) - BUDGET
    for i, base in enumerate(pattern):
        place = start[:, None] + (i + shift)[None, :]
        inside = (place >= 0) & (place < length[read][:, None])
        there = text[read[:, None], np.clip(place, 0, text.shape[1] - 1)]
        now = np.where(inside, band + (there != base), over).astype(np.int8)
        now[:, :-1] = np.minimum(now[:, :-1], band[:, 1:] + 1)
        for j in range(1, WIDTH):
            now[:, j] = np.minimum(now[:, j], now[:, j - 1] + 1)
        band = np.minimum(now, over)
    return band.min(axis=1)


def possible(text: np.ndarray, pattern: bytes, places: int) -> np.ndarray:
    """Whether each read (row) may start the pattern at each place (column): False only where the budget cannot do."""
    n, width = text.shape
    size = len(pattern) // (BUDGET + 1)
    if not size:
        return np.ones((n, places), bool)
    out = np.zeros((n, places), bool)
    spots = max(0, width - size + 1)
    for offset in range(0, size * (BUDGET + 1), size):
        whole = np.ones((n, spots), bool)
        for k, base in enumerate(pattern[offset : offset + size]):
            whole &= text[:, k : k + spots] == base
        for move in range(offset - BUDGET, offset + BUDGET + 1):
            first, last = max(0, -move), min(places, spots - move)
            if first < last:
                out[:, first:last] |= whole[:, first + move : last + move]
    return out


def starts(reads: list[str | None], scaffold: str, first: int, spare: int) -> np.ndarray:
    """PRJ7: of each read the first place in [first, length - spare] within the budget, moved on to strictly better ones at most BUDGET places ahead; -1 if there is none or if it moved beyond that end."""
    pattern = scaffold.encode()
    raw = [(r or "").encode() for r in reads]
    length = np.array([len(r) for r in raw], np.int64)
    width = int(length.max(initial=0)) + 1
    text = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raw), np.uint8).reshape(len(raw), width)
    last = length - spare
    places = width + 2 * BUDGET
    row, at = np.nonzero(possible(text, pattern, places) & (np.arange(places) >= first) & (np.arange(places) <= last[:, None] + 2 * BUDGET))
    cost = np.full((len(raw), places), BUDGET + 1, np.int8)
    cost[row, at] = costs(text, length, pattern, row, at)
    fits = (cost <= BUDGET) & (np.arange(places) <= last[:, None])
    place, everyone = fits.argmax(axis=1), np.arange(len(raw))
    found = fits.any(axis=1)
    best = cost[everyone, place]
    ahead, end = place + 1, place + BUDGET
    for _ in range(BUDGET * (BUDGET + 1)):
        value = cost[everyone, np.minimum(ahead, places - 1)]
        better = (ahead <= end) & (ahead < places) & (value < best)
        place, best = np.where(better, ahead, place), np.where(better, value, best)
        end = np.where(better, ahead + BUDGET, end)
        ahead = ahead + 1
    return np.where(found & (place <= last), place, -1)


def locate(read: Column, scaffold: str, first: int) -> Column:
    """PRJ7 as a column: the scaffold's start in ``read``, from ``first`` on; null if there is none."""
    spare = len(scaffold) - BUDGET

    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            own = batch.tolist()
            rows = max(1, BLOCK // max(1, max((len(r) for r in own if r), default=1)))
            found = [starts(own[k : k + rows], scaffold, first, spare) for k in range(0, len(own), rows)]
            place = pd.Series(np.concatenate([*found, np.zeros(0, np.int64)]).astype("int32"), dtype="Int32")
            yield place.mask(place < 0)

    return F.pandas_udf(find, "int")(read)


def anchored(reads: DataFrame, scaffold: str, length: int, max_mismatch: int) -> DataFrame:
    """PRJ5: ``reads`` with the scaffold's start in read2 and the ``length`` bases before it, filled up with N on the left.

    Both are null where there is no scaffold.
    """
    ship(reads.sparkSession)
    found = reads.withColumn("start", locate(F.col("read2"), scaffold, length - max_mismatch))
    before = F.substring("read2", F.greatest(F.col("start") - length, F.lit(0)) + 1, F.least("start", F.lit(length)))
    return found.withColumn("feature_barcode", F.when(F.col("start").isNotNull(), F.lpad(before, length, "N")))
