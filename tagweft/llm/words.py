"""Words of many texts at once, as numpy arrays over one Arrow buffer.

A word is a run of bytes other than the six white-space bytes 0x20 and 0x09-0x0D.
All functions work on the UTF-8 bytes of a block of texts, so no Python object is
made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


@dataclass
class Block:
    """Rows ``first`` to ``first + len(docs) - 1`` of a batch and their words."""

    first: int
    data: np.ndarray  # bytes of all texts, end to end
    docs: np.ndarray  # byte offset of each text, and the end
    starts: np.ndarray  # byte offset of each word
    ends: np.ndarray
    bounds: np.ndarray  # index of each text's first word, and the end

    @property
    def n_docs(self) -> int:
        return len(self.docs) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.counts())


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def split(data: np.ndarray, docs: np.ndarray, first: int = 0, lower: bool = False) -> Block:
    """Find the words of the texts that lie end to end in ``data``."""
    if lower:
        data = LOWER[data]
    n = len(data)
    inside = ~SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    edges = docs[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    begins[edges] = inside[edges]
    stops[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begins)
    return Block(first, data, docs, starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, docs))


def blocks(column: pa.Array, lower: bool = False, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Consecutive rows in blocks of about ``size`` bytes (one text at least)."""
    data, at = text_buffers(column)
    row, last = 0, len(at) - 1
    while row < last:
        end = max(row + 1, int(np.searchsorted(at, at[row] + size, "right")) - 1)
        yield split(data[at[row] : at[end]], at[row : end + 1] - at[row], row, lower)
        row = end


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


_kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = int(_BASE)) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n; up to a million of each base are kept."""
    up, down = _kept.get(base, (np.zeros(0, np.uint64),) * 2)
    if n > len(up):
        size = 1 << max(16, (n - 1).bit_length())
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
        if size <= 1 << 20:
            _kept[base] = up, down
    return up[:n], down[:n]


def span_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = int(_BASE)) -> np.ndarray:
    """Polynomial hash, modulo 2**64, of each span ``values[start:end]``."""
    up, down = powers(max(len(values), 1), base)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return (total[ends] - total[starts]) * down[np.minimum(starts, len(down) - 1)]


def word_hashes(block: Block, part: int = 1 << 18) -> np.ndarray:
    """A 64-bit hash of each word's bytes, made over parts of the block at a time."""
    out = np.empty(len(block.starts), np.uint64)
    first = 0
    while first < len(out):
        low = block.starts[first]
        last = max(first + 1, int(np.searchsorted(block.ends, low + part, "right")))
        starts, ends = block.starts[first:last] - low, block.ends[first:last] - low
        out[first:last] = span_sums(block.data[low : low + ends[-1]].astype(np.uint64) + np.uint64(1), starts, ends)
        out[first:last] += (ends - starts).astype(np.uint64)
        first = last
    return mix(out)


def joined(block: Block) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The texts with one space after each word: bytes, and each word's start and end there."""
    keep = ~SPACE[block.data]
    after = block.ends[block.ends < len(block.data)]
    last = np.zeros(len(block.data) + 1, bool)
    last[block.docs] = True
    after = after[~last[after]]
    data = block.data.copy()
    data[after] = 32
    keep[after] = True
    moved = np.zeros(len(keep) + 1, np.int64)
    np.cumsum(keep, out=moved[1:])
    return data[keep].tobytes(), moved[block.starts], moved[block.ends]
