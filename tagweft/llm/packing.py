"""Harmonic packing of token sequences into bins of a fixed capacity.

A document's ids are cut into whole bins of ``capacity`` ids first. What is left
over falls in a reciprocal class: class k takes lengths from capacity/(k+1),
exclusive, to capacity/k, and each of its bins holds k pieces. A length with much
slack in its class gives up a power of two first (capacity/2, /4, ...; these fill
their classes exactly), down to ``Settings.least_cut``, until the rest fits well.
Each worker fills the bins of every class by itself, so nothing is shuffled. Pieces
left in unfilled bins at a worker's end, and those of lengths that no full bin of
their class has come for, run on end to end through closing bins.

State is bounded: under ``capacity`` ids a class. Null texts count as empty, and a
document has at least its end id. Rows are packed one by one, so repeated rows and
ids are packed again, and a retried task gives the same bins in the same order. A
text of any length is cut like any other; its ids alone are held at once. An empty
table gives no rows.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Settings:
    capacity: int = 2048
    end_id: int = 1
    least_cut: int = 64
    slack: float = 1 / 128


def pieces(length: int, settings: Settings) -> list[int]:
    """The lengths a document of ``length`` ids is cut into, in order."""
    out = [settings.capacity] * (length // settings.capacity)
    rest = length % settings.capacity
    while rest:
        k = settings.capacity // rest
        room = settings.capacity // k
        if rest < settings.least_cut or room - rest <= settings.slack * rest:
            out.append(rest)
            break
        cut = 1 << (rest.bit_length() - 1)
        out.append(cut)
        rest -= cut
    return out


@dataclass
class Piece:
    doc: int  # row that the caller gave
    start: int
    ids: np.ndarray  # little-endian uint32
    total: int


class Packer:
    """One worker's open bins. ``add`` and ``close`` return closed bins, each a list of pieces in order."""

    def __init__(self, settings: Settings):
        self.settings = settings
        self.open: dict[int, list[Piece]] = {}

    def add(self, doc: int, ids: np.ndarray) -> Iterator[list[Piece]]:
        start = 0
        for length in pieces(len(ids), self.settings):
            piece = Piece(doc, start, ids[start : start + length], len(ids))
            start += length
            k = self.settings.capacity // length
            held = self.open.setdefault(k, [])
            held.append(piece)
            if len(held) == k:
                del self.open[k]
                yield held

    def close(self) -> Iterator[list[Piece]]:
        """Run the unfilled classes end to end, longest pieces first; the last bin ends in powers of two."""
        rest = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        left = sum(len(p.ids) for p in rest)
        bin_, room = [], 0
        for piece in rest:
            at = 0
            while at < len(piece.ids):
                if not room:
                    if bin_:
                        yield bin_
                    # whole bins, then the powers of two that make up what is left
                    bin_, room = [], min(self.settings.capacity, 1 << (left.bit_length() - 1))
                take = min(room, len(piece.ids) - at)
                bin_.append(Piece(piece.doc, piece.start + at, piece.ids[at : at + take], piece.total))
                at, room, left = at + take, room - take, left - take
        if bin_:
            yield bin_


class Vocabulary(NamedTuple):
    """Local paths, that every worker has, of one public vocabulary: as ranks, with the pattern that splits text, and as a tokenizer."""

    ranks: str
    pattern: str
    tokenizer: str


class Encoder:
    """Ids of texts by the ranks, equal to those of the tokenizer.

    The ranks' encoder is the faster one, but gives up on very long runs of white
    space; the tokenizer itself takes such texts.
    """

    def __init__(self, vocabulary: Vocabulary):
        import tiktoken

        with open(vocabulary.ranks, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        with open(vocabulary.tokenizer, "rb") as file:
            added = {token["content"]: token["id"] for token in json.load(file)["added_tokens"]}
        self.vocabulary = vocabulary
        self.fast = tiktoken.Encoding("ranks", pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens=added)

    def _slow(self, text: str, ordinary: bool) -> list[int]:
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(self.vocabulary.tokenizer)
        own.encode_special_tokens = ordinary
        return own.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> list[int]:
        """Texts that spell an added token get its id there."""
        try:
            return self.fast.encode(text, allowed_special="all", disallowed_special=())
        except ValueError:
            return self._slow(text, False)

    def ordinary(self, text: str) -> list[int]:
        """Added tokens are ordinary text."""
        try:
            return self.fast.encode_ordinary(text)
        except ValueError:
            return self._slow(text, True)


@lru_cache(4)
def encoder(vocabulary: Vocabulary) -> Encoder:
    return Encoder(vocabulary)


def packed(documents: DataFrame, vocabulary: Vocabulary, settings: Settings = Settings()) -> DataFrame:
    """Pack all texts; a row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    Sequence ids are the worker's number times 2**40 and a counter. Only doc_id and
    text are read, so other columns may have any name.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).ids
        packer = Packer(settings)
        sequence = TaskContext.get().partitionId() << 40
        names: dict[int, object] = {}  # ids of the rows that open bins may still name
        row = 0
        out: list[tuple] = []

        def put(bin_: list[Piece]) -> None:
            nonlocal sequence
            offset = 0
            for p in bin_:
                raw = p.ids.tobytes()
                out.append((names[p.doc], p.start, len(p.ids), zlib.crc32(raw), p.total, sequence, offset, raw))
                offset += len(p.ids)
            sequence += 1

        def flush(doc_type: pa.DataType) -> pa.RecordBatch:
            nonlocal out
            columns = list(zip(*out)) or [()] * 8
            out = []
            types = [doc_type, *[pa.int64()] * 6, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

        doc_type = pa.int64()
        for batch in batches:
            doc_type = batch.schema.field("doc_id").type
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                got = encode(text.as_py() or "")
                got.append(settings.end_id)
                names[row] = doc_id
                for bin_ in packer.add(row, np.array(got, "<u4")):
                    put(bin_)
                row += 1
                if len(out) >= 10_000:
                    yield flush(doc_type)
            held = {p.doc for ps in packer.open.values() for p in ps}
            names = {k: v for k, v in names.items() if k in held}
        for bin_ in packer.close():
            put(bin_)
        yield flush(doc_type)

    return documents.select("doc_id", "text").mapInArrow(pack, schema)
