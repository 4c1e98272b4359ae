"""LM scoring: a causal self-attention model over subword ids, beside a word unigram.

A text is lower-cased (A-Z) and cut into words (runs of bytes other than the six
ASCII white-space bytes) and an end token. Texts whose crc32(doc_id) mod 5 is not 1
train: counts of all their words, and the network of :mod:`attention`, which reads each
word as its first subword id.

The model's outcomes are those of the unigram: the words that training texts have, the
end, and any other word as one outcome. That one has the share of training tokens that
occur once (a Good-Turing estimate). Of the rest, a word's probability mixes (``Settings.mix``)
that of its first subword in context, times the word's share of the training words that
begin so, and the word's own share. So the probabilities of all outcomes sum to one.

1. Each task cuts its texts into shards of about ``shard_bytes`` (or one longer
   text) and writes, for each, the words as numbers into the shard's own dictionary.
2. Dictionaries meet by ranges of word hashes ("buckets"); each bucket adds up its
   words over all shards, returns the sums to the shards, and counts first subwords.
3. The network starts on ``Settings.sample_windows`` windows of ``sample_shards``
   shards. Every task then trains its own copy on all training windows of all its
   shards, ``batch`` a step, in one pass; the copies' mean, weighted by windows, is the
   model. So scores depend a little on how the table is split into tasks.
4. Shards and sums meet, and each text is scored alone: no window crosses texts.

Only per-shard dictionaries are shuffled, so a word as common as can be counts once
a shard. Null text is just an end token; rows with a null id train, as no remainder
is 1. Repeated rows and ids are scored, and counted, one by one; an empty table gives an
empty one. A text of any length is one shard at least, and scored window by window. Only
doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import attention, words
from .packing import Vocabulary, encoder
from .shared import stored


@dataclass(frozen=True)
class Settings:
    """``mix`` is the weight of a word's first subword in context and the word after it; the rest is the word's own share.

    It was picked on training texts alone, of which a fifth was held back.
    """

    mix: float = 0.98
    shard_bytes: int = 4 << 20
    bucket_words: int = 1_500_000
    sample_shards: int = 12
    sample_windows: int = 6000
    batch: int = 512
    rate: float = 0.003


def squeeze(x: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes())


def unsqueeze(x: bytes, kind: str | None = None) -> np.ndarray | bytes:
    raw = zstandard.ZstdDecompressor().decompress(x)
    return np.frombuffer(raw, kind) if kind else raw


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def cut(block: words.Block, training: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The dictionary of a block (words joined by spaces), each word's number in it, and each entry's count in training texts."""
    hashed = words.word_hashes(block)
    _, first, number = np.unique(hashed, return_index=True, return_inverse=True)
    count = np.bincount(number[training[block.doc_of_word()]], minlength=len(first))
    size = block.ends[first] - block.starts[first]
    data = np.full(int(size.sum()) + len(size), 32, np.uint8)
    at = np.cumsum(size + 1) - size - 1
    data[np.repeat(at, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = block.data[np.repeat(block.starts[first], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
    return data.tobytes()[:-1], number.astype(np.int32), count.astype(np.int64)


def shards(documents: DataFrame, vocabulary: Vocabulary, settings: Settings) -> DataFrame:
    """Step 1: shard, doc_id and n_words (lists), words, first subwords, number and count (compressed), and the shard's training tokens and texts."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            column = batch.column("doc_id")
            for block in words.blocks(batch.column("text"), lower=True, size=settings.shard_bytes):
                ids = column.slice(block.first, block.n_docs)
                training = np.array([not held_out(i) for i in ids.to_pylist()], bool)
                text, number, count = cut(block, training)
                own = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                sizes = pa.array([block.counts().astype(np.int32)])
                yield pa.record_batch(
                    [pa.array([shard]), own, sizes, pa.array([squeeze(text)]), pa.array([squeeze(first_subwords(text, vocabulary).astype(np.int32))]), pa.array([squeeze(number)]), pa.array([squeeze(count)]), pa.array([len(count)]), pa.array([int(block.counts()[training].sum() + training.sum())]), pa.array([int(training.sum())])],
                    names=["shard", "doc_id", "n_words", "words", "first", "number", "count", "entries", "train_tokens", "train_texts"],
                )
                shard += 1

    schema = f"shard long, doc_id array<{kind}>, n_words array<int>, words binary, first binary, number binary, count binary, entries long, train_tokens long, train_texts long"
    return documents.select("doc_id", "text").mapInArrow(make, schema)


def dictionary(text: bytes) -> words.Block:
    data = np.frombuffer(text, np.uint8)
    return words.split(data, np.array([0, len(data)]))


def bucketed(table: DataFrame, n_buckets: int) -> DataFrame:
    """Each shard's dictionary in parts by word hash: bucket, shard, entry, words, count."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for shard, text, count in zip(batch.shard, batch.words, batch["count"]):
                block = dictionary(unsqueeze(text))
                if not len(block.starts):
                    continue
                count = unsqueeze(count, "<i8")
                which = ((words.word_hashes(block) >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(which, kind="stable")
                edges = np.searchsorted(which[order], np.arange(n_buckets + 1))
                raw = block.data.tobytes()
                own = [raw[a:b] for a, b in zip(block.starts.tolist(), block.ends.tolist())]
                for b in np.flatnonzero(np.diff(edges)):
                    part = order[edges[b] : edges[b + 1]]
                    out.append((int(b), shard, squeeze(part.astype(np.int32)), squeeze(b" ".join([own[i] for i in part.tolist()])), squeeze(count[part])))
            yield pd.DataFrame(out, columns=["bucket", "shard", "entry", "words", "count"])

    return table.select("shard", "words", "count").mapInPandas(deal, "bucket long, shard long, entry binary, words binary, count binary")


@lru_cache(4)
def id_bytes(vocabulary: Vocabulary) -> np.ndarray:
    """Length of each id's bytes; the last is for the end token, which has an id of its own."""
    with open(vocabulary.ranks, "rb") as lines:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, lines)}
    size = np.zeros(max(ranks) + 2, np.int64)
    for i, raw in ranks.items():
        size[i] = len(raw)
    return size


def first_subwords(text: bytes, vocabulary: Vocabulary) -> np.ndarray:
    """The first id of each word of a dictionary, each with a space before it.

    An id counts to the word in which it begins; a word in which none begins (white space
    beyond the six bytes can be part of one id with what is before it) has that id.
    """
    if not text:
        return np.zeros(0, np.int64)
    ids = np.array(encoder(vocabulary).ordinary(" " + text.decode("utf-8", "replace")), np.int64)
    size = id_bytes(vocabulary)[ids]
    return ids[np.minimum(np.searchsorted(np.cumsum(size) - size, dictionary(text).starts), len(ids) - 1)]


def summed(parts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Step 2: for each bucket and shard the sums (shard, entry, count); for each bucket a row of shard -1 with counts of first subwords.

    That row's ``entry`` has ids, its ``count`` their counts; ``distinct`` is the number
    of words with a training count, ``once`` that of words with a count of one.
    """

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        texts = [unsqueeze(x) for x in frame.words]
        hashed = [words.word_hashes(dictionary(x)) for x in texts]
        counts = [unsqueeze(x, "<i8") for x in frame["count"]]
        _, first, number = np.unique(np.concatenate(hashed), return_index=True, return_inverse=True)
        total = np.bincount(number, np.concatenate(counts), len(first)).astype(np.int64)
        edges = np.cumsum([0, *map(len, hashed)])
        out = [(shard, entry, squeeze(total[number[a:b]]), 0, 0) for shard, entry, a, b in zip(frame.shard, frame.entry, edges[:-1], edges[1:])]
        every = b" ".join(texts).split(b" ")
        seen = np.flatnonzero(total > 0)
        ids = first_subwords(b" ".join([every[i] for i in first[seen].tolist()]), vocabulary)
        key, number = np.unique(ids, return_inverse=True)
        out.append((-1, squeeze(key.astype(np.int64)), squeeze(np.bincount(number, total[seen], len(key)).astype(np.int64)), len(seen), int((total == 1).sum())))
        return pd.DataFrame(out, columns=["shard", "entry", "count", "distinct", "once"])

    return parts.groupBy("bucket").applyInPandas(merge, "shard long, entry binary, count binary, distinct long, once long")


def count_tables(sums: DataFrame, train_texts: int, vocabulary: Vocabulary) -> attention.Tables:
    """The tables of first subwords from all buckets; the driver gets a row an id of the vocabulary at most."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, n in zip(batch.column("entry").to_pylist(), batch.column("count").to_pylist()):
                yield pa.record_batch([pa.array(unsqueeze(key, "<i8")), pa.array(unsqueeze(n, "<i8"))], names=["key", "n"])

    rows = sums.where("shard = -1").select("entry", "count").mapInArrow(spread, "key long, n long")
    total = rows.groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    v = len(id_bytes(vocabulary))
    first = np.bincount(total.key.to_numpy(np.int64), total.n.to_numpy(np.float64), v)
    first[v - 1] = train_texts
    return attention.tables(first, v - 1)


@dataclass
class Sequence:
    """The tokens of a shard's texts, each text's end included, text after text."""

    token: np.ndarray  # each token's entry in the dictionary, the end's after all others
    ids: np.ndarray  # its first subword
    bounds: np.ndarray  # where each text begins, and the end


def sequence(t: attention.Tables, first: bytes, number: bytes, n_words: np.ndarray) -> Sequence:
    """From a shard's first subwords and numbers, as compressed."""
    ids = np.append(unsqueeze(first, "<i4"), np.int32(t.end_id))
    token = np.insert(unsqueeze(number, "<i4").astype(np.int64), np.cumsum(n_words), len(ids) - 1)
    return Sequence(token, ids[token], np.concatenate([[0], np.cumsum(n_words + 1)]))


def windows(s: Sequence) -> tuple[np.ndarray, np.ndarray]:
    """Places of the windows: index of each text, and of the first fresh id."""
    n = -(-np.diff(s.bounds) // attention.FRESH)
    doc = np.repeat(np.arange(len(n)), n)
    return doc, s.bounds[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * attention.FRESH


def gathered(s: Sequence, t: attention.Tables, doc: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """(before, blank, now, used, place) of windows."""
    begin, end = s.bounds[doc], s.bounds[doc + 1]
    key = first[:, None] + np.arange(-attention.CONTEXT, attention.FRESH)[None, :]
    before = s.ids[np.clip(key - 1, 0, len(s.ids) - 1)]
    before[key <= begin[:, None]] = t.end_id
    blank = np.clip(attention.CONTEXT - (first - begin), 0, attention.CONTEXT)
    place = key[:, attention.CONTEXT :]
    used = place < end[:, None]
    place = np.minimum(place, len(s.ids) - 1)
    return before, blank, s.ids[place], used, place


def training_windows(r, t: attention.Tables, random: np.random.Generator) -> tuple[Sequence, np.ndarray, np.ndarray]:
    """A shard's sequence, and (as :func:`windows`) all windows of its training texts in random order."""
    s = sequence(t, r.first, r.number, np.asarray(r.n_words, np.int64))
    training = np.array([not held_out(None if pd.isna(i) else i) for i in r.doc_id], bool)
    doc, first = windows(s)
    mine = random.permutation(np.flatnonzero(training[doc]))
    return s, doc[mine], first[mine]


def first_network(table: DataFrame, shared: Broadcast, settings: Settings) -> dict[str, np.ndarray]:
    """A network trained in one task on windows of a few shards, from which all tasks go on."""
    chosen = [r.shard for r in table.select("shard").orderBy(F.xxhash64("shard"), "shard").limit(settings.sample_shards).collect()]

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        random = np.random.default_rng(17)
        wanted = -(-settings.sample_windows // settings.sample_shards)
        parts = []
        for batch in batches:
            for r in batch.itertuples(index=False):
                s, doc, first = training_windows(r, shared.value, random)
                parts.append(gathered(s, shared.value, doc[:wanted], first[:wanted])[:4])
        net = attention.fit(shared.value, tuple(np.concatenate(x) for x in zip(*parts))) if parts else attention.start_network()
        yield pd.DataFrame({"name": list(net), "value": [x.tobytes() for x in net.values()]})

    got = table.where(F.col("shard").isin(chosen)).select("shard", "doc_id", "n_words", "first", "number").repartition(1).sortWithinPartitions("shard").mapInPandas(train, "name string, value binary").collect()
    like = attention.start_network()
    values = {r.name: np.frombuffer(r.value, np.float32) for r in got}
    return {x: values[x].reshape(y.shape) if x in values else y for x, y in like.items()}


def copies(table: DataFrame, shared: Broadcast, start: Broadcast, settings: Settings) -> DataFrame:
    """(place, value, seen): each task's copy of the first network, trained on all training windows of its shards."""

    def go_on(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trainer, seen = attention.Trainer(start.value), 0
        for batch in batches:
            for r in batch.itertuples(index=False):
                s, doc, first = training_windows(r, shared.value, np.random.default_rng(abs(r.shard)))
                for at in range(0, len(doc), settings.batch):
                    trainer.step(shared.value, gathered(s, shared.value, doc[at : at + settings.batch], first[at : at + settings.batch])[:4], settings.rate)
                seen += len(doc)
        if seen:
            flat = np.concatenate([x.reshape(-1) for x in trainer.net.values()]).astype(np.float64)
            yield pd.DataFrame({"place": np.arange(len(flat), dtype=np.int32), "value": flat * seen, "seen": seen})

    return table.select("shard", "doc_id", "n_words", "first", "number").mapInPandas(go_on, "place int, value double, seen long")


def network(table: DataFrame, t: attention.Tables, settings: Settings) -> dict[str, np.ndarray]:
    """Train on all training windows: each task a copy of the first network, then their mean.

    Copies are added up by parameter, so the driver gets one row a parameter.
    """
    context = table.sparkSession.sparkContext
    shared = context.broadcast(t)
    net = first_network(table, shared, settings)
    trained = copies(table, shared, context.broadcast(net), settings)
    means = trained.groupBy("place").agg((F.sum("value") / F.sum("seen")).alias("value")).toPandas().sort_values("place")
    if not len(means):
        return net
    edges = np.cumsum([x.size for x in net.values()])[:-1]
    return {x: v.reshape(net[x].shape) for x, v in zip(net, np.split(means.value.to_numpy(np.float32), edges))}


def log_probabilities(net: dict[str, np.ndarray], t: attention.Tables, s: Sequence, count: np.ndarray, n_tokens: int, unknown: float, mix: float = Settings.mix, batch: int = 256) -> np.ndarray:
    """log10 probability of each text of a sequence; ``count`` has each token's count in training texts."""
    if not len(s.ids):
        return np.zeros(0)
    out = np.zeros(len(s.ids), np.float32)
    doc, begin = windows(s)
    for at in range(0, len(doc), batch):
        before, blank, now, used, place = gathered(s, t, doc[at : at + batch], begin[at : at + batch])
        out[place[used]] = attention.probabilities(net, t, before, blank, now, used)
    in_context = out * np.minimum(count / np.maximum(t.first_count[s.ids], 1), 1)
    known = (1 - unknown) * (mix * in_context + (1 - mix) * count / max(n_tokens, 1))
    return np.add.reduceat(np.log10(np.maximum(np.where(count > 0, known, unknown), 1e-30)), s.bounds[:-1])


def scored(documents: DataFrame, vocabulary: Vocabulary, settings: Settings = Settings()) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = documents.sparkSession
    kind = documents.schema["doc_id"].dataType.simpleString()
    table = stored(shards(documents, vocabulary, settings), "lm-shards")
    size = table.agg(F.sum("entries").alias("entries"), F.sum("train_tokens").alias("tokens"), F.sum("train_texts").alias("texts")).first()
    n_tokens, n_texts = size.tokens or 0, size.texts or 0
    n_buckets = max(12, math.ceil((size.entries or 0) / settings.bucket_words))
    sums = stored(summed(bucketed(table, n_buckets), vocabulary), "lm-sums")
    facts = sums.where("shard = -1").agg(F.sum("distinct").alias("distinct"), F.sum("once").alias("once")).first()
    distinct = (facts.distinct or 0) + (n_texts > 0)
    unknown = max(facts.once or 0, 0.5) / max(n_tokens, 1) if n_tokens else 1.0
    t = count_tables(sums, n_texts, vocabulary)
    net = network(table, t, settings)
    model = spark.sparkContext.broadcast((net, t))
    own = sums.where("shard >= 0").groupBy("shard").agg(F.collect_list(F.struct("entry", "count")).alias("sums"))
    both = table.select("shard", "doc_id", "n_words", "first", "number", "entries").join(own, "shard", "left")
    below = n_tokens + 0.5 * (distinct + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, t = model.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                ids = row["doc_id"].values
                n_words = np.asarray(row["n_words"].values, np.int64)
                total = np.zeros(row["entries"].as_py() + 1, np.int64)
                for part in row["sums"].as_py() or ():
                    total[unsqueeze(part["entry"], "<i4")] = unsqueeze(part["count"], "<i8")
                total[-1] = n_texts
                s = sequence(t, row["first"].as_py(), row["number"].as_py(), n_words)
                count, at = total[s.token], s.bounds[:-1]
                base = np.add.reduceat(np.log10((count + 0.5) / below), at)
                known = np.add.reduceat((count > 0).astype(np.int64), at)
                score = log_probabilities(net, t, s, count, n_tokens, unknown, settings.mix)
                held = pa.array([held_out(x) for x in ids.to_pylist()])
                yield pa.record_batch(
                    [ids, held, pa.array(n_words + 1), pa.array(known), pa.array(np.full(len(ids), n_tokens)), pa.array(base), pa.array(score)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return both.mapInArrow(score, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
