"""SimHash near-dedup for texts whose five-word shingles have a Jaccard similarity of 0.8 or more.

A text is lower-cased (A-Z) and cut into words; its set is that of its five-word
shingles as 64-bit hashes (the whole sequence if it has fewer words; texts without
words, null included, have equal sets). All pairs at 0.8 or more are found, and their
components are groups of near copies:

1. each set gets a SimHash of its shingles, and the vantage-point trees of
   :mod:`tagweft.llm.simhash` link those within ``RADIUS`` bits; sets are then compared,
   and only links at 0.8 or more stay. No radius of 64 bits finds all pairs at 0.8, so
   this joins the closest copies, and two steps find the rest;
2. shingles are put in an order, those that a sample of texts shares last. Two sets
   at 0.8 or more share one of the first shingles, a fifth of each set, in any order
   that holds for all; so the sample decides how many candidates there are, but not
   which pairs are found. Sets that share such a shingle meet in a block. A second
   fingerprint, the odd counts of shingles by hashed places, tells by its Hamming
   distance how many shingles differ at least. In each block, pivots are compared with
   all others that are not in one component with them yet, and a spanning forest of
   the candidates is returned, so a group of any size gives a row a member. This is done
   with a few blocks first, so that others need not join the same large groups again;
3. the candidates' sets are made again from their packed texts and compared. Where that
   refuted links of a forest, blocks meet once more, with the components so far, and
   return all candidates between different ones.

Rows with a null id are rows like any other. An empty table gives an empty one. Texts
of any length are taken whole. Other columns are kept and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from . import simhash, words
from .shared import bounded, first_of_groups, release, stored

WIDTH = 5
RADIUS = 3
#: Places of odd counts: so many for sets of twice as many shingles, up to the most.
LEAST_PLACES, MOST_PLACES = 1024, 8192
BLOCK = 1 << 20
#: Texts that shape the order, shingles that it moves back, rows that are broadcast at most, and shingles of a block.
SAMPLE, MOVED, BROADCAST, BLOCK_ROWS = 8192, 1 << 18, 1_000_000, 100_000
#: Forests are taken from one block in so many, and then from all: what the first have joined, the others pass by.
FIRST_BLOCKS = (16, 1)
#: Members of a shingle from which pivots are taken in place of all pairs.
PIVOT = 12

TEXT_KEY = F.xxhash64


def sets_of(block: words.Block) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles in order of their hashes, text after text, and where each text's begin."""
    counts = block.counts()
    n = np.maximum(counts - WIDTH + 1, 1)
    at = np.concatenate([[0], np.cumsum(n)])
    first = np.repeat(block.bounds[:-1], n) + np.arange(at[-1]) - np.repeat(at[:-1], n)
    last = np.minimum(first + WIDTH, np.repeat(block.bounds[1:], n))
    out = words.mix(words.span_sums(words.word_hashes(block), first, last) + (last - first).astype(np.uint64))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        out[a:b].sort()
    fresh = np.ones(len(out), bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[at[:-1]] = True
    return out[fresh], np.concatenate([[0], np.cumsum(fresh)])[at]


def node_of(shingles: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A number for each set."""
    return words.mix(np.add.reduceat(words.mix(shingles ^ np.uint64(0x5851F42D4C957F2D)), at[:-1]) + np.diff(at).astype(np.uint64))


def fingerprints_of(shingles: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The SimHash of each set: bits that over half of its shingles' hashes have."""
    out = np.zeros(len(at) - 1, np.uint64)
    size = np.diff(at)
    for bit in range(64):
        ones = np.add.reduceat(((shingles >> np.uint64(bit)) & np.uint64(1)).astype(np.int32), at[:-1])
        out |= (2 * ones > size).astype(np.uint64) << np.uint64(bit)
    return out


def places_of(size: int) -> int:
    places = LEAST_PLACES
    while places < MOST_PLACES and 2 * places < size:
        places *= 2
    return places


def odd_counts(shingles: np.ndarray, at: np.ndarray) -> list[bytes]:
    """For each set, bits: whether an odd number of shingles has each place. Halves fold by exclusive or."""
    place = (words.mix(shingles) >> np.uint64(7)).astype(np.int64)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        places = places_of(b - a)
        odd = np.bincount(place[a:b] % places, minlength=places) & 1
        out.append(np.packbits(odd.astype(np.uint8)).tobytes())
    return out


def folded(odd: np.ndarray, n: int) -> np.ndarray:
    """Odd counts (uint64) over ``n`` words, fewer by a power of two."""
    while len(odd) > n:
        half = len(odd) // 2
        odd = odd[:half] ^ odd[half:]
    return odd


def prefixes(shingles: np.ndarray, at: np.ndarray, moved: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of each set in the common order, and where each set's begin; ``moved`` (sorted) come last, by ``rank``."""
    size = np.diff(at)
    wanted = size - (4 * size + 4) // 5 + 1
    place = np.minimum(np.searchsorted(moved, shingles), max(len(moved) - 1, 0))
    back = moved[place] == shingles if len(moved) else np.zeros(len(shingles), bool)
    before = np.concatenate([[0], np.cumsum(~back)])
    take = ~back & (before[:-1] - np.repeat(before[at[:-1]], size) < np.repeat(wanted, size))
    short = wanted - (before[at[1:]] - before[at[:-1]])
    for i in np.flatnonzero(short > 0).tolist():
        own = at[i] + np.flatnonzero(back[at[i] : at[i + 1]])
        take[own[np.lexsort((shingles[own], rank[place[own]]))[: short[i]]]] = True
    return shingles[take], np.concatenate([[0], np.cumsum(take)])[at]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for block in words.blocks(batch.column("text"), lower=True, size=BLOCK):
            yield batch.slice(block.first, block.n_docs), *sets_of(block)


def common_order(documents: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that three or more texts of a sample share, in order, and how many share each."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, shingles, _ in _blocks(batches):
            yield pa.record_batch([pa.array(shingles.view(np.int64))], names=["shingle"])

    some = documents.where(F.pmod(TEXT_KEY("text"), F.lit(max(1, n // SAMPLE))) == 0).select("text")
    shared = some.mapInArrow(cut, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where("n > 2")
    rows = shared.orderBy(F.desc("n"), "shingle").limit(MOVED).toPandas()
    moved, rank = rows.shingle.to_numpy(np.int64).view(np.uint64), rows.n.to_numpy(np.int64)
    order = np.argsort(moved)
    return moved[order], rank[order]


def marks(documents: DataFrame, order: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, key (of the text as it is), node, fp, size, odd (bits) and prefix of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(order)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, shingles, at in _blocks(batches):
            first, bounds = prefixes(shingles, at, *shared.value)
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(first.view(np.int64)))
            numbers = [pa.array(x.view(np.int64)) for x in (node_of(shingles, at), fingerprints_of(shingles, at))]
            yield pa.record_batch([rows.column("doc_id"), rows.column("key"), *numbers, pa.array(np.diff(at).astype(np.int32)), pa.array(odd_counts(shingles, at), pa.binary()), lists], names=["doc_id", "key", "node", "fp", "size", "odd", "prefix"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    own = documents.select("doc_id", TEXT_KEY("text").alias("key"), "text")
    return own.mapInArrow(make, f"doc_id {kind}, key long, node long, fp long, size int, odd binary, prefix array<long>")


class Block:
    """The sets of a block: which pairs may be similar enough, and which are in one component."""

    def __init__(self, size: np.ndarray, odd: list[bytes], label: np.ndarray):
        self.size = size.astype(np.int64)
        self.whole = [np.frombuffer(x, np.uint64) for x in odd]
        self.least = np.stack([folded(x, LEAST_PLACES // 64) for x in self.whole]) if odd else np.zeros((0, 1), np.uint64)
        self.label = label.copy()

    def differ(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the pairs may be at 0.8 or more, and at least how many shingles differ in those."""
        both = self.size[a] + self.size[b]
        near = np.flatnonzero(5 * np.minimum(self.size[a], self.size[b]) >= 4 * np.maximum(self.size[a], self.size[b]))
        least = np.zeros(len(near), np.int64)
        for k in range(0, len(near), 1 << 14):
            some = near[k : k + (1 << 14)]
            least[k : k + (1 << 14)] = np.bitwise_count(self.least[a[some]] ^ self.least[b[some]]).sum(axis=1, dtype=np.int64)
        fits = 9 * least <= both[near]
        near, least = near[fits], least[fits]
        for i in np.flatnonzero(np.minimum(self.size[a[near]], self.size[b[near]]) > 2 * LEAST_PLACES).tolist():
            x, y = self.whole[a[near[i]]], self.whole[b[near[i]]]
            n = min(len(x), len(y))
            least[i] = np.bitwise_count(folded(x, n) ^ folded(y, n)).sum()
        fits = 9 * least <= both[near]
        return near[fits], least[fits]

    def join(self, a: int, b: int) -> None:
        one, other = self.label[a], self.label[b]
        self.label[self.label == max(one, other)] = min(one, other)


def pairs_of(token: np.ndarray, member: np.ndarray, block: Block, forest: bool) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """(a, b, share that differs at least) of sets (``member``) that share a token, may be similar enough and have different labels.

    With ``forest``, candidates join their labels, closest first, so that a spanning forest is returned.
    """
    order = np.lexsort((member, token))
    token, member = token[order], member[order]
    fresh = np.ones(len(token), bool)
    fresh[1:] = (token[1:] != token[:-1]) | (member[1:] != member[:-1])
    token, member = token[fresh], member[fresh]
    at = np.concatenate([np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])), [len(token)]]) if len(token) else np.zeros(1, np.int64)
    out: tuple[list, list, list] = ([], [], [])

    def found(a: np.ndarray, b: np.ndarray) -> None:
        near, least = block.differ(a, b)
        a, b = a[near], b[near]
        share = least / (block.size[a] + block.size[b])
        if forest:
            keep = []
            for i in np.argsort(share, kind="stable").tolist():
                if block.label[a[i]] != block.label[b[i]]:
                    block.join(a[i], b[i])
                    keep.append(i)
            a, b, share = a[keep], b[keep], share[keep]
        for parts, x in zip(out, (a, b, share)):
            parts.append(x)

    # few members: all pairs of all such tokens, each pair once
    small = np.diff(at) <= PIVOT
    inside = np.repeat(small, np.diff(at))
    t, m = token[inside], member[inside]
    pairs, lag, start = [], 1, np.arange(len(t))
    while len(start := start[start + lag < len(t)]) and len(start := start[t[start] == t[start + lag]]):
        pairs.append(m[start] * len(block.size) + m[start + lag])
        lag += 1
    pairs = np.unique(np.concatenate([*pairs, np.zeros(0, np.int64)]))
    a, b = pairs // max(len(block.size), 1), pairs % max(len(block.size), 1)
    apart = block.label[a] != block.label[b]
    found(a[apart], b[apart])
    # many: pivots of the smallest component until one component is left
    for k in np.flatnonzero(~small).tolist():
        left = member[at[k] : at[k + 1]]
        while True:
            labels, n = np.unique(block.label[left], return_counts=True)
            if len(labels) < 2:
                break
            pivot = left[np.flatnonzero(block.label[left] == labels[n.argmin()])[0]]
            others = left[block.label[left] != block.label[pivot]]
            found(np.full(len(others), pivot), others)
            left = left[left != pivot]
    return out


def candidates(again: DataFrame, sets: DataFrame, forest: bool) -> DataFrame:
    """(a, b, far) of distinct sets in different components that may be at 0.8 or more, from tokens (part, token, node, root)."""

    def meet(rows: pa.Table) -> pa.Table:
        node, first, member = np.unique(rows["node"].to_numpy(), return_index=True, return_inverse=True)
        size, root = rows["size"].to_numpy()[first], rows["root"].to_numpy()[first]
        block = Block(size, rows["odd"].take(pa.array(first)).to_pylist(), np.unique(root, return_inverse=True)[1])
        a, b, far = (np.concatenate([*x, np.zeros(0)]) for x in pairs_of(rows["token"].to_numpy(), member, block, forest))
        a, b = node[a.astype(np.int64)], node[b.astype(np.int64)]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "far": far})

    rows = again.join(sets.select("node", "size", "odd"), "node")
    return rows.groupBy("part").applyInArrow(meet, "a long, b long, far double").groupBy("a", "b").agg(F.min("far").alias("far"))


def apart(tokens: DataFrame) -> DataFrame:
    """Those tokens (part, token, node, root) whose sets are not all in one component."""

    def several(rows: pa.Table) -> pa.Table:
        token, root = rows["token"].to_numpy(), rows["root"].to_numpy()
        order = np.lexsort((root, token))
        token, root = token[order], root[order]
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        size = np.diff(np.append(first, len(token)))
        differ = root[first] != root[first + size - 1]
        return rows.take(pa.array(order[np.repeat(differ, size)]))

    return stored(tokens.groupBy("part").applyInArrow(several, "part int, token int, node long, root long"), "near-tokens")


def with_root(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with the root of each node by ``roots`` (node, root), or the node itself."""
    return rows.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def packed(documents: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, packed) of the texts of some nodes, found by their keys; other texts are not shuffled."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for block in words.blocks(batch.column("text"), lower=True, size=BLOCK):
                own = [tool.compress(block.data[a:b].tobytes()) for a, b in zip(block.docs[:-1].tolist(), block.docs[1:].tolist())]
                yield pa.record_batch([pa.array(node_of(*sets_of(block)).view(np.int64)), pa.array(own, pa.binary())], names=["node", "packed"])

    keys = stored(sets.join(nodes, "node", "left_semi").select("key"), "near-asked")
    texts = documents.select(TEXT_KEY("text").alias("key"), "text").join(bounded(keys, BROADCAST), "key", "left_semi").select("text")
    return stored(texts.mapInArrow(pack, "node long, packed binary").dropDuplicates(["node"]), "near-texts")


def similar(documents: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the stored pairs (a, b) whose sets are at 0.8 or more."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                some = batch.slice(k, 64)
                n = some.num_rows
                both = [unpack(x) for x in [*some.column("x").to_pylist(), *some.column("y").to_pylist()]]
                sets = []
                for block in words.blocks(pa.array(both, pa.binary()).cast(pa.large_string()), size=BLOCK):
                    shingles, at = sets_of(block)
                    sets += np.split(shingles, at[1:-1])
                ok = [9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y)) for x, y in zip(sets[:n], sets[n:])]
                yield some.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    texts = packed(documents, ends, sets)
    left, right = texts.select(F.col("node").alias("a"), F.col("packed").alias("x")), texts.select(F.col("node").alias("b"), F.col("packed").alias("y"))
    found = stored(pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"), "near-links")
    release(texts)
    release(pairs)
    return found


def closest(sets: DataFrame, settings: simhash.Search) -> DataFrame:
    """(a, b): pairs of sets whose SimHashes are equal, or linked by the vantage-point trees."""
    by = stored(sets.groupBy("fp").agg(F.min("node").alias("least")), "near-fingerprints")
    equal = sets.join(by, "fp").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    linked = simhash.links(by.select("fp"), settings)
    for end in "ab":
        linked = linked.join(by.select(F.col("fp").alias(end), F.col("least").alias(f"node_{end}")), end)
    return stored(equal.union(linked.select("node_a", "node_b")), "near-closest")


def links(documents: DataFrame, marked: DataFrame, settings: simhash.Search = simhash.Search(radius=RADIUS)) -> DataFrame:
    """(a, b): pairs of sets at 0.8 or more that connect all such pairs."""
    sets = stored(marked.groupBy("node").agg(F.min(F.struct("key", "fp", "size", "odd", "prefix")).alias("s")).select("node", "s.*"), "near-sets")
    near = similar(documents, sets, closest(sets, settings))
    roots = stored(components(near), "near-roots")
    total = 0 if sets.isEmpty() else sets.agg(F.sum(F.size("prefix"))).first()[0]
    parts = max(16, total // BLOCK_ROWS)
    tokens = with_root(sets.select("node", "prefix"), roots).select("node", "root", F.explode("prefix").alias("shingle"))
    tokens = tokens.select(F.pmod("shingle", F.lit(parts)).cast("int").alias("part"), F.shiftright("shingle", 32).cast("int").alias("token"), "node", "root")
    again = apart(tokens)
    for every in FIRST_BLOCKS:
        rows = again.where(F.col("part") % every == 0)
        near = near.union(similar(documents, sets, stored(candidates(rows, sets, forest=True), "near-pairs")))
        roots = stored(components(near), "near-roots")
        left = apart(with_root(again, roots))
        release(again)
        again = left
    last = similar(documents, sets, stored(candidates(again, sets, forest=False), "near-pairs"))
    release(again)
    release(sets)
    return near.union(last)


def deduplicated(documents: DataFrame, settings: simhash.Search = simhash.Search(radius=RADIUS)) -> DataFrame:
    """``documents`` with one row of each group, see :func:`tagweft.llm.shared.first_of_groups`."""
    marked = stored(marks(documents, common_order(documents, documents.count())), "near-marks")
    roots = stored(components(links(documents, marked, settings)), "near-roots")
    return first_of_groups(documents, with_root(marked.select("node", "doc_id", "key"), roots), TEXT_KEY("text"))
