"""SimHash near-dedup: exact pairs within a Hamming radius from vantage-point trees.

A text is lower-cased (A-Z), cut into words, and its three-word shingles (repeats
included; the whole sequence if it has fewer words) are hashed with XXH64, seed
42. A fingerprint bit is set if it is set in over half the hashes; a text without
words, null included, has fingerprint zero and links like any other.

Only distinct fingerprints are searched. A router tree cuts them into shards by
distance to vantage points: its top is built on the driver from a bounded sample
(``Search.sample``), and what lies below each of its at most ``Search.top`` leaves by
tasks, from samples that grow with the table, so shards do not. Each fingerprint lives
in one shard and visits those shards beyond its own whose region it may touch: the
triangle inequality shows which. Each shard searches with a tree of its own and returns
a spanning forest of the links found, so a dense group of any size gives as many rows
as it has members. Components are contracted as DataFrames.

Rows with a null id, or with an id in common, are rows like any other; an empty table
gives an empty one, and only doc_id and text are read, so other columns may have any
name. A text of any length is hashed as a whole.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from . import words
from .shared import first_of_groups, stored


@dataclass(frozen=True)
class Search:
    """``sample`` fingerprints shape the ``top`` leaves of the router, and ``each`` for every shard what lies below; all are indexed."""

    radius: int = 3
    shard: int = 6000
    leaf: int = 192
    sample: int = 32_768
    top: int = 2048
    each: int = 16


def fingerprints_of(block: words.Block, width: int = 3, seed: int = 42) -> np.ndarray:
    """The fingerprint of each text of a lower-cased block, as uint64."""
    data, starts, ends = words.joined(block)
    counts = block.counts()
    n_shingles = np.where(counts > 0, np.maximum(counts - width + 1, 1), 0)
    at = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(n_shingles, out=at[1:])
    first = np.repeat(block.bounds[:-1], n_shingles) + np.arange(at[-1]) - np.repeat(at[:-1], n_shingles)
    last = np.minimum(first + width - 1, np.repeat(block.bounds[1:], n_shingles) - 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(data[a:b], seed) for a, b in zip(starts[first].tolist(), ends[last].tolist())), np.uint64, at[-1])
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(n_shingles)
    if len(some):
        for bit in range(64):
            ones = np.add.reduceat(((hashes >> np.uint64(bit)) & np.uint64(1)).astype(np.int32), at[some])
            out[some] |= (2 * ones > n_shingles[some]).astype(np.uint64) << np.uint64(bit)
    return out


TEXT_KEY = F.xxhash64


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, key, fp long) for every row, in one pass; ``key`` is a hash of the text as it is."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [fingerprints_of(b) for b in words.blocks(batch.column("text"), lower=True)]
            fp = np.concatenate([*parts, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.record_batch([batch.column("doc_id"), batch.column("key"), pa.array(fp)], names=["doc_id", "key", "fp"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", TEXT_KEY("text").alias("key"), "text").mapInArrow(make, f"doc_id {kind}, key long, fp long")


def distance(points: np.ndarray, to: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ to)


def vantage(points: np.ndarray, random: np.random.Generator) -> tuple[np.uint64, int] | None:
    """A point and a distance that cut ``points`` into two parts, most evenly and with few points near the cut."""
    best = None
    for v in random.choice(points, min(6, len(points)), replace=False):
        d = np.bincount(distance(points, v), minlength=65)
        below = np.cumsum(d)
        for cut in range(64):
            if 0 < below[cut] < len(points):
                smaller = min(below[cut], len(points) - below[cut]) / len(points)
                near = d[max(0, cut - 2) : cut + 4].sum() / len(points)
                value = smaller * (1.02 - near)
                if best is None or value > best[0]:
                    best = (value, v, cut)
    return None if best is None else (best[1], best[2])


def router(sample: np.ndarray, shards: int, seed: int = 11) -> list[tuple]:
    """A tree over the sample with about ``shards`` leaves, as a list of nodes.

    An inner node is (vantage point, cut, inside child, outside child), a leaf is
    (None, number of the shard).
    """
    random = np.random.default_rng(seed)
    nodes: list[tuple] = [()]
    todo, leaves = [(0, sample, max(1, shards))], 0
    while todo:
        place, points, want = todo.pop()
        found = vantage(points, random) if want > 1 and len(points) >= 8 else None
        if found is None:
            nodes[place] = (None, leaves)
            leaves += 1
            continue
        v, cut = found
        inside = distance(points, v) <= cut
        nodes[place] = (v, cut, len(nodes), len(nodes) + 1)
        share = max(1, min(want - 1, round(want * inside.mean())))
        todo += [(len(nodes), points[inside], share), (len(nodes) + 1, points[~inside], want - share)]
        nodes += [(), ()]
    return nodes


def route(nodes: list[tuple], points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of point, shard, and whether the point lives there; visits only to shards beyond the home."""
    home = np.zeros(len(points), np.int64)
    visits: list[tuple[np.ndarray, int, np.ndarray]] = []
    todo = [(0, np.arange(len(points)), np.ones(len(points), bool))]
    while todo:
        place, who, own = todo.pop()
        if not len(who):
            continue
        if nodes[place][0] is None:
            visits.append((who, nodes[place][1], own))
            home[who[own]] = nodes[place][1]
            continue
        v, cut, inside, outside = nodes[place]
        d = distance(points[who], v).astype(np.int64)
        go = d <= cut + radius
        todo.append((inside, who[go], own[go] & (d[go] <= cut)))
        go = d > cut - radius
        todo.append((outside, who[go], own[go] & (d[go] > cut)))
    who = np.concatenate([w for w, _, _ in visits] or [np.zeros(0, np.int64)])
    shard = np.concatenate([np.full(len(w), s) for w, s, _ in visits] or [np.zeros(0, np.int64)])
    own = np.concatenate([o for _, _, o in visits] or [np.zeros(0, bool)])
    go = own | (shard > home[who])
    return who[go], shard[go], own[go]


class Forest:
    """Components of the links fed in; links are contracted in bulk."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.a: list[np.ndarray] = []
        self.b: list[np.ndarray] = []
        self.held = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if not len(a):
            return
        a, b = self.root[a], self.root[b]
        keep = a != b
        self.a.append(a[keep])
        self.b.append(b[keep])
        self.held += int(keep.sum())
        if self.held > 1_000_000:
            self.settle()

    def settle(self) -> None:
        a, b = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (self.a, self.b))
        self.a, self.b, self.held = [], [], 0
        root = self.root
        while True:
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root = up
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                break
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        self.root = root


def search(points: np.ndarray, visitors: np.ndarray, radius: int, leaf: int, seed: int = 5) -> Forest:
    """Links within ``radius`` among ``points`` and from ``visitors`` to them, as a forest over both, in that order."""
    everyone = np.concatenate([points, visitors])
    forest = Forest(len(everyone))
    random = np.random.default_rng(seed)
    todo = [(np.arange(len(points)), np.arange(len(everyone)))]
    while todo:
        here, asking = todo.pop()
        if not len(here) or not len(asking):
            continue
        found = vantage(everyone[here], random) if len(here) > leaf else None
        if found is None:
            for k in range(0, len(asking), 4096):
                part = asking[k : k + 4096]
                for j in range(0, len(here), 1024):
                    i, m = np.nonzero(distance(everyone[part][:, None], everyone[here[j : j + 1024]][None, :]) <= radius)
                    forest.add(part[i], here[j : j + 1024][m])
            continue
        v, cut = found
        d, ask = distance(everyone[here], v).astype(np.int64), distance(everyone[asking], v).astype(np.int64)
        todo.append((here[d <= cut], asking[ask <= cut + radius]))
        todo.append((here[d > cut], asking[ask > cut - radius]))
    forest.settle()
    return forest


def grafted(top: list[tuple], below: dict[int, list[tuple]]) -> list[tuple]:
    """A router with its leaves numbered anew, after some have been replaced by routers of their own."""
    nodes, leaves = list(top), 0
    for place, node in enumerate(top):
        if node[0] is not None:
            continue
        own = below.get(node[1], [(None, 0)])
        moved = {0: place} | {i: len(nodes) + i - 1 for i in range(1, len(own))}
        nodes += [()] * (len(own) - 1)
        for i, x in enumerate(own):
            if x[0] is None:
                nodes[moved[i]] = (None, leaves)
                leaves += 1
            else:
                nodes[moved[i]] = (x[0], x[1], moved[x[2]], moved[x[3]])
    return nodes


def whole_router(distinct: DataFrame, settings: Search) -> list[tuple]:
    """The router over all fingerprints; a node takes some 40 bytes, and there are two for each shard."""
    s = settings
    n = distinct.count()
    want = -(-n // s.shard)
    sampled = distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(s.sample)
    top = router(np.array([r.fp for r in sampled.collect()], np.int64).view(np.uint64), min(want, s.top))
    if want <= s.top:
        return top
    shared = distinct.sparkSession.sparkContext.broadcast(top)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column("fp").to_numpy().view(np.uint64)
            who, leaf, own = route(shared.value, points, 0)
            yield pa.record_batch([pa.array(points[who[own]].view(np.int64)), pa.array(leaf[own])], names=["fp", "leaf"])

    def build(rows: pa.Table) -> pa.Table:
        nodes = router(np.sort(rows["fp"].to_numpy().view(np.uint64)), -(-len(rows) // s.each))
        return pa.table({"leaf": rows["leaf"][:1].combine_chunks(), "nodes": pa.array([pickle.dumps(nodes)], pa.binary())})

    some = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(max(1, s.shard // s.each))) == 0).select("fp")
    rows = some.mapInArrow(home, "fp long, leaf long").groupBy("leaf").applyInArrow(build, "leaf long, nodes binary").collect()
    return grafted(top, {r.leaf: pickle.loads(r.nodes) for r in rows})


def links(distinct: DataFrame, settings: Search = Search()) -> DataFrame:
    """(a, b): links that connect what is within the radius, among distinct fingerprints ``fp``."""
    s = settings
    shared = distinct.sparkSession.sparkContext.broadcast(whole_router(distinct, s))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column("fp").to_numpy().view(np.uint64)
            who, shard, own = route(shared.value, points, s.radius)
            yield pa.record_batch([pa.array(points[who].view(np.int64)), pa.array(shard), pa.array(own)], names=["fp", "shard", "own"])

    def join(rows: pa.Table) -> pa.Table:
        fp = rows["fp"].to_numpy().view(np.uint64)
        own = rows["own"].to_numpy()
        both = np.concatenate([fp[own], fp[~own]])
        forest = search(fp[own], fp[~own], s.radius, s.leaf)
        linked = np.flatnonzero(forest.root != np.arange(len(both)))
        return pa.table({"a": both[linked].view(np.int64), "b": both[forest.root[linked]].view(np.int64)})

    sent = distinct.select("fp").mapInArrow(send, "fp long, shard long, own boolean")
    return sent.groupBy("shard").applyInArrow(join, "a long, b long")


def named(marks: DataFrame, settings: Search = Search()) -> DataFrame:
    """(fp, root, component_id) of each distinct fingerprint of ``marks`` (doc_id, fp): the id is the smallest that links reach, null if all are null."""
    distinct = stored(marks.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    parts = stored(components(links(distinct, settings)), "simhash-parts")
    own = distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = own.groupBy("root").agg(F.min("first").alias("component_id"))
    return stored(own.join(least, "root").select("fp", "root", "component_id"), "simhash-known")


def groups(documents: DataFrame, settings: Search = Search()) -> DataFrame:
    """One row per document: doc_id, fp, component_id."""
    marks = stored(fingerprints(documents), "simhash")
    return marks.join(named(marks, settings), "fp").select("doc_id", "fp", "component_id")


def deduplicated(documents: DataFrame, settings: Search = Search()) -> DataFrame:
    """``documents`` with one row of each component, see :func:`tagweft.llm.shared.first_of_groups`."""
    marks = stored(fingerprints(documents), "simhash")
    return first_of_groups(documents, marks.join(named(marks, settings), "fp").select("root", "doc_id", "key"), TEXT_KEY("text"))
