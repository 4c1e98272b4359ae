"""Benchmark decontamination: a BM25 inverted index of test items, searched with block-max WAND.

Words are runs of ASCII letters, digits and non-ASCII characters, lower-cased by
Arrow, for items and texts alike. A
text is cut into passages of twice the longest item's words that overlap by half,
so every item that a text holds lies whole in some passage. Each passage is a query
against the index, whose scores are scaled so that an item scores 1 against itself;
all items at ``Settings.threshold`` or above are retrieved, by skipping what block
maxima rule out, never by a top-k.

Each item leaves out its most frequent terms, up to ``Settings.common`` of the threshold,
from the lists that open blocks: an item can reach the threshold only if a passage has
some of its other, essential terms. So a passage meets the blocks of its own rare terms
alone, and its work does not grow with the items it has nothing to do with. A block is
searched if the block maxima of the passage's essential terms, with the most that
common terms can add there, reach the threshold. A retrieved item counts as leaked if its
question (all but its last third of words) and its answer (the rest) each have at
least ``overlap`` of their five-word shingles in that passage (parts of fewer words:
the whole part).

Null or empty texts and items without words match nothing; an empty table gives an
empty one, and texts of any length are cut like others. Repeated items or rows give
repeated findings, ties all count, and other columns are never read. The index is made
and broadcast in parts of at most ``part_items`` items, whose words are bounded by
``part_words``; more items mean more parts, each a pass of its own over the texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame

from . import words
from .shared import stored


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.7
    common: float = 0.5
    overlap: float = 0.8
    shingle: int = 5
    k1: float = 1.2
    b: float = 0.75
    block: int = 8
    part_items: int = 50_000
    part_words: int = 4_000_000


WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True


def tokens(texts: list[str | None]) -> list[list[bytes]]:
    """The words of each text."""
    return [WORD.findall((x.as_py() or "").encode()) for x in pc.utf8_lower(pa.array(texts, pa.string()))]


def parts_of(item: list[bytes]) -> tuple[list[bytes], list[bytes]]:
    """Question and answer: the last third of the words is the answer."""
    cut = len(item) - len(item) // 3
    return item[:cut], item[cut:]


def shingles(part: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    return {tuple(part[i : i + size]) for i in range(max(1, len(part) - size + 1))} if part else set()


@dataclass
class Index:
    """Postings by term, ordered by item, and for each term its blocks of items with their largest weight.

    A block is ``settings.block`` consecutive items. ``at`` to ``block_most`` are those
    of the essential postings alone; the others' weights sum up to ``common_most`` in
    each block at most.
    """

    settings: Settings
    ids: list = field(default_factory=list)
    items: list[list[bytes]] = field(default_factory=list)
    terms: dict[bytes, int] = field(default_factory=dict)
    postings: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    blocks: list[dict[int, tuple[int, int, float]]] = field(default_factory=list)  # block: postings from, to, largest weight
    n_blocks: int = 0
    longest: int = 0
    hashes: np.ndarray | None = None  # of terms, sorted
    order: np.ndarray | None = None  # term number of each
    at: np.ndarray | None = None  # where the essential blocks of each term begin in the next two
    block_no: np.ndarray | None = None
    block_most: np.ndarray | None = None
    common_most: np.ndarray | None = None


def build(rows: list[tuple], settings: Settings, n_items: int | None = None, df: Counter | None = None, mean: float | None = None) -> Index:
    """Index (item_id, text) rows; the counts of the whole benchmark go with a part of it."""
    index = Index(settings)
    for (item_id, _), got in zip(rows, tokens([t for _, t in rows])):
        if got:
            index.ids.append(item_id)
            index.items.append(got)
    df = df or Counter(t for item in index.items for t in set(item))
    n_items = n_items or len(index.items)
    mean = mean or (sum(map(len, index.items)) / max(1, len(index.items)))
    lists: dict[bytes, list[tuple[int, float, bool]]] = defaultdict(list)
    common_sum = np.zeros(len(index.items))
    for i, item in enumerate(index.items):
        index.longest = max(index.longest, len(item))
        weight = {}
        for term, n in Counter(item).items():
            idf = math.log(1 + (n_items - df[term] + 0.5) / (df[term] + 0.5))
            weight[term] = idf * n * (settings.k1 + 1) / (n + settings.k1 * (1 - settings.b + settings.b * len(item) / mean))
        whole = sum(weight.values())
        for term in sorted(weight, key=lambda t: (-df[t], t)):
            w = weight[term] / whole
            essential = common_sum[i] + w > settings.common * settings.threshold
            if not essential:
                common_sum[i] += w
            lists[term].append((i, w, essential))
    index.n_blocks = -(-len(index.items) // settings.block)
    at, block_no, block_most = [0], [], []
    for term, found in lists.items():
        index.terms[term] = len(index.postings)
        who, w, essential = (np.array(x) for x in zip(*found))
        index.postings.append((who, w))
        no, first = np.unique(who // settings.block, return_index=True)
        most, end = np.maximum.reduceat(w, first), [*first[1:], len(who)]
        index.blocks.append({int(b): (int(f), int(e), float(m)) for b, f, e, m in zip(no, first, end, most)})
        if essential.any():
            no, first = np.unique(who[essential] // settings.block, return_index=True)
            block_no.append(no)
            block_most.append(np.maximum.reduceat(w[essential], first))
        at.append(at[-1] + (len(no) if essential.any() else 0))
    if index.terms:
        data = np.frombuffer(b" ".join(index.terms), np.uint8)
        hashed = words.word_hashes(words.split(data, np.array([0, len(data)])))
        index.order = np.argsort(hashed)
        index.hashes = hashed[index.order]
        index.at = np.array(at)
        index.block_no = np.concatenate([*block_no, np.zeros(0, np.int64)]).astype(np.int64)
        index.block_most = np.concatenate([*block_most, np.zeros(0)])
        index.common_most = np.maximum.reduceat(common_sum, np.arange(0, len(common_sum), settings.block))
    return index


def wand(index: Index, query: list[int], block: int) -> list[tuple[int, float]]:
    """All (item, score) of a block at the threshold or above for a set of term numbers."""
    need = index.settings.threshold - 1e-9
    lists = []  # place, end, bound, items, weights
    for t in query:
        part = index.blocks[t].get(block)
        if part:
            lists.append([part[0], part[1], part[2], *index.postings[t]])
    out: list[tuple[int, float]] = []
    if sum(x[2] for x in lists) < need:
        return out
    while True:
        lists = [x for x in lists if x[0] < x[1]]
        lists.sort(key=lambda x: x[3][x[0]])
        total, pivot = 0.0, -1
        for k, x in enumerate(lists):
            total += x[2]
            if total >= need:
                pivot = k
                break
        if pivot < 0:
            return out
        item = lists[pivot][3][lists[pivot][0]]
        if lists[0][3][lists[0][0]] == item:
            score = 0.0
            for x in lists:
                if x[3][x[0]] != item:
                    break
                score += x[4][x[0]]
                x[0] += 1
            if score >= need:
                out.append((int(item), float(score)))
        else:
            for x in lists[:pivot]:
                x[0] += int(np.searchsorted(x[3][x[0] : x[1]], item))


def passages(block: words.Block, index: Index) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(text, first word, end, item blocks) of the passages whose bound reaches the threshold in some block.

    A passage is two neighbouring segments of the longest item's words. Only pairs of a
    passage and a block that share an essential term are made.
    """
    hashed = words.word_hashes(block)
    place = np.minimum(np.searchsorted(index.hashes, hashed), len(index.hashes) - 1)
    hit = np.flatnonzero(index.hashes[place] == hashed)
    term = index.order[place[hit]]
    opens = index.at[term + 1] > index.at[term]
    hit, term = hit[opens], term[opens]
    if not len(hit):
        return
    counts, step, n_terms = block.counts(), index.longest, len(index.terms)
    n = -(-counts // step)  # segments of each text
    at = np.cumsum(n) - n
    owner = np.repeat(np.arange(len(counts)), n)
    within = np.arange(len(owner)) - at[owner]
    doc = block.doc_of_word()[hit]
    key = np.unique((at[doc] + (hit - block.bounds[:-1][doc]) // step) * n_terms + term)
    later = key[within[key // n_terms] > 0] - n_terms  # the passage of the segment before has them too
    key = np.unique(np.concatenate([key, later]))
    passage, term = key // n_terms, key % n_terms
    whole = (within[passage] == 0) | (within[passage] < n[owner[passage]] - 1)  # a last segment is in the passage before
    passage, term = passage[whole], term[whole]
    size = index.at[term + 1] - index.at[term]
    from_ = np.repeat(index.at[term] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    pair, place = np.unique(np.repeat(passage, size) * index.n_blocks + index.block_no[from_], return_inverse=True)
    bound = np.bincount(place, index.block_most[from_], len(pair)) + index.common_most[pair % index.n_blocks]
    pair = pair[bound >= index.settings.threshold - 1e-6]
    found, first_pair = np.unique(pair // index.n_blocks, return_index=True)
    for k, item_blocks in zip(found.tolist(), np.split(pair % index.n_blocks, first_pair[1:])):
        d = owner[k]
        first = block.bounds[d] + within[k] * step
        yield int(d), int(first), int(min(first + 2 * step, block.bounds[d + 1])), item_blocks


def leaks(index: Index, passage: list[bytes], item_blocks: np.ndarray) -> Iterator[tuple[int, float, float, float]]:
    """(item, score, question overlap, answer overlap) of the items in some blocks that a passage holds."""
    s = index.settings
    known = sorted({index.terms[t] for t in set(passage) if t in index.terms})
    for item, score in (x for b in item_blocks for x in wand(index, known, int(b))):
        shares = []
        for part in parts_of(index.items[item]):
            want = shingles(part, s.shingle)
            size = min(s.shingle, len(part))
            have = {tuple(passage[i : i + size]) for i in range(len(passage) - size + 1)}
            shares.append(len(want & have) / len(want) if want else 1.0)
        if min(shares) >= s.overlap:
            yield item, score, shares[0], shares[1]


def _found(column: pa.Array, index: Index) -> Iterator[tuple[int, int, float, float, float, int]]:
    """(row, item, score, question, answer, first word) of a column of lower-case texts, each item's best passage only."""
    if not index.items:
        return
    data, at = words.text_buffers(column)
    table = np.where(_IN_WORD, np.arange(256), 32).astype(np.uint8)
    row, rows = 0, len(at) - 1
    size = 1 << 20
    while row < rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + size, "right")) - 1)
        block = words.split(table[data[at[row] : at[end]]], at[row : end + 1] - at[row])
        best: dict[tuple[int, int], tuple] = {}
        for doc, first, stop, item_blocks in passages(block, index):
            got = block.data[block.starts[first] : block.ends[stop - 1]].tobytes().split()
            for item, *values in leaks(index, got, item_blocks):
                key = (row + doc, item)
                if key not in best or values[0] > best[key][0]:
                    best[key] = (*values, first - int(block.bounds[doc]))
        for (r, item), values in sorted(best.items()):
            yield r, item, *values
        row = end


def indexes(benchmark: DataFrame, settings: Settings) -> Iterator[Index]:
    """The benchmark in parts of bounded size, one after the other; statistics are those of all items.

    Items are read twice, a few at a time: the driver holds their words' counts and one part.
    """

    def rows() -> Iterator[tuple]:
        return ((r.item_id, r.text) for r in benchmark.select("item_id", "text").toLocalIterator())

    df, n, total = Counter(), 0, 0
    for _, text in rows():
        item = tokens([text])[0]
        df.update(set(item))
        n, total = n + bool(item), total + len(item)
    group, size = [], 0
    for row in rows():
        length = len(tokens([row[1]])[0])
        if group and (len(group) >= settings.part_items or size + length > settings.part_words):
            yield build(group, settings, n, df, total / max(1, n))
            group, size = [], 0
        group.append(row)
        size += length
    yield build(group, settings, n, df, total / max(1, n))


def findings(documents: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, first_word): each item that each text leaks."""
    spark = documents.sparkSession
    kinds = documents.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType
    schema = f"doc_id {kinds[0]}, item_id {kinds[1].simpleString()}, score double, question_overlap double, answer_overlap double, first_word long"

    def one(shared: Broadcast) -> DataFrame:
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids = shared.value.ids
            for batch in batches:
                got = list(_found(pc.utf8_lower(batch.column("text")), shared.value))
                take = [list(x) for x in zip(*got)] or [[] for _ in range(6)]
                columns = [batch.column("doc_id").take(pa.array(take[0], pa.int64())), pa.array([ids[i] for i in take[1]])]
                yield pa.RecordBatch.from_arrays([columns[0], columns[1].cast(_arrow(kinds[1])), *(pa.array(x, pa.float64()) for x in take[2:5]), pa.array(take[5], pa.int64())], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"])

        return documents.select("doc_id", "text").mapInArrow(find, schema)

    every, held = None, None
    for index in indexes(benchmark, settings):
        if held is not None:  # more than one part: each is done before the next is made
            found = stored(one(held), "leaks")
            held.destroy()
            every = found if every is None else every.union(found)
        held = spark.sparkContext.broadcast(index)
    return one(held) if every is None else every.union(one(held))


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def clean(documents: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows that leak nothing, judged row by row in one pass a part, with all their columns."""
    names = documents.columns
    where = names.index("text")
    for index in indexes(benchmark, settings):
        shared = documents.sparkSession.sparkContext.broadcast(index)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                stays = np.ones(batch.num_rows, bool)
                stays[[r for r, *_ in _found(pc.utf8_lower(batch.column(where)), shared.value)]] = False
                yield batch.filter(pa.array(stays))

        documents = documents.mapInArrow(keep, documents.schema)
    return documents
