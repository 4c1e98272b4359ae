import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tagweft.llm import decontaminate, exact_dedup, near_copies, shared, simhash, site_tree, substrings, words
from tagweft.llm.shared import ship

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(autouse=True)
def package(spark):
    ship(spark)


def docs(spark, texts, ids=None):
    ids = ids if ids is not None else range(len(texts))
    return spark.createDataFrame([(i, t, None, "s", None) for i, t in zip(ids, texts)], DOCS)


# --- exact dedup


@pytest.mark.parametrize("bits, capacity", [(64, 50_000), (64, 3), (5, 3), (2, 4)])
def test_exact(spark, bits, capacity):
    rng = random.Random(bits)
    texts = [rng.choice(["a  b", "a b", "a\tb", "c", None, "", " ", f"t{rng.randint(0, 40)}", "é" * 5000]) for _ in range(150)]
    ids = [rng.choice([None, *range(60)]) for _ in texts]
    frame = docs(spark, texts, ids).withColumn("key", F.lit("clash")).repartition(5)
    rows = exact_dedup.groups(frame, hash_bits=bits, capacity=capacity).collect()
    plain = {}
    for i, t in zip(ids, texts):
        plain.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", t or ""), []).append(i)
    want = {hashlib.sha256(k.encode()).hexdigest(): (min((i for i in v if i is not None), default=None), len(v)) for k, v in plain.items()}
    assert len(rows) == 150
    for r in rows:
        assert (r.keep_id, r.group_size) == want[r.text_sha256]
    kept = [r for r in rows if r.kept]
    assert len(kept) == len(want) and all(r.doc_id == r.keep_id for r in kept)
    left = exact_dedup.deduplicated(frame).collect()
    assert len(left) == len(want) and left[0].asDict().keys() == set(frame.columns)


def test_exact_splits_buckets(spark):
    frame = docs(spark, [f"text {i}" for i in range(200)])
    table = exact_dedup.entries(frame)
    every = table.select("key", "sha", F.lit(1).cast("long").alias("rows"), F.struct(F.lit(False).alias("last"), F.col("doc_id").alias("id")).alias("first"), F.col("row_no").alias("first_row"))
    found = exact_dedup.index(every, capacity=20).collect()
    assert len(found) == 200 and min(r.depth for r in found) >= 3
    sizes = {}
    for r in found:
        sizes[r.lowest, r.depth] = sizes.get((r.lowest, r.depth), 0) + 1
        assert ((r.key ^ r.lowest) & ((1 << 64) - 1)) >> (64 - r.depth) == 0
    assert max(sizes.values()) <= 20
    assert exact_dedup.groups(frame.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [18, 3])
def test_filter(spark, monkeypatch, bits):
    monkeypatch.setattr(shared, "MOST_BITS", bits)
    keys = shared.stored(spark.range(0, 3000, 3).select(F.col("id").alias("key")), "keys")
    rows = spark.range(3000).select("id", F.lit("x").alias("filter_at"), F.lit("y").alias("May_be"))
    got = shared.possibly(rows, F.col("id"), keys)
    some = {r.id for r in got.collect()}
    assert got.columns == rows.columns and some >= set(range(0, 3000, 3)) and (len(some) < 1100 if bits == 18 else len(some) <= 3000)
    assert shared.possibly(rows, F.col("id"), shared.stored(keys.limit(0), "keys")).count() == 0
    lost = spark.createDataFrame([(5, 50), (None, 60), (7, 71)], "doc_id long, key long")
    frame = spark.createDataFrame([(5, "a", 50), (5, "b", 51), (None, "c", 60), (None, "d", 61), (7, "e", 70)], "doc_id long, text string, may_be long")
    assert sorted(r.text for r in shared.without(frame, lost, F.col("may_be")).collect()) == ["b", "d", "e"]


# --- SimHash


def plain_fingerprint(text):
    w = re.sub(r"[A-Z]+", lambda m: m[0].lower(), text or "").encode().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.none() | st.text(alphabet="aBé \n\t", max_size=40), min_size=1, max_size=6))
def test_fingerprints(texts):
    got = [int(x) for b in words.blocks(pa.array(texts, pa.string()), lower=True, size=50) for x in simhash.fingerprints_of(b)]
    assert got == [plain_fingerprint(t) for t in texts]


def near_points(n, seed):
    rng = np.random.default_rng(seed)
    points = rng.integers(0, 1 << 63, n // 4, dtype=np.uint64)
    out = [points]
    for _ in range(4):
        x = points[rng.integers(0, len(points), n // 4)].copy()
        for _ in range(rng.integers(1, 5)):
            x ^= np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64)
        out.append(x)
    return np.unique(np.concatenate(out))


def plain_roots(points, radius=3):
    root = np.arange(len(points))
    for _ in range(len(points)):
        new = root.copy()
        for i in range(len(points)):
            near = np.bitwise_count(points ^ points[i]) <= radius
            new[i] = root[near].min()
        if np.array_equal(new, root):
            return root
        root = new


@pytest.mark.parametrize("shards", [1, 9, 14])
def test_routing_and_search(shards):
    points = near_points(1200, shards)
    nodes = simhash.router(points[::3], min(shards, 9))
    if shards > 9:  # some leaves get routers of their own
        _, leaf, own = simhash.route(nodes, points, 0)
        nodes = simhash.grafted(nodes, {i: simhash.router(points[leaf == i], 3 if i < 2 else 2) for i in range(4)})
        shards = sum(x[0] is None for x in nodes)
        assert shards == 15 and sorted(x[1] for x in nodes if x[0] is None) == list(range(15))
    who, shard, own = simhash.route(nodes, points, 3)
    assert sorted(who[own].tolist()) == list(range(len(points)))
    forest = simhash.Forest(len(points))
    for s in range(shards):
        at = shard == s
        members = np.concatenate([who[at & own], who[at & ~own]])
        f = simhash.search(points[who[at & own]], points[who[at & ~own]], 3, leaf=16)
        forest.add(members, members[f.root])
    forest.settle()
    assert np.array_equal(forest.root, plain_roots(points))


def test_near_groups(spark):
    rng = random.Random(9)
    base = [" ".join("".join(rng.choices("abcdef", k=4)) for _ in range(300)) for _ in range(12)]
    texts = base + [b.replace(" ", "  ", 3) for b in base] + [b + " tail" for b in base] + [None, "", "x", "X"]
    ids = [*range(len(texts) - 1), None]
    rows = simhash.groups(docs(spark, texts, ids), simhash.Search(shard=10, leaf=4)).collect()
    fp = np.array([plain_fingerprint(t) for t in texts], np.uint64)
    order = sorted(set(fp.tolist()))
    root = plain_roots(np.array(order, np.uint64))
    group = {x: order[root[i]] for i, x in enumerate(order)}
    least = {}
    for i, x in zip(ids, fp.tolist()):
        if i is not None:
            least[group[x]] = min(i, least.get(group[x], i))
    by = dict(zip(ids, fp.tolist()))
    assert len(rows) == len(texts)
    for r in rows:
        assert r.fp & ((1 << 64) - 1) == by[r.doc_id] and r.component_id == least[group[by[r.doc_id]]]
    deep = simhash.groups(docs(spark, texts, ids), simhash.Search(shard=5, leaf=4, top=2, each=5))
    assert sorted(map(repr, deep.collect())) == sorted(map(repr, rows))
    left = simhash.deduplicated(docs(spark, texts, ids), simhash.Search(shard=10, leaf=4))
    assert {r.doc_id for r in left.collect()} - {None} == set(least.values())
    assert simhash.groups(docs(spark, texts).limit(0)).count() == 0


# --- near copies of the pipeline


def plain_shingles(text):
    own = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))}


def test_near_copies(spark, monkeypatch):
    rng = random.Random(4)
    menu = " ".join(f"menu{i}" for i in range(30))
    texts = [None, "", " ", "x", "X", "a b c d e", "A B  c d e"]
    for k in range(25):
        own = [f"w{rng.randint(0, 3000)}" for _ in range(rng.choice([7, 40, 200]))] + (menu.split() if k % 3 else [])
        for _ in range(5):
            some = list(own)
            for _ in range(rng.randint(0, 1 + len(own) // 60)):
                some[rng.randrange(len(some))] = f"n{rng.randint(0, 10**6)}"
            texts.append(" ".join(some))
    ids = [i if rng.random() < 0.9 else rng.choice([None, 3, 20]) for i in range(len(texts))]
    frame = docs(spark, [*texts, texts[-1]], [*ids, ids[-1]])
    shingles = [plain_shingles(t) for t in texts]
    root = list(range(len(texts)))
    pairs = 0
    for i in range(len(texts)):
        for j in range(i):
            if 9 * len(shingles[i] & shingles[j]) >= 4 * (len(shingles[i]) + len(shingles[j])):
                pairs += shingles[i] != shingles[j]
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert pairs > 50
    least = {}
    for i, r in zip(ids, root):
        least.setdefault(r, []).append(i)
    want = sorted((i is None, i or 0) for i in (min((x for x in v if x is not None), default=None) for v in least.values()))
    for sample in (near_copies.SAMPLE, 40):
        monkeypatch.setattr(near_copies, "SAMPLE", sample)
        monkeypatch.setattr(near_copies, "BROADCAST", sample)
        monkeypatch.setattr(near_copies, "PIVOT", 12 if sample == 40 else 2)
        left = corpus_pipeline.near_duplicates(spark, frame, "")
        assert left.columns == frame.columns
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in left.collect()) == want
    assert corpus_pipeline.near_duplicates(spark, frame.limit(0), "").count() == 0


# --- substrings


def plain_removed(rows, length):
    seen, out = {}, []
    ordered = [(i if i is not None else 2**63 - 1, (t or "").encode().split()) for i, t in rows]
    for i, w in ordered:
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            seen[key] = min(i, seen.get(key, i))
    for i, w in ordered:
        gone = set()
        for k in range(len(w) - length + 1):
            if seen[tuple(w[k : k + length])] < i:
                gone.update(range(k, k + length))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed, length", [(1, 8), (2, 7), (3, 50)])
def test_substrings(spark, seed, length):
    rng = random.Random(seed)
    pool = [[rng.choice("abc") for _ in range(rng.randint(length, 3 * length))] for _ in range(6)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(rng.randint(0, 4)):
            part = rng.choice(pool)
            cut = rng.randint(0, 4)
            w += part[cut:] if rng.random() < 0.6 else [f"w{rng.randint(0, 999)}" for _ in range(rng.randint(1, length))]
        rows.append((rng.choice([i, i, None, 3]), " ".join(w).replace(" ", "\n", 1)))
    rows += [(70, None), (71, ""), (72, "same " * 500), (73, "same " * 500), (73, "same " * 500), (74, "same " * 40)]
    frame = docs(spark, [t for _, t in rows], [i for i, _ in rows]).withColumn("sha", F.lit("clash")).repartition(3)
    got = substrings.removed(frame, length)
    assert sorted((r.doc_id if r.doc_id is not None else 2**63 - 1, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == plain_removed(rows, length)
    assert substrings.removed(frame.limit(0), length).count() == 0


def test_grown(spark):
    rng = random.Random(2)
    shared = [f"s{rng.randint(0, 10**6)}" for _ in range(45)]
    texts = [" ".join(["a", *shared, "b"]), " ".join(["c", "d", *shared]), " ".join(shared[:12]), "x " * 9, None, " ".join(["a", *shared, "b"])]
    rows = substrings.removed(docs(spark, texts), 10).collect()
    assert {r.doc_id: r.longest_repeat for r in rows} == {0: 40, 1: 40, 2: 10, 3: 0, 4: 0, 5: 40}


# --- decontamination


def bench(spark, items):
    return spark.createDataFrame(list(enumerate(items)), "item_id long, text string")


def plain_scores(index, passage):
    score = {}
    for term in set(passage):
        if term in index.terms:
            for item, w in zip(*index.postings[index.terms[term]]):
                score[int(item)] = score.get(int(item), 0) + w
    return score


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.7])
def test_wand(threshold):
    rng = random.Random(6)
    vocabulary = ["the", "of", "a"] * 8 + [f"w{i}" for i in range(120)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(5, 25)))) for i in range(60)] + [(60, "the of a the"), (61, "the"), (62, None), (63, "")]
    index = decontaminate.build(items, decontaminate.Settings(threshold=threshold, block=4))
    hits = 0
    for _ in range(60):
        passage = (" ".join(rng.choices(vocabulary, k=15)) + " " + (rng.choice(items)[1] or "")).encode().split()
        known = sorted({index.terms[t] for t in passage if t in index.terms})
        got = {i: s for b in range(index.n_blocks) for i, s in decontaminate.wand(index, known, b)}
        want = {i: s for i, s in plain_scores(index, passage).items() if s >= threshold - 1e-9}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in got)
        hits += len(got)
        data = np.frombuffer(b" ".join(passage), np.uint8)
        block = words.split(data, np.array([0, len(data)]))
        bounds = {(f, e): set(b.tolist()) for _, f, e, b in decontaminate.passages(block, index)}
        for (first, end), blocks in bounds.items():
            scores = plain_scores(index, passage[first:end])
            assert {i // 4 for i, s in scores.items() if s >= threshold} <= blocks
    assert hits >= 60


def test_leaks(spark):
    rng = random.Random(7)
    make = lambda n: " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(n))
    items = [make(rng.randint(15, 40)).capitalize() + "." for _ in range(28)]
    items += ["ΤΟΥΣ ΛΟΓΟΥΣ " + make(12) + " ΟΔΟΣ", "İstanbul ŞIŞLI " + make(12) + " DİYE", "", None, "two words"]
    filler = [make(rng.randint(0, 300)) for _ in range(30)]
    half = " ".join(items[3].split()[: len(items[3].split()) // 2])
    texts = [f + " " + items[i].upper().replace(" ", "\n  ") + " " + f for i, f in enumerate(filler)] + filler + [half, None, "", items[5] + " " + make(400) + " " + items[6]]
    found = decontaminate.findings(docs(spark, texts).withColumn("item_id", F.lit("clash")), bench(spark, items)).collect()
    want = {(i, i) for i in range(30)} | {(len(texts) - 1, 5), (len(texts) - 1, 6)}
    assert {(r.doc_id, r.item_id) for r in found} == want and len(found) == len(want)
    parts = decontaminate.findings(docs(spark, texts), bench(spark, items), decontaminate.Settings(part_items=7)).collect()
    assert {(r.doc_id, r.item_id, round(r.score, 9)) for r in parts} == {(r.doc_id, r.item_id, round(r.score, 9)) for r in found}
    left = decontaminate.clean(docs(spark, texts), bench(spark, items))
    assert {r.doc_id for r in left.collect()} == set(range(len(texts))) - {d for d, _ in want}
    assert decontaminate.findings(docs(spark, texts).limit(0), bench(spark, items)).count() == 0
    assert decontaminate.findings(docs(spark, texts), bench(spark, items).limit(0)).count() == 0
    assert decontaminate.clean(docs(spark, texts), bench(spark, items).limit(0)).count() == len(texts)


# --- HTML


def extract(html):
    return "\n".join(site_tree.blocks(site_tree.parse(html), frozenset()))


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""),
        ("", ""),
        ("just &lt;text&gt; &amp; more", "just <text> & more"),
        ("<nav>menu</nav><article><h1>T &am</h1><p><b>one<br><p>two&nbsp;\n  x</p></article><footer>f</footer>", "T &am\none\ntwo x"),
        ("<body><header>h</header><div class='sidebar'>s</div><div><p>text</p><div id='comments'>c</div></div></body>", "text"),
        ("<article><header><h1>Title</h1></header><p>a</p><aside>x</aside><form>f</form><div class='ad'>ad</div><section class='comments'><article class='comment'><p>r</p></article></section></article>", "Title\na"),
        ("<script>var t='</p>';x('<p>no</p>')</script><p>yes<style>p{}</style></p>", "yes"),
        ("<main><div role='navigation'>n</div><p>m<span> n</span></p><ul><li>1<li>2</ul></main>", "m n\n1\n2"),
        ("<p>open <b>bold<p>next</div></p>tail", "open bold\nnext\ntail"),
        ("<div class='shared-heading'><p>stays</p></div><div class='download'>too</div>", "stays\ntoo"),
        ("<article><p>a</p><div class='cookie-notice'>n</div><!-- c --></article><article><p>b</p></article>", "a\nb"),
    ],
)
def test_blocks(html, text):
    assert extract(html) == text


def test_site_tree(spark):
    rng = random.Random(1)
    say = lambda n: " ".join("".join(rng.choices("abcdef", k=5)) for _ in range(n))
    body = [say(20) for _ in range(30)]
    rows = [(i, "https://a.example/x", f"<body><div class='lead'>Best site ever</div><div class='text'><p>{b}</p></div></body>") for i, b in enumerate(body)]
    rows += [(100 + i, "HTTP://user@B.example:80/", f"<div class='lead'>Best site ever</div><p>{b}</p>") for i, b in enumerate(body[:3])]
    rows += [(200 + i, "https://c.example", f"<article><div class='text'><p>{body[0]}</p></div></article>") for i in range(20)]
    rows += [(300, None, None), (300, None, None), (None, "x", "<p>" + "long " * 100_000 + "</p>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    for hosts in (20_000, 0):
        got = site_tree.extracted(frame, site_tree.Settings(broadcast_rows=hosts)).collect()
        by = {r.page_id: r.text for r in got}
        assert len(got) == len(rows)
        assert all(by[i] == b for i, b in enumerate(body))
        assert all(by[100 + i] == f"Best site ever\n{b}" for i, b in enumerate(body[:3]))
        assert all(by[200 + i] == body[0] for i in range(20))
        assert by[300] == "" and len(by[None]) == 499_999
    assert site_tree.extracted(frame.limit(0)).count() == 0


def plain_importance(htmls, settings=site_tree.Settings()):
    """Composite importance of each path of one host, by recursion over whole pages."""
    pages = [site_tree.style_rows(site_tree.parse(h), settings.levels) for h in dict.fromkeys(htmls)]
    paths = {}
    for page in pages:
        for path, (above, *_) in page.items():
            paths[path] = above
    shared = {p for p in paths if sum(p in page for page in pages) >= settings.pages}

    def entropy(counts, m):
        total = sum(counts)
        return -sum(c / total * math.log(c / total) for c in counts) / math.log(m) if m > 1 else 0

    def value(path):
        own = [page[path] for page in pages if path in page]
        m, looks = len(own), Counter(x[1] for x in own)
        terms = {t for x in own for t in x[3]}
        spread = [entropy([x[3][t] for x in own if t in x[3]], m) for t in terms]
        content = 1 - sum(spread) / len(spread) if spread else 0
        texts, kinds = sum(bool(x[3]) for x in own), sum(x[2] for x in own)
        children = [c for c in shared if paths[c] and paths[c][-1] == path]
        n = {c: sum(c in page for page in pages) for c in children}
        parts = texts * content + (kinds - sum(n.values())) + sum(n[c] * value(c) for c in children)
        left = settings.decay ** len(looks)
        return (1 - left) * entropy(looks.values(), m) + (left * parts / (kinds + texts) if kinds + texts else 0)

    def most(path):
        own = [page[path] for page in pages if path in page]
        children = [c for c in shared if paths[c] and paths[c][-1] == path]
        apart = sum(x[2] for x in own) - sum(sum(c in page for page in pages) for c in children)
        return max([value(path), min(1, apart / len(own)), *map(most, children)])

    return {p: (value(p), most(p)) for p in shared}


def varied_site(rng, n=24):
    """Pages whose furniture declares nothing and differs from page to page, beside articles that no tag marks."""
    pool = ["Home", "News", "About us", "Prices", "Contact", "Jobs", "Archive"]
    say = lambda k: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(k))
    rows, bodies = [], []
    for _ in range(n):
        links = "".join(f"<div><a href='#'>{x}</a></div>" for x in rng.sample(pool, 5))
        bodies.append([say(30) for _ in range(rng.randint(1, 4))])
        text = "".join(f"<p>{b}</p>" for b in bodies[-1])
        rows.append(f"<body><div class='x{rng.randint(1, 9)}'>{links}</div><div class='y'>{text}</div><div class='z'>Made by {rng.choice(['us', 'them'])} in {rng.choice(['May', 'June'])}</div></body>")
    return rows, ["\n".join(b) for b in bodies]


def test_tree_finds_furniture_that_varies_and_declares_nothing(spark):
    htmls, bodies = varied_site(random.Random(3))
    rows = [(i, "https://a.example/x", h) for i, h in enumerate([*htmls, htmls[0], htmls[0]])]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"paths": F.lit(1), "Host": F.lit("x")}).repartition(3)
    got = {r.path: r for r in site_tree.importance(frame).collect()}
    want = plain_importance(htmls)
    assert got.keys() == want.keys() and all(abs(got[p].importance - want[p][0]) < 1e-9 and abs(got[p].most - want[p][1]) < 1e-9 for p in want)
    text = {r.page_id: r.text for r in site_tree.extracted(frame).collect()}
    assert [text[i] for i in range(len(htmls))] == bodies and text[len(htmls)] == bodies[0]
    alone = {r.page_id: r.text for r in site_tree.extracted(frame, site_tree.Settings(declarations=False)).collect()}
    assert alone == text
    without = {r.page_id: r.text for r in site_tree.extracted(frame, site_tree.Settings(tree=False)).collect()}
    assert all("Made by" in x for x in without.values())


@pytest.mark.parametrize("seed", range(3))
def test_importance_against_recursion(spark, seed):
    rng = random.Random(seed)

    def some(depth):
        if depth == 0 or rng.random() < 0.3:
            return " ".join(rng.choices("abcdefg", k=rng.randint(0, 4)))
        tag = rng.choice(["div", "section", "ul", "p", "article", "nav", "b"])
        return "".join(f"<{tag}>{some(depth - 1)}</{tag}>" for _ in range(rng.randint(1, 3)))

    htmls = [some(4) for _ in range(40)]
    s = site_tree.Settings(pages=4)
    frame = spark.createDataFrame([(i, "//h/", h) for i, h in enumerate([*htmls, htmls[3]])], "page_id long, url string, html string")
    got = {r.path: (r.importance, r.most) for r in site_tree.importance(frame, s).collect()}
    want = plain_importance(htmls, s)
    assert len(want) > 2 and got.keys() == want.keys() and all(abs(x - y) < 1e-9 for p in want for x, y in zip(got[p], want[p]))


def test_a_page_of_mostly_furniture_keeps_its_text(spark):
    rng = random.Random(5)
    same = "".join(f"<div class='f{c}'>Always the same {c}</div>" for c in "abcdefghij")
    bodies = [" ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(20)) for _ in range(30)]
    rows = [(i, "//a/", f"<body>{same}<div class='text'><div>{b}</div></div></body>") for i, b in enumerate(bodies)]
    rows += [(100 + i, "//b/", f"<body>{same}<div class='{''.join(rng.choices('xyzuvw', k=6))}'>{b}</div></body>") for i, b in enumerate(bodies)]
    got = {r.page_id: r.text for r in site_tree.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == got[100 + i] == b for i, b in enumerate(bodies))


@pytest.mark.parametrize("tags", ["<div>", "<b>", "<p><b>", "<article>", "<main><header>", "<article><header>", "<li><td>", "<nav>", "<i>"])
def test_deep_and_long_pages(tags):
    n = 100_000
    inner = {"<i>": "deep text" + "<div>" * 1000, "<main><header>": "deep text", "<nav>": "deep text"}.get(tags, "<h1>deep text</h1>")
    html = f"{tags * n}{inner}{'</u></p></q>' * n}<p>after</p>"
    root = site_tree.parse(html)
    text = " ".join(site_tree.blocks(root, frozenset([1])))
    assert ("deep text" in text) == (tags not in ("<nav>", "<main><header>"))
    assert sum(len(x[3]) for x in site_tree.style_rows(root, 64).values()) <= 3
