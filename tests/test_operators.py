import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tagweft.operators import chemistry, chimera, components, matrix, molecules, nearest, scaffold, umi
from tagweft.sources import derived

KEYS = "category string, cell_id int, feature_id int, umi string, reads long"


def listed(spark, *barcodes):
    return spark.createDataFrame(list(enumerate(barcodes)), "id int, barcode string")


def matches(spark, barcodes, limit, queries):
    keys = spark.createDataFrame([(q,) for q in queries], "barcode string")
    got = nearest.match(keys, listed(spark, *barcodes), len(barcodes[0]), limit)
    return {r.barcode: r.id for r in got.collect()}


def test_tags_looked_up_are_those_made(spark):
    rows = spark.createDataFrame([(n,) for n in (*range(50), -1, -7, 10**12, None)], "n long")
    got = rows.select(derived._numbered_tag("cell", F.col("n"), 32, 16).alias("a"), derived._tag("cell", F.col("n") % 32, 16).alias("b"))
    assert got.where("not (a <=> b)").count() == 0 and got.where("a is null").count() == 1


def test_nearest_fixed_cases(spark):
    assert matches(spark, ["AAAA", "CCCC"], 1, ["AAAA", "ANAA", "CCCT", "AACC", "AAA"]) == {"AAAA": 0, "ANAA": 0, "CCCT": 1}
    assert matches(spark, ["AAAA", "AACC"], 1, ["AAAC"]) == {}
    assert matches(spark, ["AAAA", "CCCC"], 2, ["AACC", "AAAC"]) == {"AAAC": 0}
    assert matches(spark, ["AAAA", "AACC"], 2, ["AATT", "GGAA"]) == {}
    with pytest.raises(ValueError):
        nearest.check_unique(listed(spark, "AAAA", "AAAA"))


@pytest.mark.parametrize("seed", range(3))
def test_nearest_against_brute_force(spark, seed):
    rng = random.Random(seed)
    barcodes = sorted({"".join(rng.choices("ACGT", k=6)) for _ in range(5 + 4 * seed)})
    limit = 2

    def best(q):
        d = [sum(x != y for x, y in zip(q, b)) for b in barcodes]
        return min(d), d.count(min(d)), d.index(min(d))

    from itertools import product

    radius = 1 if any(best("".join(q))[:2][0] == 1 and best("".join(q))[1] > 1 for q in product("ACGTN", repeat=6)) else limit
    queries = {"".join(rng.choices("ACGTN", k=6)) for _ in range(150)}
    want = {q: best(q)[2] for q in queries if best(q)[0] <= radius and best(q)[1] == 1}
    assert nearest.radius_of(listed(spark, *barcodes), 6, limit) == radius
    assert matches(spark, barcodes, limit, queries) == want


CASES = [
    ({"AAAA": 10, "AAAC": 3, "AACC": 2}, {"AAAA": 15}, {"AAAA": 10, "AAAC": 5}, {"AAAA": 15}),
    ({"AAAA": 10, "AAAC": 3, "AACC": 3}, {"AAAA": 16}, {"AAAA": 10, "AAAC": 6}, {"AAAA": 13, "AACC": 3}),
    ({"AAAA": 5, "AAAC": 4}, {"AAAA": 9}, {"AAAA": 9}, {"AAAA": 5, "AAAC": 4}),
    ({"AAAA": 1, "AAAC": 1, "AACC": 1}, {"AAAA": 3}, {"AAAA": 1, "AAAC": 2}, {"AAAA": 3}),
    ({"AAAA": 7}, {"AAAA": 7}, {"AAAA": 7}, {"AAAA": 7}),
]


def corrected(spark, groups, method):
    rows = [("x", 0, i, u, n) for i, g in enumerate(groups) for u, n in g.items()]
    out = defaultdict(dict)
    for r in umi.correct(spark.createDataFrame(rows, KEYS), method).collect():
        out[r.feature_id][r.umi] = r.reads
    return [out[i] for i in range(len(groups))]


@pytest.mark.parametrize("place, method", [(1, "cluster"), (2, "adjacency"), (3, "directional"), (3, "anything else")])
def test_umi_fixed_cases(spark, place, method):
    assert corrected(spark, [c[0] for c in CASES], method) == [c[place] for c in CASES]


def plain_directional(group):
    order = sorted(group, key=lambda u: (-group[u], u[::-1]))
    rank = {u: i for i, u in enumerate(order)}
    near = {u: [v for v in order if sum(a != b for a, b in zip(u, v)) == 1] for u in order}
    label = {u: u for u in order}
    changed = True
    while changed:
        changed = False
        for a in order:
            for b in near[a]:
                ok = (group[a] > 1 and group[a] >= 2 * group[b] - 1) or group[a] == group[b] == 1
                if ok and rank[label[a]] < rank[label[b]]:
                    label[b] = label[a]
                    changed = True
    out = Counter()
    for u in order:
        out[label[u]] += group[u]
    return dict(out)


def test_directional_against_plain(spark):
    rng = random.Random(4)
    groups = [{"".join(rng.choices("ACG", k=4)): rng.choice([1, 1, 1, 2, 3, 5, 9]) for _ in range(rng.randint(1, 25))} for _ in range(40)]
    got = corrected(spark, groups, "directional")
    assert got == [plain_directional(g) for g in groups]
    assert [sum(g.values()) for g in got] == [sum(g.values()) for g in groups]
    whole = corrected(spark, groups, "cluster")
    assert all(len(a) <= len(b) <= len(g) for a, b, g in zip(whole, got, groups))


def test_chimeric(spark):
    rows = [("x", 0, 1, "U", 6), ("x", 0, 2, "U", 4), ("x", 0, 1, "V", 5), ("x", 0, 2, "V", 5), ("x", 0, 1, "W", 3)]
    frame = spark.createDataFrame(rows, KEYS)
    assert {(r.umi, r.feature_id) for r in chimera.chimeric_filter(frame).collect()} == {("U", 1), ("W", 1)}
    assert {(r.umi, r.feature_id) for r in chimera.chimeric_filter(frame, 3).collect()} == {("U", 1)}
    assert chimera.chimeric_filter(frame, 3, 0.0).count() == 5
    tie = spark.createDataFrame([("x", 0, 1, "U", 7), ("x", 0, 2, "U", 3)], KEYS)
    assert chimera.chimeric_filter(tie, 0, 0.7).count() == 0
    with pytest.raises(ValueError):
        chimera.chimeric_filter(frame, 0, 1.0)


def test_counters_and_umis(spark):
    layout = molecules.Layout(4, 4, 4, cell_mismatch=0, feature_mismatch=0)
    reads = spark.createDataFrame([("AAAAACGT", "CCCC"), ("TTTTACGT", "CCCC"), ("AAAAACGT", "GGGG"), ("AAAAACGN", "CCCC"), ("AAAAacgt", "CCCC")], "read1 string, read2 string")
    cells, features = listed(spark, "AAAA"), listed(spark, "CCCC").withColumn("category", F.lit("x"))
    assigned = molecules.assigned(molecules.pieces(reads, layout), cells, features, layout)
    assert tuple(molecules.counters(assigned, layout).first()) == (5, 4, 4, 3, 2)
    assert [tuple(r) for r in molecules.molecules(assigned, layout).collect()] == [("x", 0, 0, "ACGT", 2)]
    assert molecules.shortest_umi(assigned, layout) == 4


def test_matrix(spark):
    rows = [("x", 7, 1, "A", 1), ("x", 7, 1, "C", 1), ("x", 9, 0, "A", 2), ("y", 9, 3, "A", 1)]
    frame = spark.createDataFrame(rows, KEYS)
    got = {tuple(r) for r in matrix.dense(matrix.counts(frame)).select("category", "cell_idx", "feature_id", "n").collect()}
    assert got == {("x", 0, 1, 2), ("x", 1, 0, 1), ("y", 0, 3, 1)}
    assert {tuple(r) for r in matrix.row_pointers(matrix.counts(frame)).collect()} == {("x", 0, 1), ("x", 1, 2), ("y", 0, 1)}
    s = {r.category: r for r in matrix.summary(frame, "raw").collect()}
    assert (s["x"].cells, s["x"].umis, s["x"].reads, s["x"].saturation) == (2, 3, 4, 25.0)
    with pytest.raises(ValueError):
        matrix.require_rows(frame.limit(0))


def plain_cost(read, pattern, start, budget=2):
    """Full-matrix alignment whose first step uses the pattern."""
    best = budget + 1
    r = read[start:]
    previous = [0] + [10**6] * len(r)
    for i, p in enumerate(pattern, 1):
        now = [i]
        for j, x in enumerate(r, 1):
            now.append(min(previous[j - 1] + (p != x), previous[j] + 1, now[j - 1] + 1))
        previous = now
    return min(best, min(previous))


def plain_locate(read, scaffold, start, end):
    i = next((i for i in range(start, end + 1) if plain_cost(read, scaffold, i) <= 2), None)
    if i is None:
        return None
    best, j = plain_cost(read, scaffold, i), i + 1
    while best > 0 and j <= i + 2:
        if plain_cost(read, scaffold, j) < best:
            best, i = plain_cost(read, scaffold, j), j
        j += 1
    return i if i <= end else None


def test_scaffold(spark):
    rng = random.Random(8)
    pattern = "GTTTAAGAGC"
    reads = []
    for _ in range(150):
        s = list(pattern)
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(s))
            change = rng.choice("ids")
            s[k : k + 1] = {"i": [s[k], rng.choice("ACGT")], "d": [], "s": [rng.choice("ACGT")]}[change]
        reads.append("".join(rng.choices("ACGT", k=rng.randint(3, 14))) + "".join(s) + "".join(rng.choices("ACGT", k=rng.randint(0, 4))))
    frame = spark.createDataFrame([(r,) for r in reads], "read2 string")
    for r in scaffold.anchored(frame, pattern, 8, 2).collect():
        want = plain_locate(r.read2, pattern, 6, len(r.read2) - 8)
        assert r.start == want, r.read2
        assert r.feature_barcode == (None if want is None else r.read2[max(0, want - 8) : want].rjust(8, "N"))


def test_decisions():
    assert chemistry.decide({"a": 0, "b": 3}) == "b"
    assert chemistry.decide({"a": 2000, "b": 500}) == "a"
    for bad in ({"a": 0}, {"a": 400, "b": 1}, {"a": 2000, "b": 1500}):
        with pytest.raises(ValueError):
            chemistry.decide(bad)
    assert chemistry.lengths("SC3Pv2") == (10, 1) and chemistry.lengths("multiome") == (12, 1) and chemistry.lengths("SC5Pv3") == (12, 0)
    for bad in ("10x_v2", "other"):
        with pytest.raises(ValueError):
            chemistry.candidates(bad)
    assert len(chemistry.candidates("auto")) == 7
    assert chemistry.totalseq("SC3Pv3:Poly-A") == "A" and chemistry.totalseq("SC3Pv4:CS1") == "B" and chemistry.totalseq("SC5Pv3") == "C"
    assert chemistry.totalseq("multiome", 20, 5) == "A" and chemistry.totalseq("multiome", 20, 20) == "C"
    for kind in ("hashing", "citeseq", "adt"):
        assert chemistry.feature_position(kind, "A", 5) == 0 and chemistry.feature_position(kind, "", 5) == 10
        assert chemistry.needs_position_vote("multiome", kind, -1) and not chemistry.needs_position_vote("multiome", kind, 0)
    for bad in ("antibody", "Hashing", ""):
        with pytest.raises(ValueError):
            chemistry.feature_position(bad)
    assert chemistry.resolved("10x_v2", "adt", n_pos0=20, n_pos10=3) == chemistry.Chemistry("SC3Pv2", 10, 1, "A", 0)
    assert chemistry.resolved("10x_v2", "adt", given=4) == chemistry.Chemistry("10x_v2", 10, 1, "", 10)
    assert chemistry.resolved("SC3Pv3:CS1", "crispr", scaffold="ACG") == chemistry.Chemistry("SC3Pv3:CS1", 12, 0, "", -1)
    assert chemistry.feature_position("crispr", scaffold="ACG") == -1 and chemistry.feature_position("cmo") == 0
    assert chemistry.settled("10x_v2", "A") == "SC3Pv2"
    with pytest.raises(ValueError):
        chemistry.feature_position("other")


def test_votes(spark):
    reads = spark.createDataFrame([(0, i, b + "xx", "") for i, b in enumerate(["AA", "AA", "CC", "GG"])], "file_id int, ordinal long, read1 string, read2 string")
    lists = spark.createDataFrame([("one", "AA"), ("two", "CC"), ("two", "AA"), ("none", "TT")], "chem string, barcode string")
    got = [tuple(r) for r in chemistry.votes(chemistry.first_reads(reads, 3), lists, 2).orderBy("rank").collect()]
    assert got == [("two", 3, 1), ("one", 2, 2), ("none", 0, 3)]


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(200)] + [(5, 5)]
    root = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in range(len(root)):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = components.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == root and got.count() == len(root)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert components.components(spark.createDataFrame([(("x", 2), ("x", 1))], "a struct<k:string,n:int>, b struct<k:string,n:int>")).count() == 2


def test_spread_join(spark, monkeypatch):
    layout = molecules.Layout(4, 4, 4, cell_mismatch=0, feature_mismatch=0)
    cells = spark.createDataFrame([(0, "AAAA", "one")], "id int, barcode string, name string")
    features = spark.createDataFrame([(0, "GGGG", "g", "x"), (1, "TTTT", "t", "y")], "id int, barcode string, name string, category string")
    reads = spark.createDataFrame([("AAAAACGT", "GGGG")] * 3 + [("AAAAACGA", "TTTT"), ("AAAAACGC", None), ("CCCCACGC", "CCCC")], "read1 string, feature string")
    parts = reads.select(F.substring("read1", 1, 4).alias("cell_barcode"), F.col("feature").alias("feature_barcode"), "read1")
    want = {("AAAAACGT", 0, 0, "x", 3), ("AAAAACGA", 0, 1, "y", 1), ("AAAAACGC", 0, None, None, 1), ("CCCCACGC", None, None, None, 1)}
    for most in (10, 0):
        monkeypatch.setattr(molecules, "BROADCAST", most)
        got = molecules.assigned(parts, cells, features, layout)
        assert {(r.read1, r.cell_id, r.feature_id, r.category, r.n) for r in got.collect()} == want and got.count() == 4
