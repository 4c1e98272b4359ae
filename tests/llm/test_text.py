import datetime
import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import public_tokenizers
from tagweft.llm import attention, chat, language_model, packing, pii, quality, words
from tagweft.llm.shared import ship

VOCABULARY = packing.Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_50k.json"))
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(autouse=True)
def package(spark):
    ship(spark)


def docs(spark, texts, ids=None):
    ids = ids if ids is not None else range(len(texts))
    return spark.createDataFrame([(i, t, None, "s", None) for i, t in zip(ids, texts)], DOCS)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abcé \t\n\x0b\x1c\u2003", max_size=30), max_size=8), st.integers(1, 40))
def test_words(texts, size):
    got, joined = [], []
    for block in words.blocks(pa.array(texts, pa.string()), size=size):
        raw = block.data.tobytes()
        data, starts, ends = words.joined(block)
        hashed = words.word_hashes(block, part=4)
        assert np.array_equal(hashed, words.word_hashes(block))
        for a, b in zip(block.bounds[:-1], block.bounds[1:]):
            got.append([raw[s:e] for s, e in zip(block.starts[a:b], block.ends[a:b])])
            joined.append(data[starts[a] : ends[b - 1]] if b > a else b"")
    want = [t.encode().split() for t in texts]
    assert got == want
    assert joined == [b" ".join(w) for w in want]


def test_null_and_sliced_words():
    column = pa.array(["x", None, "b c", ""]).slice(1)
    assert [b.counts().tolist() for b in words.blocks(column)] == [[0, 2, 0]]


# --- packing


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 9000))
def test_pieces(length):
    s = packing.Settings()
    cut = packing.pieces(length, s)
    assert sum(cut) == length and all(0 < x <= s.capacity for x in cut)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=60))
def test_packer(lengths):
    packer, bins = packing.Packer(packing.Settings()), []
    for i, n in enumerate(lengths):
        bins += packer.add(i, np.arange(n, dtype="<u4"))
    bins += packer.close()
    seen = {}
    for b in bins:
        assert 0 < sum(len(p.ids) for p in b) <= 2048
        for p in b:
            assert p.ids[0] == p.start and p.total == lengths[p.doc]
            seen.setdefault(p.doc, []).extend(p.ids.tolist())
    assert {k: sorted(v) for k, v in seen.items()} == {i: list(range(n)) for i, n in enumerate(lengths)}


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet=" \n\t\x1c\x85\xa0\u2028'sx<|endoftext|>9é", max_size=40))
def test_ids_are_the_tokenizers(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY.tokenizer)
    for own in (text, f"{text}<|endoftext|>", f"a <|endoftext|>{text}<|endoftext|> \n{text}"):
        assert packing.encoder(VOCABULARY).ids(own) == t.encode(own, add_special_tokens=False).ids


def test_packed(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY.tokenizer)
    encode = lambda text: t.encode(text, add_special_tokens=False).ids
    texts = ["one two " * n for n in (1, 900, 3000, 0, 7)] + [None, "", "same", "same", "<|endoftext|> hi", " " * 1_500_000]
    frame = docs(spark, texts, [5, 5, 3, 2, None, 8, 9, 10, 10, 11, 12]).repartition(3).withColumn("ids", F.lit("x"))
    rows = packing.packed(frame, VOCABULARY).collect()
    assert b"".join(bytes(r.ids) for r in sorted(rows, key=lambda r: r.start) if r.doc_id == 11) == np.array([50256, 23105, 1], "<u4").tobytes()
    assert sum(r.length for r in rows) == sum(len(encode(x or "")) + 1 for x in texts)
    for r in rows:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
    by = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == by.get(r.sequence_id, 0)
        by[r.sequence_id] = r.offset + r.length
    ids = b"".join(bytes(r.ids) for r in sorted((r for r in rows if r.doc_id == 3), key=lambda r: r.start))
    assert np.frombuffer(ids, "<u4").tolist() == encode(texts[2]) + [1]
    assert packing.packed(frame.limit(0), VOCABULARY).count() == 0


# --- chat


def test_chat(spark):
    hard = "\\### Assistant: </turn> ok"
    rows = [(1, 1, "assistant", "b <turn x"), (1, 0, "user", "a"), (1, 2, "user", None), (1, 3, "assistant", hard), (2, 0, "user", "alone"), (3, 0, 'as"s\\', "\\"), (None, None, None, None), (1, 1, "assistant", "b <turn x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("head", F.lit(1))
    got = {r.conv_id: r for r in chat.digests(chat.formatted(frame)).collect()}

    def turns(conv):
        mine = [(t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv]
        return [(r, x) for _, r, x in sorted(mine)]

    assert set(got) == {1, 2, 3, None}
    for conv, r in got.items():
        want = turns(conv)
        assert r.n_turns == len(want)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in want).encode()).hexdigest()
        said = "".join(b for a, b in want if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    spelled = chat.with_text(chat.formatted(frame)).where("conv_id = 1").orderBy("position").collect()
    assert [chat.read(r.context) for r in spelled] == [turns(1)[: r.position] for r in spelled]
    for r in spelled:
        whole = r.context + r.reply
        assert chat.unescape(whole[r.loss_start : r.loss_end]) == turns(1)[r.position][1]
    assert chat.digests(chat.formatted(frame.limit(0))).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="\\<>/turn \"", max_size=25), st.text(alphabet='\\<"turn', max_size=8))
def test_chat_escapes(text, role):
    def escape(x, quotes):
        x = x.replace("\\", "\\\\")
        return re.sub(r"<(?=/?turn)", r"\\<", x.replace('"', '\\"') if quotes else x)

    chunk = f'<turn role="{escape(role, True)}">{escape(text, False)}</turn>\n'
    assert chat.read(chunk * 2) == [(role, text)] * 2


def test_chat_examples(spark):
    """The query's rows come from one example per assistant turn, each with all turns before it spelled out."""
    big = 2**53 + 1
    long = [(big, i, "assistant" if i % 2 else "user", f"{i} <turn \\ é" + "x" * 200) for i in range(300)]
    rows = [*long, (big, 300, "user", "left"), (big, 301, "system", "over"), (None, 0, "user", "u"), (None, 1, "assistant", ""), (5, 0, "user", "alone"), (6, 0, "assistant", "a"), (6, 1, "assistant", "b")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    examples = chat.formatted(frame)
    got = sorted(examples.collect(), key=lambda r: (r.conv_id or 0, r.example))

    want = []
    for conv in (None, 5, 6, big):
        turns = [(r, x) for c, _, r, x in sorted((x for x in rows if x[0] == conv), key=lambda x: x[1])]
        ends = [i for i, (r, _) in enumerate(turns) if r == "assistant" or i == len(turns) - 1]
        want += [(conv, k, i, turns[: i + 1]) for k, i in enumerate(ends)]
    assert [(r.conv_id, r.example, r.position) for r in got] == [w[:3] for w in want]
    for r, (_, _, i, turns) in zip(got, want):
        assert chat.read(r.context) == turns[:i] and chat.read(r.reply) == turns[i:]
        assert r.trained == (turns[i][0] == "assistant") == (r.loss_start is not None)
        if r.trained:
            assert chat.unescape((r.context + r.reply)[r.loss_start : r.loss_end]) == turns[i][1]
    assert sum(len(r.context) + len(r.reply) for r in got) > chat.BATCH_CHARS

    read = {r.conv_id: r for r in chat.digests(examples).collect()}
    assert set(read) == {None, 5, 6, big}
    assert (read[big].n_turns, read[big].loss_chars) == (302, sum(len(x[3]) for x in long[1::2]))
    for spoilt in (examples.withColumn("context", F.lit("")), examples.where("example <> 1")):
        with pytest.raises(Exception, match="does not go on from the one before"):
            chat.digests(spoilt).collect()


# --- PII


def luhn(x):
    return sum((2 * d - 9 * (d > 4)) if i % 2 else d for i, d in enumerate(map(int, reversed(x)))) % 10 == 0


def test_pii(spark):
    card = "4785380592391139"
    texts = [f"card {card}, mail hein.19@mail5.example.com\x01\x02", f"again 4785-3805-9239-1139 {card}8 x", "ip 152.143.123.131 999.1.1.1 call +1 (743) 555-3824", "born 1984-02-29 1985-02-29 29.02.1984 ssn 123-45-6789 000-12-3456", None, "", "clean text 12 4.", f"card {card}, mail hein.19@mail5.example.com\x01\x02"]
    frame = docs(spark, texts).withColumn("n_pseudonyms", F.lit("old"))
    got = {r.doc_id: r for r in pii.pseudonymised(frame, "k").collect()}
    assert [got[i].n_pseudonyms for i in range(8)] == [2, 1, 2, 3, 0, 0, 0, 2]
    assert (got[4].text, got[5].text, got[6].text) == (None, "", texts[6])
    new = re.search(r"\d{16}", got[0].text)[0]
    assert new != card and luhn(new) and "hein.19" not in got[0].text and got[0].text.endswith("@mail5.example.com\x01\x02")
    assert "-".join(new[i : i + 4] for i in range(0, 16, 4)) in got[1].text and f"{card}8" in got[1].text
    assert "999.1.1.1" in got[2].text and re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}$", got[2].text) and "555-3824" not in got[2].text
    y, m, d = re.search(r"born (\d{4})-(\d\d)-(\d\d) 1985-02-29", got[3].text).groups()
    assert f"{d}.{m}.{y}" in got[3].text and "000-12-3456" in got[3].text and "123-45-6789" not in got[3].text
    assert got[0].text == got[7].text
    assert pii.pseudonymised(frame, "other").where("doc_id = 0").first().text != got[0].text
    assert pii.pseudonymised(frame.limit(0), "k").count() == 0


def test_network_permutes(spark):
    for radices in ((10, 10), (3, 7, 5), (189,), (26, 1, 10)):
        size = int(np.prod(radices))
        values = [tuple(int(x) for x in np.unravel_index(i, radices)) for i in range(size)]
        frame = spark.createDataFrame([(list(v),) for v in values], "v array<bigint>")
        new = frame.select(pii.network(F.col("v"), F.array(*[F.lit(r).cast("bigint") for r in radices]), "k", "t").alias("v")).collect()
        assert {tuple(r.v) for r in new} == set(values)


def test_days_permute(spark):
    days = spark.range(146097).select(F.date_add(F.to_date(F.lit("1800-01-01")), F.col("id").cast("int")).alias("d"))
    got = days.select(pii._day(F.col("d"), "k").alias("n")).agg(F.count_distinct("n"), F.min("n").cast("string"), F.max("n").cast("string")).first()
    assert tuple(got) == (146097, "1800-01-01", "2199-12-31")


def plain_network(values, radices, kind, key):
    cut = len(values) // 2
    left, right = list(values[:cut]), list(values[cut:])

    def added(own, other, radix, turn):
        seen = ",".join(map(str, other))
        return [(x + int(hashlib.sha256(f"{key}|{kind}|{turn}|{i}|{seen}".encode()).hexdigest()[:10], 16)) % r for i, (x, r) in enumerate(zip(own, radix))]

    for turn in range(pii.ROUNDS):
        if turn % 2 == 0:
            left = added(left, right, radices[:cut], turn)
        else:
            right = added(right, left, radices[cut:], turn)
    return left + right


def plain_pseudonym(value, key):
    """One found value by plain rules, on strings and dates of Python."""
    fits = lambda pattern: re.fullmatch(pattern, value, re.A)
    digits = lambda x, kind: "".join(map(str, plain_network([int(c) for c in x], [10] * len(x), kind, key)))
    only = re.sub("[^0-9]", "", value)

    def refilled(new):
        new = iter(new)
        return "".join(next(new) if c in "0123456789" else c for c in value)

    if "@" in value:
        name, rest = value.split("@", 1)
        first = [48 if c.isdigit() else 97 if c.islower() else 65 if c.isupper() else None for c in name]
        new = plain_network([ord(c) - f if f else 0 for c, f in zip(name, first)], [10 if f == 48 else 26 if f else 1 for f in first], "email", key)
        return "".join(chr(n + f) if f else c for c, f, n in zip(name, first, new)) + "@" + rest
    if fits(f"{pii.ISO}|{pii.DOTTED}|{pii.SLASHED}"):
        for shape in ("%Y-%m-%d", "%d.%m.%Y", "%m/%d/%Y", "%d/%m/%Y"):
            try:
                day = datetime.datetime.strptime(value, shape).date()
            except ValueError:
                continue
            if 1800 <= day.year <= 2199:
                n = (day - datetime.date(1800, 1, 1)).days
                a, b = plain_network([n // 773, n % 773], [189, 773], "date", key)
                return (datetime.date(1800, 1, 1) + datetime.timedelta(days=a * 773 + b)).strftime(shape)
        return value
    if fits(pii.IPV4):
        parts = [int(x) for x in value.split(".")]
        return ".".join(map(str, plain_network(parts, [256] * 4, "ip", key))) if max(parts) < 256 else value
    if fits(pii.SSN):
        area, group, serial = map(int, value.split("-"))
        if not (0 < area < 900 and area != 666 and group and serial):
            return value
        a, g, n = plain_network([area - 1 - (area > 666), group - 1, serial - 1], [898, 99, 9999], "ssn", key)
        return f"{a + 1 + (a + 1 >= 666):03d}-{g + 1:02d}-{n + 1:04d}"
    if fits(pii.PHONE):
        keep = len(only) - 10 if re.match(r"(\+?1[ .\-]?)?\(|(\+?1[ .\-])?\d{3}[.\-]|\+1", value, re.A) else 2
        return refilled(only[:keep] + digits(only[keep:], "phone")) if 8 <= len(only) <= 15 else value
    if not luhn(only):
        return value
    body = digits(only[:-1], "card")
    return refilled(next(body + str(c) for c in range(10) if luhn(body + str(c))))


def test_pseudonyms_against_plain_rules(spark):
    """Over all documents of the smallest shared tables, and texts made of values of each kind."""
    rng = random.Random(12)
    some = lambda n, of="0123456789": "".join(rng.choices(of, k=n))
    made = []
    for _ in range(400):
        card = some(rng.choice([12, 15, 18]))
        made.append(rng.choice([
            f"{some(5, 'aB.9_-')}@{some(4, 'ab')}.org", f"{rng.randint(1750, 2250)}-{rng.randint(0, 13):02d}-{rng.randint(0, 31):02d}", f"{rng.randint(0, 31):02d}.{rng.randint(1, 13):02d}.{rng.randint(1790, 2210)}",
            f"{rng.randint(0, 31):02d}/{rng.randint(0, 31):02d}/{rng.randint(1900, 2100)}", ".".join(str(rng.randint(0, 270)) for _ in range(4)), f"{rng.randint(0, 950):03d}-{some(2)}-{some(4)}",
            f"+1 ({some(3)}) {some(3)}-{some(4)}", f"+{rng.randint(2, 9)}{some(9)}", f"+4{some(1)} {some(3)} {some(5)}", f"{some(3)}.{some(3)}.{some(4)}",
            next(card + c for c in "0123456789" if luhn(card + c)), card + some(1), f"{some(4)} {some(4)} {some(4)} {some(4)}", "plain text", "\x01\x02",
        ]))
    texts = [" ".join(rng.sample(made, 12)) for _ in range(100)] + made
    path = "/root/testdata/sf0.001/documents.parquet"
    if os.path.exists(path):
        texts += [r.text for r in spark.read.parquet(path).select("text").collect()]
    frame = docs(spark, texts).withColumns({"Pieces": F.lit("x"), "new": F.lit("y")})
    got = pii.pseudonymised(frame, "k")
    assert got.columns == [*frame.columns, "n_pseudonyms"]
    changed = 0
    for r in got.collect():
        n = 0

        def put(found):
            nonlocal n
            new = plain_pseudonym(found[0], "k")
            n += new != found[0]
            return new

        want = None if texts[r.doc_id] is None else re.sub(pii.ANY, put, texts[r.doc_id], flags=re.A)
        assert (r.text, r.n_pseudonyms) == (want, n)
        changed += n
    assert changed > 300


# --- quality


def plain_ftrl(rows, s):
    """FTRL-proximal, coordinate by coordinate."""
    z, n, rate = {}, {}, 0.0
    share = sum(y for *_, y in rows) / len(rows)
    bias = math.log((share + 1e-3) / (1 - share + 1e-3))

    def weight(i):
        if abs(z.get(i, 0.0)) <= s.l1:
            return 0.0
        return -(z[i] - math.copysign(s.l1, z[i])) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)

    random_ = np.random.default_rng(s.seed)
    for _ in range(s.epochs):
        for k in random_.permutation(len(rows)):
            index, value, y = rows[k]
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(weight(i) * v for i, v in zip(index, value)) + bias))))
            for i, v in zip(index, value):
                g, w, before = (p - y) * v, weight(i), n.get(i, 0.0)
                n[i] = before + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(before)) / s.alpha * w
            rate += (p - y) ** 2
            bias -= s.alpha * (p - y) / (s.beta + math.sqrt(rate))
    return {i: weight(i) for i in z}, bias


def test_training_and_scores_against_plain_ones(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["one", "Two", "3", "four.", "é", "$$"], weights=[1 + i % 2, 2, 1, 1, 1, 3 * (i % 2)], k=rng.randint(0, 12))) for i in range(60)]
    ids = [f"id{i}" for i in range(60)]
    frame = spark.createDataFrame([*zip(ids, texts), ("id3", texts[3] + " more"), (None, "x")], "doc_id string, text string").withColumn("key", F.lit(1))
    labels = spark.createDataFrame([(x, i % 2, 0) for i, x in enumerate(ids)] + [(None, 1, 0)], "doc_id string, quality int, toxic int")
    s = quality.Settings(bits=12, sample_rows=30)
    weights, bias = quality.train(frame, labels, s)
    key = {r.doc_id: r.k for r in labels.select("doc_id", F.xxhash64("doc_id").alias("k")).collect()}
    chosen = sorted((x for x in ids if zlib.crc32(x.encode()) % 3 != 1), key=lambda x: (key[x], x))[:30]
    rows = []
    for x in sorted(chosen, key=lambda x: key[x]):
        own = min(t for i, t in [*zip(ids, texts), ("id3", texts[3] + " more")] if i == x)
        index = quality.features(next(words.blocks(pa.array([own]))), s.bits)[0].tolist()
        n = Counter(index)
        rows.append((sorted(n), [n[i] / math.sqrt(len(index)) for i in sorted(n)], int(x[2:]) % 2))
    want, want_bias = plain_ftrl(rows, s)
    assert abs(bias - want_bias) < 1e-5 and any(want.values())
    assert all(abs(weights[i] - w) < 1e-5 for i, w in want.items()) and np.count_nonzero(weights) == sum(w != 0 for w in want.values())
    for r in quality.scored(frame, (weights, bias), s.bits).collect():
        index = quality.features(next(words.blocks(pa.array([r.text]))), s.bits)[0].tolist()
        x = sum(float(weights[i]) for i in index) / math.sqrt(max(1, len(index))) + bias
        assert abs(r.quality_score - 1 / (1 + math.exp(-x))) < 1e-6


def test_quality(spark):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choices("abcdefg", k=5)) for _ in range(80)]
    good = [" ".join(rng.choices(vocabulary, k=30)) for _ in range(150)]
    bad = [" ".join(w + "$$$" for w in rng.choices(vocabulary, k=30)) for _ in range(150)]
    frame = docs(spark, good + bad + [None, "", "x " * 200_000])
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(300)] + [(0, 1, None), (1, None, 1), (None, 0, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(frame, labels)
    assert np.array_equal(model[0], quality.train(frame, labels)[0])
    rows = quality.scored(frame, model).collect()
    assert len(rows) == 303 and rows[0].source == "s" and all(0 <= r.quality_score <= 1 for r in rows)
    held = [r for r in rows if r.doc_id < 300 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([(r.quality_score >= 0.5) == (r.doc_id < 150) for r in held]) > 0.97
    index, at = quality.features(next(words.blocks(pa.array([good[0], bad[0]]))), 20)
    assert at[-1] == len(index) == 240
    empty = quality.train(frame.limit(0), labels)
    assert not empty[0].any() and quality.scored(frame.limit(0), empty).count() == 0


# --- language model


def small_tables(rng, v=40):
    count = rng.integers(0, 9, v).astype(float)
    count[v - 1] = 5
    return attention.tables(count, v - 1)


def test_tables_reach_every_id():
    rng = np.random.default_rng(4)
    count = rng.integers(1, 99, 5000).astype(float)
    t = attention.tables(count, 4999)
    mass = np.bincount(t.group * attention.SLOTS + t.slot, t.in_slot)
    assert np.allclose(mass[mass > 0], 1, atol=1e-5) and (t.in_slot > 0).all()
    assert (np.bincount(t.group * attention.SLOTS + t.slot)[: attention.SLOTS - 1] == 1).all()


def test_gradients():
    rng = np.random.default_rng(0)
    t, v = small_tables(rng), 40
    t.row[30:] = attention.ROWS
    net = {k: x.astype(np.float64) for k, x in attention.start_network().items()}
    before = rng.integers(0, v, (2, attention.WINDOW))
    now = rng.choice(np.flatnonzero(t.first_count), (2, attention.FRESH))
    blank, used = np.array([3, 0]), rng.random((2, attention.FRESH)) < 0.8
    args = (t, before, blank, now, used)
    _, g = attention.gradients(net, *args)
    for name, x in net.items():
        assert g[name].any(), name
        places = np.argwhere(np.abs(g[name]) >= np.abs(g[name]).max() / 3)
        for at in [tuple(places[i]) for i in rng.integers(0, len(places), 5)]:
            keep = x[at]
            x[at] = keep + 1e-5
            up = attention.gradients(net, *args)[0]
            x[at] = keep - 1e-5
            down = attention.gradients(net, *args)[0]
            x[at] = keep
            assert abs((up - down) / 2e-5 - g[name][at]) < 1e-6 + 1e-2 * abs(g[name][at]), name


def test_probabilities_sum_to_one_at_most():
    rng = np.random.default_rng(2)
    t, v = small_tables(rng), 40
    net = attention.start_network()
    before = rng.integers(0, v, (1, attention.WINDOW))
    total = np.zeros(attention.FRESH)
    for x in np.flatnonzero(t.first_count):
        total += attention.probabilities(net, t, before, np.array([0]), np.full((1, attention.FRESH), x), np.ones((1, attention.FRESH), bool))
    assert (total <= 1 + 1e-4).all() and (total > 0.3).all()


def plain_score(net, t, ids, count, n_tokens, unknown):
    """log10 probability of one text, id by id."""
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    net = {k: x.astype(np.float64) for k, x in net.items()}
    total = 0.0
    for i, x in enumerate(ids):
        first = i // attention.FRESH * attention.FRESH
        keys = range(max(0, first - attention.CONTEXT), i + 1)
        before = [t.end_id if j == 0 else ids[j - 1] for j in keys]
        e = net["embed"][t.row[before]]
        a = soft(np.array([(e[-1] @ net["q"]) @ (y @ net["k"]) + net["lag"][i - j] for j, y in zip(keys, e)]))
        h = e[-1] + a @ (e @ net["v"])
        gate = soft(h @ net["gate"] + net["gate0"])
        c = t.group[x]
        chosen = soft(h @ net["group"] + net["group0"])[c] * soft(h @ net["slot"][c] + net["slot0"][c])[t.slot[x]] * t.in_slot[x]
        p = gate @ [chosen, sum(w for w, b in zip(a, before) if b == x), t.first[x]]
        word = language_model.Settings.mix * p * count[i] / max(t.first_count[x], 1) + (1 - language_model.Settings.mix) * count[i] / n_tokens
        total += math.log10((1 - unknown) * word if count[i] else unknown)
    return total


def test_scores_against_a_plain_scorer():
    rng = np.random.default_rng(6)
    t, net = small_tables(rng), attention.start_network(seed=9)
    sizes = [0, 1, 23, 24, 25, 70]
    ids = np.concatenate([np.append(rng.choice(np.flatnonzero(t.first_count)[:-1], n), t.end_id) for n in sizes]).astype(np.int32)
    bounds = np.concatenate([[0], np.cumsum(np.array(sizes) + 1)])
    count = np.minimum(rng.integers(0, 5, len(ids)), t.first_count[ids]).astype(np.int64)
    got = language_model.log_probabilities(net, t, language_model.Sequence(ids, ids, bounds), count, 200, 0.1, batch=2)
    want = [plain_score(net, t, ids[a:b], count[a:b], 200, 0.1) for a, b in zip(bounds[:-1], bounds[1:])]
    assert np.allclose(got, want, atol=1e-4)


def test_outcomes_sum_to_one():
    """Over all training words, the end, and any other word, after a word."""
    rng = np.random.default_rng(5)
    v, end = 9, 8
    words_of = {w: int(rng.integers(0, 8)) for w in range(60)}  # the first subword of each
    count = {w: int(rng.integers(1, 9)) for w in words_of}
    first = np.bincount([words_of[w] for w in words_of], [count[w] for w in words_of], v)
    first[end] = 12
    t, net, n_tokens = attention.tables(first, end), attention.start_network(seed=3), int(first.sum())
    total = 0.1
    for w in [*words_of, None]:
        ids = np.array([1, end if w is None else words_of[w], end], np.int32)
        own = 12 if w is None else count[w]
        scores = [language_model.log_probabilities(net, t, language_model.Sequence(x, x, np.array([0, len(x)])), n, n_tokens, 0.1)[0] for x, n in ((ids[:2], np.array([3, own])), (ids[:1], np.array([3])))]
        total += 10 ** (scores[0] - scores[1])
    assert 0.3 < total <= 1 + 1e-5


def test_language_model(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices(["th", "er", "on", "ing", "sh"], k=rng.randint(1, 3))) for _ in range(60)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 120))) for _ in range(200)]
    texts += [None, "", "The\tTHE  the\x0b", "word " * 30_000, "\u00a0x \u00a0", texts[0], "unseen$$$"]
    frame = docs(spark, texts, [*range(205), 0, None]).repartition(3)
    rows = language_model.scored(frame, VOCABULARY, language_model.Settings(shard_bytes=6000, bucket_words=300)).collect()
    low = [re.sub(r"[A-Z]+", lambda m: m[0].lower(), t or "").encode().split() for t in texts]
    ids = [*range(205), 0, None]
    train = [w + [None] for i, w in zip(ids, low) if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    from collections import Counter

    c = Counter(x for w in train for x in w)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), len(w) + 1, sum(c[x] > 0 for x in [*w, None]), round(float(sum(np.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in [*w, None])), 4)) for i, w in zip(ids, low))
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 4)) for r in rows) == want
    assert {r.train_tokens for r in rows} == {n} and all(r.score < 0 for r in rows)
    one = {r.score for r in rows if r.doc_id == 0}
    assert max(one) - min(one) < 1e-3  # a text's score does not depend on its shard
    assert language_model.scored(frame.limit(0), VOCABULARY).count() == 0


def test_all_training_windows(spark):
    texts = [f"text {i} " + "some words here " * (i % 50) for i in range(200)]
    settings = language_model.Settings(shard_bytes=3000)
    table = language_model.shards(docs(spark, texts).repartition(3), VOCABULARY, settings).cache()
    v = len(language_model.id_bytes(VOCABULARY))
    t = attention.tables(np.ones(v), v - 1)
    share = spark.sparkContext.broadcast
    rows = language_model.copies(table, share(t), share(attention.start_network()), settings).where("place = 0").collect()
    want = 0
    for r in table.collect():
        s = language_model.sequence(t, r.first, r.number, np.array(r.n_words))
        doc = language_model.windows(s)[0]
        want += sum(not language_model.held_out(r.doc_id[d]) for d in doc.tolist())
    assert sum(r.seen for r in rows) == want > 200
