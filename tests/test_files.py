import gzip

import pytest

from tagweft.operators import chemistry, molecules, nearest
from tagweft.plans import cli
from tagweft.plans import run as plan
from tagweft.sinks import fastq as out
from tagweft.sinks import tables
from tagweft.sources import fastq, lines, lists
from tagweft.streaming import intake


def write(path, text):
    with gzip.open(path, "wt") as f:
        f.write(text)


def record(name, seq, qual=None):
    return f"@{name} c\n{seq}\n+\n{qual or 'I' * len(seq)}\n"


def test_pairs(spark, tmp_path):
    fastq.register(spark)
    for k in "ba":
        write(tmp_path / f"{k}_R1_001.fastq.gz", record(f"{k}1", "ACGT") + ">f2\nAC\nGG\n")
        write(tmp_path / f"{k}_R2_001.fastq.gz", record("x", "TT") + record("y", "GG"))
    (tmp_path / "other.txt").write_text("no")
    rows = spark.read.format("fastq_pairs").load(str(tmp_path)).select("file_id", "ordinal", "read1", "read2", "name1", "qual1").orderBy("file_id", "ordinal").collect()
    assert [tuple(r) for r in rows] == [(0, 0, "ACGT", "TT", "a1", "IIII"), (0, 1, "ACGG", "GG", "f2", ""), (1, 0, "ACGT", "TT", "b1", "IIII"), (1, 1, "ACGG", "GG", "f2", "")]


@pytest.mark.parametrize("one, two, says", [(record("a", "AC") * 2, record("b", "AC"), "number of records"), ("@a\nACGT\n+\nII", record("b", "AC"), "truncated"), ("@a\n\n+\n\n", record("b", "AC"), "empty"), ("junk\n", record("b", "AC"), "not a record")])
def test_broken_pairs(spark, tmp_path, one, two, says):
    fastq.register(spark)
    write(tmp_path / "a_R1_001.fastq.gz", one)
    write(tmp_path / "a_R2_001.fastq.gz", two)
    with pytest.raises(Exception, match=says):
        spark.read.format("fastq_pairs").load(str(tmp_path)).collect()
    rows = spark.read.format("fastq_pairs").option("mode", "PERMISSIVE").load(str(tmp_path)).collect()
    assert says in rows[-1].error


def test_listing(tmp_path):
    with pytest.raises(ValueError):
        fastq.file_pairs(str(tmp_path))
    write(tmp_path / "a_R1_001.fastq.gz", "")
    with pytest.raises(ValueError):
        fastq.file_pairs(str(tmp_path))


def parsed(spark, text):
    lines = spark.createDataFrame(list(enumerate(text.split("\n"))), "line_no long, line string").coalesce(1)
    return lists.parse_lines(lines)


def test_lists(spark, tmp_path):
    rows = parsed(spark, "﻿ ACGT , tag1 \r\nACGT\n\n \nACGT,tag1, hash\nACGT\tTTTT").collect()
    assert [tuple(r) for r in rows] == [(0, "ACGT", "tag1"), (1, "ACGT", "ACGT"), (2, "ACGT", "tag1, hash"), (3, "ACGT", "TTTT")]
    write(tmp_path / "cells.txt.gz", "AAAA\nCCCC\tname\n")
    assert [tuple(r) for r in lists.cell_list(spark, str(tmp_path / "cells.txt.gz")).collect()] == [(0, "AAAA", "AAAA"), (1, "CCCC", "name")]
    for bad in ("AAAA\nCCC", "AAAA\nAAAA"):
        with pytest.raises(ValueError):
            lists.checked(parsed(spark, bad))


def test_categories(spark):
    got = lists.with_categories(parsed(spark, "AA,x,hash\nCC,y,guide\nGG,z,guide"), "none").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(0, "CC", "y", "guide"), (1, "GG", "z", "guide"), (2, "AA", "x", "hash")]
    assert {r.category for r in lists.with_categories(parsed(spark, "AA,x\nCC,y"), "none").collect()} == {"none"}
    with pytest.raises(Exception, match="no category"):
        lists.with_categories(parsed(spark, "AA,x,hash\nCC,y"), "none").collect()


def test_run_and_sinks(spark, tmp_path):
    layout = molecules.Layout(4, 4, 4, cell_mismatch=0, feature_mismatch=1)
    cells = spark.createDataFrame([(0, "AAAA", "one"), (1, "CCCC", "two")], "id int, barcode string, name string")
    features = spark.createDataFrame([(0, "GGGG", "g", "crispr"), (1, "TTTT", "t", "hash")], "id int, barcode string, name string, category string")
    rows = [("CCCCACGT", "GGGG")] * 3 + [("CCCCACGA", "GGGG"), ("CCCCACGT", "TTTA"), ("AAAAAAAA", "TTTT"), ("GGGGAAAA", "TTTT")]
    result = plan.run(spark.createDataFrame(rows, "read1 string, read2 string"), cells, features, layout)
    steps = {(r.step, r.category): (r.cells, r.umis, r.reads) for r in result.summaries.collect()}
    assert steps == {("raw", "crispr"): (1, 2, 4), ("raw", "hash"): (2, 2, 2), ("umi_correct", "crispr"): (1, 1, 4), ("umi_correct", "hash"): (2, 2, 2), ("chimeric_filtered", "crispr"): (1, 1, 4)}
    tables.write_molecules(result.molecules, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 8
    raw = result.molecules.where("step = 'raw'")
    tables.write_matrix(raw, cells, features, str(tmp_path / "x"))
    assert spark.read.parquet(str(tmp_path / "x/entries")).count() == 3
    tables.write_market(raw, cells, features, str(tmp_path / "mtx"))
    whole = b"".join(p.read_bytes() for p in sorted((tmp_path / "mtx/hash/matrix.mtx").glob("*.gz")))
    assert gzip.decompress(whole).decode().split("\n") == ["%%MatrixMarket matrix coordinate integer general", "1 2 2", "1 1 1", "1 2 1", ""]
    facts = nearest.list_facts(features, 4, 1).first().asDict()
    assert facts == {"barcodes": 2, "length": 4, "n_keys": 34, "n_ambiguous": 0, "ambiguous_share": 0.0}
    text = tables.report_text(result.counters.first().asDict(), [r.asDict() for r in result.summaries.collect()], [r.asDict() for r in result.kept.collect()], tables.list_text("Features", facts), result.seconds)
    assert "Number of reads: 7" in text and "(85.71%)" in text and "[hash] raw" in text and "umis_kept: 50.00" in text and "cells_kept: 100.00" in text
    assert text.startswith("Features: 2 barcodes of 4 bases; 0 of 34 index keys are ambiguous (0.00%)") and "seconds of UMI correction" in text


def test_bgzf(spark):
    data = bytes(range(256)) * 600
    whole = b"".join(out.bgzf(iter([data[:70000], data[70000:]])))
    assert gzip.decompress(whole) == data and whole.endswith(out.LAST_BLOCK)
    size = int.from_bytes(whole[16:18], "little") + 1
    assert gzip.decompress(whole[:size]) == data[: out.BLOCK]
    kind = "read struct<name: string, comment: string, seq: string, qual: string>"
    frame = spark.createDataFrame([(("r", "", "ACGT", "IIII"),)] * 5, kind)
    blocks = b"".join(r.data for r in out.bgzf_parts(frame).orderBy("part", "block").collect()) + out.LAST_BLOCK
    assert gzip.decompress(blocks) == b"@r\nACGT\n+\nIIII\n" * 5


def test_one_bgzf_file(spark, tmp_path):
    rows = [((f"r{i}", "", "ACGT" * 30, "I" * 120),) for i in range(2000)]
    frame = spark.createDataFrame(rows, "read struct<name: string, comment: string, seq: string, qual: string>").coalesce(3)
    out.write_bgzf(frame, str(tmp_path / "one.fastq.gz"))
    with gzip.open(tmp_path / "one.fastq.gz", "rt") as f:
        assert [r[0] for r in fastq.records(f)] == [f"r{i}" for i in range(2000)]


@pytest.mark.parametrize("size", [70, 1000, 40000, 10**9])
def test_lines_of_bgzf_by_split(spark, tmp_path, size):
    texts = [b"".join(b"%d %s\n" % (i, b"x" * (i * 37 % 300)) for i in range(3000)), b"\n\na\n\n", b"", b"one", b"y" * 200_000 + b"\nlast", b"a\n" + b"z" * 70_000]
    own = out.BLOCK if size > 10**6 else size
    spark.conf.set("spark.sql.files.maxPartitionBytes", 3000)
    try:
        for n, text in enumerate(t for t in texts if len(t) < 5000 * own):
            path = tmp_path / f"{n}.bgz"
            path.write_bytes(b"".join(out.bgzf_block(text[i : i + own]) for i in range(0, len(text), own)) + out.LAST_BLOCK)
            got = lines.bgzf_lines(spark, str(path))
            want = text.decode().split("\n")
            assert sorted(map(tuple, got.collect())) == list(enumerate(want if want[-1] else want[:-1]))
            if path.stat().st_size > 10_000:
                assert got.rdd.getNumPartitions() > 2  # not one task for a file
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_damaged_bgzf(spark, tmp_path):
    whole = out.bgzf_block(b"abc\n") + out.LAST_BLOCK
    for n, bad in enumerate((b"junk" + whole, whole[:-5], whole[:20] + b"?" + whole[21:])):
        (tmp_path / f"{n}.bgz").write_bytes(bad)
        with pytest.raises(Exception, match="BGZF|zlib|decompress"):
            lines.bgzf_lines(spark, str(tmp_path / f"{n}.bgz")).collect()


def test_bgzf_file_of_no_reads(spark, tmp_path):
    out.write_bgzf(spark.createDataFrame([], "read struct<name: string, comment: string, seq: string, qual: string>"), str(tmp_path / "none.bgz"))
    assert (tmp_path / "none.bgz").read_bytes() == out.LAST_BLOCK and lines.bgzf_lines(spark, str(tmp_path / "none.bgz")).count() == 0


def test_written_pairs(spark, tmp_path):
    kind = "struct<name: string, comment: string, seq: string, qual: string>"
    rows = [((f"r{i}", "1", "ACGT", "IIII"), (f"r{i}", "2", "T" * (i % 5 + 1), "")) for i in range(500)]
    out.write_pairs(spark.createDataFrame(rows, f"read1 {kind}, read2 {kind}").repartition(3), str(tmp_path / "x"))
    want = sorted((f"r{i}", "ACGT", "T" * (i % 5 + 1), "1", "2", "IIII", "") for i in range(500))
    names = ["name1", "read1", "read2", "comment1", "comment2", "qual1", "qual2"]
    for where in (f"{tmp_path}/x", f"file://{tmp_path}/x"):
        assert sorted(tuple(r) for r in fastq.read_pairs(spark, where).select(names).collect()) == want
        few = fastq.read_pairs(spark, where, 300)
        assert few.count() == 300 and few.select("name1").distinct().count() == 300
    assert fastq.read_pairs(spark, f"{tmp_path}/x,{tmp_path}/x").count() == fastq.read_pairs(spark, f"file://{tmp_path}/x,file://{tmp_path}/x").count() == 1000
    assert fastq.read_pairs(spark, f"file://{tmp_path}/x,file://{tmp_path}/x").select("file_id", "ordinal").distinct().count() == 1000
    write(tmp_path / "x/z_R1_001.fastq.gz", record("a", "ACGT") * 2)
    write(tmp_path / "x/z_R2_001.fastq.gz", record("a", "ACGT"))
    for where in (f"{tmp_path}/x", f"file://{tmp_path}/x"):
        with pytest.raises(Exception, match="number of records"):
            fastq.read_pairs(spark, where).collect()


def test_batches_and_records_agree():
    texts = [record("a", "ACGT") * 5, record("a b", "ACGT") + ">c\nAC\nGG\n" + record("d", "A"), "\n" + record("a", "AC"), record("a", "AC") + "\n" + record("b", "AC"), "@a\nAC\nGT\n+\nII\nII\n", "", record("a", "ACGT", "@III") * 3]
    for text in texts:
        for size in (1, 2, 100):
            got = [r for b in fastq.batches(iter(text.splitlines(True)), size) for r in zip(*b)]
            assert got == list(fastq.records(iter(text.splitlines(True))))


def test_array_batches_and_records_agree(tmp_path):
    plain = "".join(record(f"r{i}" + " c" * (i % 3), "ACGT"[: i % 4 + 1]) for i in range(40))
    odd = ["@a\tb c\n AC \n+x\nII\n", "@ c\nAC\n+\nII\n", ">f\nAC\nGG\n", "@a\nAC\nGT\n+\nII\nII\n", "@é c\nAC\n+\nII\n", "\n", "@a c\r\nAC\r\n+\r\nII\r\n", record("a", "ACGT", "@III"), ""]
    for text in (plain, "", *(plain + o + plain for o in odd), *odd, "@ c\nAC\n+\nII"):
        (tmp_path / "t").write_text(text, newline="")
        for size in (1, 3, 100):
            with open(tmp_path / "t") as f:
                got = [r for b in fastq.array_batches(fastq.file_arrays(f), size) for r in zip(*(x.to_pylist() for x in b))]
            with open(tmp_path / "t") as f:
                assert got == list(fastq.records(f))


def test_mates_meet_by_chunk(spark, tmp_path):
    n = 2 * fastq.BATCH + 5
    for k in "ab":
        for mate in "12":
            write(tmp_path / f"{k}_R{mate}_001.fastq.gz", "".join(record(f"{k}{i}", "ACGT"[int(mate) :] * (i % 3 + 1)) for i in range(n)))
    where = f"file://{tmp_path}"
    assert fastq._chunks(spark, [f"{where}/{k}_R1_001.fastq.gz" for k in "ab"], "1").count() == 6  # rows that are sorted and shuffled
    names = ["file_id", "ordinal", "name1", "name2", "read1", "read2", "qual2", "comment1"]
    want = [(f, i, f"{k}{i}", f"{k}{i}", "CGT" * (i % 3 + 1), "GT" * (i % 3 + 1), "II" * (i % 3 + 1), "c") for f, k in enumerate("ab") for i in range(n)]
    for place in (where, str(tmp_path)):
        assert sorted(map(tuple, fastq.read_pairs(spark, place).select(names).collect())) == want
        assert sorted(map(tuple, fastq.read_pairs(spark, place, n + 9000).select(names).collect())) == want[: n + 9000]


def test_pairs_keep_their_rows_order(spark, tmp_path):
    kind = "struct<name: string, comment: string, seq: string, qual: string>"
    read = "struct(string(id) AS name, '' AS comment, 'ACGT' AS seq, 'IIII' AS qual)"
    rows = spark.range(20000, numPartitions=2).selectExpr(f"{read} AS read1", f"{read} AS read2")
    before = spark.conf.get(out.WRITERS)
    out.write_pairs(rows, str(tmp_path / "x"))
    out.write_pairs(spark.createDataFrame([], f"read1 {kind}, read2 {kind}"), str(tmp_path / "none"))
    assert spark.conf.get(out.WRITERS) == before and fastq.read_pairs(spark, str(tmp_path / "none")).count() == 0
    for part in "01":
        for mate in "12":
            with gzip.open(tmp_path / f"x/reads_0000{part}_R{mate}_001.fastq.gz", "rt") as f:
                assert [int(r[0]) for r in fastq.records(f)] == list(range(int(part) * 10000, int(part) * 10000 + 10000))


def test_stream(spark, tmp_path):
    layout = molecules.Layout(4, 4, 4)
    cells = spark.createDataFrame([(0, "AAAA", "one")], "id int, barcode string, name string")
    features = spark.createDataFrame([(0, "GGGG", "g", "x")], "id int, barcode string, name string, category string")
    source = tmp_path / "in"
    for rows in ([("AAAAACGT", "GGGG")], [("AAAAACGT", "GGGG"), ("AAAAACGN", "GGGG")]):
        spark.createDataFrame(rows, "read1 string, read2 string").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("read1 string, read2 string").option("maxFilesPerTrigger", 1).parquet(str(source))
    seen = {}
    query = intake.start(intake.molecule_stream(stream, cells, features, layout), str(tmp_path / "check"), lambda df, _: seen.update({r.umi: r.reads for r in df.collect()}))
    query.processAllAvailable()
    query.stop()
    assert seen == {"ACGT": 2}
    near = spark.createDataFrame([("AANAACGT", "GGCC"), ("AAAAACGT", "GGGG"), ("ANNAACGT", "GGGG")], "read1 string, read2 string")
    assert [tuple(r) for r in intake.molecule_stream(near, cells, features, layout).collect()] == [("x", 0, 0, "ACGT", 2)]


def test_stream_in_windows(spark, tmp_path):
    layout = molecules.Layout(4, 4, 4)
    cells = spark.createDataFrame([(0, "AAAA", "one")], "id int, barcode string, name string")
    features = spark.createDataFrame([(0, "GGGG", "g", "x")], "id int, barcode string, name string, category string")
    source = tmp_path / "in"
    source.mkdir()
    stream = spark.readStream.schema("ts timestamp, read1 string, read2 string").parquet(str(source))
    seen = {}
    counts = intake.molecule_stream(stream, cells, features, layout, event_time="ts")
    query = intake.start(counts, str(tmp_path / "check"), lambda df, _: seen.update({(r.window.start.hour, r.umi): r.reads for r in df.collect()}))
    for stamps in (["2026-01-01 00:10:00", "2026-01-01 00:20:00"], ["2026-01-01 09:00:00"], ["2026-01-01 00:30:00", "2026-01-01 09:30:00"]):
        rows = spark.createDataFrame([(t, "AAAAACGT", "GGGG") for t in stamps], "ts string, read1 string, read2 string")
        rows.selectExpr("timestamp(ts) AS ts", "read1", "read2").coalesce(1).write.mode("append").parquet(str(source))
        query.processAllAvailable()
    query.stop()
    assert seen == {(0, "ACGT"): 2, (9, "ACGT"): 2}  # the read of 00:30 came when its window was over


TAGS, CELLS = ["ACGTACGTAC", "TTGGCCAATT"], ["ACGTACGT", "GGCCTTAA", "CATGCATG"]
SCAFFOLD = "GTTTAAGAGCTAAGCTGGAA"
RUNS = [
    # type, options, list that holds the cells, start of the tag in read2, scaffold
    ("hashing", [], "SC3Pv3:Poly-A", 0, ""),
    ("citeseq", ["--chemistry", "threeprime"], "SC3Pv3:CS1", 10, ""),
    ("adt", [], "10x_v2", 0, ""),
    ("adt", ["--chemistry", "multiome", "--barcode-pos", "3"], "multiome", 10, ""),
    ("hashing", ["--chemistry", "SC5Pv3", "-p", "3", "--no-such-flag", "7"], "SC5Pv3", 10, ""),
    ("cmo", ["--barcode-pos", "4"], "SC5Pv3", 0, ""),
    ("crispr", ["--barcode-pos", "4"], "multiome", 4, ""),
    ("crispr", ["--chemistry", "SC3Pv2"], "SC3Pv2", 0, ""),
    ("crispr", ["--scaffold-sequence", SCAFFOLD], "SC3Pv4:Poly-A", 7, SCAFFOLD),
]


@pytest.mark.parametrize("kind, options, chem, start, scaffold", RUNS)
def test_command_line(spark, tmp_path, kind, options, chem, start, scaffold):
    (tmp_path / "lists").mkdir()
    for name, file in chemistry.LISTS.items():
        own = CELLS if file == chemistry.LISTS[chem] else ["T" * 7 + "ACG"[len(name) % 3]]
        write(tmp_path / "lists" / file, "".join(f"{c}\n" for c in own))
    (tmp_path / "features.csv").write_text("".join(f"{t},tag{i}\n" for i, t in enumerate(TAGS)))
    (tmp_path / "reads").mkdir()
    umi = chemistry.lengths(chem)[0]
    rows = [(CELLS[i % 3] + ("ACGT"[i % 4] * umi), "G" * start + TAGS[i % 2] + scaffold + "C" * 5) for i in range(60)]
    for mate in (0, 1):
        write(tmp_path / f"reads/a_R{mate + 1}_001.fastq.gz", "".join(record(f"r{i}", r[mate]) for i, r in enumerate(rows)))
    cli.main([str(tmp_path / "lists"), kind, str(tmp_path / "features.csv"), str(tmp_path / "reads"), str(tmp_path / "out"), *options])
    raw = spark.read.parquet(str(tmp_path / "out/molecules")).where("step = 'raw'")
    want = {(i % 3, i % 2, "ACGT"[i % 4] * umi) for i in range(60)}
    assert {(r.cell_id, r.feature_id, r.umi) for r in raw.collect()} == want and {r.category for r in raw.collect()} == {kind}
    report = "\n".join(p.read_text() for p in (tmp_path / "out/report").glob("part-*"))
    assert "Features: 2 barcodes of 10 bases" in report and "Cells: 3 barcodes of 8 bases" in report
    assert "Reads with valid barcodes and UMI: 60 (100.00%)" in report and f"[{kind}] raw" in report and "umis_kept" in report and "seconds of reads to molecules" in report
    assert ("chimeric_filtered" in report) == (kind == "crispr")


def test_command_line_refuses(spark, tmp_path):
    (tmp_path / "features.csv").write_text("ACGT,a\n")
    for kind, options in (("antibody", []), ("hashing", ["--chemistry", "10x_v2"]), ("cmo", ["--chemistry", "other"])):
        with pytest.raises(ValueError):
            cli.main([str(tmp_path), kind, str(tmp_path / "features.csv"), str(tmp_path), str(tmp_path / "out"), *options])
    with pytest.raises(SystemExit):
        cli.main(["a", "cmo", "c", "d", "e", "--read-ratio-cutoff", "1"])
    with pytest.raises(Exception, match="(?i)path"):  # a list that is not there
        (tmp_path / "reads").mkdir()
        write(tmp_path / "reads/a_R1_001.fastq.gz", record("a", "ACGT"))
        write(tmp_path / "reads/a_R2_001.fastq.gz", record("a", "ACGT"))
        cli.main([str(tmp_path), "cmo", str(tmp_path / "features.csv"), str(tmp_path / "reads"), str(tmp_path / "out")])
