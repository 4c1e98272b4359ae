import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagweft.functions import dna


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_strict_substr(spark):
    assert one(spark, dna.strict_substr(F.lit("ACGT"), 1, 2)) == "CG"
    with pytest.raises(Exception, match="too short"):
        one(spark, dna.strict_substr(F.lit("ACGT"), 3, 2))


def test_codes(spark):
    words = ["A", "C", "ACGTN", "nACG", "T" * 21, "ACGTACGTACGTACGTACGTA"]
    frame = spark.createDataFrame([(w,) for w in words], "b string")
    for r in frame.select("b", dna.encode(F.col("b")).alias("c"), dna.decode(dna.encode(F.col("b")), F.length("b")).alias("d")).collect():
        assert r.c == sum("ACGTN".index(x) << (3 * i) for i, x in enumerate(r.b.upper()))
        assert r.d == r.b.upper()
    assert one(spark, dna.encode(F.lit("ACX"))) is None
    assert one(spark, dna.encode(F.lit("A" * 22))) is None


def test_small_functions(spark):
    assert one(spark, dna.reverse_complement(F.lit("ACGN"))) == "NCGT"
    assert one(spark, dna.hamming(F.lit("ACGT"), F.lit("AGGA"))) == 2
    assert one(spark, dna.wildcard(F.lit("ACGT"), F.lit(2))) == "A*GT"
    assert one(spark, dna.trim_space(F.lit(" \tACGT x\r\n"))) == "ACGT x"
    assert one(spark, dna.percent(F.lit(1), F.lit(3))) == 33.33
    assert one(spark, dna.percent(F.lit(1), F.lit(0))) is None
    assert one(spark, dna.type_label(F.lit("citeseq"))) == "Antibody Capture"
    assert one(spark, dna.type_label(F.lit("cmo"))) == "Custom"


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text("ACGTN", min_size=4, max_size=4), min_size=2, max_size=2))
def test_wildcards_meet_within_distance(pair):
    from itertools import combinations

    def stars(b, n):
        return {"".join("*" if i in c else x for i, x in enumerate(b)) for c in combinations(range(4), n)}

    distance = sum(x != y for x, y in zip(*pair))
    for n in range(3):
        assert bool(stars(pair[0], n) & stars(pair[1], n)) == (distance <= n)


def test_fastq_text(spark):
    kind = "read struct<name: string, comment: string, seq: string, qual: string>"
    frame = spark.createDataFrame([(("r1", "c", "ACGT", "IIII"),), (("r2", None, "AC", None),)], kind)
    got = [r.t for r in frame.select(dna.fastq_text(F.col("read")).alias("t")).collect()]
    assert got == ["@r1 c\nACGT\n+\nIIII\n", ">r2\nAC\n"]
