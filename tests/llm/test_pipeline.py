import os

import duckdb
import pytest

import corpus_pipeline
from tagweft.llm import catalogue
from tagweft.llm.shared import ship

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no shared tables")


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = catalogue.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    want = con.sql(catalogue.ORACLE_SQL[name])
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(repr, want.select(*names).fetchall()))


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "near_dedup", "decontamination", "packing"]
    docs = catalogue.table(spark, SF, "documents")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == names
        ids = {r.doc_id for r in after.collect()}
        assert ids and ids <= {r.doc_id for r in docs.select("doc_id").collect()}
        docs = docs.where(docs.doc_id.isin(*ids))
    packed = {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()}
    assert packed == {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == packed


def test_stages_on_odd_rows(spark):
    ship(spark)
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "a b", "en", "s", 3), (2, "", "en", None, 0), (2, "", "en", None, 0), (3, "word " * 50_000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, catalogue.table(spark, SF, "documents").schema)
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, frame, SF).collect()
