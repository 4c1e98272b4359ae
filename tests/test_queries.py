"""Every core query with SQL, against DuckDB over the smallest shared tables."""

import os
import sys

import duckdb
import pytest

import __spark_entry__
from tagweft import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no shared tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query(spark, sql, name):
    got = catalogue.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    want = sql.sql(catalogue.ORACLE_SQL[name])
    assert names == sorted(want.columns)
    rows = sorted(map(repr, (tuple(r[c] for c in names) for r in got.collect())))
    assert rows == sorted(map(repr, want.select(*names).fetchall()))


def test_entry_without_the_training_data_package(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("tagweft.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "public_tokenizers", None)  # its import fails
    with pytest.warns(UserWarning, match="no training-data queries"):
        assert __spark_entry__.queries().keys() == catalogue.QUERIES.keys()
    with pytest.warns(UserWarning):
        assert __spark_entry__.oracle_sql().keys() == catalogue.ORACLE_SQL.keys()


def test_every_query_has_sql():
    assert catalogue.QUERIES.keys() == catalogue.ORACLE_SQL.keys()
