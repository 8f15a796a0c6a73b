"""Every query of the bank with SQL against DuckDB on the small tables."""

import os

import pytest

from tessera.plans import bank, planes  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings pages".split()
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(6) + 0.0
    return sorted(map(repr, df.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(bank.ORACLE_SQL))
def test_query(spark, con, name):
    got = bank.QUERIES[name](spark, SF)
    want = con.sql(bank.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got.toPandas()) == plain(want.df())


def test_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(bank.QUERIES) <= set(entry.queries())
