"""Registered queries against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as contract
from tools import check_oracle as tool

ORACLES = contract.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in tool.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns[0] == "modele" and df.count() == 4


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(contract.queries()) and len(ORACLES) > 100


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, sf, name):
    df = contract.queries()[name](spark, sf)
    mine = [tuple(r) for r in df.collect()]
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    theirs = result.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert tool.canonical(mine, df.columns) == tool.canonical(theirs, columns)
