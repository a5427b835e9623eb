"""Registered queries against their DuckDB statements on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from sedge.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{entry.SMOKE}/{name}.parquet'")
    return con


def plain(rows):
    return sorted(str([round(float(x), 9) if isinstance(x, float) else str(x) for x in r]) for r in rows)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert QUERIES.keys() == ORACLES.keys() <= entry.queries().keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, entry.SMOKE)
    columns = sorted(df.columns)
    want = duck.sql(ORACLES[name])
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    assert plain(df.select(*columns).collect()) == plain([r[i] for i in order] for r in want.fetchall())
