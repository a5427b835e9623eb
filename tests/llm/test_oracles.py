"""Queries with a DuckDB statement, over the whole smallest tables, and what is registered."""

import pytest
from conftest_llm import SMOKE

import __spark_entry__ as entry
from sedge.llm.queries import ORACLES, QUERIES


def plain(rows):
    return sorted(str([round(float(x), 6) if isinstance(x, float) else str(x) for x in r]) for r in rows)


def test_registered():
    names = entry.queries()
    assert [sum(x.startswith(f"op{n}_") for x in names) for n in range(1, 11)] == [1] * 10
    assert "pipeline" in names
    assert ORACLES.keys() <= QUERIES.keys()


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMOKE)
    want = duck.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    assert plain(df.select(*columns).collect()) == plain([r[i] for i in order] for r in want.fetchall())
