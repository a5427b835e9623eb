"""The sparse relation's queries leave no order out."""

import itertools
from collections import Counter

import duckdb

import __spark_entry__ as entry
from sedge.plans.queries import QUERIES


def test_all_orders(spark):
    edges = duckdb.sql(f"SELECT DISTINCT l_orderkey::VARCHAR, l_partkey::VARCHAR FROM '{entry.SMOKE}/lineitem.parquet'").fetchall()
    brand = dict(duckdb.sql(f"SELECT p_partkey::VARCHAR, p_brand FROM '{entry.SMOKE}/part.parquet'").fetchall())
    buyers = {}
    for order, part in edges:
        buyers.setdefault(part, []).append(order)
    shared = {p for p, of in buyers.items() if len(of) >= 2}
    counts = Counter(brand[p] for p in shared)
    pairs = Counter(pair for of in buyers.values() for pair in itertools.combinations(sorted(of), 2))

    def got(name):
        return {tuple(r) for r in QUERIES[name](spark, entry.SMOKE).collect()}

    assert got("shared_suppliers") == {(p,) for p in shared}
    assert got("community_counts") == set(counts.items())
    assert got("community_lines") == {(f"Community {label}", n) for label, n in counts.items()}
    assert got("pair_counts_saturated") == {(*p, n) for p, n in pairs.items()}
