import itertools

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sedge.functions.ids import is_digits, numeric_key, ordered_list, trimmed
from sedge.functions.lines import short_similarity
from sedge.operators.community import count_by_community, shared_suppliers
from sedge.operators.graph import adjacency, degrees, distinct_edges, exploded, limit_hubs
from sedge.operators.pairs import INT_MAX, pair_counts, pair_members, saturated, top_pair
from sedge.operators.similarity import directed, jaccard, top_k
from sedge.plans import community_counts, max_pair, topk_lex, topk_numeric
from sedge.sources import parse_edges


def edges_of(spark, pairs):
    return spark.createDataFrame(list(pairs), "company string, supplier string")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("line", "comma", "space"),
    [
        ("a b", ("a", "b"), ("a", "b")), ("a\tb\tc", ("a", "b"), ("a", "b")), ("a,b c", ("a", "b"), ("a,b", "c")), (",a b", None, (",a", "b")),
        (" a,", None, None), (",", None, None), ("", None, None), ("  \t ", None, None), ("one", None, None), ("a\x0bb", ("a", "b"), ("a", "b")), ("a b", None, None),
    ],
)
def test_parse(spark, line, comma, space):
    lines = spark.createDataFrame([(line,)], "value string")
    for delimiter, want in (("ws_or_comma", comma), ("ws", space)):
        assert [tuple(r) for r in parse_edges(lines, delimiter).collect()] == ([want] if want else [])


def test_ids(spark):
    assert one(spark, trimmed(F.lit("\t\x01 a b\n"))) == "a b"
    assert [one(spark, is_digits(F.lit(x))) for x in ("12", "", "1a", "١")] == [True, False, False, False]
    ids = ["10", "9", "007", "7", "123456789012345678901234567890", "0", "000"]
    rows = spark.createDataFrame([(x,) for x in ids], "v string")
    assert [r.v for r in rows.orderBy(numeric_key(F.col("v"))).collect()] == ["0", "000", "007", "7", "9", "10", "123456789012345678901234567890"]
    assert rows.agg(ordered_list(F.col("v"), "numeric").alias("x")).first().x[:3] == ["0", "000", "007"]
    assert rows.agg(ordered_list(F.col("v")).alias("x")).first().x == sorted(ids)


def test_short_similarity(spark):
    texts = {2 / 3: "0.6666666666", 1.0: "1", 0.5: "0.5", 1 / 1050: "0.0009523809"}
    assert {x: one(spark, short_similarity(F.lit(x))) for x in texts} == texts
    assert one(spark, F.format_string("%.6f", F.lit(1 / 128))) == "0.007813"


def test_numeric_pairs_are_one(spark):
    got = pair_counts(edges_of(spark, [("7", "a"), ("007", "a"), ("7", "b"), ("007", "b")]), "numeric").collect()
    assert [tuple(r) for r in got] == [("007", "7", 2)]


def test_hub_boundary(spark):
    edges = edges_of(spark, [(str(c), s) for s, n in (("x", 3), ("y", 4)) for c in range(n)])
    assert {r.supplier for r in limit_hubs(edges, 3).collect()} == {"x"}


def test_rounded_against_exact_rank(spark):
    """Unions of 2000 and 2001: equal at six decimals, so the id decides one ranking and the similarity the other."""
    rows = [("m", "s")] + [("b", f"b{i}") for i in range(1999)] + [("a", f"a{i}") for i in range(2000)] + [("a", "s"), ("b", "s")]
    edges = edges_of(spark, rows)
    assert topk_lex(edges, 1, shared=False).filter("company = 'm'").first().other == "a"
    top = jaccard(pair_counts(edges), degrees(distinct_edges(edges)))
    assert top_k(directed(top), 1, None).filter("company = 'm'").first().other == "b"


def test_labels(spark):
    edges = edges_of(spark, [("1", "a"), ("2", "a"), ("1", "b"), ("a", "a")])
    labels = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "y"), ("b", "y"), ("c", "z")], "company string, label string")
    assert [tuple(r) for r in count_by_community(shared_suppliers(edges), labels).collect()] == [("y", 1)]


def test_empty(spark):
    edges = edges_of(spark, [])
    labels = spark.createDataFrame([], "company string, label string")
    for df in (max_pair(edges), topk_lex(edges), topk_numeric(edges), community_counts(edges, labels), top_pair(pair_counts(edges))):
        assert df.count() == 0
    assert topk_lex(edges_of(spark, [("1", "a"), ("2", "a")]), 0).count() == 0


def test_saturation(spark):
    counts = spark.createDataFrame([("a", "b", INT_MAX + 5)], "c1 string, c2 string, common long")
    assert saturated(counts).first().common == INT_MAX


graphs = st.lists(st.tuples(st.integers(0, 7).map(str), st.integers(0, 6).map(str)), max_size=40)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(graphs)
def test_against_brute_force(spark, rows):
    sets = {}
    for c, s in rows:
        sets.setdefault(c, set()).add(s)
    pairs = {(a, b): sets[a] & sets[b] for a, b in itertools.combinations(sorted(sets), 2) if sets[a] & sets[b]}
    sims = {(a, b): len(x) / len(sets[a] | sets[b]) for (a, b), x in pairs.items()}
    edges = distinct_edges(edges_of(spark, rows + rows[:3]))
    assert {(r.c1, r.c2): set(r.shared) for r in pair_members(edges).collect()} == pairs
    assert {(r.c1, r.c2): r.sim for r in jaccard(pair_counts(edges), degrees(edges)).collect()} == sims
    assert {(r.company, r.supplier, r.size) for r in exploded(adjacency(edges)).collect()} == {(c, s, len(sets[c])) for c, s in rows}
    both = {(a, b): s for (x, y), s in sims.items() for a, b in ((x, y), (y, x))}
    want = {(c, o, i + 1) for c in sets for i, (_, o) in enumerate(sorted((-round(s, 6), b) for (a, b), s in both.items() if a == c)[:3])}
    assert {(r.company, r.other, r.rank) for r in topk_lex(edges_of(spark, rows)).collect()} == want
    best = sorted((-len(x), p) for p, x in pairs.items())[:1]
    assert [(r.c1, r.c2, r.common) for r in max_pair(edges_of(spark, rows)).collect()] == [(*p, -n) for n, p in best]


def test_hubs_are_cut(spark, monkeypatch):
    """A hub's pairs are the same made in one task or in several."""
    rows = [(str(c), s) for s, n in (("hub", 40), ("x", 5), ("y", 1)) for c in range(n)]
    whole = {tuple(r) for r in pair_members(edges_of(spark, rows)).select("c1", "c2", "common").collect()}
    monkeypatch.setattr("sedge.operators.pairs.HUB_ROWS", 7)
    assert {tuple(r) for r in pair_members(edges_of(spark, rows)).select("c1", "c2", "common").collect()} == whole
    assert {(r.c1, r.c2, r.common) for r in pair_counts(edges_of(spark, rows), "numeric").collect()} == {(*sorted(r[:2], key=int), r[2]) for r in whole}
