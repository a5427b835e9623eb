"""Companies of equal suppliers: rankings make pairs of their classes, not of their members."""

import itertools
import random

import duckdb
import pytest

from sedge.operators import classes as of_classes
from sedge.plans import tasks, topk_lex, topk_numeric
from sedge.plans.queries import QUERIES

USERS, TYPES = 2500, ("click", "error", "purchase", "signup", "view")


@pytest.fixture(scope="module")
def events(tmp_path_factory):
    """Users 0 to ``USERS`` - 1, each with all types of events."""
    at = tmp_path_factory.mktemp("alike")
    types = " UNION ALL ".join(f"SELECT '{x}' AS event_type" for x in TYPES)
    duckdb.sql(f"COPY (SELECT range AS user_id, event_type FROM range({USERS}), ({types})) TO '{at}/events.parquet' (FORMAT parquet)")
    return str(at)


@pytest.fixture
def met(monkeypatch):
    """How many rows of edges the pairs were made of, call by call."""
    calls, plain = [], tasks.counted
    monkeypatch.setattr(tasks, "counted", lambda edges: calls.append(edges.count()) or plain(edges))
    return calls


def ranking(k, key):
    least = sorted(range(USERS), key=key)[: k + 1]
    return {(str(u), i + 1, str(o)) for u in range(USERS) for i, o in enumerate([x for x in least if x != u][:k])}


@pytest.mark.parametrize("name", ["format_lex", "format_numeric", "sink_keys", "sink_trailing_tab", "topk_ties_lex", "topk_ties_numeric"])
def test_growth(spark, events, met, name):
    lex = name in ("topk_ties_lex", "format_lex", "sink_trailing_tab")
    want = ranking(3, str) if lex else ranking(4, int)
    rows = QUERIES[name](spark, events).collect()
    assert met == [len(TYPES)]
    if name.startswith("topk"):
        assert sorted((r.company, r.rank, r.other) for r in rows) == sorted(want) and {(r.common, r.sim) for r in rows} == {(5, 1.0)}
        return
    end = (", {%s}, " % ",".join(TYPES if lex else sorted(TYPES, key=lambda x: (len(x), x)))) + ("1.000000" if lex else "1") + "\t" * (name == "sink_trailing_tab")
    lines = {(c, i, f"{c}:{o}{end}") for c, i, o in want}
    if name.startswith("sink"):
        assert sorted(r.value for r in rows) == sorted(x[2] for x in lines)
    else:
        assert sorted((r.company, r.rank, r.line) for r in rows) == sorted(lines)


@pytest.mark.parametrize("folded", ["as it is", "all alike"])
def test_against_all_pairs(spark, monkeypatch, folded):
    """Few different sets, a null among the suppliers, and hashes that tell nothing apart."""
    if folded == "all alike":
        monkeypatch.setattr(of_classes, "fold", lambda suppliers: [of_classes.F.min(of_classes.F.lit(0)).alias(f"_fold{i}") for i in range(2)])
    draw = random.Random(5)
    sets = {str(c): frozenset(draw.sample(["a", "b", "c", "d", None], draw.choice((1, 2, 2, 3)))) for c in range(60)}
    edges = spark.createDataFrame([(c, s) for c, of in sets.items() for s in of] + [(None, "a")], "company string, supplier string")
    pairs = {}
    for a, b in itertools.permutations(sets, 2):
        if shared := sorted((sets[a] & sets[b]) - {None}):
            pairs.setdefault(a, []).append((len(shared) / (len(sets[a]) + len(sets[b]) - len(shared)), b, shared))
    for k, of, key in ((3, topk_lex, lambda x: (-round(x[0], 6), x[1])), (100, topk_numeric, lambda x: (-x[0], int(x[1])))):
        want = sorted((a, i + 1, b, len(s), sim, s) for a, near in pairs.items() for i, (sim, b, s) in enumerate(sorted(near, key=key)[:k]))
        assert sorted((r.company, r.rank, r.other, r.common, r.sim, list(r.shared)) for r in of(edges, k).collect()) == want
