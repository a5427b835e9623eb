"""The micro-fixture of FIXTURES.md and its expected outputs."""

from types import SimpleNamespace

import pytest

from sedge import cli, storage
from sedge.functions.lines import filter_id_suffix, format_lex_line, format_numeric_line
from sedge.operators.community import titled
from sedge.plans import community_counts, max_pair, topk_lex, topk_numeric
from sedge.sources import parse_edges, parse_labels, read_edges

LINES = ["1 10", "1 11", "1 12", "2\t10", "2 11", "2 13", "3 11", "3 12", "10 11", "9 10", "1 10", "4,20", "   ", "x", "007 11", "z 11"]
LABELS = ["10 5", "11 5", "12 7", "13 7", "1 9"]
LEX = """007:10, {11}, 1.000000
007:z, {11}, 1.000000
007:3, {11}, 0.500000
1:3, {11,12}, 0.666667
1:2, {10,11}, 0.500000
1:007, {11}, 0.333333
10:007, {11}, 1.000000
10:z, {11}, 1.000000
10:3, {11}, 0.500000
2:1, {10,11}, 0.500000
2:007, {11}, 0.333333
2:10, {11}, 0.333333
3:1, {11,12}, 0.666667
3:007, {11}, 0.500000
3:10, {11}, 0.500000
9:1, {10}, 0.333333
9:2, {10}, 0.333333
z:007, {11}, 1.000000
z:10, {11}, 1.000000
z:3, {11}, 0.500000""".splitlines()
NUMERIC = """1:3, {11,12}, 0.6666666666
1:2, {10,11}, 0.5
1:007, {11}, 0.3333333333
1:9, {10}, 0.3333333333
2:1, {10,11}, 0.5
2:007, {11}, 0.3333333333
2:9, {10}, 0.3333333333
2:10, {11}, 0.3333333333
3:1, {11,12}, 0.6666666666
3:007, {11}, 0.5
3:10, {11}, 0.5
3:2, {11}, 0.25
007:10, {11}, 1
007:3, {11}, 0.5
007:1, {11}, 0.3333333333
007:2, {11}, 0.3333333333
9:1, {10}, 0.3333333333
9:2, {10}, 0.3333333333
10:007, {11}, 1
10:3, {11}, 0.5
10:1, {11}, 0.3333333333
10:2, {11}, 0.3333333333""".splitlines()


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame([(x,) for x in LINES], "value string")


@pytest.fixture(scope="module")
def labels(spark):
    return parse_labels(spark.createDataFrame([(x,) for x in LABELS], "value string"))


def by_company(found):
    out = {}
    for line in found:
        out.setdefault(line.split(":")[0], []).append(line)
    return out


def test_edges(lines):
    assert parse_edges(lines, "ws_or_comma").distinct().count() == 13
    assert parse_edges(lines).distinct().count() == 12
    assert parse_edges(lines, "ws", "digits").distinct().count() == 11


def test_max_pair(lines):
    edges = parse_edges(lines, "ws_or_comma")
    assert [tuple(r) for r in max_pair(edges).collect()] == [("1", "2", 2)]
    assert [tuple(r) for r in max_pair(edges, 2).collect()] == [("1", "3", 1)]


def test_topk_lex(lines):
    got = topk_lex(parse_edges(lines)).orderBy("company", "rank").select(format_lex_line().alias("x")).collect()
    assert by_company(r.x for r in got) == by_company(LEX)


def test_topk_numeric(lines):
    got = topk_numeric(parse_edges(lines, "ws", "digits"))
    text = got.orderBy("company", "rank").select(format_numeric_line().alias("x"))
    assert by_company(r.x for r in text.collect()) == by_company(NUMERIC)
    assert {r.company for r in filter_id_suffix(got, "7").collect()} == {"007"}
    assert filter_id_suffix(got, "0").count() == 4


def test_communities(lines, labels):
    got = titled(community_counts(parse_edges(lines), labels)).collect()
    assert {tuple(r) for r in got} == {("Community 5", 2), ("Community 7", 1)}


def test_files(spark, tmp_path):
    (tmp_path / "in").write_text("\n".join(LINES) + "\n")
    (tmp_path / "labels").write_text("\n".join(LABELS) + "\n")

    def run(*args):
        cli.main([str(a) for a in args], spark)
        parts = sorted((tmp_path / "out").glob("part-*"))
        return [line for x in parts for line in x.read_text().splitlines()]

    assert run("max-pair", tmp_path / "in", tmp_path / "out") == ["1\t2\t2"]
    assert run("topk-lex", tmp_path / "in", tmp_path / "out") == [x + "\t" for x in LEX]
    assert sorted(run("community", tmp_path / "in", tmp_path / "labels", tmp_path / "out")) == ["Community 5\t2", "Community 7\t1"]
    assert by_company(run("topk-numeric", tmp_path / "in", tmp_path / "out", 4)) == by_company(NUMERIC)
    cli.main(["suffix", "7", str(tmp_path / "out"), str(tmp_path / "out2")], spark)
    assert spark.read.text(str(tmp_path / "out2")).count() == 4
    with pytest.raises(Exception, match="(?i)exist"):
        cli.main(["--mode", "errorifexists", "max-pair", str(tmp_path / "in"), str(tmp_path / "out")], spark)


def test_folders_and_patterns(spark, tmp_path):
    for name, lines in (("a1", LINES[:5]), ("a2", LINES[5:]), ("b1", ["no pattern"])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "part").write_text("\n".join(lines) + "\n")
    assert read_edges(spark, f"{tmp_path}/a*").distinct().count() == 12
    assert read_edges(spark, [f"{tmp_path}/a1", f"{tmp_path}/a2"]).distinct().count() == 12


def test_working_tables(spark, tmp_path):
    """Tables on the way go as soon as what came of them is written; on a cluster there is no folder of one's own."""
    made = len(storage._made)
    df = spark.range(5)
    out = storage.settled("end", lambda: storage.written(df.union(storage.written(df, "one")), "two"))
    assert out.count() == 10 and len(storage._made) == made + 1
    storage.discard(out, df)
    assert len(storage._made) == made
    context = SimpleNamespace(master="local-cluster[2,1,1024]", _jsc=spark.sparkContext._jsc)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        with pytest.raises(RuntimeError, match="checkpoint"):
            storage.shared_dir(SimpleNamespace(conf={}, sparkContext=context))
