"""The registered queries over the driver's tables, each with the DuckDB statement that gives the same rows.

Companies and suppliers are cut from the tables, always from all rows: R1 sells parts to suppliers (``l_suppkey``,
``l_partkey``), R2 ties users to event types, R3 ties orders to parts, whose brands are the labels, R4 is R1 with
leading zeros in some ids, R5 ties suppliers to orders, of which two suppliers share few.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.functions.lines import filter_id_suffix, format_lex_line, format_numeric_line, short_similarity
from sedge.operators.community import one_label, shared_suppliers, titled
from sedge.operators.graph import adjacency, degrees, distinct_edges, exploded, inverted_index, limit_hubs
from sedge.operators.numbering import number
from sedge.operators.pairs import pair_counts, pair_members, saturated
from sedge.operators.similarity import directed
from sedge.plans.tasks import community_counts, max_pair, similar_pairs, topk_lex, topk_numeric
from sedge.sources.text import parse_edges, parse_labels, read_edges, write_lines
from sedge.storage import new_path

HUB = 25
#: What counts are multiplied by, so that some pass the largest 32-bit integer.
MANY = 16_000_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(name: str) -> Column:
    return F.col(name).cast("string")


def r1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select(_text("l_suppkey").alias("company"), _text("l_partkey").alias("supplier"))


def r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select(_text("user_id").alias("company"), F.col("event_type").alias("supplier"))


def r3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select(_text("l_orderkey").alias("company"), _text("l_partkey").alias("supplier"))


def r4(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("00"), _text("l_suppkey"))).otherwise(_text("l_suppkey"))
    return _table(spark, sf_dir, "lineitem").select(padded.alias("company"), _text("l_partkey").alias("supplier"))


def r5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select(_text("l_suppkey").alias("company"), _text("l_orderkey").alias("supplier"))


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select(_text("p_partkey").alias("company"), F.col("p_brand").alias("label"))


def _lines(spark: SparkSession, sf_dir: str, separator: str, *more: Column) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select(F.concat_ws(separator, _text("l_suppkey"), _text("l_partkey"), *more).alias("value"))


def _untidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line a row of lineitem: padded, of one token, blank, led by a comma, of three tokens, of two tabs, of comma and space."""
    s, p, way = _text("l_suppkey"), _text("l_partkey"), F.col("l_orderkey") % 7
    lines = [F.concat(F.lit(" \t"), s, F.lit(" "), p, F.lit("  ")), s, F.lit("   "), F.concat(F.lit(","), s, F.lit(" "), p), F.concat(s, F.lit(","), p, F.lit(",x")), F.concat(s, F.lit("\t\t"), p), F.concat(s, F.lit(", "), p)]
    value = F.when(way == 0, lines[0])
    for k in range(1, 7):
        value = value.when(way == k, lines[k])
    return _table(spark, sf_dir, "lineitem").select(value.alias("value"))


def _sunk(lines: DataFrame, **how) -> DataFrame:
    """The lines as a sink's files hold them."""
    spark = lines.sparkSession
    path = new_path(spark, "sink")
    write_lines(lines, path, **how)
    return spark.read.text(path)


def _globbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of two folders, read by one pattern."""
    path = new_path(spark, "folders")
    lines = _lines(spark, sf_dir, " ")
    for name, rows in (("part-a", lines), ("part-b", _lines(spark, sf_dir, "\t", F.lit("more")))):
        write_lines(rows, f"{path}/{name}")
    return read_edges(spark, f"{path}/part-*")


def _conflicting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brands(spark, sf_dir).unionAll(brands(spark, sf_dir).select("company", F.lower("label").alias("label")))


def _similar(spark: SparkSession, sf_dir: str, edges: Callable) -> DataFrame:
    own = number(edges(spark, sf_dir))
    return own.named(similar_pairs(own), "c1", "c2")


def _directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = number(r1(spark, sf_dir))
    return own.named(directed(similar_pairs(own)), "company", "other")


def _e1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_edges(r1(spark, sf_dir))


def _joined(df: DataFrame, *names: str) -> DataFrame:
    """Arrays as comma-joined text, which any engine compares alike."""
    return df.select(*[F.concat_ws(",", c).alias(c) if c in names else c for c in df.columns])


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("sim", F.round("sim", 6))


def _ranked(top: DataFrame) -> DataFrame:
    return _joined(_rounded(top), "shared") if "shared" in top.columns else _rounded(top)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "parse_ws_or_comma": lambda s, d: parse_edges(_lines(s, d, ","), "ws_or_comma"),
    "parse_ws": lambda s, d: parse_edges(_lines(s, d, "\t", F.lit("more")), "ws"),
    "parse_digits": lambda s, d: parse_edges(_table(s, d, "events").select(F.concat_ws(" ", _text("user_id"), "event_type").alias("value")).unionAll(_lines(s, d, " ")), "ws", "digits"),
    "parse_labels": lambda s, d: parse_labels(_table(s, d, "part").select(F.concat_ws(" ", _text("p_partkey"), "p_brand").alias("value"))),
    "distinct_edges": _e1,
    "degrees": lambda s, d: degrees(_e1(s, d)),
    "adjacency": lambda s, d: _joined(adjacency(_e1(s, d)), "suppliers"),
    "adjacency_exploded": lambda s, d: exploded(adjacency(_e1(s, d))),
    "inverted_index": lambda s, d: _joined(inverted_index(_e1(s, d)), "companies"),
    "hub_guard_pairs": lambda s, d: pair_counts(limit_hubs(_e1(s, d), HUB)),
    "pair_counts_lex": lambda s, d: pair_counts(r1(s, d)),
    "pair_counts_numeric": lambda s, d: pair_counts(r1(s, d), "numeric"),
    "pair_counts_saturated": lambda s, d: saturated(pair_counts(r3(s, d))),
    "pair_members_lex": lambda s, d: _joined(pair_members(r1(s, d)), "shared"),
    "pair_members_numeric": lambda s, d: _joined(pair_members(r1(s, d), "numeric"), "shared"),
    "max_pair": lambda s, d: max_pair(r1(s, d)),
    "max_pair_hub_guard": lambda s, d: max_pair(r1(s, d), HUB),
    "jaccard_pairs": lambda s, d: _rounded(_similar(s, d, r1)),
    "directed_pairs": lambda s, d: _rounded(_directed(s, d)),
    "topk_lex": lambda s, d: _ranked(topk_lex(r1(s, d), shared=False)),
    "topk_numeric": lambda s, d: _ranked(topk_numeric(r1(s, d), shared=False)),
    "topk_ties_lex": lambda s, d: _ranked(topk_lex(r2(s, d), shared=False)),
    "topk_ties_numeric": lambda s, d: _ranked(topk_numeric(r2(s, d), shared=False)),
    "topk_with_shared": lambda s, d: _ranked(topk_lex(r1(s, d))),
    "topk_numeric_with_shared": lambda s, d: _ranked(topk_numeric(r1(s, d))),
    "shared_suppliers": lambda s, d: shared_suppliers(distinct_edges(r3(s, d))),
    "one_label": lambda s, d: one_label(_conflicting(s, d)),
    "community_counts": lambda s, d: community_counts(r3(s, d), brands(s, d)),
    "community_lines": lambda s, d: titled(community_counts(r3(s, d), brands(s, d))),
    "suffix_filter": lambda s, d: _ranked(filter_id_suffix(topk_numeric(r1(s, d), shared=False), "7")),
    "format_lex": lambda s, d: topk_lex(r2(s, d)).select("company", "rank", format_lex_line().alias("line")),
    "format_numeric": lambda s, d: topk_numeric(r2(s, d)).select("company", "rank", format_numeric_line().alias("line")),
    "parse_untidy_ws": lambda s, d: parse_edges(_untidy(s, d), "ws"),
    "parse_untidy_commas": lambda s, d: parse_edges(_untidy(s, d), "ws_or_comma"),
    "scan_glob": _globbed,
    "topk_leading_zeros": lambda s, d: _ranked(topk_numeric(r4(s, d))),
    "similarity_text": lambda s, d: _similar(s, d, r5).select("c1", "c2", short_similarity(F.col("sim")).alias("text")),
    "saturation": lambda s, d: saturated(pair_counts(r1(s, d)).withColumn("common", F.col("common") * MANY)),
    "community_conflicts": lambda s, d: community_counts(r3(s, d), _conflicting(s, d)),
    "sink_tabs": lambda s, d: _sunk(pair_counts(r1(s, d))),
    "sink_trailing_tab": lambda s, d: _sunk(topk_lex(r2(s, d)).select(format_lex_line().alias("line")), trailing_tab=True),
    "sink_keys": lambda s, d: _sunk(topk_numeric(r2(s, d)).select(format_numeric_line().alias("line"))),
}

_R1 = "e AS (SELECT DISTINCT l_suppkey::VARCHAR AS company, l_partkey::VARCHAR AS supplier FROM lineitem)"
_R2 = "e AS (SELECT DISTINCT user_id::VARCHAR AS company, event_type AS supplier FROM events)"
_R3 = "e AS (SELECT DISTINCT l_orderkey::VARCHAR AS company, l_partkey::VARCHAR AS supplier FROM lineitem)"
_R4 = "e AS (SELECT DISTINCT CASE WHEN l_partkey % 3 = 0 THEN '00' || l_suppkey ELSE l_suppkey::VARCHAR END AS company, l_partkey::VARCHAR AS supplier FROM lineitem)"
_R5 = "e AS (SELECT DISTINCT l_suppkey::VARCHAR AS company, l_orderkey::VARCHAR AS supplier FROM lineitem)"
_DEGREES = "d AS (SELECT company, count(*) AS degree FROM e GROUP BY company)"


def _before(order: str, a: str = "a.company", b: str = "b.company") -> str:
    return f"{a} < {b}" if order == "lex" else f"(length({a}), {a}) < (length({b}), {b})"


def _pairs(order: str = "lex", edges: str = "e", lists: bool = False) -> str:
    by = "a.supplier" if order == "lex" else "length(a.supplier), a.supplier"
    members = f", string_agg(a.supplier, ',' ORDER BY {by}) AS shared" if lists else ""
    return f"p AS (SELECT a.company AS c1, b.company AS c2, count(*) AS common{members} FROM {edges} a JOIN {edges} b ON a.supplier = b.supplier AND {_before(order)} GROUP BY 1, 2)"


_SIMS = "s AS (SELECT c1, c2, common, common::DOUBLE / (x.degree + y.degree - common)::DOUBLE AS sim FROM p JOIN d x ON x.company = c1 JOIN d y ON y.company = c2)"
_BOTH = "b AS (SELECT c1 AS company, c2 AS other, common, sim FROM s UNION ALL SELECT c2, c1, common, sim FROM s)"


def _top(edges: str, order: str, k: int, rest: str) -> str:
    by = "round(sim, 6) DESC, other" if order == "lex" else "sim DESC, length(other), other"
    top = f"t AS (SELECT company, row_number() OVER (PARTITION BY company ORDER BY {by}) AS rank, other, common, sim FROM b QUALIFY rank <= {k})"
    return f"WITH {edges}, {_DEGREES}, {_pairs(order)}, {_SIMS}, {_BOTH}, {top} {rest}"


_TOP = "SELECT company, rank, other, common, round(sim, 6) AS sim FROM t"


def _lists(order: str, columns: str) -> str:
    by = "x.supplier" if order == "lex" else "length(x.supplier), x.supplier"
    return f"""SELECT {columns} FROM (
  SELECT t.company, rank, t.other, common, sim, string_agg(x.supplier, ',' ORDER BY {by}) AS shared
  FROM t JOIN e x ON x.company = t.company JOIN e y ON y.company = t.other AND y.supplier = x.supplier GROUP BY ALL)"""


_WITH_LISTS = "company, rank, other, common, round(sim, 6) AS sim, shared"
#: Similarities of R2 are ratios of numbers up to 5, so six decimals, and ten, are exact roundings here.
_LEX_LINE = "company, rank, company || ':' || other || ', {' || shared || '}, ' || printf('%.6f', round(sim, 6)) AS line"
_NUMERIC_LINE = r"company, rank, company || ':' || other || ', {' || shared || '}, ' || regexp_replace(regexp_replace(substr(printf('%.17f', sim), 1, 12), '0+$', ''), '\.$', '') AS line"
_COMMUNITY = f"""WITH {_R3}, l AS (SELECT p_partkey::VARCHAR AS company, max(p_brand) AS label FROM part GROUP BY 1),
shared AS (SELECT supplier FROM e GROUP BY supplier HAVING count(*) >= 2)"""
_CONFLICTS = _COMMUNITY.replace("max(p_brand)", "max(greatest(p_brand, lower(p_brand)))")
_UNTIDY = """lines AS (SELECT CASE l_orderkey % 7 WHEN 0 THEN ' ' || chr(9) || s || ' ' || p || '  ' WHEN 1 THEN s WHEN 2 THEN '   ' WHEN 3 THEN ',' || s || ' ' || p
  WHEN 4 THEN s || ',' || p || ',x' WHEN 5 THEN s || chr(9) || chr(9) || p ELSE s || ', ' || p END AS line
  FROM (SELECT l_orderkey, l_suppkey::VARCHAR AS s, l_partkey::VARCHAR AS p FROM lineitem))"""


def _split(separator: str) -> str:
    parts = f"regexp_split_to_array(trim(line, ' ' || chr(9)), '{separator}')"
    return f"WITH {_UNTIDY}, cut AS (SELECT {parts} AS x FROM lines) SELECT x[1] AS company, x[2] AS supplier FROM cut WHERE x[1] <> '' AND coalesce(x[2], '') <> ''"


#: The order of R4's ids: by number, and equal numbers by their text.
_ZEROS = "length(ltrim({0}, '0')), ltrim({0}, '0'), {0}"
_SIM_TEXT = r"regexp_replace(regexp_replace(substr(printf('%.17f', sim), 1, 12), '0+$', ''), '\.$', '')"
_PADDED = f"""WITH {_R4}, {_DEGREES},
p AS (SELECT a.company AS c1, b.company AS c2, count(*) AS common FROM e a JOIN e b ON a.supplier = b.supplier AND a.company <> b.company GROUP BY 1, 2),
s AS (SELECT c1 AS company, c2 AS other, common, common::DOUBLE / (x.degree + y.degree - common)::DOUBLE AS sim FROM p JOIN d x ON x.company = c1 JOIN d y ON y.company = c2),
t AS (SELECT company, row_number() OVER (PARTITION BY company ORDER BY sim DESC, {_ZEROS.format("other")}) AS rank, other, common, sim FROM s QUALIFY rank <= 4)
"""
_GUARD = f"g AS (SELECT * FROM e WHERE supplier IN (SELECT supplier FROM e GROUP BY supplier HAVING count(*) <= {HUB}))"

ORACLES: dict[str, str] = {
    "parse_ws_or_comma": "SELECT l_suppkey::VARCHAR AS company, l_partkey::VARCHAR AS supplier FROM lineitem",
    "parse_ws": "SELECT l_suppkey::VARCHAR AS company, l_partkey::VARCHAR AS supplier FROM lineitem",
    "parse_digits": "SELECT l_suppkey::VARCHAR AS company, l_partkey::VARCHAR AS supplier FROM lineitem",
    "parse_labels": r"SELECT p_partkey::VARCHAR AS company, regexp_split_to_array(trim(p_brand), '\s+')[1] AS label FROM part",
    "distinct_edges": f"WITH {_R1} SELECT * FROM e",
    "degrees": f"WITH {_R1}, {_DEGREES} SELECT * FROM d",
    "adjacency": f"WITH {_R1} SELECT company, count(*) AS size, string_agg(supplier, ',' ORDER BY supplier) AS suppliers FROM e GROUP BY company",
    "adjacency_exploded": f"WITH {_R1}, {_DEGREES} SELECT supplier, company, degree AS size FROM e JOIN d USING (company)",
    "inverted_index": f"WITH {_R1} SELECT supplier, string_agg(company, ',' ORDER BY company) AS companies FROM e GROUP BY supplier",
    "hub_guard_pairs": f"WITH {_R1}, {_GUARD}, {_pairs(edges='g')} SELECT * FROM p",
    "pair_counts_lex": f"WITH {_R1}, {_pairs()} SELECT * FROM p",
    "pair_counts_numeric": f"WITH {_R1}, {_pairs('numeric')} SELECT * FROM p",
    "pair_counts_saturated": f"WITH {_R3}, {_pairs()} SELECT c1, c2, least(common, 2147483647)::INTEGER AS common FROM p",
    "pair_members_lex": f"WITH {_R1}, {_pairs(lists=True)} SELECT * FROM p",
    "pair_members_numeric": f"WITH {_R1}, {_pairs('numeric', lists=True)} SELECT * FROM p",
    "max_pair": f"WITH {_R1}, {_pairs()} SELECT * FROM p ORDER BY common DESC, c1, c2 LIMIT 1",
    "max_pair_hub_guard": f"WITH {_R1}, {_GUARD}, {_pairs(edges='g')} SELECT * FROM p ORDER BY common DESC, c1, c2 LIMIT 1",
    "jaccard_pairs": f"WITH {_R1}, {_DEGREES}, {_pairs()}, {_SIMS} SELECT c1, c2, common, round(sim, 6) AS sim FROM s",
    "directed_pairs": f"WITH {_R1}, {_DEGREES}, {_pairs()}, {_SIMS}, {_BOTH} SELECT company, other, common, round(sim, 6) AS sim FROM b",
    "topk_lex": _top(_R1, "lex", 3, _TOP),
    "topk_numeric": _top(_R1, "numeric", 4, _TOP),
    "topk_ties_lex": _top(_R2, "lex", 3, _TOP),
    "topk_ties_numeric": _top(_R2, "numeric", 4, _TOP),
    "topk_with_shared": _top(_R1, "lex", 3, _lists("lex", _WITH_LISTS)),
    "topk_numeric_with_shared": _top(_R1, "numeric", 4, _lists("numeric", _WITH_LISTS)),
    "shared_suppliers": f"WITH {_R3} SELECT supplier FROM e GROUP BY supplier HAVING count(*) >= 2",
    "one_label": "SELECT p_partkey::VARCHAR AS company, max(greatest(p_brand, lower(p_brand))) AS label FROM part GROUP BY 1",
    "community_counts": f"{_COMMUNITY} SELECT label, count(*) AS n FROM shared JOIN l ON l.company = supplier GROUP BY label",
    "community_lines": f"{_COMMUNITY} SELECT 'Community ' || label AS community, count(*) AS n FROM shared JOIN l ON l.company = supplier GROUP BY label",
    "suffix_filter": _top(_R1, "numeric", 4, _TOP + " WHERE regexp_matches(company, '^[0-9]*7$')"),
    "format_lex": _top(_R2, "lex", 3, _lists("lex", _LEX_LINE)),
    "format_numeric": _top(_R2, "numeric", 4, _lists("numeric", _NUMERIC_LINE)),
    "parse_untidy_ws": _split(r"\s+"),
    "parse_untidy_commas": _split(r"[\s,]+"),
    "scan_glob": "SELECT l_suppkey::VARCHAR AS company, l_partkey::VARCHAR AS supplier FROM lineitem UNION ALL SELECT l_suppkey::VARCHAR, l_partkey::VARCHAR FROM lineitem",
    "topk_leading_zeros": _PADDED + _lists("numeric", _WITH_LISTS),
    "similarity_text": f"WITH {_R5}, {_DEGREES}, {_pairs()}, {_SIMS} SELECT c1, c2, {_SIM_TEXT} AS text FROM s",
    "saturation": f"WITH {_R1}, {_pairs()} SELECT c1, c2, least(common * {MANY}, 2147483647)::INTEGER AS common FROM p",
    "community_conflicts": f"{_CONFLICTS} SELECT label, count(*) AS n FROM shared JOIN l ON l.company = supplier GROUP BY label",
    "sink_tabs": f"WITH {_R1}, {_pairs()} SELECT c1 || chr(9) || c2 || chr(9) || common AS value FROM p",
    "sink_trailing_tab": f"SELECT line || chr(9) AS value FROM ({_top(_R2, 'lex', 3, _lists('lex', _LEX_LINE))})",
    "sink_keys": f"SELECT line AS value FROM ({_top(_R2, 'numeric', 4, _lists('numeric', _NUMERIC_LINE))})",
}
