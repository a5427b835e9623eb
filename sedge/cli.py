"""Run an analysis on files: ``python -m sedge.cli max-pair|topk-lex|topk-numeric|community|suffix ...``"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sedge.functions.lines import format_lex_line, format_numeric_line
from sedge.operators.community import titled
from sedge.operators.pairs import saturated
from sedge.plans.tasks import community_counts, max_pair, topk_lex, topk_numeric
from sedge.sources.text import read_edges, read_labels, write_lines


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sedge", description=__doc__)
    top.add_argument("--mode", default="overwrite", choices=["overwrite", "errorifexists"])
    commands = top.add_subparsers(dest="command", required=True)
    for name, extra in (("max-pair", ()), ("topk-lex", (3,)), ("topk-numeric", (4,)), ("community", ()), ("suffix", ())):
        c = commands.add_parser(name)
        if name == "suffix":
            c.add_argument("suffix")
        c.add_argument("input")
        if name == "community":
            c.add_argument("labels")
        c.add_argument("output")
        if extra:
            c.add_argument("k", nargs="?", type=int, default=extra[0])
        if name == "max-pair":
            c.add_argument("--max-companies", type=int, default=5000)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("sedge").getOrCreate()
    if a.command == "max-pair":
        write_lines(saturated(max_pair(read_edges(spark, a.input, "ws_or_comma"), a.max_companies)), a.output, a.mode)
    elif a.command == "topk-lex":
        top = topk_lex(read_edges(spark, a.input), a.k)
        write_lines(top.orderBy("company", "rank").select(format_lex_line().alias("line")), a.output, a.mode, trailing_tab=True)
    elif a.command == "topk-numeric":
        top = topk_numeric(read_edges(spark, a.input, id_rule="digits"), a.k)
        write_lines(top.orderBy("company", "rank").select(format_numeric_line().alias("line")), a.output, a.mode)
    elif a.command == "community":
        write_lines(titled(community_counts(read_edges(spark, a.input), read_labels(spark, a.labels))), a.output, a.mode)
    else:
        lines = spark.read.text(a.input)
        write_lines(lines.filter(F.col("value").rlike(f"^[0-9]*{a.suffix}:")), a.output, a.mode)


if __name__ == "__main__":
    main()
