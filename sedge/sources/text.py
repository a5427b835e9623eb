"""Edge and label files: a record a line, its first two tokens are the columns and the rest is ignored.

Lines without two tokens are dropped. Files may be named by folder, glob or any URI Spark reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.functions.ids import is_digits, trimmed

#: What separates tokens: white space, or white space and commas.
DELIMITERS = {"ws": r"\s+", "ws_or_comma": r"[\s,]+"}


def _two_tokens(lines: DataFrame, first: str, second: str, delimiter: str) -> DataFrame:
    column = lines.columns[0]
    parts: Column = F.split(trimmed(F.col(column)), DELIMITERS[delimiter])
    tokens = lines.select(trimmed(F.get(parts, F.lit(0))).alias(first), trimmed(F.get(parts, F.lit(1))).alias(second))
    return tokens.filter((F.col(first) != "") & (F.col(second) != ""))


def parse_edges(lines: DataFrame, delimiter: str = "ws", id_rule: str = "any") -> DataFrame:
    """(company, supplier) from a DataFrame whose first column is the line. ``id_rule`` ``digits`` keeps rows
    of two all-digit ids."""
    if id_rule not in ("any", "digits"):
        raise ValueError("id_rule is any or digits")
    edges = _two_tokens(lines, "company", "supplier", delimiter)
    return edges.filter(is_digits(F.col("company")) & is_digits(F.col("supplier"))) if id_rule == "digits" else edges


def parse_labels(lines: DataFrame) -> DataFrame:
    """(company, label) from lines separated by white space."""
    return _two_tokens(lines, "company", "label", "ws")


def read_edges(spark: SparkSession, path: str | list[str], delimiter: str = "ws", id_rule: str = "any") -> DataFrame:
    return parse_edges(spark.read.text(path), delimiter, id_rule)


def read_labels(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_labels(spark.read.text(path))


def write_lines(lines: DataFrame, path: str, mode: str = "errorifexists", trailing_tab: bool = False) -> None:
    """Write columns joined by tabs, a row a line. ``trailing_tab`` ends lines as an empty value would."""
    joined = F.concat_ws("\t", *[F.col(f"`{c}`").cast("string") for c in lines.columns])
    lines.select((F.concat(joined, F.lit("\t")) if trailing_tab else joined).alias("value")).write.mode(mode).text(path)
