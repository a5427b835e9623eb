"""Output lines of the rankings, and the filter on id endings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _listed() -> Column:
    return F.concat(F.lit("{"), F.concat_ws(",", "shared"), F.lit("}"))


def format_lex_line() -> Column:
    """``company:other, {s1,s2}, 0.123456``"""
    return F.format_string("%s:%s, %s, %.6f", F.col("company"), F.col("other"), _listed(), F.col("sim"))


def short_similarity(sim: Column) -> Column:
    """Plain decimal text cut at 12 characters, without trailing zeros or point."""
    text = F.substring(sim.cast("decimal(20,17)").cast("string"), 1, 12)
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")


def format_numeric_line() -> Column:
    """``company:other, {s1,s2}, 0.5``"""
    return F.concat(F.col("company"), F.lit(":"), F.col("other"), F.lit(", "), _listed(), F.lit(", "), short_similarity(F.col("sim")))


def filter_id_suffix(ranking: DataFrame, suffix: str) -> DataFrame:
    """Rows whose company is digits ending in ``suffix`` (a regular expression)."""
    return ranking.filter(F.col("company").rlike(f"^[0-9]*{suffix}$"))
