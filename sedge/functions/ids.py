"""Ids as text: trimming, digit tests, and two orders, lexicographic and numeric of unbounded length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed(value: Column) -> Column:
    """Without leading and trailing characters up to U+0020 (``trim`` takes spaces only)."""
    return F.regexp_replace(value, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def is_digits(value: Column) -> Column:
    return F.coalesce(value.rlike("^[0-9]+$"), F.lit(False))


def strip_zeros(value: Column) -> Column:
    """Without leading zeros, but for the last digit."""
    return F.regexp_replace(value, "^0+(?=.)", "")


def numeric_key(value: Column) -> Column:
    """A struct that orders digit strings of any length by number, and equal numbers by their text."""
    plain = strip_zeros(value)
    return F.struct(F.length(plain).alias("len"), plain.alias("plain"), value.alias("raw"))


def order_key(value: Column, order: str) -> Column:
    if order not in ("lex", "numeric"):
        raise ValueError("order is lex or numeric")
    return numeric_key(value) if order == "numeric" else value


def ordered_list(value: Column, order: str = "lex") -> Column:
    """Aggregate: the distinct values in order, as an array."""
    if order == "lex":
        return F.array_sort(F.collect_set(value))
    return F.transform(F.array_sort(F.collect_set(order_key(value, order))), lambda x: x["raw"])
