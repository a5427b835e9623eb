"""Pairs of companies that share suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.functions.ids import ordered_list
from sedge.operators.numbering import number
from sedge.storage import written

INT_MAX = 2**31 - 1

#: Companies of a supplier from which on its pairs are made in several tasks.
HUB_ROWS = 2000


def meetings(edges: DataFrame) -> DataFrame:
    """c1, c2, supplier for every two companies (numbers) of a supplier, c1 before c2.

    A hub, a supplier of over ``HUB_ROWS`` companies, is cut into that many fewer pieces on one side, each meeting
    a copy of the other, so that no task makes all pairs of a hub. Hubs are few: they are written, so that their size
    is known. Where there are none the edges are dealt once for both sides.
    """
    hubs = edges.groupBy("supplier").agg(F.count("*").alias("_n")).filter(F.col("_n") > HUB_ROWS)
    if hubs.isEmpty():
        a, b = (edges.select(F.col("company").alias(c), "supplier") for c in ("c1", "c2"))
        return a.join(b, "supplier").filter("c1 < c2").select("c1", "c2", "supplier")
    cut = edges.join(written(hubs, "hubs"), "supplier", "left").withColumn("_pieces", F.ceil(F.coalesce("_n", F.lit(1)) / HUB_ROWS).cast("int"))
    a = cut.select("supplier", F.pmod(F.xxhash64("company"), "_pieces").cast("int").alias("_piece"), F.col("company").alias("c1"))
    b = cut.select("supplier", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1)).alias("_piece"), F.col("company").alias("c2"))
    return a.join(b, ["supplier", "_piece"]).filter("c1 < c2").select("c1", "c2", "supplier")


def counted(edges: DataFrame) -> DataFrame:
    """c1, c2, common (numbers): how many suppliers two companies share."""
    return meetings(edges).groupBy("c1", "c2").agg(F.count("*").alias("common"))


def pair_counts(edges: DataFrame, order: str = "lex") -> DataFrame:
    """c1, c2, common: how many suppliers two companies share."""
    own = number(edges, order)
    return own.named(counted(own.edges), "c1", "c2")


def pair_members(edges: DataFrame, order: str = "lex") -> DataFrame:
    """c1, c2, common, shared (ordered array) for all pairs. For a ranking take ``attach_shared`` instead, which
    gathers lists for the winners only."""
    own = number(edges, order)
    lists = meetings(own.edges).groupBy("c1", "c2").agg(F.count("*").alias("common"), ordered_list(F.col("supplier"), order).alias("shared"))
    return own.named(lists, "c1", "c2")


def saturated(counts: DataFrame) -> DataFrame:
    """``counts`` with ``common`` as a 32-bit integer that stops at its largest value."""
    return counts.withColumn("common", F.least("common", F.lit(INT_MAX)).cast("int"))


def top_pair(counts: DataFrame) -> DataFrame:
    """The row of most common suppliers, the least (c1, c2) on a tie; none from an empty input."""
    return counts.orderBy(F.desc("common"), "c1", "c2").limit(1)
