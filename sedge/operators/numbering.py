"""The edge set kept once, with companies as numbers: what all pairing operators work on.

A company's number is its place in the order asked for, so numbers compare as the ids do, pairs are two longs
whatever the ids look like, and only what is left at the end is turned back into ids.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.functions.ids import order_key
from sedge.operators.graph import distinct_edges
from sedge.storage import discard, written


@dataclass(frozen=True)
class EdgeSet:
    """``edges``: company (number), supplier, distinct. ``companies``: id, company, degree. ``order``: lex or numeric."""

    edges: DataFrame
    companies: DataFrame
    order: str

    @property
    def degrees(self) -> DataFrame:
        return self.companies.select(F.col("id").alias("company"), "degree")

    def named(self, df: DataFrame, *columns: str) -> DataFrame:
        """``df`` with the ids in place of the numbers in ``columns``."""
        for c in columns:
            ids = self.companies.select(F.col("id").alias(c), F.col("company").alias("_id"))
            df = df.join(ids, c).select(*[F.col("_id").alias(c) if x == c else x for x in df.columns])
        return df


def number(edges: DataFrame, order: str = "lex") -> EdgeSet:
    """The input is read once: its distinct edges are written, and companies and numbered edges follow from that."""
    found = written(distinct_edges(edges), "edges")
    sizes = found.groupBy("company").agg(F.count("*").alias("degree")).orderBy(order_key(F.col("company"), order))
    companies = written(sizes.select(F.monotonically_increasing_id().alias("id"), "company", "degree"), "companies")
    numbered = found.join(companies.select("id", "company"), "company").select(F.col("id").alias("company"), "supplier")
    numbered = written(numbered, "numbered-edges")
    discard(found)
    return EdgeSet(numbered, companies, order)
