"""Jaccard similarity of companies and the ranking of each company's peers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedge.functions.ids import order_key, ordered_list


def jaccard(counts: DataFrame, degree: DataFrame) -> DataFrame:
    """c1, c2, common, sim. The union's size is the sum of the degrees less what is common; pairs of unknown
    degree, or without similarity, are dropped. Spark broadcasts the degrees if they are small enough."""
    d1 = degree.select(F.col("company").alias("c1"), F.col("degree").alias("_d1"))
    d2 = degree.select(F.col("company").alias("c2"), F.col("degree").alias("_d2"))
    union = F.col("_d1") + F.col("_d2") - F.col("common")
    sized = counts.join(d1, "c1").join(d2, "c2").withColumn("_union", union).filter("_union > 0")
    return sized.withColumn("sim", F.col("common") / F.col("_union")).filter("sim > 0").select("c1", "c2", "common", "sim")


def directed(pairs: DataFrame) -> DataFrame:
    """company, other, common, sim: every pair from both its ends, from one pass over the pairs."""
    ends = F.explode(F.array(F.struct(F.col("c1").alias("company"), F.col("c2").alias("other")), F.struct(F.col("c2").alias("company"), F.col("c1").alias("other"))))
    return pairs.select(ends.alias("_e"), "common", "sim").select("_e.company", "_e.other", "common", "sim")


def top_k(candidates: DataFrame, k: int, rank_decimals: int | None = None, order: str = "lex") -> DataFrame:
    """The ``k`` most similar others of each company, with ``rank`` from 1; ties go to the lesser id.

    ``rank_decimals`` ranks by the similarity rounded so; None by the exact one. Spark keeps only ``k`` rows of
    a company before and after the shuffle.
    """
    if k <= 0:
        return candidates.withColumn("rank", F.lit(1)).filter("false")
    sim = F.col("sim") if rank_decimals is None else F.round("sim", rank_decimals)
    by = W.partitionBy("company").orderBy(sim.desc(), order_key(F.col("other"), order))
    return candidates.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def attach_shared(ranking: DataFrame, edges: DataFrame, order: str = "lex") -> DataFrame:
    """``ranking`` with ``shared``, the ordered array of common suppliers, gathered for its rows only."""
    own = edges.select(F.col("company"), F.col("supplier"))
    others = edges.select(F.col("company").alias("other"), F.col("supplier"))
    lists = ranking.select("company", "other").join(own, "company").join(others, ["other", "supplier"]).groupBy("company", "other").agg(ordered_list(F.col("supplier"), order).alias("shared"))
    return ranking.join(lists, ["company", "other"])
