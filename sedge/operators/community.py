"""Shared suppliers by community."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_suppliers(edges: DataFrame, min_buyers: int = 2) -> DataFrame:
    """supplier: those of at least ``min_buyers`` companies, from an edge set. Counts are added up before the
    shuffle, so a supplier of very many buyers is a few rows there."""
    return edges.groupBy("supplier").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_buyers).select("supplier")


def one_label(labels: DataFrame) -> DataFrame:
    """One label a company, the greatest where there are several."""
    return labels.groupBy("company").agg(F.max("label").alias("label"))


def count_by_community(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """label, n: how many shared suppliers carry the label as companies; labels of none are absent."""
    labelled = shared.join(one_label(labels).withColumnRenamed("company", "supplier"), "supplier")
    return labelled.groupBy("label").agg(F.count("*").alias("n"))


def titled(counts: DataFrame) -> DataFrame:
    """community (``Community <label>``), n."""
    return counts.select(F.concat(F.lit("Community "), F.col("label")).alias("community"), "n")
