"""The edge set and what follows from it by one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.functions.ids import ordered_list


def distinct_edges(edges: DataFrame) -> DataFrame:
    """The edge set: every pairing operator takes it, and deduping before a self-join is what keeps that small."""
    return edges.select("company", "supplier").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """company, degree: suppliers of each company, from an edge set."""
    return edges.groupBy("company").agg(F.count("*").alias("degree"))


def adjacency(edges: DataFrame, order: str = "lex") -> DataFrame:
    """company, size, suppliers (ordered array). A list is as long as its company has suppliers."""
    return edges.groupBy("company").agg(F.count("*").alias("size"), ordered_list(F.col("supplier"), order).alias("suppliers"))


def inverted_index(edges: DataFrame, order: str = "lex") -> DataFrame:
    """supplier, companies (ordered array)."""
    return edges.groupBy("supplier").agg(ordered_list(F.col("company"), order).alias("companies"))


def exploded(adjacent: DataFrame) -> DataFrame:
    """The edges of an adjacency relation, each with its company's size."""
    return adjacent.select(F.explode("suppliers").alias("supplier"), "company", "size")


def limit_hubs(edges: DataFrame, max_companies: int = 5000) -> DataFrame:
    """The edge set without suppliers of more than ``max_companies`` companies. Those are few, and what is few is
    matched: Spark broadcasts it where it is small."""
    large = edges.groupBy("supplier").agg(F.count("*").alias("_n")).filter(F.col("_n") > max_companies).select("supplier")
    return edges.join(large, "supplier", "left_anti").select("company", "supplier")
