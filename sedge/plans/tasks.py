"""The four analyses. Each reads its input once: the edge set is kept, and all else follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.operators.classes import classes
from sedge.operators.community import count_by_community, shared_suppliers
from sedge.operators.graph import distinct_edges, limit_hubs
from sedge.operators.numbering import EdgeSet, number
from sedge.operators.pairs import counted, top_pair
from sedge.operators.similarity import attach_shared, directed, jaccard, top_k
from sedge.storage import written


def max_pair(edges: DataFrame, max_companies: int | None = 5000) -> DataFrame:
    """c1, c2, common: the two companies of most common suppliers, hubs of over ``max_companies`` left out."""
    own = number(edges)
    return own.named(top_pair(counted(own.edges if max_companies is None else limit_hubs(own.edges, max_companies))), "c1", "c2")


def similar_pairs(own: EdgeSet) -> DataFrame:
    """c1, c2, common, sim (numbers) of every two companies that share a supplier."""
    return jaccard(counted(own.edges), own.degrees)


def ranked(edges: DataFrame, k: int, rank_decimals: int | None, order: str, shared: bool) -> DataFrame:
    """company, rank, other, common, sim of each company's ``k`` nearest peers, and ``shared``. Numbers stand in the
    order of the ids, so ties are broken by number.

    Classes of companies of equal suppliers are ranked first. Members of a class have one list of peers, but that none is
    its own peer: a list of ``k + 1`` serves all. It is made of the ``k + 1`` nearest classes, by their least members, and of
    their least members. The lists of shared suppliers are gathered for classes that win only.
    """
    own = number(edges, order)
    alike = classes(own)
    near = top_k(directed(similar_pairs(alike.sets)).unionByName(alike.inner()), k + 1, rank_decimals).drop("rank")
    peers = near.withColumnRenamed("other", "class").join(alike.first(k + 1).withColumnRenamed("id", "other"), "class")
    sizes = alike.sets.companies.select(F.col("id").alias("company"), "n")
    top = top_k(peers, k + 1, rank_decimals).join(sizes, "company").filter((F.col("n") > 1) | (F.col("rank") <= k))
    top = written(top.select(F.col("company").alias("to"), "rank", "other", "class", "common", "sim"), "ranking")
    lists = own.named(top.withColumn("number", F.col("other")), "other")
    if shared:
        pairs = top.select(F.col("to").alias("company"), F.col("class").alias("other")).distinct()
        lists = lists.join(attach_shared(pairs, alike.sets.edges, order).toDF("to", "class", "shared"), ["to", "class"])
    return alike.each(lists.drop("class"), top.filter("class = to").select(F.col("other").alias("id"), F.col("rank").alias("own")), k)


def topk_lex(edges: DataFrame, k: int = 3, shared: bool = True) -> DataFrame:
    """Ranked by similarity at six decimals, then by id as text."""
    return ranked(edges, k, 6, "lex", shared)


def topk_numeric(edges: DataFrame, k: int = 4, shared: bool = True) -> DataFrame:
    """Ranked by exact similarity, then by id as a number of any length."""
    return ranked(edges, k, None, "numeric", shared)


def community_counts(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """label, n: shared suppliers of each community."""
    return count_by_community(shared_suppliers(distinct_edges(edges)), labels)
