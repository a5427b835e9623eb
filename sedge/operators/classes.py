"""Companies of one and the same set of suppliers, taken as one: they have the same peers at the same similarities.

Where very many companies buy from the same few suppliers, pairs of companies grow with the square of their number;
pairs of classes do not. Where no two sets are equal, a class is a company.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedge.operators.numbering import EdgeSet
from sedge.storage import written


@dataclass(frozen=True)
class Classes:
    """``sets``: the edge set of the classes; a class has the least number of its members. ``members``: id, company,
    class, n (members of the class) of every company."""

    sets: EdgeSet
    members: DataFrame

    def inner(self) -> DataFrame:
        """company, other, common, sim of two members of one class, in the form of a class paired with itself."""
        several = self.sets.companies.filter("n > 1").select(F.col("id").alias("company"), "degree")
        common = self.sets.edges.groupBy("company").agg(F.count("supplier").alias("common"))
        sim = F.col("common") / (2 * F.col("degree") - F.col("common"))
        return common.join(several, "company").filter("common > 0").select("company", F.col("company").alias("other"), "common", sim.alias("sim"))

    def first(self, most: int) -> DataFrame:
        """class, id of the ``most`` least members of each class."""
        by = W.partitionBy("class").orderBy("id")
        return self.members.withColumn("_place", F.row_number().over(by)).filter(F.col("_place") <= most).select("class", "id")

    def each(self, lists: DataFrame, places: DataFrame, k: int) -> DataFrame:
        """The ``k`` best of its class's list for every company, itself left out. ``lists``: to (class), rank, other, number
        (of other) and more; ``places``: id, own, where a company stands in the list of its own class."""
        members = self.members.select("id", "company", F.col("class").alias("to")).join(places, "id", "left")
        rank = F.when(F.col("own") < F.col("rank"), F.col("rank") - 1).otherwise(F.col("rank"))
        rows = members.join(lists, "to").filter("id <> number").withColumn("rank", rank).filter(F.col("rank") <= k)
        return rows.select("company", *[c for c in lists.columns if c not in ("to", "number")])


def fold(suppliers: str) -> list:
    """Aggregates that are equal for equal sets of suppliers, and for others hardly ever."""
    return [F.bit_xor(F.xxhash64(F.lit(i), F.col(suppliers))).alias(f"_fold{i}") for i in range(2)]


def classes(own: EdgeSet) -> Classes:
    """Classes of the companies of an edge set. Sets are told apart by size and by what their hashes add up to; then a
    class's distinct suppliers must be as many as each member has, or its members stay classes of their own. Where no
    two companies are alike, the edges are those of the classes as they are."""
    keys = ["degree", "_fold0", "_fold1"]
    sizes = own.edges.groupBy(F.col("company").alias("id")).agg(F.count("*").alias("degree"), *fold("supplier"))
    sizes = written(own.companies.select("id", "company").join(sizes, "id"), "sizes")
    found = sizes.groupBy(*keys).agg(F.min("id").alias("class"), F.count("*").alias("n")).filter("n > 1")
    found = written(found, "classes")
    if found.isEmpty():
        members = sizes.select("id", "company", F.col("id").alias("class"), F.lit(1).alias("n"), "degree")
        return Classes(EdgeSet(own.edges, members.select("id", "company", "degree", "n"), own.order), members)
    several = sizes.join(found, keys).select(F.col("id").alias("company"), "class", "degree")
    union = own.edges.join(several, "company").select("class", "degree", "supplier").distinct()
    unlike = union.groupBy("class", "degree").agg(F.count("*").alias("_all")).filter("_all <> degree").select("class")
    found = found.join(written(unlike, "unlike"), "class", "left_anti").select(*keys, "class", "n")
    members = sizes.join(found, keys, "left").select("id", "company", F.coalesce("class", "id").alias("class"), F.coalesce("n", F.lit(1)).alias("n"), "degree")
    members = written(members, "members")
    least = members.filter("id = class").select("id", "company", "degree", "n")
    edges = written(own.edges.join(least.select(F.col("id").alias("company")), "company", "left_semi"), "sets")
    return Classes(EdgeSet(edges, least, own.order), members)
