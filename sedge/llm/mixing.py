"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedge.llm.work import WORD, full_text, hash60, numbered, table, written

#: Bits of one histogram level, and levels before the boundary cell is read row by row.
BITS, LEVELS, HASH_BITS = 12, 2, 60


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """One row per source: source, source_size, target, base (whole passes), need (words of one further pass).

    Targets split ``share`` times all words by weight; none exceeds ``most`` times its source, and what is
    over goes to the others by weight until none is above. Ordered by size over weight the capped sources
    are a prefix, so the final level follows from running sums over the sources, not from iteration.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("_i", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), (F.col("_i") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("_w", weight).withColumn("_ratio", F.col("source_size").cast("double") / F.col("_w"))
    everything, order = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing), W.orderBy("_ratio", "_i").rowsBetween(W.unboundedPreceding, -1)
    ranked = (
        ranked.withColumn("_total", F.sum("source_size").over(everything))
        .withColumn("_weights", F.sum("_w").over(everything))
        .withColumn("_full", F.coalesce(F.sum("source_size").over(order), F.lit(0)))
        .withColumn("_gone", F.coalesce(F.sum("_w").over(order), F.lit(0)))
        .withColumn("_level", (F.col("_total") * F.lit(float(share)) - F.col("_full") * F.lit(float(most))) / (F.col("_weights") - F.col("_gone")))
        .withColumn("_capped", F.col("source_size") * F.lit(float(most)) <= F.col("_w") * F.col("_level"))
        .withColumn("_final", F.min(F.when(~F.col("_capped"), F.struct("_ratio", "_i", "_level"))).over(everything))
    )
    target = F.when(F.col("_capped") | F.col("_final").isNull(), F.col("source_size") * F.lit(float(most))).otherwise(F.col("_w") * F.col("_final._level"))
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return ranked.withColumn("target", target).withColumn("base", base).withColumn("need", F.col("target") - F.col("base") * F.col("source_size")).select("source", "source_size", "target", "base", "need")


def thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` with ``cut``: of a source, hashes up to ``cut`` sum to as near ``need`` as whole hashes can.

    Words are summed by source and leading hash bits; only the bucket that holds the boundary is summed again
    by its next bits, and of the last such bucket (about one row in 16 million) the hashes themselves.
    """
    cells = sizes.join(targets.select(F.col("source").alias("_source"), "need"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("_base", F.lit(0).cast("long"))
    for level in range(1, LEVELS + 1):
        bucket = F.shiftright("hash", HASH_BITS - BITS * level)
        summed = cells.groupBy("source", "_base", "need", bucket.alias("_bucket")).agg(F.sum("size").alias("_sum"))
        running = F.sum("_sum").over(W.partitionBy("source").orderBy("_bucket"))
        bounds = summed.withColumn("_after", F.col("_base") + running).withColumn("_before", F.col("_after") - F.col("_sum")).filter((F.col("_before") <= F.col("need")) & (F.col("_after") > F.col("need")))
        bounds = written(bounds.select(F.col("source").alias("_source"), F.col("_bucket").alias("_b"), F.col("_before").alias("_start")), "mix-bounds")
        cells = cells.join(bounds, F.col("source").eqNullSafe(F.col("_source")) & (bucket == F.col("_b"))).select("source", "hash", "size", "need", F.col("_start").alias("_base"))
    single = cells.groupBy("source", "need", "_base", "hash").agg(F.sum("size").alias("_sum"))
    after = F.col("_base") + F.sum("_sum").over(W.partitionBy("source").orderBy("hash"))
    marked = single.withColumn("_after", after).withColumn("_in", 2 * F.col("_after") - F.col("_sum") <= 2 * F.col("need"))
    cut = marked.groupBy(F.col("source").alias("_source")).agg(F.max(F.when(F.col("_in"), F.col("hash"))).alias("_last"), F.min("hash").alias("_first"))
    joined = targets.join(cut, F.col("source").eqNullSafe(F.col("_source")), "left")
    # No boundary bucket: the need is zero or all of the source.
    whole = F.when(F.col("need") > 0, F.lit(1 << HASH_BITS)).otherwise(F.lit(-1)).cast("long")
    return joined.withColumn("cut", F.when(F.col("_first").isNull(), whole).otherwise(F.coalesce("_last", F.col("_first") - 1))).drop("_source", "_last", "_first")


def document_hash(name: str = "doc_id") -> Column:
    return hash60(F.coalesce(F.col(name).cast("string"), F.lit("\\N")))


def source_cuts(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """The words and hash of each document, and of each source (named ``_source``) its target, base and cut.

    What has a row a source is written, so that its size is known: Spark broadcasts it where it is small, and
    neither texts nor a source of many rows are shuffled to meet it.
    """
    if most < share:
        raise ValueError("most must be at least share, else the targets can't be met")
    words = F.regexp_count(full_text(), F.lit(WORD)).cast("long")
    sizes = written(docs.select("doc_id", F.col("source").cast("string").alias("source"), words.alias("size"), document_hash().alias("hash")), "mix-sizes")
    targets = written(source_targets(sizes, weights, share, most), "mix-targets")
    return sizes, written(thresholds(sizes, targets).withColumnRenamed("source", "_source"), "mix-cuts")


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies (times the mix takes it).

    ``size`` counts words; a null or empty text has none and takes none. Sources are ordered by code point,
    null last (null is a source), and weigh ``weights`` in turn. Every document is taken ``base`` times, and
    once more where the hash of its doc_id is at most the source's cut; rows of one doc_id fare alike, and a
    rerun decides alike. An empty table gives no rows. Only doc_id, source and text are read.
    """
    sizes, cuts = source_cuts(docs, weights, share, most)
    copies = F.col("base") + (F.col("hash") <= F.col("cut")).cast("long")
    return sizes.join(cuts, F.col("source").eqNullSafe(F.col("_source"))).withColumn("copies", copies).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as many times as it is taken, with the columns of ``docs`` unchanged.

    The cut of a source is all a scan needs to decide, so the texts are read once more and not shuffled.
    """
    _, cuts = source_cuts(docs)
    rows, source = numbered(docs), F.col(f"c{docs.columns.index('source')}")
    copies = F.col("base") + (document_hash(f"c{docs.columns.index('doc_id')}") <= F.col("cut")).cast("long")
    taken = rows.join(cuts.select("_source", "base", "cut"), source.cast("string").eqNullSafe(F.col("_source"))).withColumn("copies", copies.cast("int"))
    return taken.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*rows.columns).toDF(*docs.columns)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("copies")


ORACLE = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS hash
  FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS i FROM sizes GROUP BY source),
weighed AS (SELECT *, CASE i % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM per),
levels AS (
  SELECT *, source_size::DOUBLE / w AS ratio,
         ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
           - coalesce(sum(source_size) OVER before, 0)::DOUBLE * 2.0::DOUBLE)
         / ((sum(w) OVER ()) - coalesce(sum(w) OVER before, 0))::DOUBLE AS lev
  FROM weighed WINDOW before AS (ORDER BY source_size::DOUBLE / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, source_size * 2.0::DOUBLE <= w * lev AS cap FROM levels),
final AS (SELECT lev FROM capped WHERE NOT cap ORDER BY ratio, i LIMIT 1),
targets AS (
  SELECT source, source_size,
         CASE WHEN cap OR (SELECT count(*) FROM final) = 0 THEN source_size * 2.0::DOUBLE ELSE w * (SELECT lev FROM final) END AS target
  FROM capped),
needs AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS base FROM targets),
running AS (
  SELECT s.doc_id, s.size, n.source_size, n.target, n.base, n.target - n.base * n.source_size AS need,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.hash RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS after,
         sum(s.size) OVER (PARTITION BY s.source, s.hash)::BIGINT AS own
  FROM sizes s JOIN needs n ON s.source IS NOT DISTINCT FROM n.source)
SELECT doc_id, size, source_size, target,
       (size * (base + CASE WHEN 2 * after - own <= 2 * need THEN 1 ELSE 0 END))::BIGINT AS taken
FROM running
"""
