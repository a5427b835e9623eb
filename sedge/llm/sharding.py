"""Rendezvous hashing of stable keys over weighted shards, with gapless slots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedge.llm.work import full_text, hash60, table, written

#: Rows a cell should hold, and rows over which it is cut further; cells, not whole shards, are what one task sorts.
CELL_ROWS, HOT_ROWS = 2000, 100_000
#: Parts that rows equal in everything are dealt into.
PARTS = 4096


def shard_score(key: Column, shard: int, weight: float = 1.0) -> Column:
    """``weight / -ln(u)`` with u in (0, 1) from the MD5 of key and shard: the largest score owns the key,
    and a shard owns keys in proportion to its weight."""
    digest = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 12), 16, 10).cast("double")
    return F.lit(float(weight)) / -F.log((digest + 0.5) / float(1 << 48))


def rendezvous(df: DataFrame, key: Column, weights: Sequence[float], added: float = 1.0) -> DataFrame:
    """``df`` with ``shard`` over ``weights``, ``grown_shard`` with one more shard of weight ``added``, and
    ``place``, a 60-bit hash of the key that orders a shard. A null key counts as the text ``\\N``.

    The owner with one more shard is either the same or the new one, so growth moves
    added / (sum of weights + added) of the keys and nothing else.
    """
    key = F.coalesce(key.cast("string"), F.lit("\\N"))
    n = len(weights)
    with_scores = df.withColumn("_scores", F.array(*[shard_score(key, i, w) for i, w in enumerate([*weights, added])]))
    old = F.slice("_scores", 1, n)
    return (
        with_scores.withColumn("_best", F.array_max(old))
        .withColumn("shard", (F.array_position("_scores", F.col("_best")) - 1).cast("int"))
        .withColumn("grown_shard", F.when(F.element_at("_scores", n + 1) > F.col("_best"), F.lit(n)).otherwise(F.col("shard")).cast("int"))
        .withColumn("place", hash60(key))
        .drop("_scores", "_best")
    )


def with_slots(df: DataFrame, ties: Sequence[str], label: str = "shard", hot: int = HOT_ROWS) -> DataFrame:
    """Gapless ``slot`` from 0 within each shard, in order of ``place`` and ``ties``; ``df`` has no other columns
    whose order would matter.

    A shard is cut into blocks by the leading bits of ``place``; each cell is numbered on its own and shifted by
    the rows of the cells before it. A cell of over ``hot`` rows, as where one key has very many, is cut again:
    by place, then by each of the ties, and rows that are equal in all of these by a part that was written with
    them. So no task sorts a whole shard or all rows of a key.
    """
    df = written(df.withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS))), label)
    rows, shards = df.count(), df.agg(F.max("shard")).first()[0]
    blocks = 1
    while blocks * CELL_ROWS * ((shards or 0) + 1) < rows:
        blocks *= 2
    df = df.withColumn("_k0", F.shiftright("place", 60 - (blocks.bit_length() - 1)).cast("long") if blocks > 1 else F.lit(0).cast("long"))
    keys = ["_k0"]
    for column in ["place", *ties, "_part"]:
        large = written(df.groupBy("shard", *keys).count().filter(F.col("count") > hot), "large-cells")
        if large.isEmpty():
            break
        marks = large.select(F.col("shard").alias("_s"), *[F.col(k).alias(f"{k}_") for k in keys], F.lit(True).alias("_large"))
        same = F.col("shard") == F.col("_s")
        for k in keys:
            same &= F.col(k).eqNullSafe(F.col(f"{k}_"))
        key = f"_k{len(keys)}"
        df = df.join(marks, same, "left").withColumn(key, F.when(F.col("_large"), F.col(column))).drop("_s", "_large", *[f"{k}_" for k in keys])
        keys.append(key)
    cells = (
        df.groupBy("shard", *keys).count()
        .withColumn("_before", F.coalesce(F.sum("count").over(W.partitionBy("shard").orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .select(F.col("shard").alias("_s"), *[F.col(k).alias(f"{k}_") for k in keys], "_before")
    )
    same = F.col("shard") == F.col("_s")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"{k}_"))
    own = F.row_number().over(W.partitionBy("shard", *keys).orderBy("place", *ties)) - 1
    return df.withColumn("_own", own).join(cells, same).withColumn("slot", F.col("_own") + F.col("_before")).drop("_own", "_before", "_s", "_part", *keys, *[f"{k}_" for k in keys])


def shard_documents(docs: DataFrame, shards: int = 24, weights: Sequence[float] | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law ``key``: doc_id and the shard count alone decide. A null text has no bytes (size 8, CRC 0); a null
    doc_id is one more key. Repeated rows share a shard and take neighbouring slots; rows of one doc_id are
    ordered by size and CRC. An empty table gives no rows. Only doc_id and text are read.
    """
    text = full_text()
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = rendezvous(rows, F.col("doc_id"), weights or [1.0] * shards)
    return with_slots(placed, ["doc_id", "size", "text_crc32"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


#: DuckDB has no CRC-32, so the statement builds the byte table of polynomial 0xEDB88320 and folds over the bytes.
ORACLE = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
           lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
rows AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 8 AS size, coalesce(doc_id::VARCHAR, '\N') AS key,
         hex(encode(coalesce(text, ''))) AS h FROM documents),
sums AS (
  SELECT doc_id, size, key,
         xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(h)::BIGINT + 1, 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)),
             lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM rows, crc),
scores AS (
  SELECT doc_id, size, key, text_crc32, list_transform(range(25), lambda i:
           1.0::DOUBLE / -ln((('0x' || substr(md5(key || ':' || i), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE)) AS s
  FROM sums),
owned AS (
  SELECT doc_id, size, key, text_crc32, list_position(s, list_max(s[1:24])) - 1 AS shard,
         CASE WHEN s[25] > list_max(s[1:24]) THEN 24 ELSE list_position(s, list_max(s[1:24])) - 1 END AS grown
  FROM scores)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(key), 1, 15))::BIGINT, doc_id, size, text_crc32) - 1 AS slot,
       grown::INTEGER AS grown_shard
FROM owned
"""
