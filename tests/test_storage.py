"""Working tables: what is left on disk once one is written."""

from pathlib import Path

from pyspark.sql import functions as F

from sedge import storage


def shuffles(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f.name for d in dirs for f in Path(d.getPath()).rglob("shuffle_*")}


def test_no_shuffle_left(spark):
    """The shuffles that a working table came of go with its writing, and what it was made of can be used again."""
    before = shuffles(spark)
    rows = spark.range(1000).repartition(7, "id").withColumn("x", F.col("id") % 5)
    sums = rows.join(rows.groupBy("x").count().hint("merge"), "x")
    kept = [storage.written(sums, "sums") for _ in range(2)]
    assert shuffles(spark) <= before
    assert [k.count() for k in kept] == [1000, 1000] and sums.count() == 1000
    storage.discard(*kept)


def test_settings_put_back(spark):
    """None is left set, and one that somebody has set is left alone."""
    keys = list(storage._WRITING)
    spark.conf.set(keys[0], "1m")
    try:
        storage.discard(storage.written(spark.range(3).toDF("id"), "few"))
        assert spark.conf.get(keys[0]) == "1m"
    finally:
        spark.conf.unset(keys[0])
    assert [spark.conf.get(k) for k in keys] == [unset for unset, _ in storage._WRITING.values()]
