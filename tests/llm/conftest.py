import sys
from pathlib import Path

import duckdb
import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent), str(Path(__file__).resolve().parent.parent.parent)]

from conftest_llm import SCHEMA, SMOKE  # noqa: E402


@pytest.fixture(scope="session")
def docs(spark):
    """Rows of every awkward kind: nulls, empty, blank, long, repeated, one letter, no letter, other scripts."""
    long = " ".join(f"word{i % 997} Thing{i % 31}," for i in range(30_000))
    rows = [
        (1, "one two three four five six", "en", "a"), (2, "", "en", "a"), (3, None, None, None), (4, "  \t\n ", "de", "b"), (5, long, "en", "b"), (6, long, "en", "b"), (6, long, "en", "b"),
        (7, "ein kurzer deutscher Satz über Straßen", "de", "c"), (8, "日本語のテキスト 😀 ﬁ", None, "c"), (9, "x", "fr", ""), (10, "123 456 !!", "es", "é"), (11, "one two three four five six", "en", "z"), (None, "a text without an id", "en", "a"), (12, "a\x00b\x0bc d e", "en", "a"),
    ]
    return spark.createDataFrame([(i, t, g, s, len(t) if t else None) for i, t, g, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd_columns(docs):
    """The same rows with more columns, under names that an operator might use itself."""
    out = docs
    for name in ("size", "hash", "shard", "slot", "tag", "label", "bucket", "n", "score", "bands", "id", "at", "_key", "_run", "copies", "quality", "x", "a", "b"):
        out = out.withColumn(name, docs["doc_id"])
    return out


@pytest.fixture(scope="session")
def smoke(spark):
    return spark.read.parquet(f"{SMOKE}/documents.parquet")


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in "documents pages labels benchmark conversations embeddings".split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SMOKE}/{name}.parquet'")
    return con
