"""The few helpers that several operators use; working tables are those of ``sedge.storage``."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Iterable, Iterator
from types import ModuleType

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from sedge.storage import discard, new_path, settled, written

__all__ = ["discard", "new_path", "settled", "written"]

#: A word is a maximal run of anything but the space and the five ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1, ...: what a caller's columns are called then clashes with nothing."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def full_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def hash60(key: Column) -> Column:
    """The first 15 hex digits of the MD5 of a string column as a long: 60 bits any SQL engine can also make."""
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def kept_in_process(name: str, make):
    """What ``make()`` gave the first time this process asked for ``name``: a Python worker runs many tasks. It stays
    until the worker starts a task of ``mapped`` that doesn't ask for it."""
    kept = _kept()
    if name not in kept:
        kept[name] = make()
    kept["asked"].add(name)
    return kept[name]


def _kept() -> dict:
    return sys.modules.setdefault("sedge_kept", ModuleType("sedge_kept")).__dict__.setdefault("kept", {"asked": set()})


def begun(make):
    """What ``make()`` gives at the start of a task, after which what is kept in this process and it didn't ask for is let
    go of: a worker of one stage runs the tasks of others too, and shouldn't hold a vocabulary meanwhile."""
    kept = _kept()
    kept["asked"].clear()
    step = make()
    idle = kept.keys() - kept["asked"] - {"asked"}
    for name in idle:
        del kept[name]
    if idle:
        give_back()
    return step


def fields(**kinds: str | DataType) -> StructType:
    """A schema of types or of their names; types go through as they are, whatever their fields are called."""
    from pyspark.sql.types import _parse_datatype_string

    return StructType([StructField(k, _parse_datatype_string(v) if isinstance(v, str) else v) for k, v in kinds.items()])


def mapped(df: DataFrame, make, schema: StructType) -> DataFrame:
    """``mapInArrow`` for a factory: ``make()`` runs once a task and gives a function from a RecordBatch to
    a dict of columns (or None). Large batches are cut by bytes, so long texts can't pile up in a worker."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = begun(make)
        for batch in batches:
            for part in in_pieces(batch):
                if (out := step(part)) is not None:
                    yield pa.RecordBatch.from_arrays([typed(out[k.name], k.type) for k in kinds], schema=kinds)
        del step
        give_back()

    return df.mapInArrow(run, schema)


def typed(x, kind: pa.DataType) -> pa.Array:
    x = x if isinstance(x, pa.Array) else pa.array(x, kind)
    return x if x.type == kind else x.cast(kind)


def give_back() -> None:
    """Return freed memory to the system: a Python worker outlives its tasks, and two of them share an executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def in_pieces(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    if batch.nbytes <= most or batch.num_rows <= 1:
        if batch.num_rows:
            yield batch
        return
    half = batch.num_rows // 2
    for part in (batch.slice(0, half), batch.slice(half)):
        yield from in_pieces(part, most)
