"""Working tables: written under the folder that all executors share, read back, and removed when done with.

What is read back has no lineage, so a lost executor costs a stage and not the job. A table that is removed by
nothing else goes when the driver's JVM ends.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch while a working table is written.
ARROW_BYTES = 2 << 20
#: Settings while a working table is written, each with Spark's own value and ours.
_WRITING = {
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", str(ARROW_BYTES)),
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": ("false", "true"),
}
#: Tables of this process that are still there, oldest first.
_made: list[str] = []
_own: list[str] = []
_roots: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the context's checkpoint folder. Without either a local session works in a
    temporary folder of its own; on a cluster that would be another folder on each host, so it raises."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="sedge-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own in this application's folder under the shared one, which goes when the driver's JVM ends."""
    application = spark.sparkContext.applicationId
    if application not in _roots:
        root = f"{shared_dir(spark)}/sedge-{application}-{uuid.uuid4().hex[:8]}"
        files, at = _files(spark, root)
        files.mkdirs(at)
        files.deleteOnExit(at)
        _roots[application] = root
    path = f"{_roots[application]}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def written(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """``df`` written as a working table and read back. ``compression`` is that of Parquet, else the session's.

    While it is written, Arrow batches are cut at ``ARROW_BYTES``, less than Spark's 64 MB: a batch and its copy for
    Python lie outside the heap. Once it is, the shuffles it came of are removed from the executors' disks; they
    would stay until the driver happens to collect its garbage. A value that somebody has set is left alone, and none is
    left set."""
    spark = df.sparkSession
    path = new_path(spark, label)
    ours = [k for k, (unset, _) in _WRITING.items() if spark.conf.get(k, unset) == unset]
    for k in ours:
        spark.conf.set(k, _WRITING[k][1])
    try:
        df.write.parquet(path, compression=compression)
    finally:
        for k in ours:
            spark.conf.unset(k)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove working tables that nothing reads any more; what isn't one is left alone."""
    for x in tables:
        if path := getattr(x, "_written_at", None):
            _remove(x.sparkSession, path)


def settled(label: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make()`` returns, written unless it is a table that ``make()`` has written; the working tables it made
    on the way are removed."""
    before = set(_made)
    out = make()
    if getattr(out, "_written_at", None) not in set(_made) - before:
        out = written(out, label)
    for path in [p for p in _made if p not in before and p != out._written_at]:
        _remove(out.sparkSession, path)
    return out


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _remove(spark: SparkSession, path: str) -> None:
    files, at = _files(spark, path)
    files.delete(at, True)
    if path in _made:
        _made.remove(path)
