"""Materialise an intermediate result that several passes read.

The rows go to a parquet table below the checkpoint folder that the session names, so a lost
executor costs a re-read and not the whole lineage, and later passes read only the columns
they need. The write's shuffle files go as soon as it has ended, and `discard` deletes a table that no frame
needs any more, so what a chain of stages holds on disk is its live tables.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of an Arrow batch where rows are whole texts or lists of their tokens.
TEXT_ROWS = 1000

_local_roots: dict[str, str] = {}
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def stage_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the session's setting, else a local one for tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="tabulon-stage-")
    return _local_roots[app]


@contextmanager
def _set(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """Executions in here have the setting; it is put back."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


@contextmanager
def text_batches(spark: SparkSession) -> Iterator[None]:
    """Executions in here hand rows to Python in batches of at most TEXT_ROWS, or fewer if the session says so."""
    rows = int(spark.conf.get(_BATCH_ROWS, "0"))
    with _set(spark, _BATCH_ROWS, str(min(rows, TEXT_ROWS) if rows > 0 else TEXT_ROWS)):
        yield


def stage(df: DataFrame, texts: bool = False) -> DataFrame:
    """Write df once and read it back. texts: Python gets rows of long values, so batches are small."""
    spark = df.sparkSession
    path = f"{stage_root(spark)}/stage-{uuid.uuid4().hex}"
    with _set(spark, _CLEAN_UP, "true"), text_batches(spark) if texts else nullcontext():
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*staged: DataFrame) -> None:
    """Delete tables that `stage` returned. No frame derived from them may be run after this, unless it was staged itself."""
    for df in staged:
        path = _paths.pop(df, None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs
            at = jvm.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
