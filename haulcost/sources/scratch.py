"""Intermediate tables on storage every executor can reach."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession

#: Spark's own setting: a finished query gives back its shuffle files at once.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's own setting: rows that travel to a Python worker at once.
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows at once where they carry whole texts: a batch lies several times in an executor,
#: in buffers of the JVM and of the worker.
TEXT_ROWS = 1000

_folders: list[str] = []


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="haulcost-")


def scratch_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only a session of one process may do without."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return _own_folder()


def new_folder(spark: SparkSession) -> str:
    """A path for one intermediate, which :func:`release_all` deletes."""
    folder = f"{scratch_folder(spark)}/haulcost-{uuid.uuid4().hex}"
    _folders.append(folder)
    return folder


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def shuffle_files_released(spark: SparkSession) -> Iterator[None]:
    """Within, a query that ends gives back its shuffle files; its result must be stored."""
    with _setting(spark, SHUFFLE_CLEANUP, "true"):
        yield


@contextmanager
def text_batches(spark: SparkSession) -> Iterator[None]:
    """Within, a query that runs hands ``TEXT_ROWS`` rows at most to a Python worker at once."""
    now = int(spark.conf.get(ARROW_ROWS))  # none or less: no limit
    with _setting(spark, ARROW_ROWS, str(min(now, TEXT_ROWS) if now > 0 else TEXT_ROWS)):
        yield


def cut_lineage(frame: DataFrame) -> DataFrame:
    """Write a frame that is read several times as a table, and read that instead.

    The table outlives lost executors, is read column by column, and its size is
    known to the optimizer. :func:`release` deletes it.
    """
    spark = frame.sparkSession
    folder = new_folder(spark)
    with shuffle_files_released(spark):
        frame.write.parquet(folder)
    stored = spark.read.schema(frame.schema).parquet(folder)
    stored._haulcost_folder = folder
    return stored


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    if folder in _folders:
        _folders.remove(folder)


def release(*frames: DataFrame) -> None:
    """Delete the tables behind frames of :func:`cut_lineage` that nothing reads any more."""
    for frame in frames:
        folder = vars(frame).pop("_haulcost_folder", None)
        if folder:
            _delete(frame.sparkSession, folder)


def release_all(spark: SparkSession) -> None:
    """Delete every intermediate of this process; call it when the results are written."""
    for folder in list(_folders):
        _delete(spark, folder)
