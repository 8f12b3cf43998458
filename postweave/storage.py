"""Where intermediate tables live.

Lineage is cut by writing Parquet below the folder named in
``spark.checkpoint.dir``: it survives the loss of executors, is columnar (later
reads prune columns) and gives the optimizer exact sizes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables and stream checkpoints.

    It is the one named in ``spark.checkpoint.dir``, or else a folder in the warehouse,
    which driver and executors share as well.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        configured = spark.sparkContext.getCheckpointDir()
    if configured is None:
        configured = f"{spark.conf.get('spark.sql.warehouse.dir')}/postweave-scratch"
    return configured.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{_session_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _session_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/postweave/{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; frames that read them are lost."""
    delete(spark, _session_dir(spark))


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder, if it is there."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


# Lists that take note of the tables written while they are in use, innermost last.
_noted: list[list[DataFrame]] = []


@contextmanager
def noted_tables() -> Iterator[list[DataFrame]]:
    """The tables that ``materialize`` writes in this block, for ``discard``."""
    _noted.append([])
    try:
        yield _noted[-1]
    finally:
        _noted.pop()


# Lets Spark remove a query's shuffle files when it ends, and not when the driver happens to collect garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh table in the shared folder and read it back.

    The frame that is returned can be given to ``discard`` once nothing reads it any more.
    """
    path = scratch_path(df.sparkSession, name)
    with _shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.scratch = path
    for tables in _noted:
        tables.append(stored)
    return stored


def discard(*stored: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote."""
    for df in stored:
        delete(df.sparkSession, df.scratch)


def is_committed(spark: SparkSession, path: str) -> bool:
    """True if a finished write left its ``_SUCCESS`` marker at ``path``."""
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    fs = marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(marker)


def committed_batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished ``batch=<number>`` folders below ``path``, in order."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(path, "batch=*/_SUCCESS")
    fs = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(pattern) or []
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)


def load_or_compute(spark: SparkSession, path: str, compute) -> DataFrame:
    """Reload a stage from ``path`` if it was committed, else compute and write it."""
    if not is_committed(spark, path):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
