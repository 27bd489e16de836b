"""Session helpers: sensible SQL settings and a shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Top-k cuts each task's rows before the shuffle up to this k; preference pairs need 10,000.
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
}


def local_session(cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark; on a cluster use the one you are given."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("perkwise")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in SQL_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, read from ``spark.checkpoint.dir``.

    Where it is unset, a local master gets one temporary folder for the session; any other master is
    an error, because its executors would each write to a disk of their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[key] = tempfile.mkdtemp(prefix="perkwise-")
    return _LOCAL_FOLDERS[key]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, so a job never overwrites what it is reading."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# The tables written inside each open ``tidy`` block.
_OPEN: list[list[str]] = []


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is in."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names of the folders directly below a path."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in files.listStatus(hadoop) if s.isDirectory()] if files.exists(hadoop) else []


@contextmanager
def tidy(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A block whose staged tables go when it ends.

    Gives a function that stages what the block returns: those tables stay, for the enclosing block if there is one.
    """
    _OPEN.append([])

    def result(df: DataFrame, name: str) -> DataFrame:
        inner = _OPEN.pop()
        try:
            return stage(df, name)
        finally:
            _OPEN.append(inner)

    try:
        yield result
    finally:
        for path in _OPEN.pop():
            drop_path(spark, path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> Iterator[None]:
    """A block in which Python workers get batches of fewer rows and bytes: ten thousand texts, or a thousand
    packed rows, take tens of megabytes on each side. A row beyond ``size`` is a batch of its own."""
    records, octets = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    before = {key: spark.conf.get(key) for key in (records, octets)}
    spark.conf.set(records, str(min(rows, int(before[records])) if int(before[records]) > 0 else rows))
    spark.conf.set(octets, str(size))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to a fresh table in the shared folder and read it back.

    Cuts the lineage of data that is used many times, and survives the loss of executors. Inside a ``tidy`` block
    the table goes when the block ends.
    """
    path = scratch_path(df.sparkSession, name)
    if _OPEN:
        _OPEN[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
