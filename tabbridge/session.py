"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tabbridge", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs here count on.

    Shuffle width is left to the cluster's own defaults; AQE coalesces small
    partitions and splits skewed join partitions.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # building wide projections gets slow when every Column keeps its call site
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def isolated(spark: SparkSession) -> SparkSession:
    """A session of its own with the settings, views and functions that ``spark`` has now.

    Its current database and settings may be changed without a trace in ``spark``.
    """
    return SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())


def forget_tables(spark: SparkSession) -> None:
    """Tables another session may have written are listed anew."""
    spark._jsparkSession.sessionState().catalog().invalidateAllCachedTables()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of this machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="tabbridge-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def workspace(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder; nothing is created yet."""
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


_staged: list[str] = []


def staged_folder(spark: SparkSession, tag: str) -> str:
    """A path below the shared folder that ``clear_staged`` removes."""
    _staged.append(workspace(spark, tag))
    return _staged[-1]


def stage(df: DataFrame, tag: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and return the re-read table.

    Used where two passes must see the same rows in the same partitions: unlike a
    cache it survives the loss of executors, and it cuts the lineage. The folder is
    kept until ``clear_staged``.
    """
    spark = df.sparkSession
    path = staged_folder(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def staging(df: DataFrame, tag: str = "stage") -> Iterator[DataFrame]:
    """``stage`` for the length of a block; the folder is removed afterwards."""
    spark, path = df.sparkSession, workspace(df.sparkSession, tag)
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        discard(spark, path)


@contextmanager
def staged_within(spark: SparkSession) -> Iterator[None]:
    """What is staged inside the block is removed at its end."""
    kept = len(_staged)
    try:
        yield
    finally:
        for path in _staged[kept:]:
            discard(spark, path)
            _staged.remove(path)


def clear_staged(spark: SparkSession) -> int:
    """Remove the folders this process has staged, once nothing reads them any more."""
    paths = _staged.copy()
    for path in paths:
        discard(spark, path)
        _staged.remove(path)
    return len(paths)


def discard(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
