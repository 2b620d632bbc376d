"""Tables staged in the shared folder between the steps of an operator."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tabbridge.session import stage, workspace

#: Python steps get small batches; finished jobs leave no shuffle files behind.
_STEP_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def released(step: Callable) -> Callable:
    """``step`` over Arrow batches; what its task has freed goes back to the system.

    Spark keeps Python workers for later steps, and the allocators would keep that memory with them.
    """

    @wraps(step)
    def run(batches):
        yield from step(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)

    return run


@contextmanager
def step_settings(spark: SparkSession, **batch: int) -> Iterator[None]:
    """``batch``: another value of an Arrow batch's limits, by the last part of their names."""
    settings = _STEP_CONF | {f"spark.sql.execution.arrow.{key}": str(value) for key, value in batch.items()}
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


class Scratch:
    """Intermediate tables of one run; all of them go when the block ends.

    Every table is Parquet in the folder that executors share, so a lost executor costs
    tasks and not the run, and the lineage of later steps starts at the files.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.tag, self._paths = spark, tag, {}

    def put(self, df: DataFrame) -> DataFrame:
        path = workspace(self.spark, self.tag)
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(table)] = (table, path)
        return table

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            self._discard(self._paths.pop(id(table))[1])

    def clear(self) -> None:
        for _, path in self._paths.values():
            self._discard(path)
        self._paths.clear()

    def _discard(self, path: str) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession, tag: str, **batch: int) -> Iterator[Scratch]:
    tables = Scratch(spark, tag)
    with step_settings(spark, **batch):
        try:
            yield tables
        finally:
            tables.clear()


def result(df: DataFrame, tag: str) -> DataFrame:
    """The finished rows, written once; ``tabbridge.session.clear_staged`` removes them."""
    return stage(df, tag)
