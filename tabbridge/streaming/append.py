"""Append a stream of files to one table, each batch exactly once."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabbridge.functions.declared import require_flat
from tabbridge.operators.stats import observed, observed_rows

LABEL = "load_label"


def stream_append(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    schema: T.StructType | None = None,
    files_per_batch: int = 100,
    label_prefix: str = "import",
    fmt: str = "parquet",
) -> int:
    """Load all files that arrived since the last run; returns the rows of this run.

    The schema is fixed before the first batch (taken from the source when not given).
    Every batch is one labelled load. The label names the checkpoint and the batch, and
    the batch overwrites only the partition of its label: a batch repeated after a
    failure does not load twice, and streams with other checkpoints keep apart.
    ``checkpoint`` and ``target`` are shared folders.
    """
    schema = schema or spark.read.format(fmt).load(source).schema
    require_flat(schema)
    stream = (
        spark.readStream.format(fmt)
        .schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(source)
    )

    stream_id = hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()[:12]
    loaded: list[int] = []

    def load(batch: DataFrame, number: int) -> None:
        counted, watch = observed(batch)
        label = f"{label_prefix}_{stream_id}_{number:012d}"
        counted.write.mode("overwrite").parquet(f"{target}/{LABEL}={label}")
        loaded.append(observed_rows(watch))

    query = (
        stream.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return sum(loaded)


def appended(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    """Rows loaded so far, without the load label."""
    return spark.read.schema(schema).parquet(target).select(schema.fieldNames())


def load_ledger(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    """Rows per load label."""
    labelled = T.StructType([*schema.fields, T.StructField(LABEL, T.StringType())])
    rows = spark.read.schema(labelled).parquet(target)
    return rows.groupBy(LABEL).agg(F.count(F.lit(1)).alias("rows"))
