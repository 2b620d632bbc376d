"""Files by format name, Arrow IPC files, and single-object loads."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabbridge.functions.declared import require_flat
from tabbridge.functions.names import bare, require
from tabbridge.operators.tables import project_by_name
from tabbridge.sources import arrow_files, publish

SPARK_FORMATS = ("csv", "json", "parquet", "orc", "text")
ARROW = "arrow"
# Reader mark for "no cell": with Spark's default a quoted empty cell would turn NULL too.
CSV_NULL = "\x00NULL\x00"


def file_format(name: str) -> str:
    """Format by name in any case, with or without the ``FILE_TYPE_`` prefix."""
    fmt = name.strip().lower().removeprefix("file_type_")
    if fmt == "avro":
        raise ValueError("avro needs the spark-avro package, which is not part of this library")
    if fmt not in (*SPARK_FORMATS, ARROW):
        raise ValueError(f"unsupported file format: {name}")
    return fmt


def read_files(
    spark: SparkSession,
    path: str | Sequence[str],
    fmt: str,
    schema: T.StructType | None = None,
    columns: Sequence[str] = (),
    **options: str | bool,
) -> DataFrame:
    """Files of one format. CSV has a header and reads as text unless a schema is given.

    A schema for JSON saves the inference pass over all files.
    """
    fmt = file_format(fmt)
    if fmt == ARROW:
        return load_arrow_file(spark, path, schema, columns)
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = (
            reader.option("header", True)
            .option("inferSchema", False)
            .option("nullValue", CSV_NULL)
            .option("escape", '"')
        )
    reader = reader.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return project_by_name(reader.load(path if isinstance(path, str) else list(path)), columns)


def write_files(
    df: DataFrame,
    path: str,
    fmt: str,
    mode: str = "error",
    max_rows_per_file: int = 0,
    **options: str | bool,
) -> None:
    """Write the rows as part files of one format; blanks in CSV cells are kept."""
    fmt = file_format(fmt)
    require_flat(df.schema)
    if fmt == ARROW:
        if options:
            raise ValueError(f"arrow files take no options: {sorted(options)}")
        write_arrow(df, path, max_rows_per_file or 1_000_000, mode)
        return
    writer = df.write.format(fmt).mode(mode)
    if fmt == "csv":
        writer = (
            writer.option("header", True)
            .option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
        )
    if max_rows_per_file:
        writer = writer.option("maxRecordsPerFile", max_rows_per_file)
    writer.options(**options).save(path)


def _arrow_format(spark: SparkSession) -> str:
    return publish.register(spark, arrow_files.ArrowFiles)


def _read_cells(spark: SparkSession, paths: str | list[str], schema: T.StructType) -> DataFrame:
    """Files of a store that only Spark opens: each one is a cell, so files stay below 2 GB."""
    target = arrow_files.arrow_schema(schema)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                source = content.as_buffer()
                if source.slice(0, len(arrow_files.MAGIC)).to_pybytes() == arrow_files.MAGIC:
                    yield from arrow_files.batches_of(source, target)
                else:
                    for record in pa.ipc.open_stream(source):
                        yield from arrow_files.conform(record, target)

    files = spark.read.format("binaryFile").load(paths)
    return files.select("content").mapInArrow(decode, schema)


def read_arrow(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | None = None,
    partition_bytes: int | None = None,
) -> DataFrame:
    """Arrow IPC files (file or stream form) as rows of a declared schema.

    Partitions are runs of record batches of about ``partition_bytes`` (Spark's setting for
    files). Columns are matched by name and cast to the declared type; others are not read,
    a missing one is an error. Without a schema that of the first file holds. A time of day
    is text ``HH:mm:ss``, or seconds where an integer is declared.
    """
    paths = path if isinstance(path, str) else list(path)
    files = sorted(spark.read.format("binaryFile").load(paths).inputFiles())
    if files and not publish.openable(files[0]):
        if schema is None:
            raise ValueError("files of this store need a declared schema")
        return _read_cells(spark, paths, schema)
    if partition_bytes is None:
        unit = spark._jvm.org.apache.spark.network.util.JavaUtils
        partition_bytes = unit.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    reader = spark.read.format(_arrow_format(spark))
    if schema is not None:
        reader = reader.schema(schema)
    return reader.option("files", json.dumps(files)).option("partition_bytes", partition_bytes).load()


def write_arrow(
    df: DataFrame,
    path: str,
    max_rows_per_file: int = 1_000_000,
    mode: str = "error",
    time_columns: Sequence[str] = (),
) -> DataFrame:
    """Arrow IPC files named by write, task and number; returns a manifest (file, rows).

    The path is resolved on the driver as Spark resolves it, and must be reachable from every
    executor by one of Arrow's file systems. Files appear when all tasks have succeeded, and
    only then an overwrite removes the old ones, so a failed write leaves the folder as it
    was, and rows may be read from the folder they replace. ``time_columns`` (text
    ``HH:mm:ss``) are stored as seconds of the day.
    """
    if max_rows_per_file < 1:
        raise ValueError("max_rows_per_file must be positive")
    require(df, time_columns)
    spark, label = df.sparkSession, uuid.uuid4().hex[:8]
    address, wanted = publish.resolve(spark, path, mode)
    files: list[tuple[str, int]] = []
    if wanted:
        writer = df.write.format(_arrow_format(spark)).mode("overwrite" if mode == "overwrite" else "append")
        settings = {"label": label, "rows": max_rows_per_file, "times": json.dumps(list(time_columns))}
        writer.options(**settings).save(address)
        files = publish.written(address, label)
    return spark.createDataFrame(files, "file string, rows long")


def load_csv_file(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    columns: Sequence[str] = (),
    separator: str = ",",
    multiline: bool = True,
) -> DataFrame:
    """One headered CSV object as a table; a column list picks and orders its columns."""
    return read_files(
        spark, path, "csv", schema, columns, sep=separator, multiLine=multiline
    )


def load_arrow_file(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType | None = None, columns: Sequence[str] = ()
) -> DataFrame:
    """Arrow files as a table; a column list picks and orders its columns, the others are not read."""
    if schema is not None and columns:
        wanted = {bare(c) for c in columns}
        schema = T.StructType([f for f in schema.fields if f.name in wanted] or schema.fields)
    return project_by_name(read_arrow(spark, path, schema), columns)


def part_number(path_column: str = "_metadata.file_name") -> Column:
    """Number of a part file: trailing digits (``export_12.parquet``), or Spark's part number."""
    name = F.col(path_column)
    # the anchored pattern first: it is cheap, and the other one is only tried without it
    spark_part = F.regexp_extract(name, r"^part-(\d+)-[0-9a-f]{8}-", 1)
    trailing = F.regexp_extract(name, r"(\d+)\.[A-Za-z]+$", 1)
    return F.when(spark_part != "", spark_part.cast("long")).otherwise(
        F.nullif(trailing, F.lit("")).cast("long")
    )


def file_manifest(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """path, size, modified (seconds) and file_id of every non-empty file; no content is read.

    The id is the MD5 of path, size and modification time, so a changed file gets a new one.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    listed = files.load(path if isinstance(path, str) else list(path))
    modified = F.unix_seconds("modificationTime")
    return listed.select(
        "path",
        F.col("length").alias("size"),
        modified.alias("modified"),
        F.md5(F.concat_ws("_", "path", F.col("length").cast("string"), modified.cast("string")))
        .alias("file_id"),
    )
