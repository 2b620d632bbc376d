"""Copies into managed tables: whole tables, key ranges, several targets, between stores."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabbridge.functions.declared import declared_schema, require_flat
from tabbridge.functions.names import bare, col, require
from tabbridge.operators.counts import key_bounds
from tabbridge.operators.stats import check_load, observed, observed_rows
from tabbridge.operators.tables import select_columns
from tabbridge.session import staging
from tabbridge.sources.assets import TableKey, auto_increment_key
from tabbridge.sources.delimited import REJECT_REASON, load_with_rejects
from tabbridge.sources.jdbc import Connection, read_jdbc, write_jdbc
from tabbridge.sources.managed import write_table

DEFAULT_BATCH_ROWS = 5000
# Overall verdicts.
ALL_GOOD = "Import completed successfully"
SOME_FAILED = "Import completed with some failures"
ALL_FAILED = "Import failed for all targets"

RESULT_SCHEMA = T.StructType(
    [
        T.StructField("source_table", T.StringType()),
        T.StructField("target_table", T.StringType()),
        T.StructField("affected_rows", T.LongType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("error_message", T.StringType()),
    ]
)


class Imported(NamedTuple):
    table: str
    rows: int


def _replace(df: DataFrame, table: str) -> Imported:
    require_flat(df.schema)
    counted, watch = observed(df)
    counted.write.mode("overwrite").format("parquet").saveAsTable(table)
    return Imported(table, observed_rows(watch))


def import_table(df: DataFrame, table: str, columns: Sequence[str] = ()) -> Imported:
    """Full copy of the chosen columns, replacing the target.

    The row count is observed while writing, not counted afterwards.
    """
    return _replace(select_columns(df, columns), table)


def range_id(key: str, low: int, batch_rows: int) -> Column:
    """Number of the ``[start, start + batch_rows - 1]`` window a key falls into."""
    return F.expr(f"(`{bare(key)}` - {low}L) div {batch_rows}L").cast("long")


def key_ranges(df: DataFrame, key: str, batch_rows: int = DEFAULT_BATCH_ROWS) -> DataFrame:
    """Rows per key range: range_id, range_start, range_end, rows, min_key, max_key.

    Empty ranges are left out; rows without a key form one range with NULL bounds.
    """
    if batch_rows < 1:
        raise ValueError("batch_rows must be positive")
    low = key_bounds(df, key).first()["min_key"] or 0
    grouped = df.groupBy(range_id(key, low, batch_rows).alias("range_id")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(col(key)).cast("long").alias("min_key"),
        F.max(col(key)).cast("long").alias("max_key"),
    )
    start = F.col("range_id") * F.lit(batch_rows) + F.lit(low)
    return grouped.select(
        "range_id",
        start.alias("range_start"),
        (start + F.lit(batch_rows - 1)).alias("range_end"),
        "rows",
        "min_key",
        "max_key",
    )


class RangeImport(NamedTuple):
    table: str
    rows: int
    ranges: DataFrame


def import_by_key_range(
    df: DataFrame,
    table: str,
    key: str,
    columns: Sequence[str] = (),
    batch_rows: int = DEFAULT_BATCH_ROWS,
) -> RangeImport:
    """Copy with an account of rows per key range; the key is added to the columns.

    All ranges are written by one job whose failed tasks Spark repeats, so a range is
    neither lost nor doubled; there is no loop over ranges and no shuffle. A relational
    source comes in by parallel ranges through ``read_jdbc(key=…)``. Without any key
    value the copy is a single range.
    """
    require(df, [key])
    wanted = [*columns, key] if columns and bare(key) not in map(bare, columns) else columns
    done = import_table(df, table, wanted)
    written = df.sparkSession.table(table)
    return RangeImport(table, done.rows, key_ranges(written, key, batch_rows))


@dataclass(frozen=True)
class Target:
    source: DataFrame
    source_name: str
    table: str
    columns: Sequence[str] = ()
    keys: Sequence[TableKey] = ()


class ImportReport(NamedTuple):
    results: DataFrame
    success: bool
    message: str


def import_targets(
    spark: SparkSession,
    targets: Sequence[Target],
    batch_rows: int = DEFAULT_BATCH_ROWS,
    parallel: int = 4,
) -> ImportReport:
    """Run several copies and report one row each; a failure does not stop the others.

    A target with a single-column auto-increment key is copied with its key added.
    """

    def run(target: Target) -> tuple:
        try:
            key = auto_increment_key(target.keys)
            if key:
                done = import_by_key_range(
                    target.source, target.table, key, target.columns, batch_rows
                )
            else:
                done = import_table(target.source, target.table, target.columns)
            return (target.source_name, done.table, done.rows, True, "")
        except Exception as error:  # noqa: BLE001 - reported per target
            return (target.source_name, target.table, 0, False, str(error))

    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        rows = list(pool.map(run, targets))
    results = spark.createDataFrame(rows, RESULT_SCHEMA)
    good = sum(1 for r in rows if r[3])
    message = ALL_GOOD if good == len(rows) else SOME_FAILED if good else ALL_FAILED
    return ImportReport(results, good == len(rows), message)


def _declared(df: DataFrame, columns: Sequence[tuple[str, str]], dialect: str) -> DataFrame:
    schema = declared_schema(list(columns), dialect)
    require(df, schema.fieldNames())
    return df.select([col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def export_to_relational(
    df: DataFrame,
    connection: Connection,
    table: str,
    columns: Sequence[tuple[str, str]],
    **options: str,
) -> int:
    """Warehouse rows to a relational table, by an explicit (name, type) column list."""
    counted, watch = observed(_declared(df, columns, connection.dialect))
    write_jdbc(counted, connection, table, **options)
    return observed_rows(watch)


def import_from_relational(
    spark: SparkSession,
    connection: Connection,
    source: str,
    table: str,
    columns: Sequence[tuple[str, str]],
    key: str | None = None,
    **options: str,
) -> Imported:
    """A relational table to a managed table, by an explicit (name, type) column list."""
    rows = read_jdbc(spark, connection, source, key=key, **options)
    return _replace(_declared(rows, columns, connection.dialect), table)


class LoadReport(NamedTuple):
    total: int
    loaded: int
    failed: int


def load_delimited(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType,
    table: str,
    rejects: str | None = None,
    multiline: bool = True,
) -> LoadReport:
    """Typed text into a table, with the three load counters.

    The text is parsed once into a staged table, which is counted while it is written.
    Without ``rejects`` a failed row fails the load and the target stays as it was; with
    it, the failed rows and their reason go to that folder as Parquet.
    """
    load = load_with_rejects(spark, path, schema, multiline)
    with staging(load.rows, "load") as staged:
        counted = load.counters.get
        report = LoadReport(
            counted["total_rows"], counted["loaded_rows"], counted["failed_rows"]
        )
        if rejects is None:
            check_load(*report)
        bad = F.col(REJECT_REASON).isNotNull()
        if rejects is not None:
            staged.where(bad).select("raw.*", REJECT_REASON).write.parquet(rejects)
        write_table(staged.where(~bad).select("typed.*"), table)
    return report
