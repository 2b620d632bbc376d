"""Table facts, size estimates and row accounting."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tabbridge.functions.names import col
from tabbridge.functions.sizing import row_bytes, size_tier
from tabbridge.sources.footers import footer_facts

TIERS = (100_000, 10_000_000, 100_000_000)
_STATISTICS = re.compile(r"(?P<bytes>\d+) bytes, (?P<rows>\d+) rows")


def estimate_size(df: DataFrame, factor: float = 1.0) -> DataFrame:
    """One row: rows, avg_row_bytes, table_bytes = average × rows × factor.

    The average is an integer division over all rows. An empty table has size 0.
    """
    facts = df.select(row_bytes(df.schema).alias("b")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("b").alias("bytes")
    )
    return _sized(facts, factor)


def _sized(facts: DataFrame, factor: float) -> DataFrame:
    average = F.when(col("rows") > 0, F.expr("bytes div rows")).otherwise(F.lit(0))
    size = col("avg_row_bytes") * col("rows") * F.lit(float(factor))
    return facts.withColumn("avg_row_bytes", average.cast("long")).select(
        "rows", "avg_row_bytes", size.cast("long").alias("table_bytes")
    )


def catalog_statistics(spark: SparkSession, table: str) -> tuple[int, int] | None:
    """(rows, bytes) that ANALYZE TABLE left in the catalog, without touching the data."""
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {table}")
    found = described.where(col("col_name") == "Statistics").select("data_type").first()
    match = _STATISTICS.search(found[0]) if found else None
    return (int(match["rows"]), int(match["bytes"])) if match else None


def _info_row(
    facts: DataFrame, name: str, columns: list[str], tiers: tuple[int, int, int]
) -> DataFrame:
    return facts.select(
        F.lit(name).alias("table_name"),
        "record_count",
        "record_size",
        F.lit(len(columns)).alias("column_count"),
        F.lit(",".join(columns)).alias("columns"),
        size_tier(col("record_count"), *tiers).alias("size_tier"),
    )


def table_info(
    tables: Mapping[str, DataFrame] | Sequence[str],
    exact: bool = True,
    tiers: tuple[int, int, int] = TIERS,
    factor: float = 1.0,
    measure: str = "footers",
) -> DataFrame:
    """One row per table: record count, byte size, columns, size tier.

    ``tables`` are DataFrames by name, or names of managed tables. Exact mode counts
    rows and reports size 0. Otherwise a managed table's catalog statistics are used
    when it has rows in them. Sizes of the rest are estimated from the footers of Parquet
    files, which reads no rows; with ``measure="rows"``, and for other frames, every row is
    measured as in ``estimate_size``.
    """
    if measure not in ("footers", "rows"):
        raise ValueError("measure must be 'footers' or 'rows'")
    if not tables:
        raise ValueError("no tables given")
    named = isinstance(tables, Mapping)
    spark = SparkSession.active()

    def facts(name: str, df: DataFrame) -> DataFrame:
        if exact:
            counted = df.agg(F.count(F.lit(1)).alias("record_count"))
            return counted.withColumn("record_size", F.lit(0).cast("long"))
        known = None if named else catalog_statistics(spark, name)
        if known and known[0] > 0:
            return spark.createDataFrame([known], "record_count long, record_size long")
        told = footers.get(name)
        sized = _sized(spark.createDataFrame([told], "rows long, bytes long"), factor) if told else estimate_size(df, factor)
        return sized.select(
            col("rows").alias("record_count"), col("table_bytes").alias("record_size")
        )

    frames = tables if named else {name: spark.table(name) for name in tables}
    footers = {} if exact or measure == "rows" else footer_facts(frames)
    return reduce(
        DataFrame.unionByName,
        [_info_row(facts(n, df), n, df.columns, tiers) for n, df in frames.items()],
    )


def observed(df: DataFrame, name: str | None = None) -> tuple[DataFrame, Observation]:
    """``df`` with a row counter that the consuming action fills; no second scan."""
    watch = Observation(name) if name else Observation()
    return df.observe(watch, F.count(F.lit(1)).alias("rows")), watch


def observed_rows(watch: Observation) -> int:
    return int(watch.get["rows"])


class RowCountMismatch(RuntimeError):
    pass


def reconcile_counts(table: str, expected: int, delivered: int) -> int:
    """``delivered``, or an error when it is not the table's row count."""
    if expected != delivered:
        raise RowCountMismatch(
            f"table {table}: expected {expected} rows, delivered {delivered} rows"
        )
    return delivered


def validate_row_count(counts: DataFrame, tolerance: float | Column = 0.0) -> DataFrame:
    """Adds diff, diff_percent and passed to rows of (operation, expected, actual).

    The percentage is 0 when nothing was expected.
    """
    tolerance = tolerance if isinstance(tolerance, Column) else F.lit(float(tolerance))
    diff = col("actual") - col("expected")
    percent = F.when(
        col("expected") > 0, diff.cast("double") / col("expected").cast("double") * 100
    ).otherwise(F.lit(0.0))
    return counts.select(
        "operation",
        "expected",
        "actual",
        diff.alias("diff"),
        percent.alias("diff_percent"),
        (F.abs(percent) <= tolerance).alias("passed"),
    )


class LoadFailed(RuntimeError):
    pass


def load_failed(total: Any, loaded: Any, failed: Any) -> Any:
    """Verdict on a load's counters, for numbers and columns alike."""
    return (failed > 0) | ((total > 0) & (loaded == 0))


def check_load(total: int, loaded: int, failed: int) -> None:
    """Raise when rows failed, or when there were rows and none was loaded."""
    if load_failed(total, loaded, failed):
        raise LoadFailed(f"load failed: total={total}, loaded={loaded}, failed={failed}")


def load_verdict(counters: DataFrame) -> DataFrame:
    """Adds ``success`` to rows holding total_rows, loaded_rows and failed_rows."""
    return counters.withColumn(
        "success",
        ~load_failed(col("total_rows"), col("loaded_rows"), col("failed_rows")),
    )
