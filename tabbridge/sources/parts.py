"""Numbered Parquet parts and CSV exports."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabbridge.functions.declared import require_flat
from tabbridge.functions.names import col
from tabbridge.functions.ordering import (
    TIE,
    SortRule,
    order_columns,
    parse_rules,
    range_partition,
    with_tie,
)
from tabbridge.functions.predicates import Filter, where
from tabbridge.functions.sizing import EXPORT_FILE_BYTES, file_rows_for
from tabbridge.operators.tables import project_by_name
from tabbridge.sources.capped import save_csv, save_parquet
from tabbridge.sources.files import part_number


def export_parquet(
    df: DataFrame,
    path: str,
    columns: Sequence[str] = (),
    filters: Iterable[Filter | Sequence[Any]] = (),
    sort: Iterable[SortRule] = (),
    max_file_bytes: int = EXPORT_FILE_BYTES,
    *,
    from_scan: bool = False,
) -> None:
    """Projected, filtered, sorted export to numbered part files below a size cap.

    Sorted exports are range-partitioned, so the part number order is the row order
    and no task sees the whole table. Unsorted exports are not shuffled. The cap holds for
    the bytes of the files (see ``capped``); on stores that only Spark opens it is planned.
    """
    rows, rules = where(df, filters), list(sort)
    if rules:
        fields = [f for f, _ in parse_rules(rules)]
        used = list(dict.fromkeys([*columns, *fields])) if columns else ()
        rows = with_tie(project_by_name(rows, used), from_scan)
        rows = range_partition(rows, [*order_columns(rows, rules), col(TIE)]).drop(TIE)
    rows = project_by_name(rows, columns)
    require_flat(rows.schema)
    if not save_parquet(rows, path, max_file_bytes):
        rows.write.option("maxRecordsPerFile", file_rows_for(rows.schema, max_file_bytes)).parquet(path)


def read_parts(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] = (),
    part_column: str | None = None,
    ordered: bool = False,
) -> DataFrame:
    """Parquet parts below a folder, columns in request order, missing ones an error.

    ``part_column`` adds the part number. ``ordered`` sorts the rows by part number and
    place in the part, which is the order a sorted export was written in.
    """
    table = spark.read.parquet(path)
    number = part_number()
    places = [number, F.col("_metadata.file_name"), F.col("_metadata.row_index")]
    rows = table.select(
        *[col(c) for c in table.columns],
        *([number.alias(part_column)] if part_column else []),
        *([p.alias(f"__place_{i}") for i, p in enumerate(places)] if ordered else []),
    )
    if ordered:
        rows = rows.orderBy(*[f"__place_{i}" for i in range(len(places))])
    wanted = [*(columns or table.columns), *([part_column] if part_column else [])]
    return project_by_name(rows, wanted)


def export_csv(
    df: DataFrame,
    path: str,
    columns: Sequence[str] = (),
    column_separator: str = ",",
    line_separator: str = "\n",
    max_file_bytes: int = EXPORT_FILE_BYTES,
) -> None:
    """CSV with column names in every part. NULL is an empty cell, '' a quoted one."""
    rows = project_by_name(df, columns)
    require_flat(rows.schema)
    save_csv(
        rows,
        path,
        max_file_bytes,
        {"sep": column_separator or ",", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss[.SSSSSS]"},
        line_separator or "\n",
    )


def part_rows(parts: DataFrame, part_column: str) -> DataFrame:
    """Rows per part number."""
    return parts.groupBy(col(part_column)).agg(F.count(F.lit(1)).alias("rows"))
