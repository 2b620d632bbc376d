"""Projected, filtered, sorted table reads and the column selection rules."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabbridge.functions.names import ColumnsNotFound, bare, col, require
from tabbridge.functions.ordering import TIE, SortRule, order_columns, with_tie
from tabbridge.functions.predicates import Filter, where

ROWID = "rowid"


def select_columns(df: DataFrame, names: Sequence[str] = ()) -> DataFrame:
    """The requested columns once each, in **source** order; nothing requested means all."""
    if not names:
        return df
    wanted = set(require(df, names))
    return df.select([col(c) for c in df.columns if c in wanted])


def select_with_rowid(df: DataFrame, names: Sequence[str] = ()) -> DataFrame:
    """``select_columns``, adding a NULL BIGINT ``rowid`` at the end when the source lacks it.

    The name is matched in any case. A ``rowid`` the source has keeps its type.
    """
    others = [n for n in names if bare(n).lower() != ROWID]
    try:
        return select_columns(df, names)
    except ColumnsNotFound:
        if len(others) == len(names):
            raise
    return select_columns(df, others).withColumn(ROWID, F.lit(None).cast("long"))


def project_by_name(df: DataFrame, names: Sequence[str] = ()) -> DataFrame:
    """The requested columns in **request** order; nothing requested means all."""
    return df.select([col(n) for n in require(df, names)]) if names else df


def sort_table(
    df: DataFrame, rules: Iterable[SortRule], *, from_scan: bool = False
) -> DataFrame:
    """Global multi-key sort, NULLs first ascending and last descending.

    ``from_scan=True`` states that ``df`` is a file scan plus row-wise steps, which
    saves the local pre-sort (see ``with_tie``).
    """
    order = order_columns(df, rules)
    if not order:
        return df
    return with_tie(df, from_scan).orderBy(*order, TIE).drop(TIE)


def read_table(
    df: DataFrame,
    columns: Sequence[str] = (),
    filters: Iterable[Filter | Sequence[Any]] = (),
    sort: Iterable[SortRule] = (),
    *,
    from_scan: bool = False,
) -> DataFrame:
    """SELECT columns WHERE filters ORDER BY rules, as one lazy plan.

    Filters and the columns in use reach the scan; the sort may use columns that
    are not selected.
    """
    require(df, columns)
    rows = where(df, filters)
    rules = list(sort)
    if not rules:
        return project_by_name(rows, columns)
    used = [*columns, *[bare(r if isinstance(r, str) else r[0]) for r in rules]]
    narrow = project_by_name(rows, list(dict.fromkeys(bare(u) for u in used)) if columns else ())
    return project_by_name(sort_table(narrow, rules, from_scan=from_scan), columns)


def empty_result(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """Zero rows of a declared schema."""
    return spark.createDataFrame([], schema)
