"""Row counts, group counts and key bounds."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabbridge.functions.names import col, require
from tabbridge.functions.predicates import Filter, where

Filters = Iterable[Filter | Sequence[Any]]


def count_rows(df: DataFrame, filters: Filters = (), name: str = "count") -> DataFrame:
    return where(df, filters).agg(F.count(F.lit(1)).alias(name))


def groupby_count(
    df: DataFrame, keys: Sequence[str], filters: Filters = (), name: str = "count"
) -> DataFrame:
    """Keys and their row counts; the filters apply before grouping."""
    names = require(df, keys)
    if not names:
        raise ValueError("groupby_count needs at least one key column")
    return where(df, filters).groupBy(*[col(n) for n in names]).agg(F.count(F.lit(1)).alias(name))


def group_count_info(
    df: DataFrame, keys: Sequence[str] = (), filters: Filters = (), name: str = "count"
) -> DataFrame:
    """The counts without their keys, one row per group; one total row without keys."""
    if not keys:
        return count_rows(df, filters, name)
    return groupby_count(df, keys, filters, name).select(name)


def key_bounds(df: DataFrame, key: str) -> DataFrame:
    """One row: smallest and largest key (NULL when there is none)."""
    (name,) = require(df, [key])
    return df.agg(F.min(col(name)).alias("min_key"), F.max(col(name)).alias("max_key"))
