"""Sort rules and a global order that survives hot keys."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabbridge.functions.names import bare, col, require

TIE = "__tie"

SortRule = str | tuple[str, str]


def parse_rules(rules: Iterable[SortRule]) -> list[tuple[str, bool]]:
    """(field, ascending) pairs from ``"field"`` or ``("field", "ASC" | "DESC")``."""
    out = []
    for rule in rules:
        field, direction = (rule, "ASC") if isinstance(rule, str) else rule
        out.append((bare(field), direction.strip().upper() != "DESC"))
    return out


def order_columns(df: DataFrame, rules: Iterable[SortRule]) -> list[Column]:
    """Sort columns; NULLs come first ascending and last descending."""
    parsed = parse_rules(rules)
    require(df, [f for f, _ in parsed])
    return [
        col(f).asc_nulls_first() if ascending else col(f).desc_nulls_last()
        for f, ascending in parsed
    ]


def with_tie(df: DataFrame, from_scan: bool) -> DataFrame:
    """Number the rows so that a range partitioner can cut a run of equal sort keys.

    Without it all rows of one hot key (or all copies of one row) land in one task.
    The number has to come out the same when a lost task is run again. A file scan
    guarantees that; behind a shuffle the arrival order varies, so there the rows of
    each partition are sorted first and the number depends on their content only.
    """
    if not from_scan:
        columns = [col(c) for c in df.columns]
        df = df.sortWithinPartitions(F.xxhash64(*columns), *columns)
    return df.withColumn(TIE, F.monotonically_increasing_id())


def range_partition(
    df: DataFrame, order: Sequence[Column], parts: int | None = None
) -> DataFrame:
    """Range-partition and sort each partition; AQE picks the width unless ``parts`` is given."""
    ranged = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    return ranged.sortWithinPartitions(*order)
