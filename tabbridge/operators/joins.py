"""Joins on shared key columns, hash keys and key intersections.

NULL keys never match anywhere in this module.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabbridge.functions.names import col, require
from tabbridge.functions.ordering import SortRule
from tabbridge.functions.text import hash_key
from tabbridge.operators.tables import project_by_name, sort_table

# Join type names; any other name means inner.
JOIN_TYPES = {
    "inner": "inner",
    "left": "left",
    "right": "right",
    "outer": "outer",
}

HOT_SHARE = 0.05
HOT_ROWS = 1_000_000  # a key with fewer rows fits a task, whatever its share
TRACKED_KEYS = 10_000

_HASH, _LEFT, _RIGHT = "__key_hash", "__left", "__right"


def join_type(name: str) -> str:
    return JOIN_TYPES.get(name.strip().lower().removeprefix("join_type_"), "inner")


def _key_hash(on: Sequence[str]) -> Column:
    return F.xxhash64(*[col(n) for n in on])


def _align_keys(
    left: DataFrame, right: DataFrame, on: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Both sides with keys of one type, so that every kind of join gives the same columns."""
    for name in on:
        a, b = left.schema[name].dataType, right.schema[name].dataType
        if a != b:
            either = F.coalesce(F.lit(None).cast(a), F.lit(None).cast(b)).alias("k")
            common = left.sparkSession.range(0).select(either).schema["k"].dataType
            left, right = (side.withColumn(name, col(name).cast(common)) for side in (left, right))
    return left, right


class HotKey(NamedTuple):
    key: tuple
    parts: int  # tasks its rows are dealt to


def hot_keys(
    df: DataFrame, on: Sequence[str], share: float = HOT_SHARE, rows: int = HOT_ROWS
) -> list[HotKey]:
    """Keys that hold about ``share`` of the rows at least, and ``rows`` of them.

    One pass over the key columns with a mergeable frequent-items sketch of their hashes, and
    one that gives the keys of these few hashes. Every key returned occurs in ``df``; a sketch
    error makes the list longer or shorter, which cannot change a join.
    """
    top = int(1 / share) + 1
    known = df.select([col(n) for n in on]).dropna()
    found = (
        known.select(_key_hash(on).alias(_HASH))
        .agg(
            F.expr(f"approx_top_k({_HASH}, {top}, {TRACKED_KEYS})").alias("top"),
            F.count(F.lit(1)).alias("n"),
        )
        .first()
    )
    least = max(rows, share * found["n"])
    parts = {t["item"]: -(-t["count"] // rows) + 1 for t in found["top"] or [] if t["count"] >= least}
    if not parts:
        return []
    keys = known.where(_key_hash(on).isin(list(parts))).withColumn(_HASH, _key_hash(on)).distinct().collect()
    return [HotKey(tuple(r[n] for n in on), parts[r[_HASH]]) for r in keys]


def _is_key(df: DataFrame, on: Sequence[str], key: tuple) -> Column:
    same = [col(n) == F.lit(v).cast(df.schema[n].dataType) for n, v in zip(on, key)]
    return reduce(lambda a, b: a & b, same)


def _parts(df: DataFrame, on: Sequence[str], hot: Sequence[HotKey]) -> Column:
    """Tasks that the rows of a row's key are dealt to: 1 unless it is hot."""
    out = F.lit(1)
    for h in hot:
        out = F.when(F.coalesce(_is_key(df, on, h.key), F.lit(False)), F.lit(h.parts)).otherwise(out)
    return out


def _salted(
    df: DataFrame, on: Sequence[str], own: Sequence[HotKey], other: Sequence[HotKey], names: tuple[str, str], spread: Column
) -> DataFrame:
    """Rows dealt to the parts of their own hot key, and a copy for each part of the other side's."""
    dealt = df.withColumn(names[0], F.pmod(spread, _parts(df, on, own)).cast("int"))
    if not other:
        return dealt.withColumn(names[1], F.lit(0))
    copies = F.sequence(F.lit(0), _parts(df, on, other) - 1)
    return dealt.select("*", F.explode(copies).alias(names[1]))


def join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    hot_share: float | None = HOT_SHARE,
    hot_rows: int = HOT_ROWS,
    *,
    from_scan: bool = False,
) -> DataFrame:
    """Join on equally named columns; each key column appears once, in the common type.

    Broadcast or sort-merge is left to the optimizer, which also splits the hot
    partitions of an inner join. An outer join cannot be split on its optional side. So keys
    with at least ``hot_share`` of a side's rows, and ``hot_rows`` of them, are looked up first,
    their rows are dealt to several parts, and the other side's few rows of such a key are
    copied to each part. All of it is one join, which reads each side once: a row meets
    every match in exactly one part, and a copy that meets none is dropped, since its key
    is known to be on the other side. ``hot_share=None`` skips the lookup.

    Rows are dealt by their content; ``from_scan=True`` states that both sides are file scans
    and row-wise steps, and deals them by number, which parts equal rows, too.
    """
    on, how = require(left, on), join_type(how)
    require(right, on)
    left, right = _align_keys(left, right, on)
    if how == "inner" or hot_share is None:
        return left.join(right, on, how)
    hot_left, hot_right = (hot_keys(side, on, hot_share, hot_rows) for side in (left, right))
    if not hot_left and not hot_right:
        return left.join(right, on, how)

    def spread(side: DataFrame) -> Column:
        return F.monotonically_increasing_id() if from_scan else F.xxhash64(*[col(c) for c in side.columns])

    salts = ["__i", "__j"]
    a = _salted(left, on, hot_left, hot_right, ("__i", "__j"), spread(left)).withColumn(_LEFT, F.lit(True))
    b = _salted(right, on, hot_right, hot_left, ("__j", "__i"), spread(right)).withColumn(_RIGHT, F.lit(True))
    both = a.join(b, [*on, *salts], how)
    # a row alone is a copy whose matches are in other parts, if its key is hot on the other side
    lone_left = col(_RIGHT).isNull() & (_parts(both, on, hot_right) > 1)
    lone_right = col(_LEFT).isNull() & (_parts(both, on, hot_left) > 1)
    return both.where(~(lone_left | lone_right)).drop(*salts, _LEFT, _RIGHT)


def add_hash_column(
    df: DataFrame, join_columns: Sequence[str], columns: Sequence[str] = (), name: str = "join_hash"
) -> DataFrame:
    """The chosen columns (all by default) plus the hash of the join columns."""
    kept = [col(n) for n in require(df, columns)] if columns else [col(n) for n in df.columns]
    return df.select(*kept, hash_key(df, join_columns).alias(name))


def distinct_keys(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """Distinct key tuples without NULLs; repeats are dropped before the shuffle."""
    keys = df.select([col(n) for n in require(df, on)])
    return keys.dropna().distinct()


def psi_join(
    table: DataFrame,
    inputs: Sequence[DataFrame],
    on: Sequence[str],
    order_by: SortRule | None = None,
    columns: Sequence[str] = (),
) -> DataFrame:
    """Rows of ``table`` whose key occurs in every input, optionally sorted.

    The inputs are reduced to distinct keys and intersected one after the other;
    all of these joins share one hash partitioning of the key.
    """
    on = require(table, on)
    rows = table
    if inputs:
        common = reduce(
            lambda a, b: a.join(distinct_keys(b, on), on, "left_semi"),
            inputs[1:],
            distinct_keys(inputs[0], on),
        )
        rows = table.join(common, on, "left_semi")
    rows = sort_table(rows, [order_by]) if order_by else rows
    return project_by_name(rows, columns)


def in_file_filter(df: DataFrame, column: str, keys: DataFrame, key_column: str) -> DataFrame:
    """Rows whose ``column`` value occurs in ``key_column`` of a data file."""
    (column,), (key_column,) = require(df, [column]), require(keys, [key_column])
    wanted = keys.select(col(key_column).alias(column))
    return df.join(distinct_keys(wanted, [column]), [column], "left_semi").select(
        [col(c) for c in df.columns]
    )
