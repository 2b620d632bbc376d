"""Filters: (field, operator, value) triples, combined with AND.

Values are ordinary Python values; ``None`` means "not given", so ``0``, ``''``
and ``False`` are usable filter values. Literals reach the plan through
``F.lit``, hence no quoting and full pushdown to the scan.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Sequence
from functools import reduce
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabbridge.functions.names import bare, col, require


class Filter(NamedTuple):
    field: str
    op: str
    value: Any


# Operator spellings of the request format.
COMPARISONS: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    ">": lambda c, v: c > v,
    "<": lambda c, v: c < v,
    ">=": lambda c, v: c >= v,
    "<=": lambda c, v: c <= v,
}
OPERATOR_NAMES = {
    "EQUAL": "=",
    "NOT_EQUAL": "!=",
    "<>": "!=",
    "GREATER_THAN": ">",
    "LESS_THAN": "<",
    "GREATER_THAN_OR_EQUAL": ">=",
    "LESS_THAN_OR_EQUAL": "<=",
    "LIKE_OPERATOR": "LIKE",
    "IN_OPERATOR": "IN",
}


def operator(op: str) -> str:
    """Canonical spelling; an unknown operator is an error."""
    name = op.strip().upper()
    name = OPERATOR_NAMES.get(name, name)
    if name not in COMPARISONS and name not in ("LIKE", "IN"):
        raise ValueError(f"unknown filter operator '{op}'")
    return name


def given_values(
    str_value: str | None = None,
    int_value: int | None = None,
    float_value: float | None = None,
    bool_value: bool | None = None,
    str_values: Sequence[str] = (),
    int_values: Sequence[int] = (),
    float_values: Sequence[float] = (),
    bool_values: Sequence[bool] = (),
) -> list[Any]:
    """Flatten a multi-kind filter value: scalars first, then the lists, by kind."""
    scalars = [v for v in (str_value, int_value, float_value, bool_value) if v is not None]
    return [*scalars, *str_values, *int_values, *float_values, *bool_values]


def literal(value: Any) -> Column:
    """Constant column. A datetime without zone is wall-clock time, whatever the session zone."""
    if isinstance(value, dt.datetime) and value.tzinfo is None:
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(value)


def _values(flt: Filter) -> list[Any]:
    value = flt.value
    values = list(value) if isinstance(value, (list, tuple, set, frozenset)) else [value]
    values = [v for v in values if v is not None]
    if not values:
        raise ValueError(f"no value given for filter '{flt.field}'")
    return values


def predicate(flt: Filter | Sequence[Any], text_like: bool = True) -> Column:
    """One filter as a Column. IN takes any number of values, every other operator one."""
    flt = Filter(*flt)
    values, op, field = _values(flt), operator(flt.op), col(flt.field)
    if op == "IN":
        return field.isin([literal(v) for v in values])
    if len(values) > 1:
        raise ValueError(f"filter '{flt.field}' {op} takes one value, not {len(values)}")
    if op == "LIKE":
        return (field if text_like else field.cast("string")).like(str(values[0]))
    return COMPARISONS[op](field, literal(values[0]))


def filters_from_lists(
    names: Sequence[str], operators: Sequence[str], values: Sequence[Any]
) -> list[Filter]:
    """Three parallel lists to filters. No filtering when any of them is empty."""
    if not names or not operators or not values:
        return []
    if not len(names) == len(operators) == len(values):
        raise ValueError(
            "filter names, operators and values must have the same length: "
            f"{len(names)}, {len(operators)}, {len(values)}"
        )
    return [Filter(*triple) for triple in zip(names, operators, values)]


def where(df: DataFrame, filters: Iterable[Filter | Sequence[Any]] = ()) -> DataFrame:
    """Rows for which all filters hold."""
    filters = [Filter(*f) for f in filters]
    require(df, [f.field for f in filters])
    if not filters:
        return df
    terms = [
        predicate(f, text_like=isinstance(df.schema[bare(f.field)].dataType, T.StringType))
        for f in filters
    ]
    return df.where(reduce(lambda a, b: a & b, terms))
