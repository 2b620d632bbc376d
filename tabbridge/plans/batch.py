"""The eight batch job modes as functions of named inputs and parameters."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame

from tabbridge.operators import counts, joins, tables
from tabbridge.sources.managed import write_table


def _query(p: dict[str, Any]) -> DataFrame:
    return tables.read_table(
        p["table"], p.get("columns", ()), p.get("filters", ()), p.get("sort", ())
    )


def _write(p: dict[str, Any]) -> DataFrame:
    write_table(p["data"], p["target"], key=p.get("key"))
    return p["data"].sparkSession.table(p["target"])


def _sort(p: dict[str, Any]) -> DataFrame:
    rows = tables.sort_table(p["data"], [p["order_by"]])
    return _stored(rows, p)


def _join(p: dict[str, Any]) -> DataFrame:
    return joins.join(p["data"], p["table"], p["on"], p.get("how", "inner"))


def _psi_join(p: dict[str, Any]) -> DataFrame:
    rows = joins.psi_join(p["table"], p["inputs"], p["on"], p.get("order_by"))
    return _stored(rows, p)


def _stored(rows: DataFrame, p: dict[str, Any]) -> DataFrame:
    """The rows, or with a target the table they were written to."""
    if not p.get("target"):
        return rows
    write_table(rows, p["target"], key=p.get("key"))
    return rows.sparkSession.table(p["target"])


MODES: dict[str, Callable[[dict[str, Any]], DataFrame]] = {
    "query": _query,
    "write": _write,
    "sort": _sort,
    "count": lambda p: counts.count_rows(p["table"], p.get("filters", ())),
    "groupby_count": lambda p: counts.groupby_count(p["table"], p["keys"], p.get("filters", ())),
    "join": _join,
    "add_hash_column": lambda p: joins.add_hash_column(
        p["table"], p["on"], p.get("columns", ())
    ),
    "psi_join": _psi_join,
}


def run(mode: str, **params: Any) -> DataFrame:
    """Run one batch mode; DataFrames are passed as parameters."""
    try:
        job = MODES[mode.strip().lower().removeprefix("operation_mode_")]
    except KeyError:
        raise ValueError(f"unknown batch mode: {mode}") from None
    return job(params)
