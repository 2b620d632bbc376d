"""Registered queries: every operator on the given tables, with the equivalent SQL."""

from tabbridge.coverage import (  # noqa: F401
    columns,
    exchange,
    joins,
    loads,
    positions,
    reads,
    reshaping,
    sqltext,
    statistics,
)
from tabbridge.coverage.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
