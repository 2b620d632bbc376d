"""Where the registered queries and their SQL are collected."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabbridge.session import workspace
from tabbridge.sources.managed import ensure_database

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without SQL only its rows are checked."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def scratch_database(spark: SparkSession, tag: str) -> str:
    """A database of its own, stored in the shared folder."""
    name = f"{tag}_{uuid.uuid4().hex[:12]}"
    ensure_database(spark, name, workspace(spark, tag))
    return name
