"""Expiry of what is named by date, and the retry list of a task ledger."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabbridge.functions.predicates import literal
from tabbridge.operators.positions import Page, page

DATE_PREFIX = "20"  # names of this century only
DATE_DIGITS = 8
RETRY_QUIET = dt.timedelta(minutes=2)


def cutoff(days: int, today: dt.date | None = None) -> str:
    """First day to keep, as yyyymmdd."""
    return ((today or dt.date.today()) - dt.timedelta(days=days)).strftime("%Y%m%d")


def is_expired(name: str, first_kept: str) -> bool:
    return (
        name.startswith(DATE_PREFIX)
        and len(name) >= DATE_DIGITS
        and name[:DATE_DIGITS] < first_kept
    )


def expire_partitions(spark: SparkSession, table: str, column: str, first_kept: str) -> list[str]:
    """Drop the partitions whose name starts with a date before ``first_kept``.

    Works on partition metadata: no kept row is read or rewritten.
    """
    names = sorted(
        {
            part.split("=", 1)[1]
            for row in spark.sql(f"SHOW PARTITIONS {table}").collect()
            for part in row[0].split("/")
            if part.split("=", 1)[0] == column
        }
    )
    expired = [n for n in names if is_expired(n, first_kept)]
    if expired:
        specs = ", ".join(f"PARTITION (`{column}` = '{n}')" for n in expired)
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {specs}")
    return expired


def expire_tables(spark: SparkSession, database: str, first_kept: str) -> list[str]:
    """Drop the tables of a database whose name starts with a date before ``first_kept``."""
    names = [r["tableName"] for r in spark.sql(f"SHOW TABLES IN `{database}`").collect()]
    expired = sorted(n for n in names if is_expired(n, first_kept))
    for name in expired:
        spark.sql(f"DROP TABLE IF EXISTS `{database}`.`{name}`")
    return expired


def drop_tables_with_prefix(spark: SparkSession, database: str, prefix: str) -> list[str]:
    """Drop all tables of a database whose name starts with ``prefix``."""
    names = [r["tableName"] for r in spark.sql(f"SHOW TABLES IN `{database}`").collect()]
    dropped = sorted(n for n in names if prefix and n.startswith(prefix))
    for name in dropped:
        spark.sql(f"DROP TABLE IF EXISTS `{database}`.`{name}`")
    return dropped


def retry_candidates(
    ledger: DataFrame, now: dt.datetime, number: int = 1, size: int = 10
) -> Page:
    """Page of tasks to run again: tried before, failed or pending, quiet for two minutes.

    The ledger has retry_count, status and updated_at; the oldest update comes first.
    """
    due = ledger.where(
        (F.col("retry_count") > 0)
        & F.col("status").isin("failed", "pending")
        & (F.col("updated_at") < literal(now - RETRY_QUIET))
    )
    return page(due, ["updated_at"], number, size)
