"""Managed tables: names, create-or-append, surrogate keys, result tables, rewrites."""

from __future__ import annotations

import datetime as dt
import decimal
import re
import uuid
from collections.abc import Iterable, Mapping, Sequence
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tabbridge.functions.declared import require_flat
from tabbridge.functions.names import col, require
from tabbridge.functions.predicates import Filter, literal, predicate
from tabbridge.operators.positions import numbered, numbered_scan
from tabbridge.operators.stats import observed, observed_rows
from tabbridge.session import discard, forget_tables, isolated
from tabbridge.sources.files import CSV_NULL

KEY_NAME = re.compile(r"^(pk|PK)_[0-9a-f]{5,10}$")
MAX_NAME_BYTES = 64
RESULT_KEY = "_auto_id"
KEY_KIND = "tabbridge.key"  # table property
_AS = re.compile(r"\sas\s", re.IGNORECASE)


def table_name(table: str, job: str | None = None) -> str:
    """Intermediate tables carry the job id as prefix."""
    return f"{job}_{table}" if job else table


def ensure_database(spark: SparkSession, database: str, location: str | None = None) -> None:
    place = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`{place}")


def _existing_key(spark: SparkSession, table: str) -> str | None:
    if not spark.catalog.tableExists(table):
        return None
    names = [c for c in spark.table(table).columns if KEY_NAME.match(c) or c == RESULT_KEY]
    return names[0] if names else None


def write_table(
    df: DataFrame,
    table: str,
    key: str | None = None,
    key_name: str | None = None,
    partition_by: Sequence[str] = (),
    partitions: int | None = None,
) -> int:
    """Create the table from the schema when it is missing, then append; returns the rows written.

    ``key="dense"`` adds a surrogate key without gaps: rows of a plain Parquet scan are numbered
    by their place in the files, others are staged once. ``key="unique"`` adds a unique one in
    a single pass. An existing table keeps its key column and its kind of key, and
    continues after its largest key. ``partitions`` spreads the write over
    that many tasks (``tier_partitions`` picks a number by table size).
    """
    if key not in (None, "dense", "unique"):
        raise ValueError("key must be None, 'dense' or 'unique'")
    require_flat(df.schema)
    spark = df.sparkSession
    if key is None:
        return _append(df, table, partition_by, partitions)
    known = _existing_key(spark, table)
    kind = _key_kind(spark, table) if known else None
    if kind not in (None, key):
        raise ValueError(f"{table} has a {kind} key, not a {key} one")
    name = known or key_name or f"pk_{uuid.uuid4().hex[:5]}"
    top = spark.table(table).agg(F.max(col(name))).first()[0] if known else None
    start = (top or 0) + 1
    key_first = [col(name), *[col(c) for c in df.columns]]
    written = _append_keyed(df, table, key, name, start, key_first, partition_by, partitions)
    if kind is None:
        spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{KEY_KIND}' = '{key}')")
    return written


def _append_keyed(
    df: DataFrame,
    table: str,
    key: str,
    name: str,
    start: int,
    key_first: list[Column],
    partition_by: Sequence[str],
    partitions: int | None,
) -> int:
    if key == "unique":
        keyed = df.withColumn(name, F.monotonically_increasing_id() + F.lit(start))
        return _append(keyed.select(key_first), table, partition_by, partitions)
    placed = numbered_scan(df, name, start)
    if placed is not None:
        return _append(placed.select(key_first), table, partition_by, partitions)
    with numbered(df, name, start) as keyed:
        return _append(keyed.select(key_first), table, partition_by, partitions)


def _key_kind(spark: SparkSession, table: str) -> str | None:
    """Kind of the table's surrogate key, as noted when it was made."""
    told = spark.sql(f"SHOW TBLPROPERTIES {table}").where(F.col("key") == KEY_KIND).first()
    return told["value"] if told else None


def _append(
    df: DataFrame, table: str, partition_by: Sequence[str], partitions: int | None
) -> int:
    spark = df.sparkSession
    exists = spark.catalog.tableExists(table)
    if exists:
        target = spark.table(table).columns
        require(df, target)
        df = df.select([col(c) for c in target])
    if partitions:
        df = df.repartition(partitions)
    counted, watch = observed(df)
    if exists:
        counted.write.insertInto(table)
    else:
        writer = counted.write.format("parquet")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.saveAsTable(table)
    return observed_rows(watch)


def truncate_table(spark: SparkSession, table: str) -> bool:
    """Empty a table; True also when it does not exist."""
    if spark.catalog.tableExists(table):
        spark.sql(f"TRUNCATE TABLE {table}")
    return True


def result_column_names(header: Sequence[str]) -> list[str]:
    """Clean result headers: the text after the last `` as ``, or ``field<i>`` when too long."""
    names = []
    for i, title in enumerate(header):
        name = _AS.split(title)[-1].strip()
        names.append(name if len(name.encode()) <= MAX_NAME_BYTES else f"field{i}")
    return names


def write_result_table(
    spark: SparkSession, path: str, table: str, multiline: bool = True
) -> int:
    """Headered CSV result files to an all-text table with an ``_auto_id`` key."""
    result = (
        spark.read.option("header", True)
        .option("inferSchema", False)
        .option("multiLine", multiline)
        .option("nullValue", CSV_NULL)
        .option("escape", '"')
        .csv(path)
    )
    if not result.columns:
        raise ValueError("result has no header")
    named = result.toDF(*result_column_names(result.columns))
    return write_table(named, table, key="dense", key_name=RESULT_KEY)


def _all_of(filters: Iterable[Filter | Sequence[Any]]) -> Column:
    held = F.lit(True)
    for f in filters:
        held = held & predicate(f)
    return held


class _Spec(NamedTuple):
    location: str
    partitions: list[str]


def _spec(spark: SparkSession, table: str) -> _Spec:
    told = [r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect() if r["col_name"] == "Location"]
    if not told:
        raise ValueError(f"{table} is not a table with files of its own")
    # a column may have this name, too: the table's own entry comes last
    return _Spec(told[-1], [c.name for c in spark.catalog.listColumns(table) if c.isPartition])


def _relocate(rows: DataFrame, table: str, location: str) -> None:
    """Write new content beside the table's files, then point the table at it.

    The table itself, its columns, comments and properties, stays what it is, and its old
    files are removed last.
    """
    spark, tag = rows.sparkSession, uuid.uuid4().hex[:8]
    fresh = f"{re.sub('__[0-9a-f]{8}$', '', location.rstrip('/'))}__{tag}"
    beside = f"{table.rstrip('`')}__{tag}" + ("`" if table.endswith("`") else "")
    spark.sql(f"CREATE TABLE {beside} LIKE {table} LOCATION '{fresh}'")
    left = fresh
    try:
        rows.write.insertInto(beside)
        spark.sql(f"ALTER TABLE {table} SET LOCATION '{fresh}'")
        left = location
    finally:
        spark.sql(f"DROP TABLE {beside}")
        discard(spark, left)
        spark.catalog.refreshTable(table)


def sql_literal(value: Any) -> str:
    """A value as SQL text."""
    if value is None or isinstance(value, bool):
        return {None: "NULL", True: "TRUE", False: "FALSE"}[value]
    if isinstance(value, dt.datetime):
        kind = "TIMESTAMP_NTZ" if value.tzinfo is None else "TIMESTAMP"
        return f"{kind} '{value.isoformat(sep=' ')}'"
    if isinstance(value, dt.date):
        return f"DATE '{value.isoformat()}'"
    if isinstance(value, (bytes, bytearray)):
        return f"X'{bytes(value).hex()}'"
    if isinstance(value, float):
        return f"CAST('{value!r}' AS DOUBLE)"
    if isinstance(value, decimal.Decimal):
        return f"{value:f}BD"
    if isinstance(value, int):
        return str(value)
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


def _partition_clause(values: Row) -> str:
    return ", ".join(f"`{name}` = {sql_literal(value)}" for name, value in values.asDict().items())


def _inside(names: Sequence[str], found: Sequence[Row]) -> Column:
    """Partitions that hold all of ``found``, named one column at a time so that the scan is pruned."""
    held = F.lit(True)
    for name in names:
        values = {r[name] for r in found}
        known = [v for v in values if v is not None]
        same = col(name).isin(known) if known else F.lit(False)
        held = held & (same | col(name).isNull() if None in values else same)
    return held


def _changed(df: DataFrame, held: Column, changes: Mapping[str, Column]) -> DataFrame:
    kept = {f.name: col(f.name) for f in df.schema.fields}
    for f in df.schema.fields:
        if f.name in changes:
            kept[f.name] = F.when(held, changes[f.name].cast(f.dataType)).otherwise(col(f.name)).alias(f.name)
    return df.select(list(kept.values()))


def _read(spark: SparkSession, table: str, alias: str | None) -> DataFrame:
    rows = spark.table(table)
    return rows.alias(alias) if alias else rows


def _rewrite_partitions(
    spark: SparkSession,
    table: str,
    alias: str | None,
    names: list[str],
    held: Column,
    changes: Mapping[str, Column] | None,
) -> int:
    """Rewrite just the partitions that hold chosen rows; others are neither read whole nor written.

    Partitions of which nothing is left are dropped by their metadata.
    """
    own, keys = isolated(spark), [col(n) for n in names]
    own.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    current = _read(own, table, alias)
    hit = current.where(held).groupBy(*keys).agg(F.count(F.lit(1)).alias("__hit")).collect()
    if not hit:
        return 0
    count = sum(r["__hit"] for r in hit)
    touched = [Row(**{n: r[n] for n in names}) for r in hit]
    if changes is None:
        sizes = current.where(_inside(names, touched)).groupBy(*keys).agg(F.count(F.lit(1)).alias("__all")).collect()
        total = {tuple(r[n] for n in names): r["__all"] for r in sizes}
        gone = [p for p, r in zip(touched, hit) if total[tuple(p)] == r["__hit"]]
        kept = [p for p in touched if p not in gone]
        rows = current.where(_inside(names, kept)).where(~held) if kept else None
    else:
        moved = [n for n in names if n in changes]
        if moved:  # the rows of the partitions they go to are written, too
            there = _changed(current.where(held), F.lit(True), {n: changes[n] for n in moved}).select(*keys).distinct()
            touched += [Row(**r.asDict()) for r in there.collect()]
        rows = _changed(current.where(_inside(names, touched)), held, changes)
        left = {tuple(r) for r in rows.select(*keys).distinct().collect()} if moved else set()
        gone = [p for p in dict.fromkeys(touched) if moved and tuple(p) not in left]
    if rows is not None:
        rows.write.insertInto(table, overwrite=True)
    for p in gone:
        own.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({_partition_clause(p)})")
    forget_tables(spark)
    return count


def rewrite_where(
    spark: SparkSession,
    table: str,
    condition: Column,
    changes: Mapping[str, Column] | None = None,
    alias: str | None = None,
) -> int:
    """Delete the rows ``condition`` holds for, or change columns of them; returns how many.

    The table keeps its partitions, properties and comments. Of a partitioned table only the
    partitions that hold such rows are written anew, or dropped when none is left. The
    condition and the changes may name columns by an ``alias`` of the table.
    """
    spec, current = _spec(spark, table), _read(spark, table, alias)
    require(current, changes or {})
    held = F.coalesce(condition, F.lit(False))
    if spec.partitions:
        return _rewrite_partitions(spark, table, alias, spec.partitions, held, changes)
    # counted first, over the columns of the condition: without a hit nothing is rewritten
    count = current.where(held).count()
    if count:
        _relocate(current.where(~held) if changes is None else _changed(current, held, changes), table, spec.location)
    return count


def delete_where(
    spark: SparkSession, table: str, filters: Iterable[Filter | Sequence[Any]]
) -> int:
    """Delete the rows all filters hold for; returns how many (see ``rewrite_where``)."""
    return rewrite_where(spark, table, _all_of(filters))


def update_where(
    spark: SparkSession,
    table: str,
    values: Mapping[str, Any],
    filters: Iterable[Filter | Sequence[Any]],
) -> int:
    """Set columns in the rows all filters hold for; returns how many (see ``rewrite_where``)."""
    if not values:
        raise ValueError("nothing to set")
    return rewrite_where(spark, table, _all_of(filters), {n: literal(v) for n, v in values.items()})

