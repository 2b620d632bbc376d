"""Column selection, casts, NULL rules and text forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabbridge.coverage.registry import load, query
from tabbridge.functions.coerce import clock_text, coerce_values, seconds_of_day, truncate_decimal
from tabbridge.functions.declared import cast_declared
from tabbridge.functions.text import (
    clean_text_columns,
    normalize_null,
    rows_as_text,
    stringify_table,
)
from tabbridge.operators.tables import (
    empty_result,
    project_by_name,
    select_columns,
    select_with_rowid,
)


@query("select_columns", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def select_source_order(spark, sf):
    return select_columns(
        load(spark, sf, "customer"), ["c_name", "c_mktsegment", "c_custkey", "c_name"]
    )


@query("select_with_rowid", "SELECT c_custkey, c_name, CAST(NULL AS BIGINT) AS rowid FROM customer")
def select_rowid(spark, sf):
    return select_with_rowid(load(spark, sf, "customer"), ["c_name", "ROWID", "c_custkey"])


@query("project_by_name", "SELECT c_mktsegment, c_acctbal, c_custkey FROM customer")
def project_request_order(spark, sf):
    return project_by_name(load(spark, sf, "customer"), ["c_mktsegment", "c_acctbal", "c_custkey"])


@query("empty_result", "SELECT s_suppkey, s_name FROM supplier WHERE 1 = 0")
def empty_supplier(spark, sf):
    schema = select_columns(load(spark, sf, "supplier"), ["s_suppkey", "s_name"]).schema
    return empty_result(spark, schema)


@query(
    "cast_declared",
    """
    SELECT CAST(event_id AS INTEGER) AS event_id,
           strftime(CAST(ts AS DATE), '%Y-%m-%d') AS ts,
           CAST(user_id AS VARCHAR) AS user_id,
           CAST(CAST(value AS DECIMAL(12, 4)) AS VARCHAR) AS value,
           event_type
    FROM events
    """,
)
def cast_events(spark, sf):
    typed = cast_declared(
        load(spark, sf, "events").drop("props"),
        {
            "event_id": "MEDIUMINT",
            "ts": "DATE",
            "user_id": "VARCHAR(20)",
            "value": "DECIMAL(12,4)",
        },
    )
    return typed.withColumns({"ts": F.col("ts").cast("string"), "value": F.col("value").cast("string")})


@query(
    "cast_declared_unsigned",
    """
    SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size,
           CAST(CAST(p_retailprice AS DECIMAL(38, 10)) AS VARCHAR) AS p_retailprice
    FROM part
    """,
)
def cast_parts(spark, sf):
    typed = cast_declared(
        project_by_name(load(spark, sf, "part"), ["p_partkey", "p_size", "p_retailprice"]),
        {"p_size": "INT UNSIGNED", "p_retailprice": "NUMERIC"},
        "kingbase",
    )
    return typed.withColumn("p_retailprice", F.col("p_retailprice").cast("string"))


def _parts_with_nulls(spark, sf):
    return load(spark, sf, "part").select(
        "p_partkey",
        F.nullif("p_brand", F.lit("Brand#2")).alias("p_brand"),
        F.nullif("p_size", F.lit(11)).alias("p_size"),
        F.nullif("p_retailprice", F.lit(900.0)).alias("p_retailprice"),
    )


@query(
    "coerce_legacy_nulls",
    """
    SELECT p_partkey,
           coalesce(nullif(p_brand, 'Brand#2'), ' ') AS p_brand,
           coalesce(nullif(p_size, 11), 0) AS p_size,
           coalesce(nullif(p_retailprice, 900.0), 0.0) AS p_retailprice
    FROM part
    """,
)
def coerce_legacy(spark, sf):
    return coerce_values(_parts_with_nulls(spark, sf), "legacy")


@query(
    "coerce_csv_nulls",
    """
    SELECT p_partkey,
           coalesce(nullif(p_brand, 'Brand#2'), '') AS p_brand,
           nullif(p_size, 11) AS p_size,
           nullif(p_retailprice, 900.0) AS p_retailprice
    FROM part
    """,
)
def coerce_csv(spark, sf):
    return coerce_values(_parts_with_nulls(spark, sf), "csv")


@query(
    "coerce_date_text",
    """
    SELECT event_id,
           strftime(date_trunc('day', ts), '%Y-%m-%d') AS day,
           CASE WHEN strftime(ts, '%H:%M:%S') = '00:00:00' THEN strftime(ts, '%Y-%m-%d')
                ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS ts
    FROM events
    """,
)
def coerce_dates(spark, sf):
    events = load(spark, sf, "events")
    return coerce_values(
        events.select(
            "event_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "ts"
        ),
        "legacy",
    )


@query(
    "truncate_decimal",
    """
    SELECT o_orderkey,
           concat(o_orderkey - 700, '.',
                  substr(lpad(CAST(o_custkey * 7919 % 1000000 AS VARCHAR), 6, '0'), 1, 2)) AS amount
    FROM orders
    """,
)
def truncate_amounts(spark, sf):
    text = F.concat(
        (F.col("o_orderkey") - 700).cast("string"),
        F.lit("."),
        F.lpad((F.col("o_custkey") * 7919 % 1000000).cast("string"), 6, "0"),
    )
    cut = truncate_decimal(text.cast("decimal(20,6)"), 18, 2)
    return load(spark, sf, "orders").select("o_orderkey", cut.cast("string").alias("amount"))


@query(
    "truncate_wide_decimal",
    """
    SELECT o_orderkey,
           concat('12345678901234567890123', lpad(CAST(o_custkey AS VARCHAR), 7, '0'), '.',
                  substr(lpad(CAST(o_custkey * 7919 % 1000000 AS VARCHAR), 6, '0'), 1, 2)) AS amount
    FROM orders
    """,
)
def truncate_wide_amounts(spark, sf):
    """30 integer digits and six decimals, cut to two."""
    text = F.concat(
        F.lit("12345678901234567890123"),
        F.lpad(F.col("o_custkey").cast("string"), 7, "0"),
        F.lit("."),
        F.lpad((F.col("o_custkey") * 7919 % 1000000).cast("string"), 6, "0"),
    )
    cut = truncate_decimal(text.cast("decimal(38,6)"), 38, 2)
    return load(spark, sf, "orders").select("o_orderkey", cut.cast("string").alias("amount"))


@query(
    "clean_line_breaks",
    """
    SELECT doc_id, regexp_replace(text, '\\r\\n?|\\n', '', 'g') AS text,
           lang, source, n_chars
    FROM documents
    """,
)
def clean_documents(spark, sf):
    return clean_text_columns(load(spark, sf, "documents"))




@query(
    "normalize_nulls",
    """
    SELECT doc_id,
           CASE doc_id % 6 WHEN 3 THEN '  ' || lang WHEN 5 THEN lang ELSE '' END AS lang
    FROM documents
    """,
)
def normalize_documents(spark, sf):
    token = (
        F.when(F.col("doc_id") % 6 == 0, "\\N")
        .when(F.col("doc_id") % 6 == 1, "\\\\N")
        .when(F.col("doc_id") % 6 == 2, " null ")
        .when(F.col("doc_id") % 6 == 3, F.concat(F.lit("  "), "lang"))
        .when(F.col("doc_id") % 6 == 4, "Null")
        .otherwise(F.col("lang"))
    )
    return load(spark, sf, "documents").select("doc_id", normalize_null(token).alias("lang"))


@query(
    "stringify",
    """
    SELECT CAST(p_partkey AS VARCHAR) AS p_partkey,
           coalesce(nullif(p_brand, 'Brand#2'), '') AS p_brand,
           coalesce(CAST(nullif(p_size, 11) AS VARCHAR), '') AS p_size,
           coalesce(printf('%.6f', nullif(p_retailprice, 900.0)), '') AS p_retailprice
    FROM part
    """,
)
def stringify_parts(spark, sf):
    return stringify_table(_parts_with_nulls(spark, sf))


@query(
    "stringify_times",
    """
    SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(epoch_us(ts) AS VARCHAR) AS ts
    FROM events
    """,
)
def stringify_times(spark, sf):
    return stringify_table(load(spark, sf, "events").select("event_id", "ts"))


@query(
    "rows_as_text",
    """
    SELECT CAST(p_partkey AS VARCHAR) AS p_partkey,
           coalesce(nullif(p_brand, 'Brand#2'), '') AS p_brand,
           coalesce(CAST(nullif(p_size, 11) AS VARCHAR), '') AS p_size
    FROM part
    """,
)
def parts_as_text(spark, sf):
    return rows_as_text(_parts_with_nulls(spark, sf).drop("p_retailprice"))


@query(
    "coerce_time_of_day",
    """
    SELECT event_id, user_id, value, props, event_type,
           CASE WHEN event_type = 'error' THEN NULL
                ELSE CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS INTEGER) END AS seconds,
           CASE WHEN event_type = 'error' THEN 0
                ELSE CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS INTEGER) END AS legacy_seconds,
           CASE WHEN event_type = 'error' THEN NULL ELSE strftime(ts, '%H:%M:%S') END AS clock
    FROM events
    """,
)
def time_of_day(spark, sf):
    """Clock text to seconds and back; text that is no time gives NULL, or midnight."""
    text = F.when(F.col("event_type") == "error", "half past nine").otherwise(F.date_format("ts", "HH:mm:ss"))
    events = load(spark, sf, "events").withColumn("text", text)
    seconds = seconds_of_day(F.col("text"))
    return events.select(
        "event_id", "user_id", "value", "props", "event_type",
        seconds.alias("seconds"),
        seconds_of_day(F.col("text"), "legacy").alias("legacy_seconds"),
        clock_text(seconds).alias("clock"),
    )
