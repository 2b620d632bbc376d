"""Table facts, sizes and row accounting."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabbridge.coverage.registry import load, query
from tabbridge.functions.names import col
from tabbridge.operators.stats import (
    estimate_size,
    observed,
    observed_rows,
    reconcile_counts,
    table_info,
    validate_row_count,
)
from tabbridge.session import workspace

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]
TIERS = (1000, 10_000, 50_000)


def _info_sql(table: str) -> str:
    return f"""
    SELECT '{table}' AS table_name, (SELECT count(*) FROM {table}) AS record_count,
           CAST(0 AS BIGINT) AS record_size, CAST(count(*) AS INTEGER) AS column_count,
           string_agg(column_name, ',' ORDER BY column_index) AS columns
    FROM duckdb_columns() WHERE table_name = '{table}'
    """


@query(
    "table_info",
    f"""
    SELECT *, CASE WHEN record_count <= {TIERS[0]} THEN 'small'
                   WHEN record_count <= {TIERS[1]} THEN 'medium'
                   WHEN record_count <= {TIERS[2]} THEN 'large' ELSE 'xlarge' END AS size_tier
    FROM ({" UNION ALL ".join(_info_sql(t) for t in TABLES)})
    """,
)
def all_tables(spark, sf):
    return table_info({t: load(spark, sf, t) for t in TABLES}, tiers=TIERS)


# DuckDB widths of a row, by the fixed widths of the types
WIDTHS = {
    "region": "4 + strlen(r_name)",
    "nation": "4 + strlen(n_name) + 4",
    "customer": "8 + strlen(c_name) + 4 + 8 + strlen(c_mktsegment)",
    "supplier": "8 + strlen(s_name) + 4 + 8",
    "part": "8 + strlen(p_name) + strlen(p_brand) + strlen(p_type) + 4 + 8",
    "orders": "8 + 8 + strlen(o_orderstatus) + 8 + 20 + strlen(o_orderpriority)",
    "lineitem": "8 * 3 + 4 + 8 * 4 + strlen(l_returnflag) + strlen(l_linestatus) + 20",
    "events": "8 + 20 + 8 + strlen(event_type) + 8 + strlen(props)",
    "documents": "8 + coalesce(strlen(text), 0) + coalesce(strlen(lang), 0) + coalesce(strlen(source), 0) + 8",
    "embeddings": "8 + coalesce(4 * len(embedding), 0) + 4",
    "pages": "8 + coalesce(strlen(url), 0) + coalesce(strlen(html), 0)",
    "benchmark": "8 + coalesce(strlen(text), 0)",
    "labels": "8 + 4 + 4",
    "conversations": "8 + 8 + coalesce(strlen(role), 0) + coalesce(strlen(text), 0)",
}


@query(
    "table_info_estimated",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS record_count, "
        f"CAST(sum({width}) // count(*) * count(*) AS BIGINT) AS record_size FROM {t}"
        for t, width in WIDTHS.items()
    ),
)
def estimated_tables(spark, sf):
    info = table_info({t: load(spark, sf, t) for t in TABLES}, exact=False, measure="rows")
    return info.select("table_name", "record_count", "record_size")


# columns of fixed width: footers tell their bytes exactly
FIXED = {
    "lineitem": ("l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate", "8 * 3 + 4 + 8 * 4 + 20"),
    "orders": ("o_orderkey, o_custkey, o_totalprice, o_orderdate", "8 * 3 + 20"),
    "events": ("event_id, ts, user_id, value", "8 * 3 + 20"),
    "labels": ("doc_id, quality, toxic", "8 + 4 + 4"),
    "documents": ("doc_id, n_chars", "16"),
}


@query(
    "table_info_footers",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS record_count, CAST({f'count(*) * ({FIXED[t][1]})' if t in FIXED else 'NULL'} AS BIGINT) AS fixed_bytes, "
        f"true AS near FROM {t}"
        for t in WIDTHS
    ),
)
def footer_tables(spark, sf):
    """Rows of all tables, bytes of fixed columns to the byte, and those of all columns nearly: from footers alone."""
    frames = {t: load(spark, sf, t) for t in TABLES}
    told = table_info(frames, exact=False).select("table_name", "record_count", "record_size")
    measured = table_info(frames, exact=False, measure="rows").select("table_name", F.col("record_size").alias("all_bytes"))
    fixed = table_info({t: frames[t].select(*[c.strip() for c in names.split(",")]) for t, (names, _) in FIXED.items()}, exact=False)
    # encoded texts are never much more than the texts, and less where values repeat
    near = F.col("record_size").between(F.col("all_bytes") * 0.02, F.col("all_bytes") * 1.2 + 2000)
    return (
        told.join(measured, "table_name")
        .join(fixed.select("table_name", F.col("record_size").alias("fixed_bytes")), "table_name", "left")
        .select("table_name", "record_count", "fixed_bytes", near.alias("near"))
    )


def _size_sql(table: str, width: str) -> str:
    return f"""
    SELECT '{table}' AS table_name, count(*) AS rows,
           CAST(sum({width}) // count(*) AS BIGINT) AS avg_row_bytes,
           CAST(floor(CAST(sum({width}) // count(*) AS BIGINT) * count(*) * 1.5) AS BIGINT)
               AS table_bytes
    FROM {table}
    """


@query(
    "estimate_size",
    " UNION ALL ".join(
        [
            _size_sql("customer", "8 + strlen(c_name) + 4 + 8 + strlen(c_mktsegment)"),
            _size_sql("documents", "8 + strlen(text) + strlen(lang) + strlen(source) + 8"),
            _size_sql("orders", "8 + 8 + strlen(o_orderstatus) + 8 + 20 + strlen(o_orderpriority)"),
            _size_sql("events", "8 + 20 + 8 + strlen(event_type) + 8 + strlen(props)"),
        ]
    ),
)
def full_sizes(spark, sf):
    """The full-table variant: every row is measured."""
    sizes = [
        estimate_size(load(spark, sf, t), 1.5).select(F.lit(t).alias("table_name"), "*")
        for t in ("customer", "documents", "orders", "events")
    ]
    first, *others = sizes
    for other in others:
        first = first.unionByName(other)
    return first


@query(
    "estimate_size_of_nulls",
    """
    SELECT count(*) AS rows,
           CAST(sum(8 + coalesce(strlen(nullif(p_brand, 'Brand#2')), 0)
                + CASE WHEN p_size = 11 THEN 0 ELSE 4 END) // count(*) AS BIGINT) AS avg_row_bytes
    FROM part
    """,
)
def null_sizes(spark, sf):
    parts = load(spark, sf, "part").select(
        "p_partkey",
        F.nullif("p_brand", F.lit("Brand#2")).alias("p_brand"),
        F.nullif("p_size", F.lit(11)).alias("p_size"),
    )
    return estimate_size(parts).select("rows", "avg_row_bytes")


@query(
    "reconcile_counts",
    """
    SELECT 'lineitem' AS table_name, count(*) AS expected, count(*) AS delivered, true AS matched
    FROM lineitem
    """,
)
def reconcile_lineitem(spark, sf):
    """A copy whose rows are counted while they are written."""
    lineitem = load(spark, sf, "lineitem")
    counted, watch = observed(lineitem)
    counted.write.parquet(workspace(spark, "copy"))
    delivered = reconcile_counts("lineitem", lineitem.count(), observed_rows(watch))
    return lineitem.agg(F.count(F.lit(1)).alias("expected")).select(
        F.lit("lineitem").alias("table_name"),
        "expected",
        F.lit(delivered).cast("long").alias("delivered"),
        (col("expected") == F.lit(delivered)).alias("matched"),
    )


@query(
    "validate_row_count",
    """
    WITH c AS (SELECT o_orderpriority AS operation, count(*) AS expected,
                      count(*) FILTER (o_orderstatus <> 'P') AS actual
               FROM orders GROUP BY o_orderpriority)
    SELECT operation, expected, actual, actual - expected AS diff,
           round((actual - expected)::DOUBLE / expected::DOUBLE * 100, 6) AS diff_percent,
           abs((actual - expected)::DOUBLE / expected::DOUBLE * 100) <= 33.0 AS passed
    FROM c
    """,
)
def validate_counts(spark, sf):
    counts = (
        load(spark, sf, "orders")
        .groupBy(col("o_orderpriority").alias("operation"))
        .agg(
            F.count(F.lit(1)).alias("expected"),
            F.count_if(col("o_orderstatus") != "P").alias("actual"),
        )
    )
    checked = validate_row_count(counts, tolerance=33.0)
    return checked.withColumn("diff_percent", F.round("diff_percent", 6))
