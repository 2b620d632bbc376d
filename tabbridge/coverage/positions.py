"""Row numbers, pages and chunks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tabbridge.coverage.registry import load, query
from tabbridge.operators.positions import (
    chunk_manifest,
    number_rows,
    order_table,
    ordered,
    page,
    read_chunk,
)
from tabbridge.plans.housekeeping import retry_candidates
from tabbridge.session import stage


@query(
    "number_rows",
    """
    SELECT o_orderkey, o_custkey, o_totalprice,
           row_number() OVER (ORDER BY o_custkey, o_totalprice DESC, o_orderkey) - 1 AS position
    FROM orders
    """,
)
def number_orders(spark, sf):
    orders = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return number_rows(
        orders, ["o_custkey", ("o_totalprice", "DESC"), "o_orderkey"], from_scan=True
    )


@query(
    "number_rows_hot_key",
    """
    SELECT l_returnflag, l_linenumber, l_quantity,
           row_number() OVER (ORDER BY l_returnflag, l_linenumber, l_quantity) - 1 AS position
    FROM lineitem
    """,
)
def number_hot_key(spark, sf):
    """Three sort key values and many equal rows: the ranges still split them."""
    lineitem = load(spark, sf, "lineitem").select("l_returnflag", "l_linenumber", "l_quantity")
    return number_rows(lineitem, lineitem.columns, from_scan=True)


_FILTERED = "FROM orders WHERE o_orderstatus = 'O'"


def _orders_page(spark, sf, number, size):
    orders = load(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    rules = [("o_totalprice", "DESC"), "o_orderkey"]
    return page(orders, rules, number, size, [("o_orderstatus", "=", "O")])


@query(
    "page",
    f"SELECT o_orderkey, o_orderstatus, o_totalprice {_FILTERED} "
    "ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 100",
)
def third_page(spark, sf):
    return _orders_page(spark, sf, 3, 50).rows


@query("page_total", f"SELECT count(*) AS total_rows {_FILTERED}")
def page_total(spark, sf):
    return _orders_page(spark, sf, 3, 50).total


@query("page_past_end", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE 1 = 0")
def page_past_end(spark, sf):
    return _orders_page(spark, sf, 1_000_000, 50).rows


@query(
    "page_deep",
    """
    SELECT * EXCLUDE (l_shipdate) FROM lineitem
    ORDER BY l_extendedprice, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
             l_discount, l_tax, l_returnflag, l_linestatus
    LIMIT 1500 OFFSET 12000
    """,
)
def page_deep(spark, sf):
    """A deep page is cut out by position, not by a top-k of all rows before it."""
    lineitem = load(spark, sf, "lineitem").drop("l_shipdate")
    rules = ["l_extendedprice", *[c for c in lineitem.columns if c != "l_extendedprice"]]
    return page(lineitem, rules, 9, 1500, from_scan=True).rows


@query(
    "retry_candidates",
    """
    SELECT event_id AS task_id, user_id % 3 AS retry_count,
           CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'pending'
                ELSE 'done' END AS status
    FROM events
    WHERE user_id % 3 > 0 AND event_type IN ('error', 'click') AND ts < TIMESTAMP '2024-01-20 11:58:00'
    ORDER BY ts, event_id LIMIT 40 OFFSET 40
    """,
)
def retry_page(spark, sf):
    ledger = load(spark, sf, "events").select(
        F.col("event_id").alias("task_id"),
        (F.col("user_id") % 3).alias("retry_count"),
        F.when(F.col("event_type") == "error", "failed")
        .when(F.col("event_type") == "click", "pending")
        .otherwise("done")
        .alias("status"),
        F.col("ts").alias("updated_at"),
    )
    rows = retry_candidates(ledger, dt.datetime(2024, 1, 20, 12), 2, 40).rows
    return rows.drop("updated_at")


_CHUNK_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
_LINES = """
    WITH l AS (
        SELECT row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS position,
               concat_ws(chr(1), o_orderkey, o_custkey, o_orderstatus, o_orderpriority) AS line
        FROM orders)
"""


@query(
    "chunk_manifest",
    _LINES
    + """
    SELECT position // 1000 AS chunk_id, position // 1000 * 1000 AS start_offset,
           position // 1000 * 1000 + count(*) AS end_offset, count(*) AS chunk_rows,
           (SELECT (count(*) + 999) // 1000 FROM orders) AS total_chunks,
           CASE WHEN position // 1000 + 1 < (SELECT (count(*) + 999) // 1000 FROM orders)
                THEN position // 1000 + 1 ELSE -1 END AS next_chunk_id,
           md5(string_agg(line, chr(10) ORDER BY position)) AS checksum
    FROM l GROUP BY position // 1000
    """,
)
def manifest(spark, sf):
    orders = load(spark, sf, "orders").select(*_CHUNK_COLUMNS)
    return chunk_manifest(orders, ["o_custkey", "o_orderkey"], 1000, from_scan=True)


@query(
    "read_chunk",
    """
    WITH p AS (SELECT o_orderkey, o_custkey,
                      row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS position
               FROM orders)
    SELECT o_orderkey, o_custkey FROM p WHERE position BETWEEN 1250 AND 1999
    """,
)
def resumed_chunk(spark, sf):
    """Second chunk of 1000 rows, resumed after the first 250."""
    orders = load(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return read_chunk(order_table(orders, ["o_custkey", "o_orderkey"], from_scan=True), 1, 1000, 250)


def _dated(df, name):
    return df.withColumn(name, F.date_format(name, "yyyy-MM-dd HH:mm:ss"))


_ORDERS = """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
           strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority
    FROM orders
"""


@query(
    "page_deep_all_columns",
    """
    SELECT * REPLACE (strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate) FROM lineitem
    ORDER BY l_shipdate DESC NULLS LAST, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
             l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus
    LIMIT 1200 OFFSET 30000
    """,
)
def page_deep_all_columns(spark, sf):
    """Every column of a deep page; ships by the thousand share a day, so the page's keys are deep, too."""
    lineitem = load(spark, sf, "lineitem")
    rules = [("l_shipdate", "DESC"), *[c for c in lineitem.columns if c != "l_shipdate"]]
    return _dated(page(lineitem, rules, 26, 1200, from_scan=True).rows, "l_shipdate")


@query(
    "page_indexed",
    f"""
    WITH o AS ({_ORDERS}), p AS (
        SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS place FROM o)
    SELECT * EXCLUDE (place), 'page 40' AS part, (SELECT count(*) FROM o) AS total_rows FROM p WHERE place BETWEEN 9750 AND 9999
    UNION ALL
    SELECT * EXCLUDE (place), 'from 250000', (SELECT count(*) FROM o WHERE o_totalprice > 250000) FROM p
    WHERE place >= (SELECT count(*) FROM o WHERE o_totalprice > 250000)
      AND place < (SELECT count(*) FROM o WHERE o_totalprice > 250000) + 75
    """,
)
def page_indexed(spark, sf):
    """One order made once: a page of it, and the rows from a key on."""
    with ordered(load(spark, sf, "orders"), [("o_totalprice", "DESC"), "o_orderkey"], from_scan=True) as table:
        found = table.page(40, 250)
        place = table.position_of([250000.0])
        rows = found.rows.withColumns({"part": F.lit("page 40"), "total_rows": F.lit(found.total.first()[0])})
        onward = table.at(place, 75).withColumns({"part": F.lit("from 250000"), "total_rows": F.lit(place).cast("long")})
        return _dated(stage(rows.unionByName(onward), "page"), "o_orderdate")


@query(
    "number_rows_all_columns",
    f"""
    SELECT *, row_number() OVER (ORDER BY o_orderpriority, o_orderdate DESC, o_orderkey) AS place FROM ({_ORDERS})
    """,
)
def number_all_columns(spark, sf):
    rules = ["o_orderpriority", ("o_orderdate", "DESC"), "o_orderkey"]
    return _dated(number_rows(load(spark, sf, "orders"), rules, "place", 1, from_scan=True), "o_orderdate")


@query(
    "chunk_manifest_all_columns",
    f"""
    WITH l AS (
        SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS position,
               concat_ws(chr(1), o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority) AS line
        FROM ({_ORDERS}))
    SELECT position // 4000 AS chunk_id, position // 4000 * 4000 AS start_offset,
           position // 4000 * 4000 + count(*) AS end_offset, count(*) AS chunk_rows,
           (SELECT (count(*) + 3999) // 4000 FROM orders) AS total_chunks,
           CASE WHEN position // 4000 + 1 < (SELECT (count(*) + 3999) // 4000 FROM orders)
                THEN position // 4000 + 1 ELSE -1 END AS next_chunk_id,
           md5(string_agg(line, chr(10) ORDER BY position)) AS checksum
    FROM l GROUP BY position // 4000
    """,
)
def manifest_all_columns(spark, sf):
    return chunk_manifest(load(spark, sf, "orders"), ["o_orderdate", "o_orderkey"], 4000, from_scan=True)


@query(
    "read_chunk_all_columns",
    f"""
    WITH p AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS place FROM ({_ORDERS}))
    SELECT * EXCLUDE (place) FROM p WHERE place BETWEEN 8100 AND 11999
    """,
)
def resumed_chunk_all_columns(spark, sf):
    """The third chunk of 4000 rows, resumed after the first 100."""
    with ordered(load(spark, sf, "orders"), ["o_orderdate", "o_orderkey"], from_scan=True) as table:
        return _dated(stage(read_chunk(table, 2, 4000, 100), "chunk"), "o_orderdate")
