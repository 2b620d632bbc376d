"""Joins, hash keys and key intersections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabbridge.coverage.registry import load, query
from tabbridge.operators import joins
from tabbridge.session import isolated


def _sides(spark, sf):
    customers = load(spark, sf, "customer").select(
        F.col("c_custkey").alias("custkey"), "c_name", "c_mktsegment"
    )
    orders = load(spark, sf, "orders").select(
        F.col("o_custkey").alias("custkey"), "o_orderkey", "o_totalprice"
    )
    return customers, orders


_SIDES_SQL = """
    WITH c AS (SELECT c_custkey AS custkey, c_name, c_mktsegment FROM customer),
         o AS (SELECT o_custkey AS custkey, o_orderkey, o_totalprice FROM orders)
"""


@query(
    "join_inner",
    _SIDES_SQL + "SELECT custkey, c_name, c_mktsegment, o_orderkey, o_totalprice "
    "FROM c JOIN o USING (custkey)",
)
def join_inner(spark, sf):
    customers, orders = _sides(spark, sf)
    return joins.join(customers, orders, ["custkey"], "inner")


@query(
    "join_left",
    _SIDES_SQL + "SELECT custkey, c_name, c_mktsegment, o_orderkey, o_totalprice "
    "FROM c LEFT JOIN o USING (custkey)",
)
def join_left(spark, sf):
    customers, orders = _sides(spark, sf)
    return joins.join(customers, orders, ["custkey"], "left")


@query(
    "join_right",
    _SIDES_SQL + "SELECT custkey, c_name, c_mktsegment, o_orderkey, o_totalprice "
    "FROM (SELECT * FROM c WHERE c_mktsegment = 'BUILDING') "
    "RIGHT JOIN o USING (custkey)",
)
def join_right(spark, sf):
    customers, orders = _sides(spark, sf)
    return joins.join(
        customers.where(F.col("c_mktsegment") == "BUILDING"), orders, ["custkey"], "JOIN_TYPE_RIGHT"
    )


@query(
    "join_outer",
    """
    WITH n AS (SELECT n_nationkey AS nationkey, n_name FROM nation WHERE n_regionkey < 3),
         s AS (SELECT s_nationkey AS nationkey, count(*) AS suppliers
               FROM supplier GROUP BY s_nationkey)
    SELECT nationkey, n_name, suppliers FROM n FULL JOIN s USING (nationkey)
    """,
)
def join_outer(spark, sf):
    nations = (
        load(spark, sf, "nation")
        .where("n_regionkey < 3")
        .select(F.col("n_nationkey").alias("nationkey"), "n_name")
    )
    suppliers = (
        load(spark, sf, "supplier")
        .groupBy(F.col("s_nationkey").alias("nationkey"))
        .agg(F.count(F.lit(1)).alias("suppliers"))
    )
    return joins.join(nations, suppliers, ["nationkey"], "outer")


@query(
    "join_outer_hot_keys",
    """
    WITH e AS (SELECT event_type AS kind, user_id AS usr, event_id FROM events),
         k AS (SELECT DISTINCT event_type AS kind, 'known' AS note FROM events
               WHERE event_type < 'p'
               UNION ALL SELECT 'absent', 'extra')
    SELECT kind, usr, event_id, note FROM e FULL JOIN k USING (kind)
    """,
)
def join_outer_hot_keys(spark, sf):
    """A handful of key values hold all rows; the hot-key route does the work at any size."""
    events = load(spark, sf, "events").select(
        F.col("event_type").alias("kind"), F.col("user_id").alias("usr"), "event_id"
    )
    kinds = (
        events.select("kind")
        .where("kind < 'p'")
        .distinct()
        .select("kind", F.lit("known").alias("note"))
        .unionByName(spark.createDataFrame([("absent", "extra")], "kind string, note string"))
    )
    return joins.join(events, kinds, ["kind"], "outer", hot_rows=1000)


_SKEWED_SQL = """
    WITH l AS (SELECT CAST(CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_orderkey END AS INTEGER) AS k, l_linenumber, l_partkey,
                      l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
                      strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate FROM lineitem WHERE l_orderkey % 7 <> 1),
         o AS (SELECT o_orderkey AS k, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate,
                      o_orderpriority FROM orders WHERE o_orderkey % 5 <> 2)
"""


def _skewed_outer(spark, sf, how):
    """A third of lineitem has one key, and neither side may be broadcast."""
    own = isolated(spark)
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    key = F.when(F.col("l_orderkey") % 3 == 0, 0).otherwise(F.col("l_orderkey")).cast("int")
    lineitem = load(own, sf, "lineitem").where("l_orderkey % 7 <> 1").withColumn("k", key).drop("l_orderkey")
    orders = load(own, sf, "orders").where("o_orderkey % 5 <> 2").withColumnRenamed("o_orderkey", "k")
    both = joins.join(lineitem, orders, ["k"], how, hot_rows=1000, from_scan=True)
    plan = both._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    rows = both.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("l_shipdate", "o_orderdate")})
    return rows.withColumn("scans", F.lit(plan.count("FileScan")))


@query("join_outer_skewed", _SKEWED_SQL + "SELECT *, 2 AS scans FROM l FULL JOIN o USING (k)")
def join_outer_skewed(spark, sf):
    return _skewed_outer(spark, sf, "outer")


@query("join_right_skewed", _SKEWED_SQL + "SELECT *, 2 AS scans FROM l RIGHT JOIN o USING (k)")
def join_right_skewed(spark, sf):
    return _skewed_outer(spark, sf, "right")


@query(
    "in_file_filter_all_columns",
    """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority
    FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
    """,
)
def in_file_all_columns(spark, sf):
    keys = load(spark, sf, "customer").where("c_mktsegment = 'BUILDING'")
    kept = joins.in_file_filter(load(spark, sf, "orders"), "o_custkey", keys, "c_custkey")
    return kept.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


@query(
    "join_unknown_type",
    """
    SELECT n_regionkey AS regionkey, n_name, r_name
    FROM nation JOIN region ON n_regionkey = r_regionkey
    """,
)
def join_unknown(spark, sf):
    return joins.join(
        load(spark, sf, "nation").select(F.col("n_regionkey").alias("regionkey"), "n_name"),
        load(spark, sf, "region").withColumnRenamed("r_regionkey", "regionkey"),
        ["regionkey"],
        "JOIN_TYPE_UNKNOWN",
    )


@query(
    "add_hash_column",
    """
    SELECT c_custkey, c_acctbal,
           sha256(concat(coalesce(c_name, '\\N'), chr(1),
                         coalesce(nullif(c_mktsegment, 'BUILDING'), '\\N'))) AS join_hash
    FROM customer
    """,
)
def add_hash_column(spark, sf):
    customers = load(spark, sf, "customer").withColumn(
        "c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING"))
    )
    return joins.add_hash_column(
        customers, ["c_name", "c_mktsegment"], ["c_custkey", "c_acctbal"]
    )


@query(
    "psi_join",
    """
    SELECT c_custkey AS custkey, c_name, c_acctbal FROM customer
    WHERE c_custkey IN (SELECT o_custkey FROM orders)
      AND c_custkey IN (SELECT user_id FROM events)
    ORDER BY c_custkey
    """,
)
def psi_join(spark, sf):
    table = load(spark, sf, "customer").select(
        F.col("c_custkey").alias("custkey"), "c_name", "c_acctbal"
    )
    orders = load(spark, sf, "orders").select(F.col("o_custkey").alias("custkey"))
    events = load(spark, sf, "events").select(F.col("user_id").alias("custkey"))
    return joins.psi_join(table, [orders, events], ["custkey"], "custkey")


@query(
    "in_file_filter",
    """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders
    WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)
    """,
)
def in_file_filter(spark, sf):
    keys = load(spark, sf, "customer").where("c_acctbal > 5000").select("c_custkey")
    return joins.in_file_filter(
        load(spark, sf, "orders").drop("o_orderdate"), "o_custkey", keys, "c_custkey"
    )
