"""Table reads, the eight predicates and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabbridge.coverage.registry import load, query
from tabbridge.functions.declared import ColumnInfo
from tabbridge.functions.predicates import Filter, filters_from_lists
from tabbridge.operators import counts
from tabbridge.operators.tables import read_table, sort_table
from tabbridge.plans import batch
from tabbridge.session import workspace
from tabbridge.sources.assets import Asset, Registry, read
from tabbridge.sources.files import write_files


@query(
    "read_table",
    """
    SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag
    FROM lineitem
    WHERE l_quantity >= 10 AND l_returnflag IN ('A', 'R')
    ORDER BY l_extendedprice DESC, l_orderkey
    """,
)
def read_lineitem(spark, sf):
    return read_table(
        load(spark, sf, "lineitem"),
        ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag"],
        [Filter("l_quantity", ">=", 10), Filter("l_returnflag", "IN", ["A", "R"])],
        [("l_extendedprice", "DESC"), ("l_orderkey", "ASC")],
        from_scan=True,
    )


@query(
    "read_asset",
    """
    SELECT o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey,
           coalesce(nullif(o_orderstatus, 'P'), 'none') AS o_orderstatus
    FROM orders WHERE o_totalprice >= 1000 ORDER BY o_orderkey
    """,
)
def read_registered_asset(spark, sf):
    """A registered asset with declared types and a default, through the general read."""
    path = workspace(spark, "asset")
    orders = load(spark, sf, "orders").withColumn(
        "o_orderstatus", F.nullif("o_orderstatus", F.lit("P"))
    )
    write_files(orders, path, "csv")
    registry = Registry(
        [
            Asset(
                "orders",
                "FILE_TYPE_CSV",
                path,
                [
                    ColumnInfo("o_orderkey", "BIGINT", nullable=False),
                    ColumnInfo("o_custkey", "INT"),
                    ColumnInfo("o_orderstatus", "VARCHAR(8)", default="none"),
                    ColumnInfo("o_totalprice", "DOUBLE"),
                    ColumnInfo("o_orderdate", "DATETIME"),
                    ColumnInfo("o_orderpriority", "VARCHAR(20)"),
                ],
            )
        ]
    )
    return read(
        spark,
        registry.asset("orders"),
        ["o_orderkey", "o_custkey", "o_orderstatus"],
        [("o_totalprice", ">=", 1000)],
        ["o_orderkey"],
    )


@query("read_table_all_columns", "SELECT * FROM customer WHERE c_acctbal > 0")
def read_all_columns(spark, sf):
    return read_table(load(spark, sf, "customer"), filters=[("c_acctbal", ">", 0)])


ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
PART_COLUMNS = ["p_partkey", "p_name", "p_brand", "p_size"]

# name, table, columns, field, operator, value, SQL condition
PREDICATES = [
    ("equal", "orders", ORDER_COLUMNS, "o_orderstatus", "=", "F", "o_orderstatus = 'F'"),
    ("not_equal", "orders", ORDER_COLUMNS, "o_orderstatus", "!=", "F", "o_orderstatus <> 'F'"),
    ("greater", "orders", ORDER_COLUMNS, "o_totalprice", ">", 250000.0, "o_totalprice > 250000"),
    ("less", "orders", ORDER_COLUMNS, "o_custkey", "<", 100, "o_custkey < 100"),
    ("greater_equal", "part", PART_COLUMNS, "p_size", ">=", 40, "p_size >= 40"),
    ("less_equal", "part", PART_COLUMNS, "p_size", "<=", 10, "p_size <= 10"),
    ("like", "part", PART_COLUMNS, "p_name", "LIKE", "%ring%", "p_name LIKE '%ring%'"),
    (
        "in",
        "part",
        PART_COLUMNS,
        "p_brand",
        "IN",
        ["Brand#1", "Brand#4", "Brand#17"],
        "p_brand IN ('Brand#1', 'Brand#4', 'Brand#17')",
    ),
]


def _register_predicate(name, table, columns, field, op, value, condition):
    @query(f"filter_{name}", f"SELECT {', '.join(columns)} FROM {table} WHERE {condition}")
    def filtered(spark, sf):
        return read_table(load(spark, sf, table), columns, [Filter(field, op, value)])


for _case in PREDICATES:
    _register_predicate(*_case)


@query(
    "filter_falsy_values",
    """
    SELECT l_orderkey, l_linenumber, l_discount, l_returnflag
    FROM lineitem WHERE l_discount = 0 AND l_returnflag <> ''
    """,
)
def filter_falsy_values(spark, sf):
    return read_table(
        load(spark, sf, "lineitem"),
        ["l_orderkey", "l_linenumber", "l_discount", "l_returnflag"],
        [("l_discount", "=", 0), ("l_returnflag", "!=", "")],
    )


@query(
    "filter_lists",
    """
    SELECT o_orderkey, o_orderpriority FROM orders
    WHERE o_orderstatus = 'O' AND o_totalprice < 100000 AND o_orderpriority LIKE '%URGENT'
    """,
)
def filter_lists(spark, sf):
    filters = filters_from_lists(
        ["o_orderstatus", "o_totalprice", "o_orderpriority"],
        ["EQUAL", "LESS_THAN", "LIKE_OPERATOR"],
        ["O", 100000.0, "%URGENT"],
    )
    return read_table(load(spark, sf, "orders"), ["o_orderkey", "o_orderpriority"], filters)


@query(
    "sort_table",
    "SELECT * FROM customer ORDER BY c_mktsegment ASC NULLS FIRST, c_acctbal DESC NULLS LAST",
)
def sort_customers(spark, sf):
    return sort_table(
        load(spark, sf, "customer"),
        [("c_mktsegment", "ASC"), ("c_acctbal", "DESC")],
        from_scan=True,
    )


@query(
    "count_rows",
    """
    SELECT count(*) AS count FROM lineitem
    WHERE l_returnflag = 'R' AND l_quantity < 25
    """,
)
def count_rows(spark, sf):
    return counts.count_rows(
        load(spark, sf, "lineitem"), [("l_returnflag", "=", "R"), ("l_quantity", "<", 25)]
    )


@query(
    "groupby_count",
    """
    SELECT o_orderstatus, o_orderpriority, count(*) AS count
    FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderstatus, o_orderpriority
    """,
)
def groupby_count(spark, sf):
    return counts.groupby_count(
        load(spark, sf, "orders"),
        ["o_orderstatus", "o_orderpriority"],
        [("o_totalprice", ">", 100000)],
    )


@query(
    "group_count_info",
    "SELECT count(*) AS count FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey",
)
def group_count_info(spark, sf):
    return counts.group_count_info(
        load(spark, sf, "orders"), ["o_custkey"], [("o_orderstatus", "!=", "P")]
    )


@query("group_count_total", "SELECT count(*) AS count FROM orders")
def group_count_total(spark, sf):
    return counts.group_count_info(load(spark, sf, "orders"))


@query(
    "key_bounds",
    "SELECT min(o_orderkey) AS min_key, max(o_orderkey) AS max_key FROM orders",
)
def key_bounds(spark, sf):
    return counts.key_bounds(load(spark, sf, "orders"), "o_orderkey")


@query(
    "batch_groupby_count",
    "SELECT event_type, count(*) AS count FROM events WHERE value > 5 GROUP BY event_type",
)
def batch_groupby_count(spark, sf):
    return batch.run(
        "OPERATION_MODE_GROUPBY_COUNT",
        table=load(spark, sf, "events"),
        keys=["event_type"],
        filters=[("value", ">", 5)],
    )
