"""SQL passthrough over the given tables."""

from __future__ import annotations

from tabbridge.coverage.registry import load, query, scratch_database
from tabbridge.plans.imports import import_table
from tabbridge.plans.sqlpass import execute_sql, execute_sql_into, sql_rows_as_text

TEXTS = {
    "sql_ranking_window": (
        ["orders"],
        """
        SELECT o_orderpriority, o_orderkey, o_totalprice, rank_no FROM (
            SELECT o_orderpriority, o_orderkey, o_totalprice,
                   CAST(row_number() OVER (PARTITION BY o_orderpriority
                        ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rank_no
            FROM orders) t
        WHERE rank_no <= 5
        """,
    ),
    "sql_rows_frame": (
        ["orders"],
        """
        SELECT o_custkey, o_orderkey,
               sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey
                                     ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS key_sum
        FROM orders
        """,
    ),
    "sql_set_operations": (
        ["customer", "orders", "supplier"],
        """
        (SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders)
        UNION
        (SELECT s_suppkey FROM supplier EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 0)
        """,
    ),
    "sql_grouping_sets": (
        ["lineitem"],
        """
        SELECT coalesce(l_returnflag, 'all') AS flag, coalesce(l_linestatus, 'all') AS status,
               count(*) AS n
        FROM lineitem
        GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())
        """,
    ),
}
# Spark spelling of the window sum differs in result type only
ORACLE_TEXTS = {
    "sql_rows_frame": """
        SELECT o_custkey, o_orderkey,
               CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey
                    ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS key_sum
        FROM orders
    """,
}


def _views(spark, sf, tables):
    for table in tables:
        load(spark, sf, table).createOrReplaceTempView(table)


def _register_text(name, tables, text):
    @query(name, ORACLE_TEXTS.get(name, text))
    def run(spark, sf):
        _views(spark, sf, tables)
        return execute_sql(spark, f"-- passed on as it is?\n{text}").rows


for _name, (_tables, _text) in TEXTS.items():
    _register_text(_name, _tables, _text)


@query(
    "sql_json_and_dates",
    """
    SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n,
           CAST(sum(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS BIGINT) AS k
    FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY ALL
    """,
)
def json_and_dates(spark, sf):
    _views(spark, sf, ["events"])
    text = """
        SELECT date_format(ts, 'yyyy-MM-dd') AS day, event_type, count(*) AS n,
               sum(CAST(get_json_object(props, '$.k') AS INT)) AS k
        FROM events WHERE ts >= CAST(? AS TIMESTAMP_NTZ)
        GROUP BY date_format(ts, 'yyyy-MM-dd'), event_type
    """
    return execute_sql(spark, text, ["2024-01-10 00:00:00"]).rows


@query(
    "sql_bound_values",
    """
    SELECT p_partkey, p_name, '?' AS mark FROM part WHERE p_size BETWEEN 10 AND 20
      AND p_brand = 'Brand#4'
    """,
)
def bound_values(spark, sf):
    _views(spark, sf, ["part"])
    text = "SELECT p_partkey, p_name, '?' AS mark FROM part WHERE p_size BETWEEN $2 AND $3 AND p_brand = $1"
    return execute_sql(spark, text, ["Brand#4", 10, 20]).rows


@query(
    "execute_sql_insert",
    """
    SELECT c_custkey, c_name, CAST(count(*) OVER () AS BIGINT) AS affected
    FROM customer WHERE c_acctbal > 9000
    """,
)
def insert_rows(spark, sf):
    """INSERT inside a chosen database reports the rows it wrote."""
    from pyspark.sql import functions as F

    db = scratch_database(spark, "insert")
    customers = load(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    import_table(customers, f"{db}.customer")
    execute_sql(spark, "CREATE TABLE rich (c_custkey BIGINT, c_name STRING) USING parquet", (), db)
    done = execute_sql(
        spark,
        "INSERT INTO rich SELECT c_custkey, c_name FROM customer WHERE c_acctbal > ?",
        [9000],
        db,
    )
    return spark.table(f"{db}.rich").withColumn("affected", F.lit(done.affected).cast("long"))


@query(
    "execute_sql_counts",
    """
    SELECT o_orderkey, o_totalprice, strftime(o_orderdate, '%Y') AS year,
           (SELECT count(*) FROM orders) AS created,
           (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS inserted
    FROM orders
    UNION ALL
    SELECT o_orderkey, o_totalprice, 'late', (SELECT count(*) FROM orders),
           (SELECT count(*) FROM orders WHERE o_orderstatus = 'F')
    FROM orders WHERE o_orderstatus = 'F'
    """,
)
def counted_writes(spark, sf):
    """CREATE TABLE AS and INSERT into a partition report the rows they wrote."""
    from pyspark.sql import functions as F

    _views(spark, sf, ["orders"])
    table = f"{scratch_database(spark, 'counts')}.by_year"
    made = execute_sql(
        spark,
        f"/* all of it? */ CREATE TABLE {table} USING parquet PARTITIONED BY (year) AS "
        "SELECT o_orderkey, o_totalprice, date_format(o_orderdate, 'yyyy') AS year FROM orders",
    )
    added = execute_sql(
        spark,
        f"INSERT INTO {table} PARTITION (year = 'late') "
        "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = ?",
        ["F"],
    )
    return spark.table(table).select(
        "o_orderkey", "o_totalprice", "year",
        F.lit(made.affected).cast("long").alias("created"), F.lit(added.affected).cast("long").alias("inserted"),
    )


@query(
    "execute_sql_into",
    """
    SELECT o_orderpriority, count(*) AS orders FROM orders GROUP BY o_orderpriority
    """,
)
def sql_into(spark, sf):
    _views(spark, sf, ["orders"])
    table = f"{scratch_database(spark, 'into')}.priorities"
    text = "SELECT o_orderpriority, count(*) AS orders FROM orders GROUP BY o_orderpriority"
    execute_sql_into(spark, text, table, key_name="pk_00001")
    return spark.table(table).drop("pk_00001")


@query(
    "sql_rows_as_text",
    """
    SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey,
           coalesce(nullif(o_orderstatus, 'P'), '') AS o_orderstatus,
           CASE WHEN o_custkey > 100 THEN 'true' ELSE 'false' END AS big
    FROM orders
    """,
)
def text_rows(spark, sf):
    _views(spark, sf, ["orders"])
    return sql_rows_as_text(
        spark,
        "SELECT o_orderkey, nullif(o_orderstatus, 'P') AS o_orderstatus, o_custkey > 100 AS big FROM orders",
    )


_FORMS = [
    ("by name", "INSERT INTO o BY NAME SELECT o_totalprice, o_orderkey, o_orderdate, o_orderstatus, o_orderpriority, o_custkey FROM orders"),
    ("comment", "INSERT INTO o /* SELECT (none) */ SELECT * FROM orders WHERE o_orderstatus = 'F'"),
    ("with", "WITH q AS (SELECT * FROM orders WHERE o_orderstatus = 'O') INSERT INTO o SELECT * FROM q"),
    ("several", "FROM orders INSERT INTO o SELECT * WHERE o_custkey % 2 = 0 INSERT INTO o SELECT * WHERE o_custkey % 3 = 0"),
    ("created", "CREATE TABLE IF NOT EXISTS made USING parquet AS SELECT * FROM orders WHERE o_totalprice > 1000"),
    ("created again", "CREATE TABLE IF NOT EXISTS made USING parquet AS SELECT * FROM orders"),
    ("definition", "CREATE TABLE plain (x INT) USING parquet COMMENT 'same AS SELECT 1'"),
    ("update", "UPDATE o SET o_orderpriority = 'none' WHERE o_orderstatus = 'P' AND o_totalprice < 2000"),
    ("delete", "DELETE FROM o AS x WHERE x.o_orderstatus = 'F' AND x.o_custkey % 5 = 0"),
]


@query(
    "execute_sql_write_counts",
    """
    WITH n AS (SELECT count(*) AS a, count(*) FILTER (o_orderstatus = 'F') AS f,
                      count(*) FILTER (o_orderstatus = 'O') AS o,
                      count(*) FILTER (o_custkey % 2 = 0) + count(*) FILTER (o_custkey % 3 = 0) AS s,
                      count(*) FILTER (o_totalprice > 1000) AS made,
                      count(*) FILTER (o_orderstatus = 'P' AND o_totalprice < 2000) AS p1,
                      count(*) FILTER (o_orderstatus = 'P' AND o_totalprice < 2000 AND o_custkey % 2 = 0)
                      + count(*) FILTER (o_orderstatus = 'P' AND o_totalprice < 2000 AND o_custkey % 3 = 0) AS p2,
                      count(*) FILTER (o_orderstatus = 'F' AND o_custkey % 5 = 0) AS d1,
                      count(*) FILTER (o_orderstatus = 'F' AND o_custkey % 10 = 0)
                      + count(*) FILTER (o_orderstatus = 'F' AND o_custkey % 15 = 0) AS d2 FROM orders)
    SELECT 'by name' AS form, a AS affected FROM n UNION ALL SELECT 'comment', f FROM n
    UNION ALL SELECT 'with', o FROM n UNION ALL SELECT 'several', s FROM n
    UNION ALL SELECT 'created', made FROM n UNION ALL SELECT 'created again', 0 FROM n
    UNION ALL SELECT 'definition', 0 FROM n UNION ALL SELECT 'update', p1 + p2 FROM n
    UNION ALL SELECT 'delete', 2 * d1 + d2 FROM n
    """,
)
def write_counts(spark, sf):
    """Affected rows of every form of a write, all of them over the whole of orders."""
    _views(spark, sf, ["orders"])
    db = scratch_database(spark, "forms")
    execute_sql(spark, "CREATE TABLE o USING parquet AS SELECT * FROM orders WHERE 1 = 0", (), db)
    counts = [(form, execute_sql(spark, text, (), db).affected) for form, text in _FORMS]
    return spark.createDataFrame(counts, "form string, affected long")


@query(
    "execute_sql_update_text",
    """
    SELECT o_orderkey, o_custkey, o_orderstatus,
           CASE WHEN o_orderstatus = 'P' AND o_custkey % 2 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice,
           strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate,
           CASE WHEN o_orderstatus = 'P' AND o_custkey % 2 = 0 THEN 'it''s ' || o_orderpriority ELSE o_orderpriority END AS o_orderpriority
    FROM orders
    """,
)
def update_text(spark, sf):
    from pyspark.sql import functions as F

    _views(spark, sf, ["orders"])
    table = f"{scratch_database(spark, 'update')}.o"
    execute_sql(spark, f"CREATE TABLE {table} USING parquet AS SELECT * FROM orders")
    text = f"UPDATE {table} AS z SET z.o_totalprice = z.o_totalprice * ?, o_orderpriority = concat($3, o_orderpriority) WHERE z.o_orderstatus = $2 AND o_custkey % 2 = 0"
    execute_sql(spark, text.replace("?", "$1"), [2, "P", "it's "])
    return spark.table(table).withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


@query(
    "execute_sql_delete_text",
    """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount,
           l_tax, l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate
    FROM lineitem WHERE NOT (l_returnflag = 'R' OR (l_quantity < 10 AND l_linestatus = 'O'))
    """,
)
def delete_text(spark, sf):
    """A partitioned table: whole partitions go by their metadata, others are written anew."""
    from pyspark.sql import functions as F

    _views(spark, sf, ["lineitem"])
    table = f"{scratch_database(spark, 'delete')}.l"
    execute_sql(spark, f"CREATE TABLE {table} USING parquet PARTITIONED BY (l_returnflag) AS SELECT * FROM lineitem")
    execute_sql(spark, f"DELETE FROM {table} WHERE l_returnflag = 'R' OR (l_quantity < 10 AND l_linestatus = 'O')")
    return spark.table(table).withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd"))
