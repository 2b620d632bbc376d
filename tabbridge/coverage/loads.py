"""Managed tables: appends with keys, imports, rewrites, streams, expiry, generated rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabbridge.coverage.registry import load, query, scratch_database
from tabbridge.functions.names import col
from tabbridge.operators import datagen
from tabbridge.operators.datagen import generate_rows, generate_schema
from tabbridge.plans.housekeeping import expire_partitions
from tabbridge.plans.imports import Target, import_by_key_range, import_table, import_targets
from tabbridge.session import workspace
from tabbridge.sources.assets import TableKey
from tabbridge.sources.managed import (
    delete_where,
    table_name,
    truncate_table,
    update_where,
    write_result_table,
    write_table,
)
from tabbridge.sources.parts import export_csv
from tabbridge.streaming.append import appended, load_ledger, stream_append


@query(
    "write_table_append",
    """
    SELECT n_nationkey, n_name, n_regionkey FROM nation
    UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation
    """,
)
def append_twice(spark, sf):
    table = f"{scratch_database(spark, 'append')}.{table_name('nation', 'job7')}"
    nations = load(spark, sf, "nation")
    write_table(nations, table)
    write_table(nations, table)
    return spark.table(table)


@query(
    "write_table_dense_key",
    """
    SELECT 2 * count(*) AS rows, 1 AS lowest, 2 * count(*) AS highest,
           2 * count(*) AS different FROM lineitem
    """,
)
def dense_key(spark, sf):
    """Two appends of all rows: the key runs from 1 without gap or repeat."""
    table = f"{scratch_database(spark, 'keyed')}.lineitem"
    lineitem = load(spark, sf, "lineitem")
    write_table(lineitem, table, key="dense", key_name="pk_00001")
    write_table(lineitem, table, key="dense")
    keys = spark.table(table).select("pk_00001")
    # distinct keys are counted by a grouped pass, then a plain sum
    per_key = keys.groupBy("pk_00001").agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.sum("n").alias("rows"),
        F.min("pk_00001").cast("int").alias("lowest"),
        F.max("pk_00001").alias("highest"),
        F.count(F.lit(1)).alias("different"),
    )


@query(
    "write_table_dense_key_rows",
    """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
           strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority,
           true AS key_in_load, 2 * (SELECT count(*) FROM orders) AS highest
    FROM orders, (VALUES (0), (1)) twice(load)
    """,
)
def dense_key_rows(spark, sf):
    """Whole rows of two appends: a scan numbered by file and row, and rows behind a shuffle."""
    table = f"{scratch_database(spark, 'keyed')}.orders"
    orders = load(spark, sf, "orders")
    n = write_table(orders, table, key="dense", key_name="pk_00001")
    write_table(orders.repartition(5), table, key="dense")
    rows = spark.table(table)
    # every order once among the first keys and once among the others, no key twice
    seen = rows.groupBy("o_orderkey").agg(F.count_if(F.col("pk_00001") <= n).alias("early"), F.count(F.lit(1)).alias("n"))
    kept = rows.join(seen.where("early = 1 AND n = 2"), "o_orderkey", "left").withColumn("key_in_load", F.col("n").isNotNull())
    highest = rows.agg(F.when(F.count_distinct("pk_00001") == F.max("pk_00001"), F.max("pk_00001"))).first()[0]
    return kept.drop("early", "n", "pk_00001").withColumns(
        {"o_orderdate": F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), "highest": F.lit(highest)}
    )


@query(
    "write_table_append_all",
    """
    SELECT * REPLACE (strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate), false AS job FROM lineitem
    UNION ALL SELECT * REPLACE (strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate), true FROM lineitem
    """,
)
def append_all(spark, sf):
    """All of lineitem twice; the second write gives its columns in another order."""
    table = f"{scratch_database(spark, 'append')}.{table_name('lineitem', 'job8')}"
    lineitem = load(spark, sf, "lineitem")
    write_table(lineitem.withColumn("job", F.lit(False)), table)
    write_table(lineitem.select(F.lit(True).alias("job"), *reversed(lineitem.columns)), table)
    return spark.table(table).withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"))


@query(
    "truncate_table_reload",
    """
    SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, user_id, event_type, value, props,
           0 AS left_after FROM events
    """,
)
def truncated_reload(spark, sf):
    """All events written, emptied and written again."""
    table = f"{scratch_database(spark, 'emptied')}.events"
    events = load(spark, sf, "events")
    write_table(events, table)
    truncate_table(spark, table)
    left = spark.table(table).count()
    write_table(events, table)
    rows = spark.table(table).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return rows.withColumn("left_after", F.lit(left).cast("int"))


@query(
    "write_table_unique_key",
    "SELECT count(*) AS rows, count(*) AS different FROM orders",
)
def unique_key(spark, sf):
    table = f"{scratch_database(spark, 'keyed')}.orders"
    write_table(load(spark, sf, "orders"), table, key="unique", key_name="pk_00001")
    per_key = spark.table(table).groupBy("pk_00001").agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("different"))


@query("truncate_table", "SELECT r_regionkey, r_name FROM region WHERE 1 = 0")
def truncated(spark, sf):
    table = f"{scratch_database(spark, 'emptied')}.region"
    write_table(load(spark, sf, "region"), table)
    truncate_table(spark, table)
    return spark.table(table)


@query("import_table", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def import_customer(spark, sf):
    """The second import replaces the first."""
    table = f"{scratch_database(spark, 'import')}.customer"
    import_table(load(spark, sf, "customer"), table)
    import_table(load(spark, sf, "customer"), table, ["c_custkey", "c_name", "c_acctbal"])
    return spark.table(table)


@query(
    "import_by_key_range",
    """
    WITH r AS (SELECT *, (o_orderkey - (SELECT min(o_orderkey) FROM orders)) // 5000 AS range_id
               FROM orders)
    SELECT range_id,
           range_id * 5000 + (SELECT min(o_orderkey) FROM orders) AS range_start,
           range_id * 5000 + 4999 + (SELECT min(o_orderkey) FROM orders) AS range_end,
           count(*) AS rows, min(o_orderkey) AS min_key, max(o_orderkey) AS max_key
    FROM r GROUP BY range_id
    """,
)
def import_ranges(spark, sf):
    table = f"{scratch_database(spark, 'ranges')}.orders"
    return import_by_key_range(
        load(spark, sf, "orders"), table, "o_orderkey", ["o_custkey", "o_totalprice"]
    ).ranges


@query(
    "import_by_key_range_rows", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders"
)
def import_range_rows(spark, sf):
    table = f"{scratch_database(spark, 'ranges')}.orders"
    import_by_key_range(
        load(spark, sf, "orders"), table, "o_orderkey", ["o_custkey", "o_totalprice"]
    )
    return spark.table(table)


@query(
    "import_targets",
    """
    SELECT 'customer' AS source_table, count(*) AS affected_rows, true AS success FROM customer
    UNION ALL SELECT 'orders', count(*), true FROM orders
    UNION ALL SELECT 'supplier', 0, false
    """,
)
def import_many(spark, sf):
    db = scratch_database(spark, "targets")
    auto = TableKey("AUTO_INCREMENT", ["o_orderkey"])
    report = import_targets(
        spark,
        [
            Target(load(spark, sf, "customer"), "customer", f"{db}.customer", ["c_custkey"]),
            Target(load(spark, sf, "orders"), "orders", f"{db}.orders", ["o_custkey"], [auto]),
            Target(load(spark, sf, "supplier"), "supplier", f"{db}.supplier", ["no_such_column"]),
        ],
    )
    return report.results.select("source_table", "affected_rows", "success")


@query(
    "write_result_table",
    """
    SELECT CAST(c_custkey AS VARCHAR) AS custkey, c_name, c_mktsegment AS field2 FROM customer
    """,
)
def result_table(spark, sf):
    path = workspace(spark, "result")
    table = f"{scratch_database(spark, 'result')}.job"
    result = load(spark, sf, "customer").select(
        F.col("c_custkey").alias("c.c_custkey AS custkey"),
        "c_name",
        F.col("c_mktsegment").alias("c_mktsegment as " + "m" * 70),
    )
    export_csv(result, path)
    write_result_table(spark, path, table)
    return spark.table(table).drop("_auto_id")


@query(
    "delete_where",
    "SELECT * FROM customer WHERE NOT (c_mktsegment = 'BUILDING' AND c_acctbal < 1000)",
)
def delete_rows(spark, sf):
    table = f"{scratch_database(spark, 'rewrite')}.customer"
    import_table(load(spark, sf, "customer"), table)
    delete_where(spark, table, [("c_mktsegment", "=", "BUILDING"), ("c_acctbal", "<", 1000)])
    return spark.table(table)


@query(
    "update_where",
    """
    SELECT c_custkey, c_name, c_nationkey,
           CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal,
           CASE WHEN c_acctbal < 0 THEN 'CLOSED' ELSE c_mktsegment END AS c_mktsegment
    FROM customer
    """,
)
def update_rows(spark, sf):
    table = f"{scratch_database(spark, 'rewrite')}.customer"
    import_table(load(spark, sf, "customer"), table)
    update_where(
        spark, table, {"c_acctbal": 0.0, "c_mktsegment": "CLOSED"}, [("c_acctbal", "<", 0)]
    )
    return spark.table(table)


@query(
    "rewrite_then_expire",
    """
    SELECT event_id, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts,
           CASE WHEN event_type = 'view' AND value >= 10 THEN 'seen' ELSE event_type END AS event_type,
           CASE WHEN event_type = 'view' AND value >= 10 THEN 0 ELSE value END AS value,
           props, strftime(ts, '%Y%m%d') AS day
    FROM events
    WHERE strftime(ts, '%Y%m%d') >= '20240108'
      AND NOT (event_type = 'error' AND strftime(ts, '%Y%m%d') < '20240120')
      AND strftime(ts, '%Y%m%d') <> '20240125'
    """,
)
def rewrite_then_expire(spark, sf):
    """Deletes and an update by day keep the partitions, so that old days can be dropped after them."""
    table = f"{scratch_database(spark, 'rewrite')}.events"
    write_table(load(spark, sf, "events").withColumn("day", F.date_format("ts", "yyyyMMdd")), table, partition_by=["day"])
    delete_where(spark, table, [("event_type", "=", "error"), ("day", "<", "20240120")])
    delete_where(spark, table, [("day", "=", "20240125")])
    update_where(spark, table, {"event_type": "seen", "value": 0.0}, [("event_type", "=", "view"), ("value", ">=", 10)])
    expire_partitions(spark, table, "day", "20240108")
    return spark.table(table).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


def _stream_events(spark, sf):
    """Two runs over the same files; the second one finds nothing new."""
    source, target, marks = (workspace(spark, t) for t in ("arrivals", "stream", "marks"))
    events = load(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    events.repartition(6, "event_id").write.parquet(source)
    first = stream_append(spark, source, target, marks, events.schema, files_per_batch=2)
    second = stream_append(spark, source, target, marks, events.schema, files_per_batch=2)
    return target, events.schema, first, second


@query("stream_append", "SELECT event_id, user_id, event_type, value FROM events")
def stream_rows(spark, sf):
    target, schema, _, _ = _stream_events(spark, sf)
    return appended(spark, target, schema)


@query(
    "stream_append_ledger",
    "SELECT count(*) AS rows, count(*) AS first_run, 0 AS second_run FROM events",
)
def stream_ledger(spark, sf):
    target, schema, first, second = _stream_events(spark, sf)
    return load_ledger(spark, target, schema).agg(
        F.sum("rows").alias("rows"),
        F.lit(first).cast("long").alias("first_run"),
        F.lit(second).cast("int").alias("second_run"),
    )


@query(
    "expire_by_date",
    """
    SELECT event_id, user_id, event_type, value, strftime(ts, '%Y%m%d') AS day
    FROM events WHERE strftime(ts, '%Y%m%d') >= '20240115'
    """,
)
def expire_events(spark, sf):
    table = f"{scratch_database(spark, 'expiry')}.events"
    events = load(spark, sf, "events").select(
        "event_id", "user_id", "event_type", "value", F.date_format("ts", "yyyyMMdd").alias("day")
    )
    write_table(events, table, partition_by=["day"])
    expire_partitions(spark, table, "day", "20240115")
    return spark.table(table)


@query(
    "expire_by_date_all_columns",
    """
    SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, user_id, event_type, value, props, strftime(ts, '%Y%m%d') AS day
    FROM events WHERE strftime(ts, '%Y%m%d') >= '20240111'
    """,
)
def expire_all_columns(spark, sf):
    table = f"{scratch_database(spark, 'expiry')}.events"
    write_table(load(spark, sf, "events").withColumn("day", F.date_format("ts", "yyyyMMdd")), table, partition_by=["day"])
    expire_partitions(spark, table, "day", "20240111")
    return spark.table(table).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query(
    "stream_append_all_columns",
    "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, user_id, event_type, value, props FROM events",
)
def stream_all_columns(spark, sf):
    source, target, marks = (workspace(spark, t) for t in ("arrivals", "stream", "marks"))
    events = load(spark, sf, "events")
    events.repartition(5, "user_id").write.parquet(source)
    stream_append(spark, source, target, marks, events.schema, files_per_batch=2)
    return appended(spark, target, events.schema).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


GENERATED_TYPES = [
    "int", "tinyint", "bigint", "double", "decimal", "varchar", "text", "date", "timestamp", "blob",
]
GENERATED_DAY = dt.date(2024, 7, 1)


def _generated(spark, sf):
    schema = generate_schema(11, GENERATED_TYPES, max_size=64, seed=7)
    ids = load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return generate_rows(ids, schema, seed=7, today=GENERATED_DAY), schema


def _mixed_sql(number: str) -> str:
    """``datagen.mix`` in SQL; a lambda binds the number, which each round uses twice."""
    for shift, factor in zip((16, 15), datagen.MIX):
        number = f"list_transform([{number}], lambda x: (xor(x, x >> {shift}) * {factor}) & 4294967295)[1]"
    return f"list_transform([{number}], lambda x: xor(x, x >> 16))[1]"


def _word_sql(column: str, what: str = "value", counter: str = "0", seed: int = 7) -> str:
    key = datagen.stream_key(seed, column, what)
    first = _mixed_sql(f"xor(id & 4294967295, {key}::BIGINT)")
    return _mixed_sql(f"({first} + (id >> 32) + ({counter}) * {datagen.STEP}) & 4294967295")


def _below_sql(column: str, limit: int, what: str = "value") -> str:
    return f"(({_word_sql(column, what)} * {limit}) >> 32)"


def _value_sql(f: T.StructField) -> str:
    name, declared, size = f.name, f.metadata["declared"].split("(")[0], f.metadata["max_size"]
    bounds = {"INT": 1 << 31, "TINYINT": 128}
    if declared in bounds:
        return _below_sql(name, bounds[declared])
    if declared == "BIGINT":
        return f"greatest(({_word_sql(name)} >> 1) * 4294967296 + {_word_sql(name, counter='1')}, 1)"
    if declared == "DOUBLE":
        return f"(({_word_sql(name)} >> 5) * 67108864 + ({_word_sql(name, counter='1')} >> 6))::DOUBLE / 9007199254740992 * 1000"
    if declared == "DECIMAL":
        return f"({_below_sql(name, 100_000)} / 100.0)::DECIMAL(10,2)"
    day = f"DATE '{GENERATED_DAY}'"
    if declared == "DATE":
        return f"strftime({day} - {_below_sql(name, datagen.DAYS)}::INTEGER, '%Y-%m-%d')"
    if declared == "TIMESTAMP":
        return f"strftime({day}::TIMESTAMP - to_seconds({_below_sql(name, datagen.DAYS * 86_400)}), '%Y-%m-%d %H:%M:%S')"
    places = f"range({_below_sql(name, size, 'length')} + 1)"
    word = _word_sql(name, counter="k")
    if declared == "BLOB":
        return f"md5(unhex(array_to_string(list_transform({places}, lambda k: printf('%02X', {word} & 255)), '')))"
    return f"array_to_string(list_transform({places}, lambda k: substr('{datagen.LETTERS}', (({word} * 62) >> 32)::INTEGER + 1, 1)), '')"


def _generated_sql() -> str:
    values = []
    for f in generate_schema(11, GENERATED_TYPES, max_size=64, seed=7).fields[1:]:
        value = _value_sql(f)
        if f.nullable:
            value = f"CASE WHEN {_below_sql(f.name, 100, 'null')} >= {datagen.NULL_PERCENT} THEN {value} END"
        values.append(f"{value} AS {f.name}")
    return f"SELECT id, {', '.join(values)} FROM (SELECT o_orderkey AS id FROM orders)"


@query("generate_rows", _generated_sql())
def generated(spark, sf):
    """Every value of every row, recomputed in SQL."""
    rows, schema = _generated(spark, sf)
    forms = {T.BinaryType: F.md5, T.DateType: lambda c: F.date_format(c, "yyyy-MM-dd"), T.TimestampNTZType: lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")}
    return rows.withColumns({f.name: forms[type(f.dataType)](col(f.name)) for f in schema.fields if type(f.dataType) in forms})


@query(
    "generate_rows_in_range",
    "SELECT count(*) AS rows, count(*) AS in_range FROM orders",
)
def generated_in_range(spark, sf):
    """Every generated row keeps the value rules of its types."""
    rows, schema = _generated(spark, sf)
    first_day = GENERATED_DAY - dt.timedelta(days=365)
    rules = {
        "INT": lambda c: c.between(0, 2147483647),
        "TINYINT": lambda c: c.between(0, 127),
        "BIGINT": lambda c: c >= 1,
        "DOUBLE": lambda c: (c >= 0) & (c < 1000),
        "DECIMAL": lambda c: (c >= 0) & (c < 1000),
        "VARCHAR": lambda c: c.rlike("^[A-Za-z0-9]{1,64}$"),
        "TEXT": lambda c: c.rlike("^[A-Za-z0-9]{1,64}$"),
        "DATE": lambda c: c.between(F.lit(first_day), F.lit(GENERATED_DAY)),
        "TIMESTAMP": lambda c: c.between(
            F.lit(first_day).cast("timestamp_ntz"), F.lit(GENERATED_DAY).cast("timestamp_ntz")
        ),
        "BLOB": lambda c: F.octet_length(c).between(1, 1024),
    }
    good = F.lit(True)
    for f in schema.fields[1:]:
        holds = rules[f.metadata["declared"].split("(")[0]](col(f.name))
        good = good & F.coalesce(holds, F.lit(f.nullable))
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(good).alias("in_range"))
