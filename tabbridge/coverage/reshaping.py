"""Result documents derived from events: JSON in, rows out.

A document covers 100 consecutive event ids, so it is bounded whatever the table size.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabbridge.coverage.registry import load, query
from tabbridge.functions.names import col
from tabbridge.operators.reshape import (
    columns_to_rows,
    columns_to_rows_long,
    columns_to_table,
    documents_to_rows,
    json_to_columns,
    json_to_csv,
)
from tabbridge.session import workspace

BUCKET = 100


def _buckets(spark, sf):
    """bucket, ids, kinds and users of 100 event ids, in id order."""
    events = load(spark, sf, "events").select(
        F.floor(col("event_id") / BUCKET).cast("long").alias("bucket"),
        F.struct("event_id", "event_type", "user_id").alias("e"),
    )
    rows = F.array_sort(F.collect_list("e"))
    return events.groupBy("bucket").agg(rows.alias("e"))


def _entry(values, idx, party=None, asset=None):
    fields = [values.alias("value"), F.lit(idx).alias("item_idx")]
    if party:
        fields += [
            F.lit("id-" + party).alias("party_id"),
            F.lit(party).alias("party_name"),
            F.lit(asset).alias("asset_name"),
        ]
    return F.struct(*fields)


def _column_documents(spark, sf):
    """Two documents per result: ids and kinds come from different parties."""
    buckets = _buckets(spark, sf)
    kinds = F.transform("e", lambda x: x["event_type"])
    ids = F.transform("e", lambda x: x["event_id"])
    # the user column is one value short, so the last row of a result has no user
    users = F.transform(F.slice("e", F.lit(1), F.size("e") - 1), lambda x: x["user_id"])
    first = F.to_json(F.struct(_entry(kinds, 2, "P1", "events").alias("kind")))
    second = F.to_json(
        F.struct(_entry(ids, 1).alias("id"), _entry(users, 3, "P2", "users").alias("user"))
    )
    return buckets.select("bucket", F.explode(F.array(first, second)).alias("doc"))


_NUMBERED = f"""
    WITH n AS (SELECT event_id // {BUCKET} AS bucket, event_id, event_type, user_id,
                      row_number() OVER (PARTITION BY event_id // {BUCKET} ORDER BY event_id) - 1
                          AS pos,
                      count(*) OVER (PARTITION BY event_id // {BUCKET}) AS size
               FROM events)
"""


@query(
    "columns_to_rows_long",
    _NUMBERED
    + """
    SELECT bucket, pos, 2 AS item_idx, 'P1.events.kind' AS name,
           '"' || event_type || '"' AS value FROM n
    UNION ALL SELECT bucket, pos, 1, 'id', CAST(event_id AS VARCHAR) FROM n
    UNION ALL SELECT bucket, pos, 3, 'P2.users.user', CAST(user_id AS VARCHAR) FROM n
    WHERE pos < size - 1
    """,
)
def long_rows(spark, sf):
    return columns_to_rows_long(_column_documents(spark, sf), "doc", ["bucket"])


@query(
    "columns_to_rows",
    _NUMBERED
    + """
    SELECT bucket, pos,
           concat('{"id":', event_id, ',"P1.events.kind":"', event_type, '"',
                  CASE WHEN pos < size - 1 THEN concat(',"P2.users.user":', user_id) ELSE '' END,
                  '}') AS row
    FROM n
    """,
)
def row_objects(spark, sf):
    return columns_to_rows(_column_documents(spark, sf), "doc", ["bucket"])


@query(
    "columns_to_table",
    _NUMBERED
    + """
    SELECT bucket, pos, CAST(event_id AS VARCHAR) AS id,
           '"' || event_type || '"' AS kind
    FROM n
    """,
)
def wide_rows(spark, sf):
    wide = columns_to_table(
        _column_documents(spark, sf), "doc", ["id", "P1.events.kind"], ["bucket"]
    )
    return wide.withColumnRenamed("P1.events.kind", "kind")


@query(
    "documents_to_rows",
    _NUMBERED
    + f"""
    SELECT bucket, pos, concat('{{"id":', event_id, ',"kind":"', event_type, '"}}') AS row
    FROM n WHERE bucket % 4 IN (0, 1)
    UNION ALL
    SELECT bucket, pos, concat('{{"ids":', event_id, '}}') FROM n WHERE bucket % 4 = 2
    UNION ALL
    SELECT bucket, pos + size, concat('{{"users":', user_id, '}}') FROM n WHERE bucket % 4 = 2
    """,
)
def document_rows(spark, sf):
    """Zipped columns, row arrays, mixed members with an array inside a string, and blanks."""
    ids = F.transform("e", lambda x: x["event_id"])
    kinds = F.transform("e", lambda x: x["event_type"])
    users = F.transform("e", lambda x: x["user_id"])
    rows = F.transform("e", lambda x: F.struct(x["event_id"].alias("id"), x["event_type"].alias("kind")))
    mixed = F.struct(
        ids.alias("ids"), F.lit("not a list").alias("note"), F.to_json(users).alias("users")
    )
    documents = _buckets(spark, sf).select(
        "bucket",
        F.when(col("bucket") % 4 == 0, F.to_json(F.struct(kinds.alias("kind"), ids.alias("id"))))
        .when(col("bucket") % 4 == 1, F.to_json(rows))
        .when(col("bucket") % 4 == 2, F.to_json(mixed))
        .otherwise(F.lit(" "))
        .alias("doc"),
    )
    return documents_to_rows(documents, "doc", ["bucket"])


def _records(spark, sf):
    """event_id and a JSON record; every third record lacks a member of the first."""
    events = load(spark, sf, "events")
    full = F.to_json(
        F.struct(
            "event_type",
            "user_id",
            F.struct("user_id", "event_type").alias("nested"),
            F.array("user_id").alias("list"),
        )
    )
    short = F.to_json(F.struct("user_id", F.lit("x").alias("unlisted")))
    return events.select(
        "event_id", F.when(col("event_id") % 3 == 2, short).otherwise(full).alias("record")
    )


_RECORD_SQL = """
    CASE WHEN event_id % 3 = 2 THEN '' ELSE event_type END AS event_type,
    CAST(user_id AS VARCHAR) AS user_id,
    CASE WHEN event_id % 3 = 2 THEN ''
         ELSE concat('{"user_id":', user_id, ',"event_type":"', event_type, '"}') END AS nested,
    CASE WHEN event_id % 3 = 2 THEN '' ELSE concat('[', user_id, ']') END AS list
"""


@query("json_to_columns", f"SELECT event_id, {_RECORD_SQL} FROM events")
def json_columns(spark, sf):
    return json_to_columns(_records(spark, sf), "record", "event_id", ["event_id"], "first")


@query(
    "json_to_columns_union",
    f"""
    SELECT event_id, {_RECORD_SQL}, CASE WHEN event_id % 3 = 2 THEN 'x' ELSE '' END AS unlisted
    FROM events
    """,
)
def json_columns_union(spark, sf):
    return json_to_columns(_records(spark, sf), "record", "event_id", ["event_id"])


@query("json_to_csv", f"SELECT {_RECORD_SQL} FROM events")
def json_csv(spark, sf):
    path = workspace(spark, "json-csv")
    json_to_csv(_records(spark, sf), "record", "event_id", path, "first")
    return (
        spark.read.option("header", True).option("escape", '"').csv(path).na.fill("")
    )


@query(
    "json_props_to_columns",
    "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
)
def props_columns(spark, sf):
    return json_to_columns(load(spark, sf, "events"), "props", "event_id", ["event_id"])
