"""File forms: every query writes in the shared folder and reads back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabbridge.coverage.registry import load, query, scratch_database
from tabbridge.functions.text import FIELD_SEPARATOR, ROW_SEPARATOR
from tabbridge.operators.stats import load_verdict
from tabbridge.operators.tables import project_by_name
from tabbridge.plans.imports import load_delimited
from tabbridge.session import isolated, workspace
from tabbridge.sources.arrow_files import PARTITION_BYTES
from tabbridge.sources.delimited import (
    load_counters,
    load_with_rejects,
    read_delimited,
    write_delimited,
)
from tabbridge.sources.files import (
    file_manifest,
    load_arrow_file,
    load_csv_file,
    read_arrow,
    read_files,
    write_arrow,
    write_files,
)
from tabbridge.sources.parts import export_csv, export_parquet, read_parts
from tabbridge.sources.snapshot import read_snapshot, write_snapshot


@query(
    "export_parquet",
    """
    SELECT l_returnflag, l_extendedprice, l_orderkey, l_quantity
    FROM lineitem WHERE l_quantity >= 10 AND l_returnflag IN ('A', 'R')
    """,
)
def export_lineitem(spark, sf):
    path = workspace(spark, "export")
    export_parquet(
        load(spark, sf, "lineitem"),
        path,
        ["l_orderkey", "l_quantity", "l_extendedprice", "l_returnflag"],
        [("l_quantity", ">=", 10), ("l_returnflag", "IN", ["A", "R"])],
        [("l_extendedprice", "DESC"), ("l_orderkey", "ASC")],
        from_scan=True,
    )
    return read_parts(
        spark, path, ["l_returnflag", "l_extendedprice", "l_orderkey", "l_quantity"]
    )


@query(
    "export_parquet_part_order",
    "SELECT count(*) AS rows, true AS parts_follow_row_order FROM orders",
)
def export_part_order(spark, sf):
    """The key ranges of consecutive parts follow each other."""
    path = workspace(spark, "export")
    export_parquet(
        load(spark, sf, "orders"), path, ["o_orderkey"], sort=["o_orderkey"], from_scan=True
    )
    parts = (
        read_parts(spark, path, part_column="part")
        .groupBy("part")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("o_orderkey").alias("low"),
            F.max("o_orderkey").alias("high"),
        )
    )
    # one row per part: sorted by part number, each part must start after the one before
    listed = parts.agg(
        F.sum("n").alias("rows"),
        F.array_sort(F.collect_list(F.struct("part", "low", "high"))).alias("p"),
    )
    later = F.transform(
        F.sequence(F.lit(1), F.size("p") - 1),
        lambda i: F.get("p", i)["low"] >= F.get("p", i - 1)["high"],
    )
    ordered = F.when(F.size("p") > 1, F.forall(later, lambda x: x)).otherwise(F.lit(True))
    return listed.select("rows", ordered.alias("parts_follow_row_order"))


@query("export_csv", "SELECT p_partkey, p_name, p_brand, p_retailprice FROM part")
def export_part_csv(spark, sf):
    path = workspace(spark, "csv")
    parts = load(spark, sf, "part")
    columns = ["p_partkey", "p_name", "p_brand", "p_retailprice"]
    export_csv(parts, path, columns, column_separator="|")
    schema = project_by_name(parts, columns).schema
    return load_csv_file(spark, path, schema, separator="|", multiline=False)


def _export_capped(spark, sf, form, cap):
    """(rows read back, files, bytes of the largest file) of an export of all documents."""
    path = workspace(spark, f"capped_{form}")
    documents = load(spark, sf, "documents")
    if form == "parquet":
        export_parquet(documents, path, max_file_bytes=cap)
        back = read_parts(spark, path)
    elif form == "csv":
        export_csv(documents, path, max_file_bytes=cap)
        back = load_csv_file(spark, path, documents.schema)
    elif form == "delimited":
        write_delimited(documents, path, max_file_bytes=cap)
        back = read_delimited(spark, path, documents.schema)
    else:
        write_snapshot(documents, path, "documents", max_file_bytes=cap)
        back = read_snapshot(spark, path, documents.schema).rows
        path = f"{path}/data"
    return back, file_manifest(spark, path).where("path NOT LIKE '%/.%'")


@query(
    "export_file_sizes",
    """
    SELECT form, d.doc_id, nullif(trim(d.text, ' ' || chr(9) || chr(10) || chr(13)), '') AS text, d.lang, d.source, d.n_chars,
           true AS below_cap, true AS several
    FROM documents d, (VALUES ('parquet'), ('csv'), ('delimited'), ('snapshot')) f(form)
    """,
)
def export_file_sizes(spark, sf):
    """No file of an export is above the cap, however long the texts are, and all rows come back."""
    sizes = load(spark, sf, "documents").agg(F.max(F.octet_length("text")).alias("longest"), F.sum(F.octet_length("text")).alias("all"))
    longest, total = sizes.first()
    cap = max(4 * longest, total // 20)
    out = []
    for form in ("parquet", "csv", "delimited", "snapshot"):
        rows, files = _export_capped(spark, sf, form, cap)
        n, largest = files.agg(F.count(F.lit(1)), F.max("size")).first()
        text = F.nullif(F.trim(F.col("text"), F.lit(" \t\n\r")), F.lit(""))
        out.append(
            rows.withColumns(
                {"text": text, "form": F.lit(form), "below_cap": F.lit(largest <= cap), "several": F.lit(n > 4)}
            )
        )
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


DELIMITED_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("n_chars", T.IntegerType()),
        T.StructField("even", T.BooleanType()),
        T.StructField("day", T.DateType()),
    ]
)
_SPACES = "' ' || chr(9) || chr(10) || chr(13)"
_DELIMITED_SQL = f"""
    SELECT doc_id, nullif(trim({{text}}, {_SPACES}), '') AS text,
           CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE lang END AS lang,
           CASE doc_id % 7 WHEN 0 THEN NULL ELSE CAST(n_chars AS INTEGER) END AS n_chars,
           doc_id % 2 = 0 AS even,
           strftime(CAST('2024-01-01' AS DATE) + CAST(doc_id % 28 AS INTEGER), '%Y-%m-%d') AS day
    FROM documents
"""


def _documents_with_tokens(spark, sf):
    return load(spark, sf, "documents").select(
        "doc_id",
        "text",
        F.when(F.col("doc_id") % 5 == 0, "\\N")
        .when(F.col("doc_id") % 5 == 1, " NULL ")
        .when(F.col("doc_id") % 5 == 2, "\\\\N")
        .otherwise(F.concat(F.lit(" "), "lang", F.lit(" ")))
        .alias("lang"),
        F.when(F.col("doc_id") % 7 != 0, F.col("n_chars").cast("int")).alias("n_chars"),
        (F.col("doc_id") % 2 == 0).alias("even"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 28).cast("int")).alias("day"),
    )


@query("read_delimited", _DELIMITED_SQL.format(text="text"))
def delimited_round_trip(spark, sf):
    """Cells with quotes and line breaks, kept as they are."""
    path = workspace(spark, "delimited")
    write_delimited(_documents_with_tokens(spark, sf), path)
    rows = read_delimited(spark, path, DELIMITED_SCHEMA)
    return rows.withColumn("day", F.col("day").cast("string"))


@query(
    "read_delimited_splittable",
    _DELIMITED_SQL.format(text="regexp_replace(text, '\\r\\n?|\\n', '', 'g')"),
)
def delimited_splittable(spark, sf):
    """Line breaks removed on write, so that the parts can be split on read."""
    path = workspace(spark, "delimited")
    write_delimited(_documents_with_tokens(spark, sf), path, clean_breaks=True)
    rows = read_delimited(spark, path, DELIMITED_SCHEMA, multiline=False)
    return rows.withColumn("day", F.col("day").cast("string"))


#: bytes of a table that one task reads to write a file
WRITER_BYTES = 128 << 20


def _writers(spark, sf, table, least=1):
    """Tasks that write a table: few files, but no task takes more of it as it grows."""
    size = file_manifest(spark, f"{sf}/{table}.parquet").agg(F.sum("size")).first()[0] or 0
    return max(least, -(-size // WRITER_BYTES))


@query(
    "read_delimited_multiline",
    f"""
    SELECT doc_id, trim(replace(replace(text, '. ', '.' || chr(13) || chr(10)), ' a', chr(10) || '"a"'), {_SPACES}) AS text, lang, source,
           n_chars, true AS one_file, true AS several_tasks
    FROM documents
    """,
)
def delimited_multiline(spark, sf):
    """All columns of documents in one file a writing task, with line breaks and quotes in most texts.

    Small tables have one writer. Every file is read by several tasks.
    """
    path, writers = workspace(spark, "delimited"), _writers(spark, sf, "documents")
    broken = F.replace(F.replace(F.col("text"), F.lit(". "), F.lit(".\r\n")), F.lit(" a"), F.lit('\n"a"'))
    documents = load(spark, sf, "documents").withColumn("text", broken)
    write_delimited(documents.coalesce(writers), path, max_file_bytes=1 << 40)
    files = file_manifest(spark, path).where("path NOT LIKE '%/.%'").count()
    rows = read_delimited(spark, path, documents.schema, block_bytes=100_000)
    tasks = rows.rdd.getNumPartitions()
    return rows.withColumns({"one_file": F.lit(files <= writers), "several_tasks": F.lit(tasks > files)})


@query(
    "load_good_rows_all_columns",
    """
    SELECT o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey, o_totalprice,
           strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderstatus, o_orderpriority
    FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0
    """,
)
def load_good_rows_all(spark, sf):
    schema = T.StructType([*ORDER_TEXT.fields, T.StructField("o_orderstatus", T.StringType()), T.StructField("o_orderpriority", T.StringType())])
    good = load_with_rejects(spark, _text_with_bad_cells(spark, sf, whole=True), schema).good
    return good.withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


@query(
    "load_rejects_all_columns",
    """
    SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey,
           CASE WHEN o_orderkey % 11 = 0 THEN 'c' ELSE '' END || o_custkey AS o_custkey,
           CAST(o_totalprice AS VARCHAR) AS o_totalprice,
           CASE WHEN o_orderkey % 13 = 0 THEN '1998-02-30' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS o_orderdate,
           o_orderstatus, o_orderpriority,
           concat_ws(',', CASE WHEN o_orderkey % 11 = 0 THEN 'o_custkey' END,
                     CASE WHEN o_orderkey % 13 = 0 THEN 'o_orderdate' END) AS reject_reason
    FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey % 13 = 0
    """,
)
def load_rejects_all(spark, sf):
    schema = T.StructType([*ORDER_TEXT.fields, T.StructField("o_orderstatus", T.StringType()), T.StructField("o_orderpriority", T.StringType())])
    return load_with_rejects(spark, _text_with_bad_cells(spark, sf, whole=True), schema).rejects


@query(
    "read_delimited_lineitem",
    """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
           l_discount, l_tax, l_returnflag, l_linestatus,
           strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate
    FROM lineitem
    """,
)
def delimited_lineitem(spark, sf):
    path = workspace(spark, "delimited")
    lineitem = load(spark, sf, "lineitem")
    write_delimited(lineitem, path)
    rows = read_delimited(spark, path, lineitem.schema, multiline=False)
    return rows.withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"))


ORDER_TEXT = T.StructType(
    [
        T.StructField("o_orderkey", T.LongType()),
        T.StructField("o_custkey", T.IntegerType()),
        T.StructField("o_totalprice", T.DoubleType()),
        T.StructField("o_orderdate", T.DateType()),
    ]
)


def _text_with_bad_cells(spark, sf, whole=False):
    """Every 11th customer key is not a number, every 13th date is not a date."""
    path = workspace(spark, "load")
    orders = load(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 11 == 0, F.concat(F.lit("c"), "o_custkey"))
        .otherwise(F.col("o_custkey").cast("string"))
        .alias("o_custkey"),
        "o_totalprice",
        F.when(F.col("o_orderkey") % 13 == 0, "1998-02-30")
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
        .alias("o_orderdate"),
        *(["o_orderstatus", "o_orderpriority"] if whole else []),
    )
    write_delimited(orders, path)
    return path


def _orders_with_bad_cells(spark, sf):
    return load_with_rejects(spark, _text_with_bad_cells(spark, sf), ORDER_TEXT, multiline=False)


@query(
    "load_delimited",
    """
    SELECT o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey, o_totalprice,
           (SELECT count(*) FROM orders) AS total, count(*) OVER () AS loaded,
           (SELECT count(*) FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey % 13 = 0) AS failed
    FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0
    """,
)
def load_into_table(spark, sf):
    """One parse of the text gives the table, the rejects and the counters."""
    table = f"{scratch_database(spark, 'load')}.orders"
    path = _text_with_bad_cells(spark, sf)
    report = load_delimited(
        spark, path, ORDER_TEXT, table, workspace(spark, "rejects"), multiline=False
    )
    counters = {k: F.lit(v).cast("long") for k, v in report._asdict().items()}
    return spark.table(table).drop("o_orderdate").withColumns(counters)


@query(
    "load_good_rows",
    """
    SELECT o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey, o_totalprice,
           strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate
    FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0
    """,
)
def load_good_rows(spark, sf):
    good = _orders_with_bad_cells(spark, sf).good
    return good.withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


@query(
    "load_rejects",
    """
    SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey,
           CASE WHEN o_orderkey % 11 = 0 THEN 'c' ELSE '' END || o_custkey AS o_custkey,
           CASE WHEN o_orderkey % 13 = 0 THEN '1998-02-30'
                ELSE strftime(o_orderdate, '%Y-%m-%d') END AS o_orderdate,
           concat_ws(',', CASE WHEN o_orderkey % 11 = 0 THEN 'o_custkey' END,
                     CASE WHEN o_orderkey % 13 = 0 THEN 'o_orderdate' END) AS reject_reason
    FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey % 13 = 0
    """,
)
def load_rejects(spark, sf):
    return _orders_with_bad_cells(spark, sf).rejects.drop("o_totalprice")


@query(
    "load_verdict",
    """
    SELECT count(*) AS total_rows,
           count(*) FILTER (o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0) AS loaded_rows,
           count(*) FILTER (o_orderkey % 11 = 0 OR o_orderkey % 13 = 0) AS failed_rows,
           count(*) FILTER (o_orderkey % 11 = 0 OR o_orderkey % 13 = 0) = 0 AS success
    FROM orders
    """,
)
def verdict(spark, sf):
    return load_verdict(load_counters(_orders_with_bad_cells(spark, sf).rows))


@query(
    "snapshot_documents",
    """
    SELECT doc_id, nullif(text, '') AS text, nullif(lang, '') AS lang, n_chars FROM documents
    """,
)
def snapshot_documents(spark, sf):
    path = workspace(spark, "snapshot")
    documents = load(spark, sf, "documents").drop("source")
    write_snapshot(documents, path, "documents")
    return read_snapshot(spark, path, documents.schema).rows


@query(
    "snapshot_types",
    """
    SELECT c_custkey, c_name, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment, c_acctbal,
           c_nationkey, c_acctbal > 0 AS positive, lower(hex(encode(c_name))) AS name_bytes
    FROM customer
    """,
)
def snapshot_types(spark, sf):
    path = workspace(spark, "snapshot")
    customers = load(spark, sf, "customer").select(
        "c_custkey",
        "c_name",
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"),
        "c_acctbal",
        "c_nationkey",
        (F.col("c_acctbal") > 0).alias("positive"),
        F.col("c_name").cast("binary").alias("name_bytes"),
    )
    write_snapshot(customers, path, "customer", "kingbase")
    rows = read_snapshot(spark, path, customers.schema).rows
    return rows.withColumn("name_bytes", F.lower(F.hex("name_bytes")))


@query("snapshot_bad_rows", "SELECT count(*) FILTER (s_suppkey % 4 = 0) AS bad_rows FROM supplier")
def snapshot_bad_rows(spark, sf):
    """Lines with a surplus field are counted, not lost silently."""
    path = workspace(spark, "snapshot")
    suppliers = load(spark, sf, "supplier")
    lines = suppliers.select(
        F.concat_ws(
            FIELD_SEPARATOR,
            F.col("s_suppkey").cast("string"),
            "s_name",
            F.when(F.col("s_suppkey") % 4 == 0, "surplus"),
        )
    )
    lines.write.option("lineSep", ROW_SEPARATOR).text(f"{path}/data")
    schema = project_by_name(suppliers, ["s_suppkey", "s_name"]).schema
    return read_snapshot(spark, path, schema).bad.select("bad_rows")


@query(
    "snapshot_bad_cells",
    """
    SELECT count(*) FILTER (o_orderkey % 7 = 0) AS wrong_fields,
           count(*) FILTER (o_orderkey % 7 <> 0 AND o_orderkey % 5 = 0) AS wrong_values,
           count(*) FILTER (o_orderkey % 7 = 0 OR o_orderkey % 5 = 0) AS bad_rows,
           count(*) FILTER (o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0) AS good_rows,
           CAST(sum(o_custkey) FILTER (o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0) AS BIGINT) AS key_sum
    FROM orders
    """,
)
def snapshot_bad_cells(spark, sf):
    """Cells that are no value of their type make a bad row, not a NULL."""
    path = workspace(spark, "snapshot")
    orders = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    odd = F.when(F.col("o_orderkey") % 5 == 0, "oops").otherwise(F.col("o_custkey").cast("string"))
    surplus = F.when(F.col("o_orderkey") % 7 == 0, "surplus")
    lines = orders.select(
        F.concat_ws(FIELD_SEPARATOR, F.col("o_orderkey").cast("string"), odd, F.col("o_orderdate").cast("string"), surplus)
    )
    lines.write.option("lineSep", ROW_SEPARATOR).text(f"{path}/data")
    back = read_snapshot(spark, path, orders.schema)
    good = back.rows.agg(F.count(F.lit(1)).alias("good_rows"), F.sum("o_custkey").alias("key_sum"))
    return back.bad.crossJoin(good)  # one row each


_SUPPLIER_SQL = "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier"


def _register_format(fmt):
    @query(f"files_{fmt}", _SUPPLIER_SQL)
    def round_trip(spark, sf):
        path = workspace(spark, fmt)
        suppliers = load(spark, sf, "supplier")
        write_files(suppliers, path, fmt)
        return read_files(spark, path, fmt, suppliers.schema)


for _fmt in ("csv", "json", "parquet", "orc"):
    _register_format(_fmt)


@query("files_text", "SELECT c_name AS value FROM customer")
def files_text(spark, sf):
    path = workspace(spark, "text")
    write_files(load(spark, sf, "customer").select(F.col("c_name").alias("value")), path, "text")
    return read_files(spark, path, "text")


@query("files_arrow", "SELECT * FROM lineitem")
def files_arrow(spark, sf):
    """All columns; the second write takes the place of the first."""
    path = workspace(spark, "arrow")
    lineitem = load(spark, sf, "lineitem")
    write_files(lineitem.where("l_linenumber = 1"), path, "arrow")
    write_files(lineitem, path, "arrow", mode="overwrite", max_rows_per_file=40000)
    return read_files(spark, path, "arrow", lineitem.schema)


@query("load_arrow_file", "SELECT s_name, s_suppkey FROM supplier")
def load_arrow_columns(spark, sf):
    path = workspace(spark, "arrow")
    suppliers = load(spark, sf, "supplier")
    write_arrow(suppliers, path)
    return load_arrow_file(spark, path, suppliers.schema, ["s_name", "s_suppkey"])


@query(
    "arrow_files_split",
    "SELECT *, true AS files_split, (SELECT count(*) FROM lineitem) AS written FROM lineitem",
)
def arrow_files_split(spark, sf):
    """Files of many batches: several tasks read one file, and the manifest counts every row."""
    path, own, writers = workspace(spark, "arrow"), isolated(spark), _writers(spark, sf, "lineitem", 2)
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    manifest = write_arrow(load(own, sf, "lineitem").coalesce(writers), path, max_rows_per_file=10_000_000)
    size = file_manifest(spark, path).where("path LIKE '%.arrow'").agg(F.sum("size")).first()[0]
    rows = read_arrow(spark, path, load(spark, sf, "lineitem").schema, partition_bytes=min(size // (2 * writers + 1), PARTITION_BYTES))
    split = rows.rdd.getNumPartitions() > manifest.count()
    written = manifest.groupBy().sum("rows").first()[0]
    return rows.withColumns({"files_split": F.lit(split), "written": F.lit(written)})


@query(
    "load_arrow_file_columns",
    """
    SELECT o_orderpriority, strftime(o_orderdate, '%H:%M:%S') AS at, o_totalprice, o_orderkey, o_custkey, o_orderstatus
    FROM orders
    """,
)
def load_arrow_orders(spark, sf):
    """All orders, columns picked in another order; a time of day is stored as seconds."""
    path = workspace(spark, "arrow")
    orders = load(spark, sf, "orders").withColumn("at", F.date_format("o_orderdate", "HH:mm:ss"))
    write_arrow(orders, path, time_columns=["at"])
    columns = ["o_orderpriority", "at", "o_totalprice", "o_orderkey", "o_custkey", "o_orderstatus"]
    return load_arrow_file(spark, path, columns=columns)


@query("load_csv_file", "SELECT doc_id, text FROM documents")
def load_csv_columns(spark, sf):
    """CSV text with quotes, separators and line breaks, typed and projected."""
    path = workspace(spark, "csv")
    documents = load(spark, sf, "documents")
    export_csv(documents, path, column_separator=";")
    return load_csv_file(spark, path, documents.schema, ["doc_id", "text"], separator=";")
