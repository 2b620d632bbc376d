import datetime as dt
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabbridge.functions.coerce import clock_text, coerce_values, seconds_of_day, truncate_decimal
from tabbridge.functions.declared import (
    ColumnInfo,
    cast_declared,
    conform,
    declared_schema,
    declared_type,
    require_flat,
    warehouse_type,
)
from tabbridge.functions.sizing import batch_rows_for, size_tier, tier_partitions
from tabbridge.functions.text import (
    clean_line_breaks,
    hash_key,
    normalize_null,
    rows_as_text,
    stringify_table,
)


def values(spark, texts, make):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["v"] for r in df.select("i", make(F.col("t")).alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("name", "dialect", "want"),
    [
        ("TINYINT", "mysql", T.ByteType()),
        ("MEDIUMINT", "mysql", T.IntegerType()),
        ("int unsigned", "tidb", T.LongType()),
        ("UNSIGNED BIGINT", "mysql", T.DecimalType(20, 0)),
        ("DECIMAL", "mysql", T.DecimalType(38, 10)),
        ("decimal(18,4)", "mysql", T.DecimalType(18, 4)),
        ("DECIMAL( 10 , 2 )", "mysql", T.DecimalType(10, 2)),
        ("DECIMAL", "doris", T.DecimalType(10, 0)),
        ("NUMERIC(20)", "kingbase", T.DecimalType(20, 0)),
        ("FLOAT", "mysql", T.FloatType()),
        ("FLOAT", "kingbase", T.DoubleType()),
        ("REAL", "vastbase", T.FloatType()),
        ("INT8", "kingbase", T.LongType()),
        ("double precision", "vastbase", T.DoubleType()),
        ("VARCHAR(255)", "gbase", T.StringType()),
        ("LONGTEXT", "tdsql", T.StringType()),
        ("BLOB", "mysql", T.BinaryType()),
        ("BYTEA", "kingbase", T.BinaryType()),
        ("DATETIME", "mysql", T.TimestampNTZType()),
        ("TIME", "kingbase", T.StringType()),
        ("GEOMETRY", "mysql", T.StringType()),
    ],
)
def test_declared_type(name, dialect, want):
    assert declared_type(name, dialect) == want


def test_declared_schema_errors():
    with pytest.raises(ValueError, match="no columns"):
        declared_schema([])
    with pytest.raises(ValueError, match="empty"):
        declared_schema([(" ", "INT")])
    with pytest.raises(ValueError, match="unsupported database"):
        declared_type("INT", "oracle")


def test_cast_declared_leaves_other_columns(spark):
    df = spark.createDataFrame([("7", "x")], "a string, b string")
    assert cast_declared(df, {"a": "BIGINT"}).dtypes == [("a", "bigint"), ("b", "string")]


def test_conform(spark):
    df = spark.createDataFrame([("1", None), (None, "b")], "a string, b string")
    rows = conform(df, [ColumnInfo("b", "VARCHAR(3)", default="z"), ColumnInfo("a", "INT")])
    assert [tuple(r) for r in rows.collect()] == [("z", 1), ("b", None)]
    with pytest.raises(PySparkException, match="must not be NULL"):
        conform(df, [ColumnInfo("a", "INT", nullable=False)]).collect()


def test_warehouse_types():
    assert warehouse_type(T.DecimalType(12, 3)) == "DECIMAL(12,3)"
    assert warehouse_type(T.TimestampNTZType()) == "DATETIME"
    assert warehouse_type(T.BinaryType()) == "VARCHAR(65533)"


def test_nested_columns_are_rejected(spark, sf):
    with pytest.raises(ValueError, match="embedding"):
        require_flat(spark.read.parquet(f"{sf}/embeddings.parquet").schema)


def test_decimals_are_cut_not_rounded(spark):
    texts = ["1.239", "-1.239", "0.999", "-0.001", "5", "12345678.10", None]
    got = values(spark, texts, lambda c: truncate_decimal(c.cast("decimal(20,6)"), 12, 2))
    assert got == [
        Decimal("1.23"), Decimal("-1.23"), Decimal("0.99"), Decimal("0.00"), Decimal("5.00"),
        Decimal("12345678.10"), None,
    ]


def test_double_is_cut_by_its_printed_form(spark):
    df = spark.createDataFrame([(0.29,), (2.675,)], "d double")
    got = df.select(truncate_decimal(F.col("d"), 10, 2).alias("v")).collect()
    assert [r["v"] for r in got] == [Decimal("0.29"), Decimal("2.67")]


def test_null_policies(spark):
    schema = "s string, i int, d decimal(5,2), t timestamp_ntz, day date, b boolean"
    df = spark.createDataFrame(
        [
            (None, None, None, None, None, None),
            ("x", 1, Decimal("1.50"), dt.datetime(2024, 5, 6), dt.date(2024, 5, 6), True),
            ("", 0, Decimal("0"), dt.datetime(2024, 5, 6, 7, 8, 9, 500), None, False),
        ],
        schema,
    )
    assert coerce_values(df).collect() == df.collect()
    legacy = [tuple(r) for r in coerce_values(df, "legacy").collect()]
    assert legacy == [
        (" ", 0, Decimal("0.00"), " ", " ", None),
        ("x", 1, Decimal("1.50"), "2024-05-06", "2024-05-06", True),
        ("", 0, Decimal("0.00"), "2024-05-06 07:08:09", " ", False),
    ]
    assert [r["s"] for r in coerce_values(df, "csv").collect()] == ["", "x", ""]
    assert coerce_values(df, "csv").first()["i"] is None
    with pytest.raises(ValueError, match="null_policy"):
        coerce_values(df, "other")


def test_null_tokens(spark):
    texts = ["\\N", "\\\\N", "null", " NULL\t", "Nullable", "", "  a ", None, "\\n"]
    assert values(spark, texts, normalize_null) == [
        "", "", "", "", "Nullable", "", "  a ", None, "\\n",
    ]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a\nb", "ab"),
        ("\n\n", ""),
        ("x\r\ry", "xy"),
        ("prefix\r\nsuffix", "prefixsuffix"),
        ("  a \n b  ", "  a  b  "),
        ("\rhello\r\nworld\n", "helloworld"),
        ("plain", "plain"),
        ("", ""),
    ],
)
def test_line_breaks(spark, text, want):
    assert values(spark, [text], clean_line_breaks) == [want]


def test_stringify(spark):
    schema = "s string, i tinyint, f double, d decimal(6,3), b boolean, day date, t timestamp_ntz, x binary"
    df = spark.createDataFrame(
        [
            ("a", 1, 2.5, Decimal("1.5"), True, dt.date(1970, 1, 3), dt.datetime(1970, 1, 1, 0, 0, 1), b"\x00\xff"),
            (None,) * 8,
            ("", -1, -0.1234567, Decimal("-1"), False, dt.date(1969, 12, 31), dt.datetime(1969, 12, 31, 23, 59, 59), b""),
        ],
        schema,
    )
    assert [tuple(r) for r in stringify_table(df).collect()] == [
        ("a", "1", "2.500000", "1.500", "true", "2", "1000000", "0x00ff"),
        ("",) * 8,
        ("", "-1", "-0.123457", "-1.000", "false", "-1", "-1000000", "0x"),
    ]


def test_rows_as_text(spark):
    df = spark.createDataFrame([(1, None, True), (None, "x", None)], "a int, b string, c boolean")
    assert [tuple(r) for r in rows_as_text(df).collect()] == [("1", "", "true"), ("", "x", "")]


def test_hash_key_separates_fields(spark):
    df = spark.createDataFrame(
        [("ab", "c"), ("a", "bc"), (None, "c"), ("\\N", "c")], "a string, b string"
    )
    got = [r[0] for r in df.select(hash_key(df, ["a", "b"])).collect()]
    assert len(set(got)) == 3  # a NULL and the text \N share a hash, by definition
    assert got[2] == got[3]
    with pytest.raises(ValueError, match="at least one"):
        hash_key(df, [])


def test_batch_rows():
    text, numbers = T.StringType(), T.LongType()
    small = T.StructType([T.StructField("a", numbers)])
    wide = T.StructType([T.StructField(f"c{i}", text) for i in range(10)])
    assert batch_rows_for(small, 1000) == 1000
    assert batch_rows_for(wide, 5000) == int(5000 * 3145728 / (1000 * 5000 * 6 // 5))


def test_size_tier(spark):
    df = spark.createDataFrame([(n,) for n in (10, 11, 100, 101, 1000, 1001)], "n int")
    got = [r["t"] for r in df.select(size_tier(F.col("n"), 10, 100, 1000).alias("t")).collect()]
    assert got == ["small", "medium", "medium", "large", "large", "xlarge"]


@pytest.mark.parametrize(
    ("rows", "want"), [(None, 10), (0, 1), (10, 1), (11, 4), (1000, 16), (1001, 64), (10**9, 64)]
)
def test_tier_partitions(rows, want):
    assert tier_partitions(rows, [10, 100, 1000, 10_000], [1, 4, 16, 64]) == want


def test_time_of_day(spark):
    texts = ["07:15:30", "7:15:30", "23:59:59.75", "00:00:00", "24:00:00", "07:60:00", "7:5:30", "quarter past", "", None, " 07:15:30"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(seconds_of_day(F.col("t")).alias("s"), seconds_of_day(F.col("t"), "legacy").alias("l")).collect()
    want = [26_130, 26_130, 86_399, 0, *[None] * 7]
    assert [r["s"] for r in got] == want
    assert [r["l"] for r in got] == [w or 0 for w in want]
    back = spark.createDataFrame([(26_130,), (86_399,), (0,), (86_400,), (-1,), (None,)], "s int").select(clock_text(F.col("s")).alias("t"))
    assert [r["t"] for r in back.collect()] == ["07:15:30", "23:59:59", "00:00:00", None, None, None]
