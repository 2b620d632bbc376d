import datetime as dt
from decimal import Decimal
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import types as T

from tabbridge.functions.names import ColumnsNotFound
from tabbridge.session import workspace
from tabbridge.sources.delimited import load_with_rejects, read_delimited, write_delimited
from tabbridge.sources.files import file_format, file_manifest, load_csv_file, read_arrow, read_files, write_arrow, write_files
from tabbridge.sources.parts import export_csv, export_parquet, part_rows, read_parts
from tabbridge.sources.snapshot import read_snapshot, snapshot_ddl, write_snapshot

TYPED = (
    "i tinyint, n bigint, f float, d double, p decimal(12,3), b boolean, "
    "day date, t timestamp_ntz, x binary, s string"
)
FULL = (1, 2**40, 1.5, -0.1, Decimal("12.345"), True, dt.date(2024, 2, 29),
        dt.datetime(2024, 2, 29, 1, 2, 3, 450000), b"\x00\xfe", 'say "hi"\nthere, \\N')


@pytest.fixture
def path(spark):
    return workspace(spark, "test")


@pytest.fixture(scope="module")
def typed(spark):
    low = (-128, -1, 0.0, 1e300, Decimal("-0.001"), False, dt.date(1900, 1, 1),
           dt.datetime(1969, 12, 31, 23, 59, 59), b"\x01", "é 漢字")
    return spark.createDataFrame([FULL, (None,) * 10, low], TYPED)


def text_file(path, name, text):
    Path(path).mkdir(parents=True, exist_ok=True)
    (Path(path) / name).write_text(text, encoding="utf8", newline="")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_delimited_round_trip(spark, typed, path):
    write_delimited(typed, path)
    assert rows(read_delimited(spark, path, typed.schema)) == rows(typed)


def test_snapshot_round_trip(spark, typed, path):
    write_snapshot(typed, path, "t")
    back = read_snapshot(spark, path, typed.schema)
    assert rows(back.rows) == rows(typed)
    assert back.bad.first()["bad_rows"] == 0
    ddl = "".join(r[0] + "\n" for r in spark.read.text(f"{path}/schema").collect())
    assert ddl == snapshot_ddl(typed.schema, "t")


def test_delimited_cells(spark, path):
    text_file(path, "0.csv", "a\x01b\x01c\n" + "\n".join(
        ["John\x0125\x01x", "Jane", "Mike\x0128\x01Seattle\x01surplus", "NULL\x01\\N\x01\\\\N",
         " pad \x01 7 \x01", '"{""k"":30,""v"":900}"\x011\x01\'q"u']))
    text_file(path, "1.csv", "a\x01b\x01c\nsecond\x015\x01part\n")
    schema = "a string, b int, c string"
    schema = spark.createDataFrame([], schema).schema
    got = rows(read_delimited(spark, path, schema))
    assert got == sorted(
        [
            ("John", 25, "x"), ("Jane", None, None), ("Mike", 28, "Seattle"), (None, None, None),
            ("pad", 7, None), ('{"k":30,"v":900}', 1, "'q\"u"), ("second", 5, "part"),
        ],
        key=repr,
    )
    csv_policy = read_delimited(spark, path, schema, null_policy="csv")
    assert ("Jane", None, "") in rows(csv_policy)
    assert ("", None, "") in rows(csv_policy)


@pytest.mark.parametrize(
    ("kind", "good", "bad"),
    [
        ("tinyint", {"127": 127, "-128": -128}, ["128", "1.5", "x"]),
        ("int", {"+5": 5}, ["2147483648", "1e3"]),
        ("double", {"1e3": 1000.0, ".5": 0.5, "-2": -2.0}, ["1.5d", "abc", "1,5"]),
        ("boolean", {"t": True, "1": True, "FALSE": False, "0": False}, ["yes", "n", "2"]),
        ("date", {"2024-02-29": dt.date(2024, 2, 29)}, ["2023-02-29", "2024-2-3", "2024"]),
        (
            "timestamp_ntz",
            {
                "2024-01-02 03:04:05": dt.datetime(2024, 1, 2, 3, 4, 5),
                "2024-01-02 03:04:05.250": dt.datetime(2024, 1, 2, 3, 4, 5, 250000),
                "2024-01-02T03:04:05Z": dt.datetime(2024, 1, 2, 3, 4, 5),
                "2024-01-02": dt.datetime(2024, 1, 2),
            },
            ["2024-01", "03:04:05", "2024-01-02 25:00:00"],
        ),
        ("binary", {"00fF": bytearray(b"\x00\xff")}, ["0", "zz"]),
        ("decimal(6,2)", {"12.34": Decimal("12.34")}, ["123456.7", "x"]),
    ],
)
def test_strict_parse(spark, path, kind, good, bad):
    schema = spark.createDataFrame([], f"n int, v {kind}").schema
    cells = list(good) + bad
    lines = [f"{i}\x01{c}" for i, c in enumerate(cells)] + ["99\x01"]
    text_file(path, "0.csv", "n\x01v\n" + "\n".join(lines) + "\n")
    load = load_with_rejects(spark, path, schema)
    loaded = {r["n"]: r["v"] for r in load.good.collect()}
    assert loaded == {**dict(enumerate(good.values())), 99: None}
    rejected = {r["v"]: r["reject_reason"] for r in load.rejects.collect()}
    assert rejected == {c: "v" for c in bad}
    with pytest.raises(PySparkException, match="column v: cannot parse"):
        read_delimited(spark, path, schema).collect()


def test_load_counters_come_with_the_write(spark, path):
    text_file(path, "0.csv", "n\x01v\n1\x01a\n2\x01b\nx\x01c\n")
    load = load_with_rejects(spark, path, spark.createDataFrame([], "n int, v string").schema)
    load.rows.write.parquet(path + "-out")
    assert load.counters.get == {"total_rows": 3, "loaded_rows": 2, "failed_rows": 1}


def test_snapshot_file_with_header(spark, path):
    lines = ["a\x01b", "1\x01x\ny", "2\x01", "a\x01b\x01c", "", "x\x01text"]
    text_file(path, "data.csv", "\u2028".join(lines) + "\u2028")
    schema = spark.createDataFrame([], "a int, b string").schema
    back = read_snapshot(spark, path, schema, header=True)
    assert rows(back.rows) == sorted([(1, "x\ny"), (2, None)], key=repr)
    assert back.bad.first().asDict() == {"bad_rows": 2, "wrong_fields": 1, "wrong_values": 1}


@pytest.mark.parametrize("mark", ["\x01", "\u2028"])
def test_snapshot_refuses_separators_in_text(spark, path, mark):
    with pytest.raises(PySparkException, match="separator character"):
        write_snapshot(spark.createDataFrame([(f"a{mark}b",)], "s string"), path, "t")


def test_ddl_quotes():
    schema = T.StructType([T.StructField("a", T.LongType(), False), T.StructField("b", T.StringType())])
    assert snapshot_ddl(schema, "t", "vastbase") == (
        'CREATE TABLE "t" (\n  "a" BIGINT NOT NULL,\n  "b" STRING\n);\n'
    )
    assert snapshot_ddl(schema, "t").startswith("CREATE TABLE `t`")


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "arrow"])
def test_typed_formats(spark, typed, path, fmt):
    # JSON keeps binary as base64 text, so it is left out there
    df = typed.drop("x") if fmt == "json" else typed
    write_files(df, path, fmt)
    assert rows(read_files(spark, path, fmt, df.schema)) == rows(df)


def test_csv_reads_as_text_by_default(spark, path):
    write_files(spark.createDataFrame([(1, " a "), (2, None), (3, "")], "n int, s string"), path, "csv")
    got = read_files(spark, path, "csv")
    assert got.dtypes == [("n", "string"), ("s", "string")]
    assert rows(got) == [("1", " a "), ("2", None), ("3", "")]


def test_format_names():
    assert file_format("FILE_TYPE_PARQUET") == "parquet"
    for name in ("avro", "xlsx"):
        with pytest.raises(ValueError):
            file_format(name)


def test_arrow_stream_form_and_column_choice(spark, path):
    Path(path).mkdir(parents=True)
    table = pa.table({"b": ["x", None], "a": pa.array([1, 2], pa.int32())})
    with pa.OSFile(f"{path}/one.arrow", "wb") as sink, pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    schema = spark.createDataFrame([], "a bigint, b string").schema
    assert rows(read_arrow(spark, path, schema)) == [(1, "x"), (2, None)]


def test_arrow_manifest(spark, path):
    manifest = write_arrow(spark.range(0, 1000, 1, 3), path, max_rows_per_file=200)
    assert manifest.groupBy().sum("rows").first()[0] == 1000
    assert max(r["rows"] for r in manifest.collect()) == 200
    names = sorted(p.name for p in Path(path).iterdir() if not p.name.startswith("."))
    assert names == sorted(r["file"] for r in manifest.collect())


def test_arrow_save_modes(spark, path):
    ten, five = spark.range(0, 10, 1, 4), spark.range(100, 105, 1, 2)

    def ids():
        return sorted(r["id"] for r in read_files(spark, path, "arrow", ten.schema).collect())

    write_files(ten, path, "arrow")
    with pytest.raises(FileExistsError):
        write_files(five, path, "arrow")
    write_files(five, path, "arrow", mode="ignore")
    assert ids() == list(range(10))
    write_files(five, path, "arrow", mode="append")
    assert ids() == [*range(10), *range(100, 105)]
    write_files(five, path, "arrow", mode="overwrite")
    assert ids() == list(range(100, 105))
    with pytest.raises(ValueError, match="save mode"):
        write_files(five, path, "arrow", mode="replace")
    with pytest.raises(ValueError, match="compression"):
        write_files(five, path, "arrow", mode="append", compression="lz4")


def test_export_file_cap_and_order(spark, path):
    df = spark.range(5000).selectExpr("id", "(id * 7919) % 5000 AS v")
    export_parquet(df, path, ["id"], [("id", "<", 4000)], [("v", "DESC")], max_file_bytes=9600)
    parts = read_parts(spark, path, part_column="part")
    assert parts.columns == ["id", "part"]
    counts = part_rows(parts, "part").collect()
    assert sum(r["rows"] for r in counts) == 4000
    files = {f for f in parts.inputFiles()}
    assert len(files) >= 4  # 1000 rows of 8 planned bytes (+20 %) fill a file
    want = [r["id"] for r in df.where("id < 4000").orderBy("v", ascending=False).collect()]
    assert [r["id"] for r in read_parts(spark, path, ["id"], ordered=True).collect()] == want


def test_part_numbers(spark, path):
    for n in (2, 10, 1):
        spark.range(n).coalesce(1).write.parquet(f"{path}/tmp{n}")
        source = next(Path(f"{path}/tmp{n}").glob("*.parquet"))
        Path(f"{path}/parts").mkdir(exist_ok=True)
        (Path(path) / "parts" / f"export_{n}.parquet").write_bytes(source.read_bytes())
    counts = part_rows(read_parts(spark, f"{path}/parts", ["id"], "part"), "part")
    assert {r["part"]: r["rows"] for r in counts.collect()} == {1: 1, 2: 2, 10: 10}
    with pytest.raises(ColumnsNotFound, match="nope"):
        read_parts(spark, f"{path}/parts", ["nope"])


def test_export_csv_separators(spark, path):
    df = spark.createDataFrame([(1, "a;b", None), (2, "", " x ")], "n int, s string, t string")
    export_csv(df, path, ["t", "n", "s"], ";", "\r\n")
    text = "".join(p.read_bytes().decode() for p in sorted(Path(path).glob("*.csv")))
    assert "t;n;s\r\n" in text and ';1;"a;b"\r\n' in text
    schema = spark.createDataFrame([], "t string, n int, s string").schema
    got = load_csv_file(spark, path, schema, ["n", "s", "t"], separator=";")
    assert rows(got) == [(1, "a;b", None), (2, "", " x ")]


def test_file_manifest(spark, path):
    text_file(path, "a.txt", "12345")
    text_file(path, "b.txt", "é")
    got = {Path(r["path"]).name: r for r in file_manifest(spark, path).collect()}
    assert (got["a.txt"]["size"], got["b.txt"]["size"]) == (5, 2)
    import hashlib

    r = got["a.txt"]
    text = f"{r['path']}_5_{r['modified']}"
    assert r["file_id"] == hashlib.md5(text.encode()).hexdigest()


def test_nested_columns_cannot_be_exported(spark, sf, path):
    with pytest.raises(ValueError, match="embedding"):
        export_parquet(spark.read.parquet(f"{sf}/embeddings.parquet"), path)
