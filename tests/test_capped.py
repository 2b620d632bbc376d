"""Files cut by the bytes that are written."""

import random
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tabbridge.session import workspace
from tabbridge.sources.capped import Lines, Parquet, save_lines
from tabbridge.sources.parts import export_csv, export_parquet, read_parts
from tabbridge.sources.publish import Task, store_of


@pytest.fixture
def path(spark):
    return workspace(spark, "capped")


def parts(path):
    return sorted(p for p in Path(path).iterdir() if not p.name.startswith("."))


def texts(n, longest, seed=1):
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyzäöü"
    return ["".join(rng.choices(letters, k=rng.randint(0, longest))) for _ in range(n)]


def fill(writer, tmp_path, batches):
    store, root = store_of(f"file:{tmp_path}")
    task = Task(store, root, "t")
    writer.fill(task, iter(batches))
    return [(tmp_path / name, rows) for name, rows in task.files]


@pytest.mark.parametrize("cap", [40, 97, 1000, 10**6])
def test_lines_below_the_cap(tmp_path, cap):
    lines = [t.replace("\n", "") for t in texts(400, 30)] + ["x" * 200]
    batches = [pa.RecordBatch.from_pydict({"line": lines[k : k + 37]}) for k in range(0, len(lines), 37)]
    files = fill(Lines("", "l", cap, "csv", "\r\n", "head"), tmp_path, batches)
    back = []
    for k, (file, rows) in enumerate(files):
        content = file.read_bytes().decode().split("\r\n")
        assert content[0] == "head" and content[-1] == "" and len(content) - 2 == rows
        assert file.stat().st_size <= cap or rows == 1
        back += content[1:-1]
        if k + 1 < len(files):  # the next line would not have fitted
            following = files[k + 1][0].read_bytes().split(b"\r\n")[1]
            assert file.stat().st_size + len(following) + 2 > cap
    assert back == lines


@pytest.mark.parametrize("cap", [20_000, 300_000, 5_000_000])
def test_parquet_below_the_cap(tmp_path, spark, cap):
    rng = random.Random(2)
    rows = [(i, t, rng.random(), i % 2 == 0, None if i % 3 else i) for i, t in enumerate(texts(3000, 800))]
    schema = spark.createDataFrame([], "id long, text string, x double, even boolean, small short").schema
    columns = list(zip(*rows))
    table = pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.float64(), pa.bool_(), pa.int64()))], ["id", "text", "x", "even", "small"])
    table = table.set_column(4, "small", table["small"].cast(pa.int64()).cast(pa.int16()))
    files = fill(Parquet("", "l", cap, schema), tmp_path, table.to_batches(max_chunksize=500))
    assert all(f.stat().st_size <= cap for f, _ in files)
    back = pa.concat_tables([pq.read_table(f) for f, _ in files])
    assert back.equals(table.cast(back.schema)) and sum(n for _, n in files) == 3000
    if cap >= 300_000:  # below, most of a file is what row groups take beside their values
        assert len(files) <= 3 + 2 * sum(f.stat().st_size for f, _ in files) // cap


def test_a_row_above_the_cap_is_a_file(tmp_path, spark):
    schema = spark.createDataFrame([], "text string").schema
    big = texts(1, 1)[0] + "".join(random.Random(3).choices("abcdefgh ", k=200_000))
    batch = pa.RecordBatch.from_pydict({"text": ["a", big, "b", "c"]})
    files = fill(Parquet("", "l", 20_000, schema), tmp_path, [batch])
    assert [x for f, _ in files for x in pq.read_table(f)["text"].to_pylist()] == ["a", big, "b", "c"]
    assert [n for f, n in files if f.stat().st_size > 20_000] == [1]


def test_exports_of_long_texts(spark, path):
    rows = [(i, t) for i, t in enumerate(texts(2000, 900, 4))]
    df = spark.createDataFrame(rows, "id long, text string")
    export_parquet(df, f"{path}/p", sort=["id"], max_file_bytes=100_000)
    export_csv(df, f"{path}/c", max_file_bytes=100_000)
    for folder in ("p", "c"):
        assert len(parts(f"{path}/{folder}")) > 8
        assert max(p.stat().st_size for p in parts(f"{path}/{folder}")) <= 100_000
    assert [tuple(r) for r in read_parts(spark, f"{path}/p", ordered=True).collect()] == rows
    assert not list(Path(f"{path}/c").glob(".writing-*"))


def test_no_rows_leave_the_columns(spark, path):
    none = spark.createDataFrame([], "id long, text string")
    export_parquet(none, f"{path}/p")
    export_csv(none, f"{path}/c")
    assert read_parts(spark, f"{path}/p").columns == ["id", "text"] and read_parts(spark, f"{path}/p").count() == 0
    assert [p.read_bytes() for p in parts(f"{path}/c")] == [b"id,text\n"]


def test_existing_folders_and_caps_are_refused(spark, path):
    export_csv(spark.range(3), path)
    with pytest.raises(FileExistsError):
        export_csv(spark.range(3), path)
    with pytest.raises(ValueError, match="positive"):
        export_csv(spark.range(3), f"{path}2", max_file_bytes=0)


def test_types_come_back_from_parquet(spark, path):
    sql = "SELECT CAST(id AS TINYINT) AS a, CAST(id * 1.25 AS DECIMAL(20, 3)) AS b, DATE '2024-02-29' AS c, TIMESTAMP_NTZ '2024-02-29 01:02:03.5' AS d, TIMESTAMP '2024-02-29 01:02:03' AS e, CAST(CAST(id AS STRING) AS BINARY) AS f, CAST(id AS FLOAT) AS g, id % 2 = 0 AS h, if(id = 1, NULL, id) AS i FROM range(4)"
    df = spark.sql(sql)
    export_parquet(df, path)
    back = read_parts(spark, path)
    assert back.dtypes == df.dtypes
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_one_column_csv_keeps_rows_without_a_value(spark, path):
    df = spark.createDataFrame([("a",), (None,), ("",), ("b c",)], "t string")
    export_csv(df, path)
    assert spark.read.option("header", True).csv(path).count() == 4


def test_csv_of_rows_without_values(spark, path):
    df = spark.createDataFrame([(None, None, None), (None, 2, None), ("", None, "x")], "a string, b int, c string")
    export_csv(df, path)
    back = spark.read.option("header", True).option("nullValue", "NULL").csv(path)
    assert back.count() == 3 and sorted(map(str, back.collect()))[0] == "Row(a='', b=None, c='x')"


def test_planned_rows_where_only_spark_opens_the_store(spark, path, monkeypatch):
    from tabbridge.sources import capped

    monkeypatch.setattr(capped, "openable", lambda _: False)
    df = spark.range(100).selectExpr("id", "concat('t', id) AS t")
    assert save_lines(df.select("t"), f"{path}/l", 100, "txt", "\n") is False
    export_parquet(df, f"{path}/p")
    export_csv(df, f"{path}/c")
    assert read_parts(spark, f"{path}/p").count() == 100 == spark.read.option("header", True).csv(f"{path}/c").count()
