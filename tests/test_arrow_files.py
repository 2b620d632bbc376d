"""The Arrow data source: partitions from footers, files published on commit."""

from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabbridge.session import isolated, workspace
from tabbridge.sources.arrow_files import plan_spans
from tabbridge.sources.files import load_arrow_file, read_arrow, read_files, write_arrow, write_files


@pytest.fixture
def path(spark):
    return workspace(spark, "arrow")


def visible(path):
    return sorted(p.name for p in Path(path.removeprefix("file:")).iterdir() if not p.name.startswith(("_", ".")))


def file_with(path, name, table, batch_rows, stream=False):
    Path(path).mkdir(parents=True, exist_ok=True)
    make = pa.ipc.new_stream if stream else pa.ipc.new_file
    with pa.OSFile(f"{path}/{name}", "wb") as sink, make(sink, table.schema) as out:
        out.write_table(table, max_chunksize=batch_rows)


def test_spans_of_batches():
    footers = [("a", 1000, 10), ("b", 50, 1), ("c", 60, 2), ("d", 400, None), ("e", 0, 0), ("f", 90, 3)]
    spans = [p.spans for p in plan_spans(footers, 300)]
    assert spans[:3] == [[("a", 0, 3)], [("a", 3, 6)], [("a", 6, 9)]]
    assert [s for part in spans[3:] for s in part] == [("a", 9, 10), ("b", 0, 1), ("c", 0, 2), ("d", 0, None), ("f", 0, 3)]
    # a batch above the size is a partition of its own, and no batch is lost or read twice
    assert [p.spans for p in plan_spans([("a", 900, 3)], 10)] == [[("a", k, k + 1)] for k in range(3)]
    assert plan_spans([], 10) == []


def test_more_partitions_than_files(spark, path):
    table = pa.table({"id": range(10_000), "name": [f"n{i}" for i in range(10_000)], "rest": ["x" * 50] * 10_000})
    file_with(path, "big.arrow", table, 500)
    file_with(path, "small.arrow", table.slice(0, 10), 500)
    schema = spark.createDataFrame([], "id long, name string").schema
    df = read_arrow(spark, path, schema, partition_bytes=100_000)
    assert df.rdd.getNumPartitions() > 5
    assert df.count() == 10_010 and df.agg(F.sum("id")).first()[0] == sum(range(10_000)) + 45
    per_task = df.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in per_task) <= 2000


def test_schema_from_the_files(spark, path):
    table = pa.table({"n": pa.array([1, None], pa.int16()), "t": pa.array([59_886, None], pa.time32("s")), "d": pa.array([1.5, 2.5])})
    file_with(path, "one.arrow", table, 10)
    df = read_arrow(spark, path)
    assert df.dtypes == [("n", "smallint"), ("t", "string"), ("d", "double")]
    assert sorted(map(tuple, df.collect()), key=str) == [(1, "16:38:06", 1.5), (None, None, 2.5)]
    seconds = read_arrow(spark, path, spark.createDataFrame([], "t int").schema)
    assert sorted((r["t"] for r in seconds.collect()), key=str) == [59_886, None]


def test_times_of_day_are_stored_as_seconds(spark, path):
    df = spark.createDataFrame([(1, "00:00:00"), (2, "23:59:59"), (3, None)], "id int, at string")
    write_arrow(df, path, time_columns=["at"])
    with pa.OSFile(str(next(Path(path).glob("part-*")))) as source:
        assert pa.ipc.open_file(source).schema.field("at").type == pa.time32("s")
    assert sorted(map(tuple, read_files(spark, path, "arrow").collect())) == [(1, "00:00:00"), (2, "23:59:59"), (3, None)]
    with pytest.raises(Exception, match="noon"):
        write_arrow(spark.createDataFrame([("noon",)], "at string"), path, mode="append", time_columns=["at"])
    with pytest.raises(ValueError, match="absent"):
        write_arrow(df, path, mode="append", time_columns=["absent"])


def test_missing_column_is_an_error(spark, path):
    write_arrow(spark.range(3), path)
    with pytest.raises(Exception, match="nope"):
        read_arrow(spark, path, spark.createDataFrame([], "nope long").schema).collect()


def test_only_chosen_columns_are_read(spark, path):
    write_arrow(spark.range(5).selectExpr("id", "id * 2 AS twice", "'x' AS s"), path)
    schema = spark.createDataFrame([], "id long, twice long, s string").schema
    assert load_arrow_file(spark, path, schema, ["s", "id"]).columns == ["s", "id"]
    assert sorted(r["twice"] for r in load_arrow_file(spark, path, columns=["twice"]).collect()) == [0, 2, 4, 6, 8]


def test_failed_overwrite_leaves_the_old_rows(spark, path):
    write_files(spark.range(100), path, "arrow")
    before = visible(path)
    late = F.when(F.col("id") < 700, F.col("id")).otherwise(F.raise_error(F.lit("broken row")).cast("long"))
    broken = spark.range(0, 800, 1, 4).select(late.alias("id"))
    for mode in ("overwrite", "append"):
        with pytest.raises(Exception, match="broken row"):
            write_files(broken, path, "arrow", mode=mode)
        assert visible(path) == before
        assert not list(Path(path).glob(".writing-*"))
    assert sorted(r["id"] for r in read_files(spark, path, "arrow").collect()) == list(range(100))


def test_overwrite_of_the_folder_it_reads(spark, path):
    write_files(spark.range(50), path, "arrow")
    rows = read_files(spark, path, "arrow")
    write_files(rows.selectExpr("id + 1000 AS id"), path, "arrow", mode="overwrite")
    assert sorted(r["id"] for r in read_files(spark, path, "arrow").collect()) == list(range(1000, 1050))


def test_one_file_for_no_rows(spark, path):
    manifest = write_arrow(spark.range(0).selectExpr("id", "'x' AS s"), path)
    assert manifest.count() == 0 and len(visible(path)) == 1
    back = read_arrow(spark, path)
    assert back.columns == ["id", "s"] and back.count() == 0


def test_files_of_a_set_number_of_rows(spark, path):
    manifest = write_arrow(spark.range(0, 2500, 1, 2), path, max_rows_per_file=400)
    assert sorted(r["rows"] for r in manifest.collect()) == [50, 50, *[400] * 6]
    assert sorted(r["file"] for r in manifest.collect()) == visible(path)
    with pytest.raises(ValueError, match="positive"):
        write_arrow(spark.range(3), path, 0, "append")


def test_streams_and_footed_files_together(spark, path):
    table = pa.table({"id": range(30)})
    file_with(path, "a.arrow", table.slice(0, 20), 7)
    file_with(path, "b c%.arrow", table.slice(20), 3, stream=True)
    (Path(path) / "_SUCCESS").write_bytes(b"")
    assert sorted(r["id"] for r in read_arrow(spark, path).collect()) == list(range(30))
    assert read_arrow(spark, f"{path}/a*").count() == 20
    assert read_arrow(spark, [f"{path}/a.arrow", f"{path}/b c%.arrow"]).count() == 30


def test_stores_that_only_spark_opens(spark, path, monkeypatch):
    from tabbridge.sources import publish

    write_arrow(spark.range(20).selectExpr("id", "'x' AS s"), path)
    monkeypatch.setattr(publish, "openable", lambda _: False)
    schema = spark.createDataFrame([], "id long").schema
    assert sorted(r["id"] for r in read_arrow(spark, path, schema).collect()) == list(range(20))
    with pytest.raises(ValueError, match="declared schema"):
        read_arrow(spark, path)


def test_sessions_beside_the_active_one(spark, path):
    own = isolated(spark)
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    write_arrow(own.range(0, 95, 1, 1), path)
    with pa.OSFile(str(next(Path(path).glob("part-*")))) as source:
        assert pa.ipc.open_file(source).num_record_batches == 10
    assert read_arrow(own, path).count() == 95 == read_arrow(spark, path).count()
