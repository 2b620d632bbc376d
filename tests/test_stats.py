import pytest
from pyspark.sql import functions as F

from tabbridge.coverage.registry import scratch_database
from tabbridge.operators.stats import (
    LoadFailed,
    RowCountMismatch,
    catalog_statistics,
    check_load,
    estimate_size,
    load_verdict,
    observed,
    observed_rows,
    reconcile_counts,
    table_info,
    validate_row_count,
)
from tabbridge.sources.footers import footer_facts


@pytest.mark.parametrize(
    ("total", "loaded", "failed", "good"),
    [
        (0, 0, 0, True),
        (1000, 1000, 0, True),
        (1000, 800, 200, False),
        (1000, 0, 1000, False),
        (5000, 0, 0, False),
        (0, 0, 100, False),
        (999999, 0, 999999, False),
    ],
)
def test_load_verdict(spark, total, loaded, failed, good):
    df = spark.createDataFrame(
        [(total, loaded, failed)], "total_rows int, loaded_rows int, failed_rows int"
    )
    assert load_verdict(df).first()["success"] is good
    if good:
        check_load(total, loaded, failed)
    else:
        with pytest.raises(LoadFailed, match=f"total={total}"):
            check_load(total, loaded, failed)


def test_validate_row_count(spark):
    df = spark.createDataFrame(
        [("read", 1000, 999), ("write", 1000, 1002), ("none", 0, 5), ("same", 7, 7)],
        "operation string, expected int, actual int",
    )
    got = {r["operation"]: r for r in validate_row_count(df, 0.1).collect()}
    assert (got["read"]["diff"], got["read"]["passed"]) == (-1, True)
    assert got["read"]["diff_percent"] == pytest.approx(-0.1)
    assert got["write"]["passed"] is False
    assert (got["none"]["diff_percent"], got["none"]["passed"]) == (0.0, True)
    assert got["same"]["passed"] is True


def test_estimate_uses_integer_average(spark):
    df = spark.createDataFrame([(1, "test1"), (2, "test22"), (3, None)], "id long, name string")
    row = estimate_size(df).first()
    assert (row["rows"], row["avg_row_bytes"], row["table_bytes"]) == (3, 35 // 3, 33)
    assert estimate_size(df, 1.5).first()["table_bytes"] == 49


def test_estimate_measures_every_row(spark):
    row = estimate_size(spark.range(100_000)).first()
    assert (row["avg_row_bytes"], row["table_bytes"]) == (8, 800_000)
    late = spark.sql("SELECT IF(id < 900, '', repeat('x', 100)) AS s FROM range(0, 1000, 1, 1)")
    assert estimate_size(late).first()["avg_row_bytes"] == 10


def test_estimate_of_nothing(spark):
    row = estimate_size(spark.createDataFrame([], "a int")).first()
    assert (row["rows"], row["table_bytes"]) == (0, 0)


def test_table_info(spark):
    tables = {"a": spark.range(5), "b": spark.createDataFrame([("x", 1)], "s string, i int")}
    exact = {r["table_name"]: r for r in table_info(tables, tiers=(1, 10, 100)).collect()}
    assert (exact["a"]["record_count"], exact["a"]["record_size"]) == (5, 0)
    assert (exact["a"]["size_tier"], exact["b"]["size_tier"]) == ("medium", "small")
    assert exact["b"]["columns"] == "s,i"
    rough = {r["table_name"]: r for r in table_info(tables, exact=False).collect()}
    assert (rough["a"]["record_size"], rough["b"]["record_size"]) == (40, 5)


def test_table_info_of_managed_tables(spark):
    db = scratch_database(spark, "info")
    spark.range(300).write.saveAsTable(f"{db}.known")
    spark.range(7).write.saveAsTable(f"{db}.unknown")
    spark.sql(f"ANALYZE TABLE {db}.known COMPUTE STATISTICS")
    rows, size = catalog_statistics(spark, f"{db}.known")
    assert rows == 300 and size > 0
    assert catalog_statistics(spark, f"{db}.unknown") is None
    names = [f"{db}.known", f"{db}.unknown"]
    info = {r["table_name"]: r for r in table_info(names, exact=False).collect()}
    assert (info[names[0]]["record_count"], info[names[0]]["record_size"]) == (300, size)
    assert (info[names[1]]["record_count"], info[names[1]]["record_size"]) == (7, 56)
    exact = {r["table_name"]: r["record_count"] for r in table_info(names).collect()}
    assert exact == {names[0]: 300, names[1]: 7}


def test_reconcile(spark):
    df, watch = observed(spark.range(50))
    df.write.format("noop").mode("overwrite").save()
    assert reconcile_counts("t", 50, observed_rows(watch)) == 50
    with pytest.raises(RowCountMismatch, match="expected 51 rows, delivered 50"):
        reconcile_counts("t", 51, 50)


def test_estimates_from_footers_read_no_row_group(spark, tmp_path):
    """The pages are overwritten, the footers stay: counts and sizes still come out."""
    import pyarrow.parquet as pq

    folder = tmp_path / "t"
    df = spark.range(0, 4000, 1, 3).selectExpr("id", "CAST(id % 5 AS INT) AS small", "if(id % 4 = 0, NULL, id * 1.5D) AS x", "sha2(CAST(id AS STRING), 256) AS text", "array(id, id) AS two")
    df.write.parquet(str(folder))
    for file in folder.glob("*.parquet"):
        raw = bytearray(file.read_bytes())
        start = len(raw) - 8 - int.from_bytes(raw[-8:-4], "little")
        raw[4:start] = bytes(start - 4)
        file.write_bytes(raw)
        crc = file.parent / f".{file.name}.crc"
        crc.unlink(missing_ok=True)
        assert pq.read_metadata(file).num_rows > 0
    rows = spark.read.parquet(str(folder))
    with pytest.raises(Exception):
        rows.agg(F.sum("id")).collect()
    fixed = table_info({"t": rows.select("id", "small", "x", "two")}, exact=False).first()
    assert (fixed["record_count"], fixed["record_size"]) == (4000, (4000 * 12 + 3000 * 8 + 8000 * 8) // 4000 * 4000)
    whole = table_info({"t": rows}, exact=False).first()
    assert 200_000 < whole["record_size"] - fixed["record_size"] < 4000 * 70


def test_frames_that_are_no_plain_table_are_measured(spark, tmp_path):
    folder = str(tmp_path / "t")
    spark.range(100).selectExpr("id", "CAST(id AS STRING) AS t").write.parquet(folder)
    scan = spark.read.parquet(folder)
    assert {n: f[0] for n, f in footer_facts({"a": scan, "b": scan.select("t"), "c": scan.limit(1)}).items()} == {"a": 100, "b": 100}
    for df in (scan.where("id > 5"), scan.selectExpr("id + 1 AS id"), scan.limit(3), scan.union(scan), spark.range(4), scan.distinct()):
        assert footer_facts({"t": df}) == {}
        assert table_info({"t": df}, exact=False).first()["record_count"] == df.count()
    scan.write.json(folder + "j")
    assert footer_facts({"t": spark.read.json(folder + "j")}) == {}
    scan.write.saveAsTable("footer_table")
    assert table_info(["footer_table"], exact=False).first()["record_count"] == 100
    spark.sql("DROP TABLE footer_table")
    with pytest.raises(ValueError, match="measure"):
        table_info({"t": scan}, exact=False, measure="guess")
