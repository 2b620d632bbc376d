import datetime as dt
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabbridge.coverage.registry import scratch_database
from tabbridge.functions.names import ColumnsNotFound
from tabbridge.operators import datagen
from tabbridge.operators.datagen import generate_schema, generate_table
from tabbridge.operators.positions import number_unordered
from tabbridge.operators.stats import LoadFailed
from tabbridge.plans import batch
from tabbridge.plans.housekeeping import (
    cutoff,
    drop_tables_with_prefix,
    expire_partitions,
    expire_tables,
    is_expired,
)
from tabbridge.plans.imports import (
    Target,
    import_by_key_range,
    import_table,
    import_targets,
    key_ranges,
    load_delimited,
)
from tabbridge.session import clear_staged, shared_folder, workspace
from tabbridge.sources.assets import (
    Asset,
    Internal,
    Registry,
    TableKey,
    Warehouse,
    auto_increment_key,
    read,
)
from tabbridge.sources.delimited import write_delimited
from tabbridge.operators.positions import numbered_scan
from tabbridge.sources.managed import (
    delete_where,
    rewrite_where,
    result_column_names,
    table_name,
    truncate_table,
    update_where,
    write_result_table,
    write_table,
)
from tabbridge.streaming.append import appended, load_ledger, stream_append


@pytest.fixture
def db(spark):
    return scratch_database(spark, "t")


@pytest.fixture(scope="module")
def items(spark):
    return spark.range(0, 1000, 1, 4).selectExpr("id", "concat('n', id) AS name", "id % 10 AS grp")


def test_append_matches_columns_by_name(spark, db, items):
    assert write_table(items, f"{db}.a") == 1000
    assert write_table(items.limit(5).select("grp", "name", "id"), f"{db}.a") == 5
    got = spark.table(f"{db}.a")
    assert got.columns == ["id", "name", "grp"]
    assert got.where("name != concat('n', id)").count() == 0
    with pytest.raises(ColumnsNotFound, match="name"):
        write_table(items.drop("name"), f"{db}.a")


def test_write_over_given_partitions(spark, db, items):
    write_table(items, f"{db}.p", partitions=3)
    assert len(spark.table(f"{db}.p").inputFiles()) == 3


@pytest.mark.parametrize("key", ["dense", "unique"])
def test_surrogate_key(spark, db, items, key):
    for _ in range(2):
        assert write_table(items, f"{db}.k", key=key) == 1000
    table = spark.table(f"{db}.k")
    name = table.columns[0]
    assert name.startswith("pk_") and len(name) == 8
    keys = sorted(r[0] for r in table.select(name).collect())
    assert len(set(keys)) == 2000 and keys[0] == 1
    if key == "dense":
        assert keys == list(range(1, 2001))


def test_kinds_of_key_are_not_mixed(spark, db, items):
    for first, second in (("dense", "unique"), ("unique", "dense")):
        write_table(items, f"{db}.mixed_{first}", key=first)
        with pytest.raises(ValueError, match=f"has a {first} key"):
            write_table(items, f"{db}.mixed_{first}", key=second)
        assert spark.table(f"{db}.mixed_{first}").count() == 1000


def test_scans_are_numbered_by_file_and_row(spark, tmp_path):
    folder = str(tmp_path / "rows")
    spark.range(0, 5000, 1, 4).selectExpr("id", "id % 9 AS v", "concat('t', id) AS `a.b`").write.parquet(folder)
    scan = spark.read.parquet(folder)
    for df in (scan, scan.select("v", "id"), scan.where("id >= 0"), scan.withColumn("w", F.col("v") * 2)):
        placed = numbered_scan(df, "n", 11)
        assert placed.columns == [*df.columns, "n"]
        assert sorted(r["n"] for r in placed.select("n").collect()) == list(range(11, 5011))
    pairs = [(r["n"], r["id"]) for r in numbered_scan(scan, "n", 0).select("n", "id").collect()]
    assert pairs == [(r["n"], r["id"]) for r in numbered_scan(scan, "n", 0).select("n", "id").collect()]
    # rows left out, made anew or moved are no plain scan
    for df in (scan.where("v <> 3"), scan.union(scan), scan.repartition(3), scan.limit(9), scan.sample(0.5), spark.range(5), scan.selectExpr("explode(array(id, v)) AS x")):
        assert numbered_scan(df, "n") is None
    scan.write.json(folder + "j")
    assert numbered_scan(spark.read.json(folder + "j"), "n") is None
    assert numbered_scan(spark.read.schema(scan.schema).parquet(folder).where("id < 0"), "n").count() == 0


def test_nested_columns_are_refused(spark, db, sf):
    with pytest.raises(ValueError, match="embedding"):
        write_table(spark.read.parquet(f"{sf}/embeddings.parquet"), f"{db}.e")


def test_truncate(spark, db, items):
    write_table(items, f"{db}.x")
    assert truncate_table(spark, f"{db}.x") and spark.table(f"{db}.x").count() == 0
    assert truncate_table(spark, f"{db}.absent")


def test_table_name():
    assert table_name("t", "job1") == "job1_t"
    assert table_name("t") == "t"


def test_result_headers():
    long = "é" * 33  # 66 bytes
    header = ["a.b as c", "x AS y As z", "plain", "basket", "q as " + "n" * 65, long, " s "]
    assert result_column_names(header) == ["c", "z", "plain", "basket", "field4", "field5", "s"]


def test_result_table(spark, db):
    path = workspace(spark, "result")
    spark.createDataFrame(
        [("x,1", 'say "hi"\nagain'), (None, "")], "`t.a AS first` string, b string"
    ).write.option("header", True).option("escape", '"').csv(path)
    assert write_result_table(spark, path, f"{db}.r") == 2
    got = spark.table(f"{db}.r")
    assert got.dtypes == [("_auto_id", "bigint"), ("first", "string"), ("b", "string")]
    assert sorted(r["_auto_id"] for r in got.collect()) == [1, 2]
    assert {(r["first"], r["b"]) for r in got.collect()} == {("x,1", 'say "hi"\nagain'), (None, "")}


def test_delete_and_update(spark, db, items):
    import_table(items.withColumn("grp", F.when(F.col("id") != 3, F.col("grp"))), f"{db}.m")
    assert delete_where(spark, f"{db}.m", [("grp", ">=", 5), ("id", "<", 500)]) == 250
    assert spark.table(f"{db}.m").count() == 750  # the NULL group stays
    assert update_where(spark, f"{db}.m", {"name": "x", "grp": 99}, [("grp", "=", 1)]) == 100
    assert spark.table(f"{db}.m").where("name = 'x' AND grp = 99").count() == 100
    assert spark.table(f"{db}.m").count() == 750
    assert [t.name for t in spark.catalog.listTables(db)] == ["m"]


@pytest.fixture
def days(spark, db):
    """A table by day and half: days d0 … d3 and one without a day, ten rows each."""
    table = f"{db}.days"
    spark.sql(
        f"CREATE TABLE {table} (a INT COMMENT 'key', b STRING, day STRING, half INT) USING parquet "
        "PARTITIONED BY (day, half) COMMENT 'note' TBLPROPERTIES ('kept' = 'yes')"
    )
    rows = "id, concat('b', id % 3), if(id >= 40, NULL, concat('d', id div 10)), id % 2"
    spark.sql(f"INSERT INTO {table} SELECT {rows} FROM range(50)")
    yield table
    told = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()}
    assert told["Comment"] == "note" and "kept=yes" in told["Table Properties"]
    spark.sql(f"DROP TABLE {table}")


def partitions(spark, table):
    return sorted(r[0] for r in spark.sql(f"SHOW PARTITIONS {table}").collect())


def files_of(spark, table, where):
    return sorted(r[0] for r in spark.table(table).where(where).selectExpr("_metadata.file_path").distinct().collect())


def test_delete_rewrites_touched_partitions_only(spark, days):
    before = files_of(spark, days, "day <> 'd1'")
    assert delete_where(spark, days, [("a", "IN", [10, 12, 14, 16, 18, 11])]) == 6
    assert files_of(spark, days, "day <> 'd1'") == before
    assert "day=d1/half=0" not in partitions(spark, days) and "day=d1/half=1" in partitions(spark, days)
    assert sorted(r["a"] for r in spark.table(days).collect()) == [a for a in range(50) if a not in (10, 11, 12, 14, 16, 18)]


def test_whole_partitions_are_dropped(spark, days):
    before = files_of(spark, days, "day <> 'd2' OR day IS NULL")
    assert delete_where(spark, days, [("day", "=", "d2")]) == 10
    assert files_of(spark, days, "true") == before
    assert len(partitions(spark, days)) == 8 and spark.table(days).count() == 40


def test_partitions_without_a_value(spark, days):
    assert update_where(spark, days, {"b": "none"}, [("a", ">=", 45)]) == 5
    assert spark.table(days).where("b = 'none' AND day IS NULL").count() == 5
    assert delete_where(spark, days, [("a", ">=", 40)]) == 10
    assert len(partitions(spark, days)) == 8 and spark.table(days).count() == 40


def test_update_moves_rows_between_partitions(spark, days):
    assert update_where(spark, days, {"day": "d3"}, [("day", "=", "d0")]) == 10
    assert {r["day"]: r["count"] for r in spark.table(days).groupBy("day").count().collect()} == {"d1": 10, "d2": 10, "d3": 20, None: 10}
    assert update_where(spark, days, {"day": "new", "half": 7}, [("a", "=", 33)]) == 1
    assert "day=new/half=7" in partitions(spark, days) and "day=d0/half=0" not in partitions(spark, days)
    assert sorted(r["a"] for r in spark.table(days).collect()) == list(range(50))


def test_rewrite_without_a_hit_changes_no_file(spark, db, days, items):
    before = files_of(spark, days, "true")
    assert delete_where(spark, days, [("a", ">", 100)]) == 0 and update_where(spark, days, {"b": "x"}, [("a", "<", 0)]) == 0
    assert files_of(spark, days, "true") == before
    import_table(items, f"{db}.plain")
    before = files_of(spark, f"{db}.plain", "true")
    assert delete_where(spark, f"{db}.plain", [("id", "<", 0)]) == 0
    assert files_of(spark, f"{db}.plain", "true") == before
    with pytest.raises(ValueError, match="nothing to set"):
        update_where(spark, f"{db}.plain", {}, [("id", "=", 1)])


def test_failed_rewrite_leaves_the_table(spark, db, items):
    table = f"{db}.whole"
    import_table(items, table)
    before = files_of(spark, table, "true")
    broken = F.when(F.col("id") == 999, F.raise_error(F.lit("broken row"))).otherwise(F.lit("x"))
    with pytest.raises(Exception, match="broken row"):
        rewrite_where(spark, table, F.col("id") > 5, {"name": broken})
    assert files_of(spark, table, "true") == before and spark.table(table).count() == 1000
    assert not [t.name for t in spark.catalog.listTables(db) if "__" in t.name]


def test_views_have_no_files_to_rewrite(spark):
    spark.range(3).createOrReplaceTempView("loads_view")
    with pytest.raises(ValueError, match="files of its own"):
        delete_where(spark, "loads_view", [("id", "=", 1)])


def test_import_replaces(spark, db, items):
    import_table(items, f"{db}.i")
    done = import_table(items.where("id < 7"), f"{db}.i", ["name", "id"])
    assert done.rows == 7
    assert spark.table(f"{db}.i").columns == ["id", "name"]


def test_key_ranges_with_gaps_and_nulls(spark):
    df = spark.createDataFrame([(-3,), (-2,), (6,), (7,), (None,)], "k long")
    got = {r["range_id"]: tuple(r) for r in key_ranges(df, "k", 5).collect()}
    assert got == {
        0: (0, -3, 1, 2, -3, -2),
        1: (1, 2, 6, 1, 6, 6),
        2: (2, 7, 11, 1, 7, 7),
        None: (None, None, None, 1, None, None),
    }


def test_key_range_import_adds_the_key_and_keeps_all_rows(spark, db):
    df = spark.createDataFrame([(None, "a"), (None, "b")], "k long, v string")
    done = import_by_key_range(df, f"{db}.n", "k", ["v"])
    assert done.rows == 2 and spark.table(f"{db}.n").columns == ["k", "v"]
    empty = import_by_key_range(df.limit(0), f"{db}.e", "k")
    assert empty.rows == 0 and empty.ranges.count() == 0


def test_import_targets_messages(spark, db, items):
    good = Target(items, "items", f"{db}.g", ["id"])
    bad = Target(items, "items", f"{db}.b", ["nope"])
    report = import_targets(spark, [good, bad])
    assert (report.success, report.message) == (False, "Import completed with some failures")
    rows = report.results.collect()
    assert [r["success"] for r in rows] == [True, False]
    assert "nope" in rows[1]["error_message"]
    assert import_targets(spark, [bad]).message == "Import failed for all targets"
    assert import_targets(spark, [good, good], parallel=1).success


def test_load_delimited(spark, db):
    path = workspace(spark, "text")
    rows = spark.range(50).selectExpr("id", "IF(id % 10 = 3, 'x', CAST(id AS STRING)) AS v")
    write_delimited(rows, path)
    schema = spark.createDataFrame([], "id long, v int").schema
    with pytest.raises(LoadFailed, match="total=50, loaded=45, failed=5"):
        load_delimited(spark, path, schema, f"{db}.l")
    assert not spark.catalog.tableExists(f"{db}.l")
    bad = workspace(spark, "rejects")
    assert load_delimited(spark, path, schema, f"{db}.l", bad) == (50, 45, 5)
    assert spark.table(f"{db}.l").agg(F.sum("v"), F.count("*")).first() == (1225 - 115, 45)
    rejects = spark.read.parquet(bad)
    assert {(r["v"], r["reject_reason"]) for r in rejects.collect()} == {("x", "v")}


def test_staged_folders_go_when_the_block_ends(spark, db, items):
    write_table(items, f"{db}.k", key="dense")
    left = [p.name for p in Path(shared_folder(spark)).iterdir() if p.name.startswith("numbered")]
    numbered = number_unordered(items, "n")
    kept = [p.name for p in Path(shared_folder(spark)).iterdir() if p.name.startswith("numbered")]
    assert len(kept) == len(left) + 1 and numbered.count() == 1000
    assert clear_staged(spark) >= 1
    assert not any((Path(shared_folder(spark)) / name).exists() for name in set(kept) - set(left))


def test_auto_increment_key():
    keys = [
        TableKey("PRIMARY", ["a"]),
        TableKey("AUTO_INCREMENT", ["a", "b"]),
        TableKey("AUTO_INCREMENT", [" c "]),
    ]
    assert auto_increment_key(keys) == "c"
    assert auto_increment_key(keys[:2]) is None
    with pytest.raises(ValueError, match="unknown key type"):
        TableKey("SECRET", ["a"])


def test_general_read(spark, db, items):
    write_table(items, f"{db}.job_t")
    want = [(3,), (13,)]
    for source in (
        Internal("t", "job", db),
        Warehouse("job_t", db),
        Asset("a", "managed", f"{db}.job_t"),
    ):
        rows = read(spark, source, ["id"], [("grp", "=", 3), ("id", "<", 20)], ["id"])
        assert [tuple(r) for r in rows.collect()] == want
    with pytest.raises(ValueError, match="unknown asset"):
        Registry([]).asset("a")
    with pytest.raises(ValueError, match="declares no columns"):
        Asset("a", "snapshot", "/nowhere").open(spark)


def test_batch_modes(spark, db, items):
    keys = spark.range(5)
    assert batch.run("count", table=items, filters=[("grp", "<", 2)]).first()[0] == 200
    assert batch.run("query", table=items, columns=["name"], sort=[("id", "DESC")]).first()[0] == "n999"
    assert batch.run("join", data=keys, table=items, on=["id"], how="left").count() == 5
    assert batch.run("write", data=items, target=f"{db}.w").count() == 1000
    assert batch.run("sort", data=items, order_by="name").first()["name"] == "n0"
    psi = batch.run("PSI_JOIN", table=items, inputs=[keys], on=["id"], order_by="id", target=f"{db}.p")
    assert psi.count() == 5
    assert "join_hash" in batch.run("add_hash_column", table=items, on=["id"]).columns
    with pytest.raises(ValueError, match="unknown batch mode"):
        batch.run("OPERATION_MODE_UNKNOWN")


def test_stream_picks_up_only_new_files(spark):
    source, target, marks = (workspace(spark, "s") for _ in range(3))
    part = spark.range(100).withColumn("v", F.lit("a"))
    part.repartition(3).write.parquet(source)
    assert stream_append(spark, source, target, marks, files_per_batch=1) == 100
    assert stream_append(spark, source, target, marks) == 0
    part.repartition(2).write.mode("append").parquet(source)
    assert stream_append(spark, source, target, marks) == 100
    assert appended(spark, target, part.schema).count() == 200
    ledger = load_ledger(spark, target, part.schema).collect()
    assert sum(r["rows"] for r in ledger) == 200
    assert all(r["load_label"].startswith("import_") for r in ledger)


def test_a_repeated_batch_is_not_loaded_twice(spark, monkeypatch):
    """The batch is written, the run fails before its progress is recorded, and runs again."""
    from tabbridge.streaming import append

    source, target, marks = (workspace(spark, "s") for _ in range(3))
    part = spark.range(60)
    part.repartition(4).write.parquet(source)

    def lost(watch):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as broken:
        broken.setattr(append, "observed_rows", lost)
        with pytest.raises(Exception, match="driver lost"):
            stream_append(spark, source, target, marks)
    assert appended(spark, target, part.schema).count() == 60
    assert stream_append(spark, source, target, marks) == 60
    assert appended(spark, target, part.schema).count() == 60


def test_streams_into_one_table_keep_apart(spark):
    target = workspace(spark, "s")
    for _ in range(2):
        source = workspace(spark, "s")
        spark.range(30).write.parquet(source)
        stream_append(spark, source, target, workspace(spark, "marks"))
    assert appended(spark, target, spark.range(1).schema).count() == 60


def test_expiry(spark, db):
    first = cutoff(10, dt.date(2024, 1, 20))
    assert first == "20240110"
    assert is_expired("20240109_job", first) and not is_expired("20240110", first)
    assert not is_expired("19991231", first) and not is_expired("2024", first)
    days = spark.createDataFrame(
        [(1, "20240109"), (2, "20240110"), (3, "20240101x"), (4, "other")], "id int, day string"
    )
    write_table(days, f"{db}.days", partition_by=["day"])
    assert expire_partitions(spark, f"{db}.days", "day", first) == ["20240101x", "20240109"]
    assert sorted(r["id"] for r in spark.table(f"{db}.days").collect()) == [2, 4]
    for name in ("20240105_a", "20240115_a", "keep"):
        write_table(days, f"{db}.`{name}`")
    assert expire_tables(spark, db, first) == ["20240105_a"]
    assert drop_tables_with_prefix(spark, db, "2024") == ["20240115_a"]
    assert drop_tables_with_prefix(spark, db, "") == []


def test_generated_schema():
    schema = generate_schema(40, ["int", "varchar", "text", "decimal", "datetime", "blob"])
    assert len(schema) == 40 and schema.fields[0].name == "id" and not schema.fields[0].nullable
    assert [f.metadata["declared"] for f in schema.fields[1:4]] == ["INT", "VARCHAR(255)", "TEXT"]
    capped = generate_schema(3, ["varchar", "text"], max_size=20)
    assert capped.fields[1].metadata == {"declared": "VARCHAR(20)", "max_size": 20}
    with pytest.raises(ValueError, match="at least one field"):
        generate_schema(0)
    for dialect in ("mysql", "gbase", "kingbase", "vastbase"):
        assert generate_schema(16, dialect=dialect) == generate_schema(16, dialect=dialect)


def test_unknown_type_names_are_guessed():
    names = ["hugeint", "nchar", "longtext", "numeric2", "timetz", "geometry", " INT ", "nvarchar2"]
    for dialect, number in (("mysql", "INT"), ("kingbase", "INTEGER")):
        schema = generate_schema(9, names, dialect)
        declared = [f.metadata["declared"] for f in schema.fields[1:]]
        assert declared == [number, "VARCHAR(255)", "TEXT", "DECIMAL(10,2)", "DATETIME", "VARCHAR(255)", number, "VARCHAR(255)"]


def test_generated_values_keep_their_rules(spark):
    """Every type of every dialect, with ids at both ends of the range."""
    ids = spark.createDataFrame([(i,) for i in [0, 1, -1, 2**63 - 1, -(2**63), 2**32, *range(500, 900)]], "id long")
    day = dt.date(2024, 2, 29)
    for dialect, templates in datagen.TEMPLATES.items():
        schema = generate_schema(len(templates) + 1, list(templates), dialect, seed=3)
        rows = datagen.generate_rows(ids, schema, 3, day).collect()
        assert len(rows) == 406
        for f in schema.fields[1:]:
            values = [r[f.name] for r in rows if r[f.name] is not None]
            assert len(values) > 330 and len(set(values)) > 60, f
            size = f.metadata["max_size"]
            if isinstance(values[0], (str, bytes, bytearray)):
                assert 1 <= min(map(len, values)) and max(map(len, values)) <= size
            elif isinstance(values[0], dt.datetime):
                assert dt.datetime(2023, 3, 1) <= min(values) and max(values) <= dt.datetime(2024, 2, 29)
            elif isinstance(values[0], dt.date):
                assert dt.date(2023, 3, 1) <= min(values) and max(values) <= day
            else:
                assert min(values) >= 0


def test_draws_are_even():
    draws = datagen.Draws(np.arange(200_000), 5, "c")
    for limit in (2, 10, 100):
        counts = np.bincount(draws.below(limit), minlength=limit)
        assert abs(counts / (200_000 / limit) - 1).max() < 0.12
    assert len(np.unique(draws.word("value"))) > 199_000 and abs(np.corrcoef(draws.word("a"), draws.word("b"))[0, 1]) < 0.01


def test_generated_rows_do_not_depend_on_partitioning(spark):
    schema = generate_schema(16, dialect="mysql", seed=5)
    day = dt.date(2024, 7, 1)
    rows = generate_table(spark, 400, schema, 5, day)
    again = generate_table(spark, 400, schema, 5, day).repartition(7).orderBy("id")
    assert rows.collect() == again.collect()
    assert rows.collect() != generate_table(spark, 400, schema, 6, day).collect()
    assert [f.dataType for f in rows.schema.fields] == [f.dataType for f in schema.fields]


def test_generated_null_share(spark):
    schema = generate_schema(16, ["int"], seed=1)
    nulls = generate_table(spark, 5000, schema).agg(
        *[F.count_if(F.col(f.name).isNull()).alias(f.name) for f in schema.fields]
    ).first()
    for f in schema.fields:
        assert 400 < nulls[f.name] < 600 if f.nullable else nulls[f.name] == 0
