import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tabbridge.operators import positions
from tabbridge.operators.positions import (
    Ordered,
    chunk_manifest,
    number_rows,
    number_unordered,
    order_table,
    ordered,
    page,
    read_chunk,
)
from tabbridge.plans.housekeeping import retry_candidates
from tabbridge.session import shared_folder


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(11)
    rows = [("hot" if i % 3 == 0 else f"k{rng.randrange(50)}", rng.randrange(20)) for i in range(3000)]
    return spark.createDataFrame(rows, "k string, v int").repartition(5), rows


def test_positions_equal_sorted_order(table):
    df, rows = table
    placed = number_rows(df, [("k", "DESC"), "v"]).orderBy("position").collect()
    assert [r["position"] for r in placed] == list(range(len(rows)))
    want = sorted(rows, key=lambda r: r[1])
    want.sort(key=lambda r: r[0], reverse=True)
    assert [(r["k"], r["v"]) for r in placed] == want


def test_unordered_numbers_are_dense(table):
    df, rows = table
    numbered = number_unordered(df, "id", 10)
    got = sorted(r["id"] for r in numbered.select("id").collect())
    assert got == list(range(10, 10 + len(rows)))
    assert numbered.columns == ["k", "v", "id"]


def test_numbering_an_empty_table(spark):
    empty = spark.createDataFrame([], "k int")
    assert number_rows(empty, ["k"]).count() == 0
    assert number_unordered(empty, "id").count() == 0
    assert chunk_manifest(empty, ["k"], 10).count() == 0


def left_behind(spark):
    """Folders in the shared folder."""
    return {p.name for p in Path(shared_folder(spark)).iterdir()}


@pytest.mark.parametrize("sample", [50_000, 200])
@pytest.mark.parametrize(("number", "size"), [(1, 10), (7, 13), (231, 13), (1, 5000), (300, 13)])
def test_pages(spark, table, monkeypatch, sample, number, size):
    """Pages of any depth, from one task or from ranges, leave nothing but their rows."""
    monkeypatch.setattr(positions, "NARROW_SAMPLE", sample)
    df, rows = table
    before = left_behind(spark)
    got = page(df, ["k", "v"], number, size)
    want = sorted(rows)[(number - 1) * size : number * size]
    assert [tuple(r) for r in got.rows.collect()] == want
    assert got.total.first()["total_rows"] == len(rows)
    assert all(name.startswith("page-") for name in left_behind(spark) - before)
    with ordered(df, ["k", "v"]) as whole:
        assert [tuple(r) for r in whole.page(number, size).rows.collect()] == want
        assert whole.page(number, size).total.first()["total_rows"] == len(rows)


@pytest.mark.parametrize("rules", [["a"], [("a", "DESC"), "b"], ["b", ("a", "DESC")], [("t", "DESC")]])
def test_deep_pages_in_a_narrow_interval(spark, monkeypatch, rules):
    """NULLs, ties, both directions: every page of every interval, whatever the sample says."""
    monkeypatch.setattr(positions, "NARROW_SAMPLE", 600)
    rng = random.Random(5)
    start = dt.datetime(2024, 3, 31)
    rows = [
        (
            None if i % 17 == 0 else rng.randrange(300) / 8,
            None if i % 23 == 0 else f"s{rng.randrange(40)}",
            start + dt.timedelta(minutes=rng.randrange(5000)),
            i,
        )
        for i in range(2000)
    ]
    df = spark.createDataFrame(rows, "a double, b string, t timestamp_ntz, i int").repartition(4)
    want = [tuple(r) for r in df.orderBy(*positions.total_order(df, rules)).collect()]
    for number, size in ((2, 40), (13, 70), (49, 40), (20, 100), (29, 70)):
        got = page(df, rules, number, size)
        assert [tuple(r) for r in got.rows.collect()] == want[(number - 1) * size : number * size]
        assert got.total.first()["total_rows"] == 2000


@pytest.mark.parametrize("sample", [50_000, 100])
def test_deep_page_without_rules(spark, monkeypatch, sample):
    """Pages follow the fingerprint."""
    monkeypatch.setattr(positions, "NARROW_SAMPLE", sample)
    df = spark.range(2000).selectExpr("id AS a", "id % 7 AS b").repartition(4)
    want = [tuple(r) for r in df.orderBy(F.xxhash64("a", "b")).collect()]
    got = page(df, [], 13, 130)
    assert [tuple(r) for r in got.rows.collect()] == want[12 * 130 : 13 * 130]


def test_narrowing_narrows(spark, monkeypatch):
    monkeypatch.setattr(positions, "NARROW_SAMPLE", 5000)
    df = spark.range(100_000).selectExpr("(id * 7919) % 100000 AS k")
    for first in (0, 60_000, 99_990):
        part, before, inside = positions._narrow(df, ["k"], first, first + 10, 100_000)
        rows, low, high = part.agg(F.count("*"), F.min("k"), F.max("k")).first()
        assert rows == inside <= 5000 and low == before <= first and high >= first + 9


def test_a_hot_key_is_one_interval(spark):
    df = spark.range(5000).selectExpr("'hot' AS k", "id AS v")
    part, before, inside = positions._narrow(df, ["k"], 2000, 2010, 5000)
    assert (part.count(), before, inside) == (5000, 0, 5000)


def test_index_is_kept_with_the_order(spark, table, tmp_path):
    """Made once in a folder of the caller, opened again, read in pruned scans."""
    df, rows = table
    folder = f"{tmp_path}/by_key"
    before = left_behind(spark)
    order_table(df, [("v", "DESC"), "k"], folder)
    assert left_behind(spark) == before
    table_again = Ordered(spark, folder)
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert table_again.total() == 3000 and table_again.columns == ["k", "v"]
    assert [tuple(r) for r in table_again.at(1495, 10).collect()] == want[1495:1505]
    assert [tuple(r) for r in table_again.at(2995, 10).collect()] == want[2995:]
    assert table_again.at(3000, 10).count() == 0 == table_again.at(0, 0).count()
    entries = table_again.index.orderBy("before").collect()
    assert [tuple(e["first"]) for e in entries] == [(want[e["before"]][1], want[e["before"]][0]) for e in entries]
    assert "__row" in table_again.at(1495, 10)._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1][:200]
    placed = {r["place"]: (r["k"], r["v"]) for r in table_again.numbered("place", 1).collect()}
    assert [placed[i] for i in range(1, 3001)] == want
    table_again.drop()
    assert not Path(folder).exists()


def test_position_of_a_key(spark, table):
    df, rows = table
    with ordered(df, [("v", "DESC"), "k"]) as whole:
        for key in ((19,), (7,), (7, "hot"), (7, "k3"), (-1,), (99,), (0, "zzz"), (None,)):
            sort = [(-r[1], r[0]) for r in rows]
            want = 3000 if key[0] is None else sum(s < tuple([-key[0], *key[1:]]) for s in ((x[: len(key)]) for x in sort))
            assert whole.position_of(key) == want, key


def test_page_filters_and_limits(table):
    df, rows = table
    got = page(df, [("v", "DESC")], 1, 5, [("k", "=", "hot")])
    assert got.total.first()["total_rows"] == sum(r[0] == "hot" for r in rows)
    assert [r["v"] for r in got.rows.collect()] == [19] * 5
    with pytest.raises(ValueError, match="start at 1"):
        page(df, ["k"], 0)


@pytest.mark.parametrize("batch", [10_000, 64])
def test_chunks_cover_all_rows(spark, table, batch):
    df, rows = table
    before = left_behind(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    manifest = chunk_manifest(df, ["k", "v"], 700).orderBy("chunk_id").collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(name.startswith("manifest-") for name in left_behind(spark) - before)
    assert [(r["start_offset"], r["end_offset"], r["chunk_rows"]) for r in manifest] == [
        (0, 700, 700), (700, 1400, 700), (1400, 2100, 700), (2100, 2800, 700), (2800, 3000, 200),
    ]
    assert [r["next_chunk_id"] for r in manifest] == [1, 2, 3, 4, -1]
    assert {r["total_chunks"] for r in manifest} == {5}
    import hashlib

    for chunk in manifest:
        lines = sorted(rows)[chunk["start_offset"] : chunk["end_offset"]]
        text = "\n".join(f"{k}\x01{v}" for k, v in lines)
        assert chunk["checksum"] == hashlib.md5(text.encode()).hexdigest()


def test_read_chunk_resumes(table):
    df, rows = table
    whole = order_table(df, ["k", "v"])
    got = [(r["k"], r["v"]) for r in read_chunk(whole, 4, 700, 150).collect()]
    assert got == sorted(rows)[2950:3000]
    for args in ((-1, 700, 0), (0, 700, 700)):
        with pytest.raises(ValueError):
            read_chunk(whole, *args)


def test_retry_candidates(spark):
    now = dt.datetime(2024, 1, 1, 12)
    old, new = now - dt.timedelta(minutes=5), now - dt.timedelta(seconds=30)
    ledger = spark.createDataFrame(
        [
            (1, 1, "failed", old),
            (2, 0, "failed", old),
            (3, 2, "pending", old - dt.timedelta(hours=1)),
            (4, 1, "failed", new),
            (5, 1, "done", old),
        ],
        "id int, retry_count int, status string, updated_at timestamp_ntz",
    )
    due = retry_candidates(ledger, now)
    assert [r["id"] for r in due.rows.collect()] == [3, 1]
    assert due.total.first()["total_rows"] == 2


def test_stage_is_a_table_in_the_shared_folder(spark):
    from tabbridge.session import shared_folder, stage

    staged = stage(spark.range(10).withColumn("x", F.lit("a")))
    assert shared_folder(spark) in staged.inputFiles()[0]
    assert staged.count() == 10
