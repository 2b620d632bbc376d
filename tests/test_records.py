"""Quoted text with line breaks in cells, read in blocks."""

import random
from decimal import Decimal
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabbridge.session import workspace
from tabbridge.sources import records
from tabbridge.sources.delimited import load_with_rejects, read_delimited, write_delimited
from tabbridge.sources.records import block_records, read_records


@pytest.fixture
def path(spark):
    folder = workspace(spark, "records")
    Path(folder).mkdir()
    return folder


def some_cells(n, seed=1):
    rng = random.Random(seed)
    parts = ["a", "wort", '"', '""', "\n", "\r\n", "\r", ",", " ", "é", "日本", "x" * 40, "\n\n", '"\n"']
    return [["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(3)] for _ in range(n)]


def quoted(cells):
    return ",".join('"' + c.replace('"', '""') + '"' for c in cells)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("last", [True, False])
@pytest.mark.parametrize("size", [1, 2, 7, 64, 1000, 10**6])
def test_blocks_give_every_record_once(monkeypatch, end, last, size):
    monkeypatch.setattr(records, "_AHEAD", 13)
    rows = [quoted(c) for c in some_cells(60)] + ["plain,cells,here", "", '"x",2,"y"']
    text = end.join(rows) + (end if last else "")
    data = text.encode()
    found, odd = [], 0
    for start in range(0, len(data), size):
        block = data[start : start + size]
        got = block_records(pa.BufferReader(data), start, len(block), odd == 1)
        odd = (odd + block.count(b'"')) % 2
        found += [] if got is None else got.to_pylist()
    assert "".join(found) == text
    assert [r.rstrip("\r\n") for r in found] == rows


def test_several_tasks_read_one_file(spark, path):
    rows = some_cells(3000, 5)
    text = "a,b,c\n" + "\n".join(map(quoted, rows)) + "\n"
    (Path(path) / "one.csv").write_bytes(text.encode())
    found = read_records(spark, [(f"file:{path}/one.csv", len(text.encode()))], 4096)
    assert found.rdd.getNumPartitions() == -(-len(text.encode()) // 4096)
    got = found.collect()
    assert sorted(r["record"] for r in got if not r["first"]) == sorted(quoted(r).rstrip("\r\n") for r in rows)
    assert [r["record"] for r in got if r["first"]] == ["a,b,c"]


def test_cells_come_back_as_they_were(spark, path):
    rows = [(i, *c) for i, c in enumerate(some_cells(2000, 7))]
    df = spark.createDataFrame(rows, "id int, a string, b string, c string")
    write_delimited(df.repartition(3), f"{path}/d")
    back = read_delimited(spark, f"{path}/d", df.schema, block_bytes=2048)
    assert back.rdd.getNumPartitions() > 20
    blank = " \t\r\n"
    want = [(i, *(c.strip(blank) or None for c in cells)) for i, *cells in rows]
    assert sorted(map(tuple, back.collect())) == want


def test_short_long_and_empty_records(spark, path):
    (Path(path) / "a.csv").write_bytes("h1,h2\r\n1,x\r\n\r\n2\r\n3,y,surplus\r\n4,\"z\r\nz\"".encode())
    (Path(path) / "b.csv").write_bytes(b"h1,h2\n")
    (Path(path) / "c.csv").write_bytes(b"")
    schema = spark.createDataFrame([], "n int, t string").schema
    got = read_delimited(spark, path, schema, sep=",").collect()
    assert sorted(map(tuple, got)) == [(1, "x"), (2, None), (3, "y"), (4, "z\r\nz")]


def test_packed_files_and_other_stores(spark, path, monkeypatch):
    df = spark.createDataFrame([(1, "a\nb"), (2, '"c"')], "n int, t string")
    df.write.option("header", True).option("escape", '"').option("compression", "gzip").option("sep", "\x01").csv(f"{path}/z")
    assert sorted(map(tuple, read_delimited(spark, f"{path}/z", df.schema).collect())) == [(1, "a\nb"), (2, '"c"')]
    write_delimited(df, f"{path}/d")
    monkeypatch.setattr(records, "openable", lambda _: False)
    assert sorted(map(tuple, read_delimited(spark, f"{path}/d", df.schema).collect())) == [(1, "a\nb"), (2, '"c"')]


def test_rejects_keep_their_line_breaks(spark, path):
    (Path(path) / "a.csv").write_bytes(b'n,t\n1,"a\nb"\n"x\ny",c\n')
    load = load_with_rejects(spark, f"{path}/a.csv", spark.createDataFrame([], "n int, t string").schema, sep=",")
    assert [tuple(r) for r in load.good.collect()] == [(1, "a\nb")]
    assert [tuple(r) for r in load.rejects.collect()] == [("x\ny", "c", "n")]


def test_surplus_decimals_are_cut(spark, path):
    texts = ["1.239", "-1.239", "0.999", "12", " 7.125 ", "1.5e-2", "1999e-3", "", "99999.999", "-0.001"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1).write.option("header", True).csv(f"{path}/x")
    schema = spark.createDataFrame([], "i int, d decimal(7,2)").schema
    got = {r["i"]: r["d"] for r in read_delimited(spark, f"{path}/x", schema, sep=",").collect()}
    want = ["1.23", "-1.23", "0.99", "12.00", "7.12", "0.01", "1.99", None, "99999.99", "0.00"]
    assert [got[i] for i in range(len(texts))] == [None if w is None else Decimal(w) for w in want]


def test_blocks_are_checked(spark):
    with pytest.raises(ValueError, match="positive"):
        read_records(spark, [], 0)
    assert read_records(spark, []).count() == 0
    assert read_records(spark, [("file:/nowhere", 0)]).agg(F.count("*")).first()[0] == 0
