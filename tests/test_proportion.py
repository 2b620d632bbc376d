"""Tasks and files follow the bytes of a table."""

from pathlib import Path

from tabbridge.coverage import QUERIES, exchange
from tabbridge.sources import records


def test_small_blocks_share_tasks(spark, tmp_path):
    rows = [f'{i},"a\n""{i}"""' for i in range(3000)]
    text = "\n".join(["a,b", *rows]) + "\n"
    (tmp_path / "one.csv").write_text(text)
    found = records.read_records(spark, [(f"file:{tmp_path}/one.csv", len(text))], 64)
    assert found.rdd.getNumPartitions() <= 256 < len(text) // 64
    assert sorted(r["record"] for r in found.collect() if not r["first"]) == sorted(rows)


def _folder(spark, tmp_path, table, df):
    df.repartition(6).write.parquet(f"{tmp_path}/{table}.parquet")
    size = sum(f.stat().st_size for f in Path(f"{tmp_path}/{table}.parquet").glob("*.parquet"))
    return str(tmp_path), size


def test_larger_tables_have_more_writers(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(exchange.__dict__, "WRITER_BYTES", 1 << 40)
    docs = spark.range(600).selectExpr("id AS doc_id", "repeat(concat('x. y a', id, ' '), 400) AS text", "'en' AS lang", "'s' AS source", "id AS n_chars")
    folder, size = _folder(spark, tmp_path, "documents", docs)
    assert (exchange._writers(spark, folder, "documents"), exchange._writers(spark, folder, "documents", 2)) == (1, 2)
    for writers in (1, 3):
        monkeypatch.setitem(exchange.__dict__, "WRITER_BYTES", -(-size // writers))
        assert exchange._writers(spark, folder, "documents") == writers
        got = QUERIES["read_delimited_multiline"](spark, folder).collect()
        assert len(got) == 600 and all(r["one_file"] and r["several_tasks"] for r in got)


def test_larger_tables_have_more_arrow_files(spark, tmp_path, monkeypatch):
    items = spark.range(20000).selectExpr("id AS l_orderkey", "cast(id AS string) AS l_comment")
    folder, size = _folder(spark, tmp_path, "lineitem", items)
    monkeypatch.setitem(exchange.__dict__, "WRITER_BYTES", -(-size // 4))
    written = []
    monkeypatch.setitem(exchange.__dict__, "write_arrow", lambda df, *a, f=exchange.write_arrow, **k: written.append(f(df, *a, **k)) or written[-1])
    got = QUERIES["arrow_files_split"](spark, folder).collect()
    assert written[0].count() == 4
    assert len(got) == 20000 and all(r["files_split"] and r["written"] == 20000 for r in got)
