import pytest
from pyspark.sql import functions as F

from tabbridge.coverage.registry import scratch_database
from tabbridge.plans.sqlpass import bind_sql, execute_sql, execute_sql_into, fill_sql, sql_rows_as_text


@pytest.mark.parametrize(
    ("text", "args", "want"),
    [
        ("SELECT ? , ?", [1, "a"], ("SELECT ? , ?", [1, "a"])),
        ("SELECT $1, $2", [1, 2], ("SELECT ?, ?", [1, 2])),
        ("SELECT $2, $1, $2", [1, 2], ("SELECT ?, ?, ?", [2, 1, 2])),
        ("SELECT '?', \"$1\", `a?b`, ?", [5], ("SELECT '?', \"$1\", `a?b`, ?", [5])),
        ("SELECT 'it''s ?', ?", [5], ("SELECT 'it''s ?', ?", [5])),
        ("SELECT 1", [], ("SELECT 1", [])),
        ("SELECT 1 /* why? */ -- $1?\n, ?", [5], ("SELECT 1 /* why? */ -- $1?\n, ?", [5])),
    ],
)
def test_bind(text, args, want):
    assert bind_sql(text, args) == want


@pytest.mark.parametrize(
    ("text", "args", "message"),
    [
        ("SELECT ?", [], "fewer values"),
        ("SELECT $2", [1], "fewer values"),
        ("SELECT ?", [1, 2], "more values"),
        ("SELECT 1", [1], "more values"),
    ],
)
def test_bind_counts(text, args, message):
    with pytest.raises(ValueError, match=message):
        bind_sql(text, args)


def test_statements(spark):
    db = scratch_database(spark, "sql")
    before = spark.catalog.currentDatabase()
    assert execute_sql(spark, "CREATE TABLE t (a INT, b STRING) USING parquet", (), db).affected == 0
    done = execute_sql(spark, "INSERT INTO t (b, a) VALUES ('x', 1), ('y', ?);", [2], db)
    assert (done.rows, done.affected) == (None, 2)
    assert execute_sql(spark, "insert into table t select a + 10, b from t", (), db).affected == 2
    rows = execute_sql(spark, "WITH q AS (SELECT * FROM t) SELECT a FROM q WHERE b = $1", ["x"], db).rows
    assert sorted(r["a"] for r in rows.collect()) == [1, 11]
    assert execute_sql(spark, "SELECT * FROM t WHERE 1 = 0", (), db).rows.count() == 0
    assert spark.catalog.currentDatabase() == before
    assert execute_sql(spark, "DROP TABLE t", (), db).affected == 0


def test_row_results_by_analysis(spark):
    for text in ("(SELECT 1 AS a) UNION (SELECT 2)", "-- note\nSELECT 1 AS a UNION SELECT 2", "FROM range(2) SELECT id AS a"):
        assert execute_sql(spark, text).rows.count() == 2
    db = scratch_database(spark, "sql")
    assert execute_sql(spark, "CREATE TABLE t USING parquet AS SELECT id FROM range(7)", (), db).affected == 7
    done = execute_sql(spark, "WITH q AS (SELECT id FROM range(3)) INSERT INTO t SELECT id FROM q", (), db)
    assert done == (None, 3) and spark.table(f"{db}.t").count() == 10


@pytest.fixture
def table(spark):
    """(database, what runs a statement there and returns the affected rows)."""
    db = scratch_database(spark, "sql")

    def run(text, *args):
        return execute_sql(spark, text, args, db).affected

    run("CREATE TABLE t (a INT COMMENT 'key', b STRING) USING parquet COMMENT 'note' TBLPROPERTIES ('kept' = 'yes')")
    run("CREATE TABLE p (a INT, b STRING, d STRING) USING parquet PARTITIONED BY (d)")
    run("INSERT INTO t SELECT id, concat('b', id % 3) FROM range(30)")
    return db, run


def test_counts_of_every_insert_form(spark, table):
    db, run = table
    for text, want in [
        ("INSERT INTO t BY NAME SELECT 'x' AS b, id AS a FROM range(4)", 4),
        ("INSERT INTO t /* of (two) SELECT rows */ SELECT 1, 'y' UNION ALL SELECT 2, '; -- z'", 2),
        ("-- first\nINSERT INTO TABLE t -- then\nTABLE t", 36),
        ("WITH q AS (SELECT id FROM range(5)) INSERT INTO t SELECT id, 'q' FROM q", 5),
        ("WITH q AS (SELECT id FROM range(5)), r AS (SELECT * FROM q LIMIT 3) INSERT INTO t SELECT id, 'r' FROM r", 3),
        ("FROM t INSERT INTO t SELECT a, b WHERE b = 'r' INSERT INTO p SELECT a, b, 'm' WHERE b = 'q'", 8),
        ("INSERT INTO p PARTITION (d = 'one') SELECT a, b FROM t WHERE b = 'q' ORDER BY a LIMIT 2", 2),
        ("INSERT OVERWRITE p PARTITION (d = 'one') IF NOT EXISTS SELECT 7, 'n'", 0),
        ("INSERT OVERWRITE TABLE p PARTITION (d) VALUES (1, 'v', 'two'), (2, 'w', 'three')", 2),
        ("INSERT INTO t (b) VALUES ('only b')", 1),
        ("INSERT INTO t SELECT * FROM t WHERE 1 = 0", 0),
    ]:
        assert run(text) == want, text
    assert spark.table(f"{db}.t").count() == 30 + 4 + 2 + 36 + 5 + 3 + 3 + 1


def test_counts_of_created_tables(spark, table):
    db, run = table
    assert run("CREATE TABLE IF NOT EXISTS n USING parquet AS SELECT id FROM range(6)") == 6
    assert run("CREATE TABLE IF NOT EXISTS n USING parquet AS SELECT id FROM range(9)") == 0
    assert spark.table(f"{db}.n").count() == 6
    assert run("CREATE TABLE c USING csv PARTITIONED BY (k) AS WITH q AS (SELECT id AS v, id % 2 AS k FROM range(?)) SELECT * FROM q", 11) == 11
    assert run("CREATE TABLE f AS (FROM t SELECT a)") == 30
    # the words of a query inside a comment make no query
    assert run("CREATE TABLE words (x INT) USING parquet COMMENT 'same AS SELECT 1'") == 0
    assert run("CREATE TABLE more (x INT COMMENT 'INSERT INTO t SELECT 1') USING parquet") == 0
    for text in ("TRUNCATE TABLE f", "ALTER TABLE t SET TBLPROPERTIES ('more' = 'INSERT')", "DROP TABLE f", "CREATE TEMP VIEW sqlpass_v AS SELECT 1 AS x"):
        assert run(text) == 0, text


def test_update_and_delete_text(spark, table):
    db, run = table
    assert run("UPDATE t SET b = concat(b, ?), a = a + 100 WHERE b = 'b1' AND a IN (1, 4, ?)", "it's", 7) == 3
    rows = {r["a"]: r["b"] for r in spark.table(f"{db}.t").collect()}
    assert len(rows) == 30 and [rows[k] for k in (101, 104, 107)] == ["b1it's"] * 3 and rows[10] == "b1"
    assert run("DELETE FROM t AS z WHERE z.a >= $1 -- late ones\n", 100) == 3
    assert run("delete from t where A between 20 and 24 and B <> 'b0'") == 3
    assert run("UPDATE t SET t.B = 'all'") == 24
    assert {r["b"] for r in spark.table(f"{db}.t").collect()} == {"all"}
    assert run("DELETE FROM t WHERE b = 'absent'") == 0
    told = {r["col_name"]: (r["data_type"], r["comment"]) for r in spark.sql(f"DESCRIBE TABLE EXTENDED {db}.t").collect()}
    assert told["a"] == ("int", "key") and told["Comment"][0] == "note" and "kept=yes" in told["Table Properties"][0]
    assert run("DELETE FROM t") == 24 and spark.table(f"{db}.t").count() == 0
    assert [t.name for t in spark.catalog.listTables(db) if not t.isTemporary] == ["p", "t"]


def test_update_without_a_match_or_a_column(spark, table):
    _, run = table
    with pytest.raises(Exception, match="absent"):
        run("UPDATE t SET absent = 1")
    with pytest.raises(Exception, match="(?i)column|attribute"):
        run("DELETE FROM t WHERE absent = 1")
    with pytest.raises(ValueError, match="fewer values"):
        run("DELETE FROM t WHERE a = ?")


def test_values_as_literals():
    assert fill_sql("a = ? AND b = '?' -- ?\n OR c = ?", ["x'\\", None]) == "a = 'x\\'\\\\' AND b = '?' -- ?\n OR c = NULL"


def test_a_database_is_entered_alone(spark, table):
    """Rows belong to the caller's session, whose views a statement sees and whose database stays."""
    db, run = table
    spark.range(3).createOrReplaceTempView("sqlpass_seen")
    before = spark.catalog.currentDatabase()
    rows = execute_sql(spark, "SELECT t.a FROM t JOIN sqlpass_seen ON t.a = sqlpass_seen.id", (), db).rows
    assert rows.sparkSession is spark and rows.count() == 3
    assert rows.join(spark.range(2), rows["a"] == F.col("id")).count() == 2
    assert spark.catalog.currentDatabase() == before
    spark.table(f"{db}.t").count()  # listed once, then written from the other session
    run("INSERT INTO t VALUES (99, 'new')")
    assert spark.table(f"{db}.t").where("a = 99").count() == 1
    spark.catalog.dropTempView("sqlpass_seen")


def test_database_is_restored_after_an_error(spark):
    before = spark.catalog.currentDatabase()
    with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND"):
        execute_sql(spark, "SELECT * FROM absent", (), scratch_database(spark, "sql"))
    assert spark.catalog.currentDatabase() == before


def test_query_into_table(spark):
    db = scratch_database(spark, "sql")
    text = "SELECT id, id * 2 AS twice FROM range(?)"
    assert execute_sql_into(spark, text, f"{db}.o", [30]) == 30
    table = spark.table(f"{db}.o")
    assert table.columns[1:] == ["id", "twice"] and table.columns[0].startswith("pk_")
    assert sorted(r[0] for r in table.collect()) == list(range(1, 31))
    with pytest.raises(ValueError, match="only a query"):
        execute_sql_into(spark, f"DROP TABLE {db}.o", "x")


def test_text_rows(spark):
    got = sql_rows_as_text(spark, "SELECT 1 AS a, CAST(NULL AS INT) AS b, true AS c, 1.50 AS d")
    assert got.first().asDict() == {"a": "1", "b": "", "c": "true", "d": "1.50"}
