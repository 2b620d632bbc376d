"""Options only: no database runs here."""

import pytest

from tabbridge.sources.jdbc import Connection, Tls, bounds_query, count_query, range_options


def url(dialect, tls=None):
    return Connection(dialect, "h", 1234, "d", "u", "p", tls).url()


@pytest.mark.parametrize(
    ("dialect", "want"),
    [
        ("mysql", "jdbc:mysql://h:1234/d?useSSL=false"),
        ("TiDB", "jdbc:mysql://h:1234/d?useSSL=false"),
        ("tdsql", "jdbc:mysql://h:1234/d?useSSL=false"),
        ("doris", "jdbc:mysql://h:1234/d?useSSL=false"),
        ("kingbase", "jdbc:kingbase8://h:1234/d?sslmode=disable"),
        ("vastbase", "jdbc:vastbase://h:1234/d?sslmode=disable"),
        (
            "gbase",
            "jdbc:gbase://h:1234/d?useSSL=false&useDynamicCharsetInfo=false"
            "&defaultFetchSize=-2147483648",
        ),
    ],
)
def test_plain_urls(dialect, want):
    assert url(dialect) == want


@pytest.mark.parametrize(
    ("dialect", "level", "want"),
    [
        ("mysql", 1, "useSSL=true&sslMode=REQUIRED"),
        ("mysql", 2, "useSSL=true&sslMode=VERIFY_CA"),
        ("mysql", 3, "useSSL=true&sslMode=VERIFY_IDENTITY"),
        ("mysql", 9, "useSSL=true&sslMode=REQUIRED"),
        ("kingbase", 2, "ssl=true&sslmode=verify-ca"),
        ("vastbase", 3, "ssl=true&sslmode=verify-full"),
        ("gbase", 1, "useSSL=true&requireSSL=true&verifyServerCertificate=false"),
        ("gbase", 3, "useSSL=true&requireSSL=true&verifyServerCertificate=true"),
    ],
)
def test_tls_levels(dialect, level, want):
    assert url(dialect, Tls(level)).split("?")[1] == want


def test_key_stores():
    options = url("mysql", Tls(2, "file:/ca.p12", "file:/me.p12", "s")).split("?")[1].split("&")
    assert "trustCertificateKeyStoreUrl=file:/ca.p12" in options
    assert "clientCertificateKeyStoreType=PKCS12" in options
    assert options.count("trustCertificateKeyStorePassword=s") == 1


def test_quotes_and_drivers():
    assert Connection("mysql", "h", 1, "d").quote("a`b") == "`a``b`"
    assert Connection("kingbase", "h", 1, "d").quote("a") == '"a"'
    assert Connection("vastbase", "h", 1, "d").driver == "cn.com.vastbase.Driver"
    with pytest.raises(ValueError, match="unsupported"):
        url("sqlite")


def test_names_with_schemas():
    mysql, kingbase, gbase = (Connection(d, "h", 1, "d") for d in ("mysql", "kingbase", "gbase"))
    assert mysql.quote_table("db.t") == "`db`.`t`" and kingbase.quote_table(" s.t ") == '"s"."t"'
    assert kingbase.quote_table('db."odd.name".t') == '"db"."odd.name"."t"'
    assert mysql.quote_table("`a.b`") == "`a.b`" and mysql.quote_table('x."y"') == "`x`.`y`"
    assert mysql.quote_table("plain") == "`plain`"
    for bad in ("", " ", "``"):
        with pytest.raises(ValueError, match="not a table name"):
            mysql.quote_table(bad)
    assert gbase.quote_table("db.t") == "`db`.`t`"


def test_sessions_that_take_double_quotes():
    """Spark quotes columns with its own mark; a source it does not know is told to take it."""
    gbase = Connection("gbase", "h", 1, "d").options()
    assert "ANSI_QUOTES" in gbase["sessionInitStatement"]
    for dialect in ("mysql", "tidb", "kingbase", "vastbase", "doris"):
        assert "sessionInitStatement" not in Connection(dialect, "h", 1, "d").options()


def test_counts_and_bounds_inside_the_source():
    mysql, vastbase, gbase = (Connection(d, "h", 1, "d") for d in ("mysql", "vastbase", "gbase"))
    assert count_query(mysql, "db.t") == "SELECT COUNT(*) AS n FROM `db`.`t`"
    assert bounds_query(vastbase, "s.t", "id") == 'SELECT MIN("id") AS low, MAX("id") AS high FROM "s"."t"'
    assert bounds_query(gbase, "t", "i`d") == 'SELECT MIN("i`d") AS low, MAX("i`d") AS high FROM "t"'


def test_ranges():
    assert range_options("id", 0, 14999)["numPartitions"] == "3"
    wide = range_options("id", 1, 10**9, 5000, 64)
    assert (wide["numPartitions"], wide["lowerBound"], wide["upperBound"]) == (
        "64", "1", "1000000001",
    )
    assert range_options("id", 5, 5)["numPartitions"] == "1"


def test_assets_ask_their_source(spark, monkeypatch, tmp_path):
    from tabbridge.sources import assets

    asked = []
    monkeypatch.setattr(assets, "count_jdbc", lambda _, c, table: asked.append((c.dialect, table)) or 7)
    monkeypatch.setattr(assets, "key_bounds_jdbc", lambda _, c, table, key: asked.append((table, key)) or (1, 9))
    relational = assets.Asset("a", "jdbc", "s.t", connection=Connection("kingbase", "h", 1, "d"))
    assert relational.count(spark) == 7 and relational.key_bounds(spark, "id") == (1, 9)
    assert asked == [("kingbase", "s.t"), ("s.t", "id")]
    spark.range(5, 25).write.parquet(str(tmp_path / "p"))
    files = assets.Asset("b", "parquet", str(tmp_path / "p"))
    assert files.count(spark) == 20 and files.key_bounds(spark, "id") == (5, 24)
