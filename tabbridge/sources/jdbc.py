"""Relational sources over JDBC: one set of options per dialect."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabbridge.functions.names import bare
from tabbridge.operators.tables import project_by_name

# URL scheme and driver class of each dialect.
DRIVERS = {
    "mysql": ("mysql", "com.mysql.cj.jdbc.Driver"),
    "tidb": ("mysql", "com.mysql.cj.jdbc.Driver"),
    "tdsql": ("mysql", "com.mysql.cj.jdbc.Driver"),
    "doris": ("mysql", "com.mysql.cj.jdbc.Driver"),
    "kingbase": ("kingbase8", "com.kingbase8.Driver"),
    "vastbase": ("vastbase", "cn.com.vastbase.Driver"),
    "gbase": ("gbase", "com.gbase.jdbc.Driver"),
}
# URL options without TLS, by URL scheme.
PLAIN_OPTIONS = {
    "mysql": ["useSSL=false"],
    "kingbase8": ["sslmode=disable"],
    "vastbase": ["sslmode=disable"],
    "gbase": ["useSSL=false", "useDynamicCharsetInfo=false", "defaultFetchSize=-2147483648"],
}
# TLS verification levels 1 (encrypt), 2 (check CA), 3 (check host).
MYSQL_TLS = {1: "REQUIRED", 2: "VERIFY_CA", 3: "VERIFY_IDENTITY"}
POSTGRES_TLS = {1: "require", 2: "verify-ca", 3: "verify-full"}

MAX_CONNECTIONS = 64  # parallel readers on one source database


_PART = re.compile(r"""(`[^`]*`|"[^"]*")(?:\.|$)|([^.]+)(?:\.|$)""")


@dataclass(frozen=True)
class Tls:
    level: int = 1
    trust_store: str | None = None
    client_store: str | None = None
    store_password: str | None = None
    extra: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Connection:
    dialect: str
    host: str
    port: int
    database: str
    user: str = ""
    password: str = ""
    tls: Tls | None = None

    @property
    def scheme(self) -> str:
        return self._entry[0]

    @property
    def driver(self) -> str:
        return self._entry[1]

    @property
    def _entry(self) -> tuple[str, str]:
        try:
            return DRIVERS[self.dialect.lower()]
        except KeyError:
            raise ValueError(f"unsupported database type: {self.dialect}") from None

    def url(self) -> str:
        base = f"jdbc:{self.scheme}://{self.host}:{self.port}/{self.database}"
        options = self._tls_options() if self.tls else PLAIN_OPTIONS[self.scheme]
        return base + "?" + "&".join(options)

    def _tls_options(self) -> list[str]:
        tls = self.tls
        if self.scheme in ("kingbase8", "vastbase"):
            options = ["ssl=true", f"sslmode={POSTGRES_TLS.get(tls.level, 'require')}"]
        elif self.scheme == "gbase":
            verify = "true" if tls.level in (2, 3) else "false"
            options = ["useSSL=true", "requireSSL=true", f"verifyServerCertificate={verify}"]
        else:
            options = ["useSSL=true", f"sslMode={MYSQL_TLS.get(tls.level, 'REQUIRED')}"]
        if self.scheme in ("mysql", "gbase"):
            stores = {"trust": tls.trust_store, "client": tls.client_store}
            for kind, store in stores.items():
                if store:
                    options += [
                        f"{kind}CertificateKeyStoreUrl={store}",
                        f"{kind}CertificateKeyStoreType=PKCS12",
                        f"{kind}CertificateKeyStorePassword={tls.store_password or ''}",
                    ]
        return options + [f"{k}={v}" for k, v in tls.extra.items()]

    @property
    def mark(self) -> str:
        """The dialect's quote mark of identifiers."""
        return '"' if self.scheme in ("kingbase8", "vastbase") else "`"

    def quote(self, name: str) -> str:
        """One identifier; dots belong to the name."""
        return self.mark + bare(name).replace(self.mark, self.mark * 2) + self.mark

    def quote_table(self, name: str) -> str:
        """A table name, with the names of its schema or database before dots.

        A part that stands in quote marks keeps its dots.
        """
        parts = [a or b for a, b in _PART.findall(name.strip())]
        if not parts or any(not bare(p) for p in parts):
            raise ValueError(f"not a table name: {name!r}")
        return ".".join(map(self.quote, parts))

    def ansi_quotes(self) -> dict[str, str]:
        """Options that make a source take ``"`` for identifiers, as Spark writes them.

        Spark knows the quote marks of some products only; for the others it uses ``"``, which a
        source of the MySQL family reads as text unless the session is told otherwise.
        """
        if self.scheme != "gbase":
            return {}
        return {"sessionInitStatement": "SET SESSION sql_mode = CONCAT(@@sql_mode, ',ANSI_QUOTES')"}

    def options(self) -> dict[str, str]:
        return {
            "url": self.url(),
            "driver": self.driver,
            "user": self.user,
            "password": self.password,
            **self.ansi_quotes(),
        }


def range_options(
    key: str, low: int, high: int, batch_rows: int = 5000, max_connections: int = MAX_CONNECTIONS
) -> dict[str, str]:
    """Parallel key-range read: one range per batch, up to the connection limit.

    Beyond the limit the ranges get wider; rows are fetched ``batch_rows`` at a time.
    """
    ranges = -(-(high - low + 1) // batch_rows)
    return {
        "partitionColumn": key,
        "lowerBound": str(low),
        "upperBound": str(high + 1),
        "numPartitions": str(max(1, min(ranges, max_connections))),
        "fetchsize": str(batch_rows),
    }


def read_jdbc(
    spark: SparkSession,
    connection: Connection,
    table: str,
    columns: Sequence[str] = (),
    key: str | None = None,
    batch_rows: int = 5000,
    max_connections: int = MAX_CONNECTIONS,
    **extra: str,
) -> DataFrame:
    """A relational table. Column choice and filters are pushed into the source's query.

    With ``key`` (an integer column) the table is read in parallel ranges between its
    smallest and largest value, which the source computes. NULL keys stay in the
    first range, an empty table is one plain read.
    """
    options = {**connection.options(), **extra}

    def load(**more: str) -> DataFrame:
        return spark.read.format("jdbc").options(**options, **more).load()

    if key is None:
        return project_by_name(load(dbtable=_source_table(connection, table)), columns)
    bounds = load(query=bounds_query(connection, table, key)).select(F.col("low").cast("long"), F.col("high").cast("long")).first()
    ranged = (
        range_options(key, bounds[0], bounds[1], batch_rows, max_connections)
        if bounds[0] is not None
        else {}
    )
    return project_by_name(load(dbtable=_source_table(connection, table), **ranged), columns)


def bounds_query(connection: Connection, table: str, key: str) -> str:
    """Smallest and largest key, computed inside the source."""
    mark = _source_mark(connection)
    quoted = mark + bare(key).replace(mark, mark * 2) + mark
    return f"SELECT MIN({quoted}) AS low, MAX({quoted}) AS high FROM {_source_table(connection, table)}"


def count_query(connection: Connection, table: str) -> str:
    """Number of rows, computed inside the source."""
    return f"SELECT COUNT(*) AS n FROM {_source_table(connection, table)}"


def _source_mark(connection: Connection) -> str:
    """The mark that holds in a session with the connection's options."""
    return '"' if connection.ansi_quotes() else connection.mark


def _source_table(connection: Connection, table: str) -> str:
    return connection.quote_table(table).replace(connection.mark, _source_mark(connection))


def count_jdbc(spark: SparkSession, connection: Connection, table: str, **extra: str) -> int:
    """Rows of a relational table; only the number leaves the source."""
    options = {**connection.options(), **extra}
    rows = spark.read.format("jdbc").options(**options, query=count_query(connection, table)).load()
    return int(rows.first()[0])


def key_bounds_jdbc(
    spark: SparkSession, connection: Connection, table: str, key: str, **extra: str
) -> tuple[int | None, int | None]:
    """Smallest and largest value of an integer key, computed inside the source."""
    options = {**connection.options(), **extra}
    rows = spark.read.format("jdbc").options(**options, query=bounds_query(connection, table, key)).load()
    low, high = rows.select(F.col("low").cast("long"), F.col("high").cast("long")).first()
    return low, high


def write_jdbc(
    df: DataFrame,
    connection: Connection,
    table: str,
    mode: str = "append",
    batch_rows: int = 5000,
    max_connections: int = MAX_CONNECTIONS,
    **extra: str,
) -> None:
    """Append rows to a relational table, creating it from the schema when it is missing."""
    (
        df.write.format("jdbc")
        .options(**connection.options(), **extra)
        .option("dbtable", _source_table(connection, table))
        .option("batchsize", batch_rows)
        .option("numPartitions", max_connections)
        .mode(mode)
        .save()
    )
