"""Named sources: registered assets, intermediate tables and warehouse tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabbridge.functions.declared import ColumnInfo, conform, declared_type
from tabbridge.functions.names import col
from tabbridge.functions.ordering import SortRule
from tabbridge.functions.predicates import Filter
from tabbridge.operators.tables import read_table
from tabbridge.sources.delimited import read_delimited
from tabbridge.sources.files import file_format, read_files
from tabbridge.sources.jdbc import Connection, count_jdbc, key_bounds_jdbc, read_jdbc
from tabbridge.sources.managed import table_name
from tabbridge.sources.snapshot import read_snapshot

AUTO_INCREMENT = "AUTO_INCREMENT"
KEY_TYPES = ("PRIMARY", "FOREIGN", "UNIQUE", "INDEX", AUTO_INCREMENT)


@dataclass(frozen=True)
class TableKey:
    """Key of a table, possibly over several columns. Only auto-increment keys have an effect."""

    type: str
    columns: Sequence[str]
    name: str = ""

    def __post_init__(self) -> None:
        if self.type not in KEY_TYPES:
            raise ValueError(f"unknown key type: {self.type}")


def auto_increment_key(keys: Iterable[TableKey]) -> str | None:
    """Column of the first auto-increment key that has exactly one column."""
    for key in keys:
        names = [c.strip() for c in key.columns]
        if key.type == AUTO_INCREMENT and len(names) == 1 and names[0]:
            return names[0]
    return None


@dataclass(frozen=True)
class Asset:
    """A registered source table: where it is and which columns it declares.

    ``kind`` is a file format, ``delimited``, ``snapshot``, ``managed`` or ``jdbc``;
    ``place`` is a path or a table name.
    """

    name: str
    kind: str
    place: str
    columns: Sequence[ColumnInfo] = ()
    dialect: str = "mysql"
    connection: Connection | None = None
    keys: Sequence[TableKey] = field(default_factory=tuple)

    def schema(self) -> T.StructType | None:
        if not self.columns:
            return None
        return T.StructType(
            [T.StructField(c.name, declared_type(c.data_type, self.dialect)) for c in self.columns]
        )

    def open(self, spark: SparkSession) -> DataFrame:
        """All rows of the asset, as declared."""
        if self.kind == "jdbc":
            if self.connection is None:
                raise ValueError(f"asset {self.name} has no connection")
            rows = read_jdbc(
                spark, self.connection, self.place, key=auto_increment_key(self.keys)
            )
        elif self.kind == "managed":
            rows = spark.table(self.place)
        elif self.kind == "delimited":
            return read_delimited(spark, self.place, self._declared())
        elif self.kind == "snapshot":
            return read_snapshot(spark, self.place, self._declared()).rows
        else:
            fmt = file_format(self.kind)
            declared = self.schema() if fmt in ("csv", "json", "arrow") else None
            rows = read_files(spark, self.place, fmt, declared)
        return conform(rows, list(self.columns), self.dialect) if self.columns else rows

    def count(self, spark: SparkSession) -> int:
        """Number of rows; a relational table is counted inside its source."""
        if self.kind == "jdbc" and self.connection is not None:
            return count_jdbc(spark, self.connection, self.place)
        return self.open(spark).count()

    def key_bounds(self, spark: SparkSession, key: str) -> tuple[int | None, int | None]:
        """Smallest and largest value of an integer key; of a relational table, by its source."""
        if self.kind == "jdbc" and self.connection is not None:
            return key_bounds_jdbc(spark, self.connection, self.place, key)
        low, high = self.open(spark).agg(F.min(col(key)), F.max(col(key))).first()
        return low, high

    def _declared(self) -> T.StructType:
        schema = self.schema()
        if schema is None:
            raise ValueError(f"asset {self.name} declares no columns")
        return schema


@dataclass(frozen=True)
class Internal:
    """An intermediate table, named by job and table."""

    table: str
    job: str | None = None
    database: str | None = None

    def open(self, spark: SparkSession) -> DataFrame:
        name = table_name(self.table, self.job)
        return spark.table(f"{self.database}.{name}" if self.database else name)


@dataclass(frozen=True)
class Warehouse:
    table: str
    database: str

    def open(self, spark: SparkSession) -> DataFrame:
        return spark.table(f"{self.database}.{self.table}")


class Registry:
    """Assets by name."""

    def __init__(self, assets: Iterable[Asset] = ()):
        self.assets: Mapping[str, Asset] = {a.name: a for a in assets}

    def asset(self, name: str) -> Asset:
        try:
            return self.assets[name]
        except KeyError:
            raise ValueError(f"unknown asset: {name}") from None


def read(
    spark: SparkSession,
    source: Asset | Internal | Warehouse,
    columns: Sequence[str] = (),
    filters: Iterable[Filter | Sequence[Any]] = (),
    sort: Iterable[SortRule] = (),
) -> DataFrame:
    """General read: one lazy plan from any kind of source, nothing is staged.

    Files give their rows in the same order when a task is run again, so their sort needs no
    pre-sort. A relational source does not, nor does a table that may be a view.
    """
    repeats = isinstance(source, Asset) and source.kind not in ("jdbc", "managed")
    return read_table(source.open(spark), columns, filters, sort, from_scan=repeats)
