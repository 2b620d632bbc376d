"""Repeatable test data: every value is a function of (seed, column, id)."""

from __future__ import annotations

import datetime as dt
import decimal
import random
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tabbridge.functions.declared import declared_type
from tabbridge.functions.names import col, require

NULLABLE_SHARE = 0.3
NULL_PERCENT = 10
OPEN_SIZE = 1024  # of types without a declared size
DAYS = 365

# Template type name -> declared type, by dialect.
_KINGBASE_TEMPLATES = {
    "int": "INTEGER",
    "smallint": "SMALLINT",
    "bigint": "BIGINT",
    "real": "REAL",
    "double": "DOUBLE PRECISION",
    "numeric": "NUMERIC(10,2)",
    "decimal": "NUMERIC(10,2)",
    "varchar": "VARCHAR(255)",
    "char": "CHAR(255)",
    "text": "TEXT",
    "clob": "CLOB",
    "date": "DATE",
    "timestamp": "TIMESTAMP",
    "bytea": "BYTEA",
}
_MYSQL_TEMPLATES = {
    "int": "INT",
    "tinyint": "TINYINT",
    "smallint": "SMALLINT",
    "mediumint": "MEDIUMINT",
    "bigint": "BIGINT",
    "float": "FLOAT",
    "double": "DOUBLE",
    "decimal": "DECIMAL(10,2)",
    "decimal18": "DECIMAL(18,4)",
    "decimal38": "DECIMAL(38,6)",
    "varchar": "VARCHAR(255)",
    "char": "CHAR(255)",
    "text": "TEXT",
    "mediumtext": "MEDIUMTEXT",
    "date": "DATE",
    "datetime": "DATETIME",
    "timestamp": "TIMESTAMP",
    "blob": "BLOB",
    "tinyblob": "TINYBLOB",
    "mediumblob": "MEDIUMBLOB",
}
# Declared types drawn from when no template list is given.
_MYSQL_POOL = (
    "TINYINT", "SMALLINT", "MEDIUMINT", "INT", "BIGINT",
    "FLOAT", "DOUBLE", "DECIMAL(10,2)", "DECIMAL(18,4)", "DECIMAL(38,6)",
    "CHAR(100)", "CHAR(255)", "VARCHAR(255)", "VARCHAR(512)", "VARCHAR(1024)",
    "TEXT", "MEDIUMTEXT", "DATE", "DATETIME", "TIMESTAMP",
    "BLOB", "TINYBLOB", "MEDIUMBLOB",
)
_GBASE_POOL = (
    "TINYINT", "SMALLINT", "INT", "BIGINT", "FLOAT", "DOUBLE", "DECIMAL(10,2)",
    "VARCHAR(255)", "VARCHAR(512)", "VARCHAR(1024)", "TEXT", "CLOB",
    "DATE", "DATETIME", "TIMESTAMP", "BLOB",
)
_KINGBASE_POOL = (
    "SMALLINT", "INTEGER", "BIGINT", "REAL", "DOUBLE PRECISION", "NUMERIC(10,2)",
    "VARCHAR(255)", "VARCHAR(512)", "VARCHAR(1024)", "TEXT", "CLOB",
    "DATE", "TIMESTAMP", "BYTEA",
)
_VASTBASE_POOL = (
    "SMALLINT", "INTEGER", "BIGINT", "REAL", "DOUBLE PRECISION", "NUMERIC(10,2)",
    "VARCHAR(255)", "VARCHAR(512)", "VARCHAR(1024)", "TEXT",
    "DATE", "TIMESTAMP", "BYTEA",
)
_GBASE_TEMPLATES = {
    "int": "INT",
    "tinyint": "TINYINT",
    "smallint": "SMALLINT",
    "bigint": "BIGINT",
    "float": "FLOAT",
    "double": "DOUBLE",
    "decimal": "DECIMAL(10,2)",
    "varchar": "VARCHAR(255)",
    "char": "CHAR(255)",
    "text": "TEXT",
    "clob": "CLOB",
    "date": "DATE",
    "datetime": "DATETIME",
    "timestamp": "TIMESTAMP",
    "blob": "BLOB",
}
_VASTBASE_TEMPLATES = {
    "int": "INTEGER",
    "smallint": "SMALLINT",
    "bigint": "BIGINT",
    "real": "REAL",
    "double": "DOUBLE PRECISION",
    "numeric": "NUMERIC(10,2)",
    "decimal": "NUMERIC(10,2)",
    "varchar": "VARCHAR(255)",
    "char": "CHAR(255)",
    "text": "TEXT",
    "date": "DATE",
    "timestamp": "TIMESTAMP",
    "bytea": "BYTEA",
}
TEMPLATES = {
    "mysql": _MYSQL_TEMPLATES,
    "gbase": _GBASE_TEMPLATES,
    "kingbase": _KINGBASE_TEMPLATES,
    "vastbase": _VASTBASE_TEMPLATES,
}
POOLS = {
    "mysql": _MYSQL_POOL,
    "gbase": _GBASE_POOL,
    "kingbase": _KINGBASE_POOL,
    "vastbase": _VASTBASE_POOL,
}


def _max_size(declared: str) -> int:
    name, _, size = declared.partition("(")
    if name == "VARCHAR":
        return int(size.rstrip(")"))
    if name == "CHAR":
        return int(size.rstrip(")")) if size else 255
    if any(kind in name for kind in ("TEXT", "CLOB", "BLOB", "BYTEA")):
        return OPEN_SIZE
    return 0


# What a type name that no template has is taken for, by what it holds; first match.
_GUESSES = (
    (("int",), None),
    (("char",), "VARCHAR(255)"),
    (("text",), "TEXT"),
    (("decimal", "numeric"), "DECIMAL(10,2)"),
    (("date", "time"), "DATETIME"),
)


def _template(name: str, templates: dict[str, str]) -> str:
    """Declared type for a template's type name; unknown names are guessed."""
    name = name.strip().lower()
    if name in templates:
        return templates[name]
    for parts, declared in _GUESSES:
        if any(part in name for part in parts):
            return declared or templates["int"]
    return "VARCHAR(255)"


def generate_schema(
    fields: int,
    types: Sequence[str] = (),
    dialect: str = "mysql",
    max_size: int = 0,
    seed: int = 42,
) -> T.StructType:
    """``id`` BIGINT and col_1 … col_n: ``fields`` columns, about 30 % of them nullable.

    The types cycle through the template list, or are drawn from the dialect's pool.
    Each field carries its declared type and text size in the metadata.
    """
    rng = random.Random(seed)
    if fields < 1:
        raise ValueError(f"a schema needs at least one field, not {fields}")
    templates = TEMPLATES[dialect]
    pool = [_template(t, templates) for t in types] or POOLS[dialect]
    out = [T.StructField("id", T.LongType(), False, {"declared": "BIGINT", "max_size": 0})]
    for i in range(1, fields):
        declared = pool[(i - 1) % len(pool)] if types else rng.choice(pool)
        size = _max_size(declared)
        if max_size and size > max_size:
            size = max_size
            if declared.startswith("VARCHAR"):
                declared = f"VARCHAR({max_size})"
        out.append(
            T.StructField(
                f"col_{i}",
                declared_type(declared, dialect),
                rng.random() < NULLABLE_SHARE,
                {"declared": declared, "max_size": size},
            )
        )
    return T.StructType(out)


_WORD = np.uint64(0xFFFFFFFF)
# Odd multipliers below 2^31, so that every product of the mixer fits 63 bits, in SQL as well.
MIX = (0x7FEB352D, 0x297A2D39)
STEP = 0x3C6EF35F
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 32-bit numbers."""
    for shift, factor in zip((16, 15), MIX):
        x = ((x ^ (x >> np.uint64(shift))) * np.uint64(factor)) & _WORD
    return x ^ (x >> np.uint64(16))


def stream_key(seed: int, column: str, what: str) -> int:
    """Number of the stream of draws for one use in one column."""
    return zlib.crc32(f"{seed}:{column}:{what}".encode())


class Draws:
    """Numbers that depend on the seed, the column, the use, the id and a counter only.

    ``mix(mix(low ^ key) + high + counter * STEP)``, modulo 2^32, where low and high are the
    halves of the id: no state goes from row to row, so rows may be made anywhere in any order.
    """

    def __init__(self, ids: np.ndarray, seed: int, column: str):
        self.ids, self.seed, self.column = ids.view(np.uint64), seed, column

    def word(self, what: str, counter: int | np.ndarray = 0, rows: np.ndarray | None = None) -> np.ndarray:
        """32-bit numbers for all rows, or for ``rows`` (with a counter each)."""
        ids = self.ids if rows is None else self.ids[rows]
        key = np.uint64(stream_key(self.seed, self.column, what))
        steps = np.asarray(counter, np.uint64) * np.uint64(STEP)
        return mix((mix((ids & _WORD) ^ key) + (ids >> np.uint64(32)) + steps) & _WORD)

    def below(self, limit: int, what: str = "value") -> np.ndarray:
        """Numbers from 0 to ``limit`` - 1; the limit is at most 2^31."""
        return ((self.word(what) * np.uint64(limit)) >> np.uint64(32)).astype(np.int64)

    def pieces(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Lengths from 1 to ``size``, and a 32-bit number for each place of all rows."""
        lengths = self.below(size, "length") + 1
        rows = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        return lengths, self.word("value", place, rows)


def _text_array(lengths: np.ndarray, data: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    buffers = [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())]
    return pa.Array.from_buffers(kind, len(lengths), buffers)


# Exclusive upper bounds of generated integers, by declared type.
_INTEGER_BOUNDS = {
    "TINYINT": 128,
    "SMALLINT": 32768,
    "MEDIUMINT": 8388608,
    "INT": 2147483648,
    "INTEGER": 2147483648,
}


def _values(f: T.StructField, draws: Draws, today: dt.date) -> pa.Array:
    declared = f.metadata["declared"].split("(")[0]
    size = f.metadata["max_size"] or 255
    if declared in _INTEGER_BOUNDS:
        return pa.array(draws.below(_INTEGER_BOUNDS[declared]))
    if declared == "BIGINT":
        high, low = draws.word("value"), draws.word("value", 1)
        return pa.array(np.maximum(((high >> np.uint64(1)) << np.uint64(32) | low).astype(np.int64), 1))
    if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
        high, low = draws.word("value") >> np.uint64(5), draws.word("value", 1) >> np.uint64(6)
        return pa.array(((high << np.uint64(26)) | low).astype(np.float64) / float(1 << 53) * 1000)
    if isinstance(f.dataType, T.DecimalType):
        cents = pa.array(draws.below(100_000)).cast(pa.decimal128(20, 0))
        return pc.divide(cents.cast(pa.decimal128(22, 2)), pa.scalar(decimal.Decimal(100), pa.decimal128(3, 0)))
    if isinstance(f.dataType, T.BinaryType):
        lengths, words = draws.pieces(size)
        return _text_array(lengths, words.astype(np.uint8), pa.binary())
    if isinstance(f.dataType, T.StringType):
        lengths, words = draws.pieces(size)
        letters = np.frombuffer(LETTERS.encode(), np.uint8)
        return _text_array(lengths, letters[(words * np.uint64(len(LETTERS))) >> np.uint64(32)], pa.string())
    midnight = np.datetime64(today, "D")
    if declared in ("DATE", "DATETIME"):
        days = pa.array(midnight - draws.below(DAYS).astype("timedelta64[D]"))
        return days if isinstance(f.dataType, T.DateType) else days.cast(pa.timestamp("us"))
    seconds = midnight.astype("datetime64[s]") - draws.below(DAYS * 86_400).astype("timedelta64[s]")
    return pa.array(seconds).cast(pa.timestamp("us"))


def _fill(schema: T.StructType, seed: int, today: dt.date):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(schema)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            columns = []
            for f, kind in zip(schema.fields, target):
                if f.name == "id":
                    columns.append(batch.column(0))
                    continue
                draws = Draws(ids, seed, f.name)
                values = _values(f, draws, today).cast(kind.type)
                if f.nullable:
                    keep = pa.array(draws.below(100, "null") >= NULL_PERCENT)
                    values = pc.if_else(keep, values, pa.scalar(None, kind.type))
                columns.append(values)
            yield pa.RecordBatch.from_arrays(columns, names=target.names)

    return rows


def generate_rows(
    ids: DataFrame, schema: T.StructType, seed: int = 42, today: dt.date | None = None
) -> DataFrame:
    """One row per id of ``ids`` (a frame with a BIGINT ``id``), filled by type.

    Values are drawn by counters (see ``Draws``), a batch of rows at a time, so they depend on
    nothing but the seed, the column and the id. NULL in 10 % of nullable values.
    """
    require(ids, ["id"])
    return ids.select(col("id").cast("long").alias("id")).mapInArrow(_fill(schema, seed, today or dt.date.today()), schema)


def generate_table(
    spark: SparkSession, rows: int, schema: T.StructType, seed: int = 42,
    today: dt.date | None = None,
) -> DataFrame:
    """``rows`` rows with ids 0 … rows-1."""
    return generate_rows(spark.range(rows), schema, seed, today)
