"""Declared type names of the supported database dialects and their Spark types."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabbridge.functions.names import bare, col, require

# Dialect families. The first of each row is the family name.
DIALECT_FAMILIES = {
    "mysql": "mysql",
    "tidb": "mysql",
    "tdsql": "mysql",
    "gbase": "mysql",
    "kingbase": "postgres",
    "vastbase": "postgres",
    "doris": "doris",
}

# Type name -> Spark type. Unsigned types take the next wider signed one.
COMMON_TYPES: dict[str, T.DataType] = {
    "TINYINT": T.ByteType(),
    "SMALLINT": T.ShortType(),
    "MEDIUMINT": T.IntegerType(),
    "INT": T.IntegerType(),
    "INTEGER": T.IntegerType(),
    "BIGINT": T.LongType(),
    "UNSIGNED TINYINT": T.ShortType(),
    "UNSIGNED SMALLINT": T.IntegerType(),
    "UNSIGNED MEDIUMINT": T.LongType(),
    "UNSIGNED INT": T.LongType(),
    "UNSIGNED BIGINT": T.DecimalType(20, 0),
    "FLOAT": T.FloatType(),
    "DOUBLE": T.DoubleType(),
    "BOOLEAN": T.BooleanType(),
    "BOOL": T.BooleanType(),
    "CHAR": T.StringType(),
    "VARCHAR": T.StringType(),
    "STRING": T.StringType(),
    "TEXT": T.StringType(),
    "TINYTEXT": T.StringType(),
    "MEDIUMTEXT": T.StringType(),
    "LONGTEXT": T.StringType(),
    "CLOB": T.StringType(),
    "TIME": T.StringType(),
    "BLOB": T.BinaryType(),
    "TINYBLOB": T.BinaryType(),
    "MEDIUMBLOB": T.BinaryType(),
    "LONGBLOB": T.BinaryType(),
    "BYTEA": T.BinaryType(),
    "DATE": T.DateType(),
    "DATETIME": T.TimestampNTZType(),
    "TIMESTAMP": T.TimestampNTZType(),
}
POSTGRES_TYPES: dict[str, T.DataType] = {
    "INT2": T.ShortType(),
    "INT4": T.IntegerType(),
    "INT8": T.LongType(),
    "REAL": T.FloatType(),
    "FLOAT4": T.FloatType(),
    "FLOAT8": T.DoubleType(),
    "FLOAT": T.DoubleType(),
    "DOUBLE PRECISION": T.DoubleType(),
    "YEAR": T.LongType(),
}
DOCUMENTED_DEFAULT = T.StringType()  # any other name is text
UNSIZED_DECIMAL = T.DecimalType(38, 10)
UNSIZED_DORIS_DECIMAL = T.DecimalType(10, 0)

_SIZE = re.compile(r"\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)")


def family(dialect: str) -> str:
    try:
        return DIALECT_FAMILIES[dialect.strip().lower()]
    except KeyError:
        raise ValueError(f"unsupported database type: {dialect}") from None


def declared_type(type_name: str, dialect: str = "mysql") -> T.DataType:
    """Spark type for a declared type name such as ``DECIMAL(10,2)`` or ``INT UNSIGNED``."""
    group = family(dialect)
    name = " ".join(type_name.upper().split())
    size = _SIZE.search(name)
    name = " ".join(_SIZE.sub(" ", name).split())
    if name.endswith(" UNSIGNED"):
        name = "UNSIGNED " + name.removesuffix(" UNSIGNED")
    if name in ("DECIMAL", "NUMERIC"):
        if size is None:
            return UNSIZED_DORIS_DECIMAL if group == "doris" else UNSIZED_DECIMAL
        precision, scale = int(size.group(1)), int(size.group(2) or 0)
        return T.DecimalType(min(precision, 38), min(scale, 38))
    if group == "postgres" and name in POSTGRES_TYPES:
        return POSTGRES_TYPES[name]
    return COMMON_TYPES.get(name, DOCUMENTED_DEFAULT)


def declared_schema(columns: list[tuple[str, str]], dialect: str = "mysql") -> T.StructType:
    """(name, declared type) pairs to a schema; an empty or absent list is an error."""
    if not columns:
        raise ValueError("no columns specified")
    if any(not name.strip() for name, _ in columns):
        raise ValueError("column name cannot be empty")
    return T.StructType([T.StructField(n, declared_type(t, dialect)) for n, t in columns])


def cast_declared(df: DataFrame, declared: dict[str, str], dialect: str = "mysql") -> DataFrame:
    """Cast the named columns to their declared types; the others stay as they are."""
    require(df, declared)
    targets = {bare(n): declared_type(t, dialect) for n, t in declared.items()}
    return df.select(
        [col(c).cast(targets[c]).alias(c) if c in targets else col(c) for c in df.columns]
    )


def warehouse_type(data_type: T.DataType) -> str:
    """Warehouse column type of a Spark type, as used in generated table definitions."""
    if isinstance(data_type, T.DecimalType):
        return f"DECIMAL({data_type.precision},{data_type.scale})"
    # Fixed values.
    names = {
        T.ByteType: "TINYINT",
        T.ShortType: "SMALLINT",
        T.IntegerType: "INT",
        T.LongType: "BIGINT",
        T.FloatType: "FLOAT",
        T.DoubleType: "DOUBLE",
        T.BooleanType: "BOOLEAN",
        T.DateType: "DATE",
        T.TimestampType: "DATETIME",
        T.TimestampNTZType: "DATETIME",
        T.StringType: "STRING",
    }
    return names.get(type(data_type), "VARCHAR(65533)")


def require_flat(schema: T.StructType) -> None:
    """The data model has scalar columns only."""
    nested = [
        f.name
        for f in schema.fields
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))
    ]
    if nested:
        raise ValueError(f"nested columns are not supported: {nested}")




@dataclass(frozen=True)
class ColumnInfo:
    """Declared column: type name of its dialect, NULL rule and default text."""

    name: str
    data_type: str
    nullable: bool = True
    default: str = ""


def conform(df: DataFrame, columns: list[ColumnInfo], dialect: str = "mysql") -> DataFrame:
    """The declared columns with their declared types, in declared order.

    A NULL takes the column's default. A NULL left in a NOT NULL column fails the job.
    """
    require(df, [c.name for c in columns])
    out = []
    for c in columns:
        kind = declared_type(c.data_type, dialect)
        value = col(c.name).cast(kind)
        if c.default:
            value = F.coalesce(value, F.lit(c.default).cast(kind))
        if not c.nullable:
            missing = F.raise_error(f"column {c.name} must not be NULL").cast(kind)
            value = F.coalesce(value, missing)
        out.append(value.alias(bare(c.name)))
    return df.select(out)
