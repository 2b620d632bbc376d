"""Table snapshots: table definition, header, and \\x01 / \\u2028 separated text."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabbridge.functions.coerce import truncate_decimal
from tabbridge.functions.declared import family, require_flat, warehouse_type
from tabbridge.functions.names import col
from tabbridge.functions.sizing import EXPORT_FILE_BYTES, file_rows_for
from tabbridge.functions.text import FIELD_SEPARATOR, HEX_SHAPE, ROW_SEPARATOR, snapshot_text
from tabbridge.sources.capped import save_lines


def snapshot_ddl(schema: T.StructType, table: str, dialect: str = "mysql") -> str:
    """CREATE TABLE text with the dialect's identifier quotes."""
    quote = '"' if family(dialect) == "postgres" else "`"
    lines = []
    for f in schema.fields:
        kind = warehouse_type(f.dataType)
        lines.append(f"  {quote}{f.name}{quote} {kind}" + ("" if f.nullable else " NOT NULL"))
    body = ",\n".join(lines)
    return f"CREATE TABLE {quote}{table}{quote} (\n{body}\n);\n"


def _cell(f: T.StructField) -> Column:
    text = snapshot_text(col(f.name), f.dataType)
    if not isinstance(f.dataType, T.StringType):
        return text
    clash = text.contains(FIELD_SEPARATOR) | text.contains(ROW_SEPARATOR)
    message = F.lit(f"snapshot: column {f.name} holds a separator character")
    return F.when(clash, F.raise_error(message).cast("string")).otherwise(text)


def write_snapshot(
    df: DataFrame,
    path: str,
    table: str,
    dialect: str = "mysql",
    max_file_bytes: int = EXPORT_FILE_BYTES,
) -> None:
    """Write ``schema`` (table definition), ``header`` and ``data`` below ``path``.

    header + data parts, concatenated in name order, are one snapshot file. Text that
    holds a separator fails the write, since it could not be read back.
    """
    require_flat(df.schema)
    spark = df.sparkSession

    def one_line(text: str, folder: str, sep: str) -> None:
        line = spark.createDataFrame([(text,)], "value string").coalesce(1)
        line.write.option("lineSep", sep).text(f"{path}/{folder}")

    one_line(snapshot_ddl(df.schema, table, dialect).rstrip("\n"), "schema", "\n")
    one_line(FIELD_SEPARATOR.join(df.columns), "header", ROW_SEPARATOR)
    lines = df.select(F.concat_ws(FIELD_SEPARATOR, *[_cell(f) for f in df.schema.fields]).alias("line"))
    if not save_lines(lines, f"{path}/data", max_file_bytes, "txt", ROW_SEPARATOR):
        writer = lines.write.option("lineSep", ROW_SEPARATOR)
        writer.option("maxRecordsPerFile", file_rows_for(df.schema, max_file_bytes)).text(f"{path}/data")


def _value(text: Column, data_type: T.DataType) -> Column:
    """Typed cell; empty is NULL. Text that does not fit the type is NULL as well, see ``_misfit``."""
    text = F.nullif(text, F.lit(""))
    if isinstance(data_type, T.StringType):
        return text
    if isinstance(data_type, T.BooleanType):
        return F.when(text == "true", F.lit(True)).when(text == "false", F.lit(False))
    if isinstance(data_type, T.DecimalType):
        p, s = data_type.precision, data_type.scale
        return truncate_decimal(text.try_cast(T.DecimalType(38, 38 - p + s)), p, s)
    if isinstance(data_type, T.BinaryType):
        digits = F.substring(text, 3, 1 << 30)
        is_hex = text.startswith("0x") & digits.rlike(HEX_SHAPE)
        return F.when(text == "0x", F.unhex(F.lit(""))).when(is_hex, F.unhex(digits)).otherwise(
            text.cast("binary")
        )
    return text.try_cast(data_type)


def _misfit(text: Column, data_type: T.DataType) -> Column:
    """The cell holds text that is no value of its type."""
    if isinstance(data_type, (T.StringType, T.BinaryType)):
        return F.lit(False)
    return (text != "") & _value(text, data_type).isNull()


class Snapshot(NamedTuple):
    rows: DataFrame
    bad: DataFrame  # one row: bad_rows = wrong_fields + wrong_values


def read_snapshot(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    header: bool = False,
) -> Snapshot:
    """Rows of a snapshot, and the number of lines that are none.

    Those are lines with a wrong field count, and lines with a cell that does not parse as
    its column's type; surplus decimals are cut. ``path`` is a folder written by ``write_snapshot``, or with ``header=True`` plain
    snapshot files whose first line is the column header. The text stays splittable.
    """
    folder = path if header else f"{path}/data"
    lines = spark.read.option("lineSep", ROW_SEPARATOR).text(folder)
    if header:
        first_block = F.col("_metadata.file_block_start") == 0
        title = F.col("value") == FIELD_SEPARATOR.join(schema.fieldNames())
        lines = lines.where(~(first_block & title))
    cells = F.split("value", FIELD_SEPARATOR, -1)
    if len(schema.fields) > 1:
        lines = lines.where(F.trim("value") != "")
    split = lines.select(cells.alias("cells"))
    fits = F.size("cells") == len(schema.fields)
    misfits = [_misfit(F.get("cells", F.lit(i)), f.dataType) for i, f in enumerate(schema.fields)]
    odd = F.coalesce(reduce(lambda a, b: a | b, misfits), F.lit(False))
    rows = split.where(fits & ~odd).select(
        [
            _value(F.get("cells", F.lit(i)), f.dataType).alias(f.name)
            for i, f in enumerate(schema.fields)
        ]
    )
    counts = split.agg(
        F.count_if(~fits).alias("wrong_fields"), F.count_if(fits & odd).alias("wrong_values")
    )
    return Snapshot(rows, counts.select((F.col("wrong_fields") + F.col("wrong_values")).alias("bad_rows"), "*"))
