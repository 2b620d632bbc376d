"""Text with \\x01-separated cells: typed load, strict or with rejects, and its writer."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabbridge.functions.declared import require_flat
from tabbridge.functions.names import col
from tabbridge.functions.sizing import EXPORT_FILE_BYTES
from tabbridge.functions.text import (
    FIELD_SEPARATOR,
    NULL_TOKENS,
    WHITESPACE,
    clean_line_breaks,
    parse_sql,
    quick_parse_sql,
    snapshot_text,
)
from tabbridge.sources.capped import save_csv
from tabbridge.sources.records import BLOCK_BYTES, read_cells, splittable

REJECT_REASON = "reject_reason"


def write_delimited(
    df: DataFrame,
    path: str,
    clean_breaks: bool = False,
    null_token: str = "\\N",
    max_file_bytes: int = EXPORT_FILE_BYTES,
) -> None:
    """Headered \\x01 CSV parts. Cleaned of line breaks, the parts are splittable on read."""
    require_flat(df.schema)
    cells = []
    for f in df.schema.fields:
        text = snapshot_text(col(f.name), f.dataType)
        if isinstance(f.dataType, T.BinaryType):
            text = F.hex(col(f.name))
        if clean_breaks and isinstance(f.dataType, T.StringType):
            text = clean_line_breaks(text)
        cells.append(F.when(col(f.name).isNull(), F.lit(null_token)).otherwise(text).alias(f.name))
    save_csv(df.select(cells), path, max_file_bytes, {"sep": FIELD_SEPARATOR})


def _raw(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType, multiline: bool, sep: str, block_bytes: int
) -> DataFrame:
    """Cells as text. Text with line breaks in cells is read by many tasks of a file, too."""
    paths = path if isinstance(path, str) else list(path)
    if multiline:
        listed = spark.read.format("binaryFile").load(paths).select("path", "length").collect()
        files = [(r["path"], r["length"]) for r in listed]
        if splittable([name for name, _ in files]):
            options = {"sep": sep, "escape": '"', "mode": "PERMISSIVE"}
            return read_cells(spark, files, schema.fieldNames(), options, block_bytes)
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    return (
        spark.read.schema(text)
        .option("header", True)
        .option("enforceSchema", True)
        .option("sep", sep)
        .option("escape", '"')
        .option("multiLine", multiline)
        .option("mode", "PERMISSIVE")
        .csv(paths)
    )


def _missing_sql(trimmed: str) -> str:
    """SQL form of ``is_missing``."""
    tokens = ", ".join(f"r'{t}'" for t in NULL_TOKENS)
    return (
        f"({trimmed} IS NULL OR {trimmed} = '' OR {trimmed} IN ({tokens}) "
        f"OR (octet_length({trimmed}) = 4 AND upper({trimmed}) = 'NULL'))"
    )


def _trim_sql(cell: str) -> str:
    marks = "".join(f"\\u{ord(c):04x}" for c in WHITESPACE)
    return f"btrim({cell}, '{marks}')"


def _quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _typed_sql(f: T.StructField, otherwise: str) -> str:
    """Typed value of a cell as SQL text.

    A well-formed cell takes the quick parse. Only when that gives NULL, the trimmed
    text is looked at: a missing cell is NULL, another form of the value is parsed, and
    anything else is ``otherwise`` (which may use the trimmed text ``t``). This part
    sits in a lambda, so it is bound once and kept out of the generated code.
    """
    cell = _quote(f.name)
    trimmed = _trim_sql(cell)
    if isinstance(f.dataType, T.StringType):
        return f"IF({_missing_sql(trimmed)}, NULL, {trimmed})"
    slow = (
        f"transform(array({trimmed}), t -> IF({_missing_sql('t')}, NULL, "
        f"coalesce({parse_sql('t', f.dataType)}, {otherwise})))[0]"
    )
    quick = quick_parse_sql(cell, f.dataType)
    return slow if quick is None else f"coalesce({quick}, {slow})"


def read_delimited(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType,
    null_policy: str = "sql",
    multiline: bool = True,
    sep: str = FIELD_SEPARATOR,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Typed load that fails on the first cell that does not fit its type.

    The header of every part is skipped and columns go by position; short rows end in
    missing cells, surplus cells are dropped, surplus decimals are cut. Missing cells are NULL,
    with ``null_policy="csv"`` '' in text columns. Parts are split between tasks also where
    cells hold line breaks (see ``records``); ``multiline=False`` states that none does, which
    saves counting quotes first.
    """
    if null_policy not in ("sql", "csv"):
        raise ValueError("null_policy must be 'sql' or 'csv'")
    out = []
    for f in schema.fields:
        what = _text(f"column {f.name}: cannot parse {f.dataType.simpleString()}: ")
        value = _typed_sql(f, f"raise_error(concat({what}, t))")
        if null_policy == "csv" and isinstance(f.dataType, T.StringType):
            value = f"coalesce({value}, '')"
        out.append(f"{value} AS {_quote(f.name)}")
    return _raw(spark, path, schema, multiline, sep, block_bytes).selectExpr(*out)


class Load(NamedTuple):
    rows: DataFrame  # raw cells, parsed values and the reject reason
    good: DataFrame
    rejects: DataFrame
    counters: Observation  # total_rows, loaded_rows, failed_rows, filled by an action on rows


def load_with_rejects(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType,
    multiline: bool = True,
    sep: str = FIELD_SEPARATOR,
    block_bytes: int = BLOCK_BYTES,
) -> Load:
    """Typed load that keeps unparsable rows apart instead of failing.

    ``rejects`` holds the original cells and the names of the columns that did not
    parse. The three counters are observed on ``rows``, so one write of ``rows``
    yields data, rejects and counters in a single pass.
    """
    raw = _raw(spark, path, schema, multiline, sep, block_bytes)
    names = [_quote(f.name) for f in schema.fields]
    typed = [_typed_sql(f, "NULL") for f in schema.fields]
    parsed = raw.selectExpr(
        f"named_struct({', '.join(f'{_text(f.name)}, {n}' for f, n in zip(schema.fields, names))})"
        " AS raw",
        f"named_struct({', '.join(f'{_text(f.name)}, {v}' for f, v in zip(schema.fields, typed))})"
        " AS typed",
    )
    bad = [
        f"IF(typed.{n} IS NULL, transform(array({_trim_sql(f'raw.{n}')}), "
        f"t -> IF({_missing_sql('t')}, NULL, {_text(f.name)}))[0], NULL)"
        for f, n in zip(schema.fields, names)
    ]
    rows = parsed.selectExpr(
        "raw", "typed", f"nullif(concat_ws(',', {', '.join(bad)}), '') AS {REJECT_REASON}"
    )
    counters = Observation()
    is_bad = F.col(REJECT_REASON).isNotNull()
    rows = rows.observe(
        counters,
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(~is_bad).alias("loaded_rows"),
        F.count_if(is_bad).alias("failed_rows"),
    )
    return Load(
        rows,
        rows.where(~is_bad).select("typed.*"),
        rows.where(is_bad).select("raw.*", REJECT_REASON),
        counters,
    )


def load_counters(rows: DataFrame) -> DataFrame:
    """total_rows, loaded_rows and failed_rows of ``Load.rows`` as a one-row table."""
    bad = F.col(REJECT_REASON).isNotNull()
    return rows.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(~bad).alias("loaded_rows"),
        F.count_if(bad).alias("failed_rows"),
    )
