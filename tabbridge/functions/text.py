"""Text forms of values: canonical text, NULL tokens, line breaks, typed parsing, key hash."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabbridge.functions.names import col, require

# Separators and tokens of the exchange formats.
FIELD_SEPARATOR = "\x01"
ROW_SEPARATOR = "\u2028"
NULL_TOKENS = ("\\N", "\\\\N")  # plus the word NULL in any case
KEY_NULL = "\\N"
WHITESPACE = " \t\n\r\x0b\x0c\x85\xa0"
TRUE_WORDS = ("1", "t", "T", "TRUE", "true", "True")
FALSE_WORDS = ("0", "f", "F", "FALSE", "false", "False")
DATE_SHAPE = r"^\d{4}-\d{2}-\d{2}$"
TIMESTAMP_SHAPE = (
    r"^\d{4}-\d{2}-\d{2}"
    r"( \d{2}:\d{2}:\d{2}(\.\d{1,9})?|T\d{2}:\d{2}:\d{2}(Z|[+-]\d{2}:\d{2}))?$"
)
FLOAT_SHAPE = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI]nf(inity)?|NaN)$"
HEX_SHAPE = r"^([0-9A-Fa-f]{2})+$"

EPOCH_NTZ = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def is_null_token(trimmed: Column) -> Column:
    """Trimmed text is ``\\N``, ``\\\\N`` or the word NULL in any case."""
    word = (F.octet_length(trimmed) == 4) & (F.upper(trimmed) == "NULL")
    return trimmed.isin(*NULL_TOKENS) | word


def is_missing(trimmed: Column) -> Column:
    return (trimmed == "") | is_null_token(trimmed)


def normalize_null(c: Column, replacement: str | None = "") -> Column:
    """NULL tokens (after trimming) become ``replacement``; other text is kept unchanged."""
    return F.when(is_null_token(trim(c)), F.lit(replacement)).otherwise(c)


def clean_line_breaks(c: Column) -> Column:
    """Drop every CR and LF."""
    return F.translate(c, "\r\n", "")


def clean_text_columns(df: DataFrame) -> DataFrame:
    """``clean_line_breaks`` on all string columns."""
    return df.select(
        [
            clean_line_breaks(col(f.name)).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else col(f.name)
            for f in df.schema.fields
        ]
    )


def stringify(c: Column, data_type: T.DataType) -> Column:
    """Canonical text of one value: NULL is '', floats carry six decimals.

    Dates are days and timestamps microseconds since 1970-01-01, as in the Arrow
    integer representation; binary is ``0x`` hex.
    """
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        text = F.format_string("%.6f", c)
    elif isinstance(data_type, T.DateType):
        text = F.unix_date(c).cast("string")
    elif isinstance(data_type, T.TimestampNTZType):
        text = F.timestamp_diff("MICROSECOND", F.expr(EPOCH_NTZ), c).cast("string")
    elif isinstance(data_type, T.TimestampType):
        text = F.unix_micros(c).cast("string")
    elif isinstance(data_type, T.BinaryType):
        text = binary_text(c)
    else:
        text = c.cast("string")
    return F.when(c.isNull(), F.lit("")).otherwise(text)


def stringify_table(df: DataFrame) -> DataFrame:
    return df.select([stringify(col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def rows_as_text(df: DataFrame) -> DataFrame:
    """Every cell cast to text, NULL as ''."""
    return df.select(
        [F.coalesce(col(f.name).cast("string"), F.lit("")).alias(f.name) for f in df.schema.fields]
    )


def binary_text(c: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(c)))


def snapshot_text(c: Column, data_type: T.DataType) -> Column:
    """Cell text of a snapshot: NULL is empty, binary ``0x`` hex, floats round-trip exactly."""
    text = binary_text(c) if isinstance(data_type, T.BinaryType) else c.cast("string")
    return F.coalesce(text, F.lit(""))


def _words(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def parse_sql(trimmed: str, data_type: T.DataType) -> str:
    """SQL text of the typed value of trimmed text, NULL where the text does not fit."""
    kind = data_type.simpleString()
    cast = f"try_cast({trimmed} AS {kind})"
    if isinstance(data_type, T.StringType):
        return trimmed
    if isinstance(data_type, T.BooleanType):
        return (
            f"CASE WHEN {trimmed} IN ({_words(TRUE_WORDS)}) THEN true "
            f"WHEN {trimmed} IN ({_words(FALSE_WORDS)}) THEN false END"
        )
    if isinstance(data_type, T.DateType):
        return f"IF({trimmed} RLIKE r'{DATE_SHAPE}', {cast}, NULL)"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return f"IF({trimmed} RLIKE r'{TIMESTAMP_SHAPE}', {cast}, NULL)"
    if isinstance(data_type, T.BinaryType):
        return f"IF({trimmed} RLIKE r'{HEX_SHAPE}', unhex({trimmed}), NULL)"
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return f"IF({trimmed} RLIKE r'{FLOAT_SHAPE}', {cast}, NULL)"
    if isinstance(data_type, T.DecimalType):
        p, s = data_type.precision, data_type.scale
        wide = f"try_cast({trimmed} AS decimal(38, {38 - p + s}))"
        cut = f"try_cast(IF(d < 0, ceil(d, {s}), floor(d, {s})) AS {kind})"
        return f"transform(array({wide}), d -> {cut})[0]"
    if isinstance(data_type, T.IntegralType):
        return cast
    raise ValueError(f"unsupported column type: {kind}")


def quick_parse_sql(cell: str, data_type: T.DataType) -> str | None:
    """Parse of untrimmed text in its usual form, NULL for anything else; no regex.

    None where there is no quicker way than ``parse_sql``.
    """
    cast = f"try_cast({cell} AS {data_type.simpleString()})"
    dashes = f"substr({cell}, 5, 1) = '-' AND substr({cell}, 8, 1) = '-'"
    if isinstance(data_type, T.DecimalType):
        # surplus decimals are cut, and an exponent moves the point: both are left to ``parse_sql``
        point = f"instr({cell}, '.')"
        plain = f"({point} = 0 OR length({cell}) - {point} <= {data_type.scale}) AND instr(lower({cell}), 'e') = 0"
        return f"IF(right({cell}, 1) BETWEEN '0' AND '9' AND {plain}, {cast}, NULL)"
    if isinstance(data_type, T.NumericType):
        # a failed cast is slow, and most text that is no number ends in another sign
        return f"IF(right({cell}, 1) BETWEEN '0' AND '9', {cast}, NULL)"
    if isinstance(data_type, T.DateType):
        return f"IF(length({cell}) = 10 AND {dashes}, {cast}, NULL)"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        shape = f"length({cell}) = 19 AND {dashes} AND substr({cell}, 11, 1) = ' '"
        return f"IF({shape}, {cast}, NULL)"
    return None


def key_text(columns: Iterable[Column]) -> Column:
    parts = [F.coalesce(c.cast("string"), F.lit(KEY_NULL)) for c in columns]
    return F.concat_ws(FIELD_SEPARATOR, *parts)


def hash_key(df: DataFrame, columns: Iterable[str]) -> Column:
    """SHA-256 hex of the key columns: text of each, NULL as ``\\N``, joined by \\x01."""
    names = require(df, columns)
    if not names:
        raise ValueError("a hash key needs at least one column")
    return F.sha2(key_text(col(n) for n in names), 256)
