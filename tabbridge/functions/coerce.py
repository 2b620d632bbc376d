"""Value coercion rules a reader can ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabbridge.functions.names import col

POLICIES = ("sql", "legacy", "csv")


def truncate_decimal(c: Column, precision: int, scale: int) -> Column:
    """Cut surplus decimals of a decimal column toward zero; a plain cast would round half up.

    The column is cut at its own precision, so any number of integer digits will do.
    """
    cut = F.when(c < 0, F.ceil(c, F.lit(scale))).otherwise(F.floor(c, F.lit(scale)))
    return cut.cast(T.DecimalType(precision, scale))


def date_text(c: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss``, shortened to the date when the time part is midnight."""
    text = F.substring(c.cast("string"), 1, 19)
    return F.when(F.substring(text, 12, 8) == "00:00:00", F.substring(text, 1, 10)).otherwise(text)


def seconds_of_day(text: Column, null_policy: str = "sql") -> Column:
    """Text ``HH:mm:ss`` as seconds since midnight; decimals of a second are cut.

    Other text and NULL give NULL, or midnight under ``legacy``.
    """
    parts = [F.regexp_extract(text, r"^([01]?\d|2[0-3]):([0-5]\d):([0-5]\d)([.,]\d+)?$", k) for k in (1, 2, 3)]
    hours, minutes, seconds = (F.nullif(p, F.lit("")).cast("int") for p in parts)
    found = hours * 3600 + minutes * 60 + seconds
    return F.coalesce(found, F.lit(0)) if null_policy == "legacy" else found


def clock_text(seconds: Column) -> Column:
    """Seconds since midnight as ``HH:mm:ss``; NULL outside the day."""
    part = lambda size, most: F.lpad(((seconds / size).cast("long") % most).cast("string"), 2, "0")
    inside = seconds.between(0, 86_399)
    return F.when(inside, F.concat_ws(":", part(3600, 24), part(60, 60), part(1, 60)))


def _legacy(c: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.StringType):
        return F.coalesce(c, F.lit(" "))
    if isinstance(data_type, T.DateType):
        return F.coalesce(c.cast("string"), F.lit(" "))
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return F.coalesce(date_text(c), F.lit(" "))
    if isinstance(data_type, T.NumericType):
        return F.coalesce(c, F.lit(0).cast(data_type))
    return c


def coerce_values(df: DataFrame, null_policy: str = "sql") -> DataFrame:
    """Apply a NULL policy to all columns.

    * ``sql``: NULL stays NULL, types are kept.
    * ``legacy``: NULL text becomes one blank, NULL numbers become 0, dates and
      timestamps become text (a midnight timestamp prints as a bare date).
    * ``csv``: NULL text becomes '', everything else stays NULL.
    """
    if null_policy not in POLICIES:
        raise ValueError(f"null_policy must be one of {POLICIES}, not {null_policy!r}")
    if null_policy == "sql":
        return df
    out = []
    for f in df.schema.fields:
        c = col(f.name)
        if null_policy == "legacy":
            c = _legacy(c, f.dataType)
        elif isinstance(f.dataType, T.StringType):
            c = F.coalesce(c, F.lit(""))
        out.append(c.alias(f.name))
    return df.select(out)
