"""Row widths, export batch sizes and table size tiers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabbridge.functions.names import col

# Bytes counted per non-NULL value. Times count as RFC 3339 text in UTC.
FIXED_WIDTHS = {
    T.ByteType: 1,
    T.ShortType: 2,
    T.IntegerType: 4,
    T.LongType: 8,
    T.FloatType: 4,
    T.DoubleType: 8,
    T.BooleanType: 1,
    T.DateType: 20,
    T.TimestampType: 20,
    T.TimestampNTZType: 20,
}
# Planning widths, Arrow overhead and message size of one export batch.
TEXT_WIDTH, NUMBER_WIDTH, BOOLEAN_WIDTH = 100, 8, 1
MESSAGE_BYTES = 3 * 1024 * 1024
EXPORT_FILE_BYTES = 200 * 1024 * 1024
DEFAULT_PARTITIONS = 10


def value_bytes(c: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, (T.StringType, T.BinaryType)):
        size = F.octet_length(c).cast("long")
    elif type(data_type) in FIXED_WIDTHS:
        size = F.when(c.isNotNull(), F.lit(FIXED_WIDTHS[type(data_type)]).cast("long"))
    elif isinstance(data_type, T.ArrayType) and type(data_type.elementType) in FIXED_WIDTHS:
        width = FIXED_WIDTHS[type(data_type.elementType)]
        size = F.when(c.isNotNull(), F.size(c).cast("long") * width)
    else:
        size = F.octet_length(c.cast("string")).cast("long")
    return F.coalesce(size, F.lit(0).cast("long"))


def row_bytes(schema: T.StructType) -> Column:
    """Estimated bytes of one row."""
    return reduce(lambda a, b: a + b, (value_bytes(col(f.name), f.dataType) for f in schema.fields))


def planning_width(schema: T.StructType) -> int:
    width = 0
    for f in schema.fields:
        if isinstance(f.dataType, T.StringType):
            width += TEXT_WIDTH
        elif isinstance(f.dataType, T.BooleanType):
            width += BOOLEAN_WIDTH
        else:
            width += NUMBER_WIDTH
    return width


def batch_rows_for(schema: T.StructType, batch_rows: int, cap_bytes: int = MESSAGE_BYTES) -> int:
    """``batch_rows``, scaled down when the estimated batch (+20 %) exceeds the cap."""
    estimate = planning_width(schema) * batch_rows
    estimate += estimate // 5
    return int(batch_rows * cap_bytes / estimate) if estimate > cap_bytes else batch_rows


def file_rows_for(schema: T.StructType, cap_bytes: int = EXPORT_FILE_BYTES) -> int:
    """Rows per exported file that keep it below the size cap."""
    return max(1, batch_rows_for(schema, 1 << 40, cap_bytes))


def size_tier(rows: Column, small: int, medium: int, large: int) -> Column:
    """Tier name by row-count thresholds (inclusive); above the last one it is xlarge."""
    return (
        F.when(rows <= small, "small")
        .when(rows <= medium, "medium")
        .when(rows <= large, "large")
        .otherwise("xlarge")
    )


def tier_partitions(
    rows: int | None, thresholds: Sequence[int], partitions: Sequence[int]
) -> int:
    """Partition count of the first tier whose threshold holds the rows, else of the last tier.

    A table of unknown size gets the default.
    """
    if rows is None:
        return DEFAULT_PARTITIONS
    fitting = [p for limit, p in zip(thresholds, partitions) if rows <= limit]
    return fitting[0] if fitting else partitions[-1]
