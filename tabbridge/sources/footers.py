"""Row counts and column bytes of Parquet files from their footers; no row group is read."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabbridge.functions.sizing import FIXED_WIDTHS
from tabbridge.sources.publish import openable, store_of

#: Plans that give all rows of a table of files, some columns of them at most.
_WHOLE = {"Project", "SubqueryAlias", "View", "LogicalRelation"}
MOST_TASKS = 1000


def _whole_scan(plan) -> bool:
    name, children = plan.getClass().getSimpleName(), plan.children()
    if name == "Project":
        kept = plan.projectList()
        if any(kept.apply(i).getClass().getSimpleName() != "AttributeReference" for i in range(kept.size())):
            return False
    if name == "LogicalRelation" and "parquet" not in plan.relation().toString().lower():
        return False
    return name in _WHOLE and all(_whole_scan(children.apply(i)) for i in range(children.size()))


def _width(data_type: T.DataType) -> int | None:
    """Bytes of a value of fixed width, or of an element of an array of them."""
    if isinstance(data_type, T.ArrayType):
        data_type = data_type.elementType
    return FIXED_WIDTHS.get(type(data_type))


def _facts(widths_of: dict[str, dict[str, int | None]]):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sizes = [], []
            for table, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                widths = widths_of[table]
                store, name = store_of(path)
                with store.open_input_file(name) as source:
                    footer = pq.read_metadata(source)
                size = 0
                for group in (footer.row_group(k) for k in range(footer.num_row_groups)):
                    for chunk in (group.column(k) for k in range(group.num_columns)):
                        column = chunk.path_in_schema.split(".")[0]
                        if column not in widths:
                            continue
                        told = chunk.statistics
                        filled = chunk.num_values - (told.null_count if told and told.has_null_count else 0)
                        # texts are stored behind four bytes of length; dictionaries make this less than all of them
                        size += filled * widths[column] if widths[column] else max(chunk.total_uncompressed_size - 4 * filled, 0)
                rows.append(footer.num_rows)
                sizes.append(size)
            told = [batch.column(0), pa.array(rows, pa.int64()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(told, ["table", "rows", "bytes"])

    return read


def _files(df: DataFrame) -> list[str]:
    """Files of a plain Parquet table; none for other frames."""
    if not _whole_scan(df._jdf.queryExecution().analyzed()):
        return []
    files = df.inputFiles()
    known = files and openable(files[0]) and all(f.lower().endswith(".parquet") for f in files)
    return files if known else []


def footer_facts(frames: Mapping[str, DataFrame]) -> dict[str, tuple[int, int]]:
    """(rows, bytes) of those frames that are plain Parquet tables, all columns, in one job.

    Values of fixed width count as in ``estimate_size``; texts by their encoded bytes, which is
    less where values repeat. Footers are read by tasks, each a few bytes from a file's end.
    """
    listed = [(name, file) for name, df in frames.items() for file in _files(df)]
    if not listed:
        return {}
    spark = next(iter(frames.values())).sparkSession
    widths = {name: {f.name: _width(f.dataType) for f in df.schema.fields} for name, df in frames.items()}
    files = spark.createDataFrame(listed, "table string, path string").repartition(min(len(listed), MOST_TASKS))
    read = files.mapInArrow(_facts(widths), "table string, rows long, bytes long")
    sums = read.groupBy("table").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))
    return {r["table"]: (r["rows"], r["bytes"]) for r in sums.collect()}
