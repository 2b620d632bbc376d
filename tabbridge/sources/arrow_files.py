"""Arrow IPC files as a Spark data source.

Reading: the driver takes the number of record batches from every file's footer, and a partition
is a run of batches of about ``partition_bytes``, so a large file is read by many tasks and many
small ones by one. Only the declared columns are taken out of a batch.

Writing: tasks write batches, as they come, to files that are published together (``publish``);
no task holds more than a batch.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition

from tabbridge.sources.publish import THREADS, Publisher, Task, store_of

NAME = "tabbridge_arrow"
MAGIC = b"ARROW1"
PARTITION_BYTES = 128 << 20


def spark_schema(schema: pa.Schema) -> T.StructType:
    """Spark's types for the columns; a time of day is text."""
    from pyspark.sql.pandas.types import from_arrow_schema

    fields = [f.with_type(pa.string()) if pa.types.is_time(f.type) else f for f in schema]
    return from_arrow_schema(pa.schema(fields))


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def conform(batch: pa.RecordBatch, target: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The target's columns by name, cast to its types; a missing column is an error."""
    table = pa.Table.from_batches([batch]).select(target.names)
    for k, field in enumerate(target):
        if pa.types.is_time(table.schema.field(k).type) and pa.types.is_integer(field.type):
            seconds = table.column(k).cast(pa.time32("s"), safe=False).cast(pa.int32())
            table = table.set_column(k, field.name, seconds)
        elif pa.types.is_time(table.schema.field(k).type):
            table = table.set_column(k, field.name, table.column(k).cast(pa.time32("s"), safe=False))
    yield from table.cast(target).to_batches()


def _open(address: str) -> tuple[pa.NativeFile, bool]:
    """An open file, and whether it has a footer (file form) or is a plain stream of batches."""
    store, path = store_of(address)
    source = store.open_input_file(path)
    footed = source.read(len(MAGIC)) == MAGIC
    source.seek(0)
    return source, footed


def _footer(address: str) -> tuple[int, int | None]:
    """Bytes of a file and its number of batches; None for streams, which have no footer."""
    source, footed = _open(address)
    with source:
        return source.size(), pa.ipc.open_file(source).num_record_batches if footed else None


def file_schema(address: str) -> pa.Schema:
    source, footed = _open(address)
    with source:
        return (pa.ipc.open_file(source) if footed else pa.ipc.open_stream(source)).schema


def batches_of(source: Any, target: pa.Schema, first: int = 0, last: int | None = None) -> Iterator[pa.RecordBatch]:
    """Batches ``first`` to ``last`` - 1 of an open file with a footer; other columns are not read."""
    known = pa.ipc.open_file(source).schema
    absent = [n for n in target.names if n not in known.names]
    if absent:
        raise KeyError(f"columns not in the Arrow file: {absent}")
    wanted = [known.get_field_index(n) for n in target.names]
    reader = pa.ipc.open_file(source, options=pa.ipc.IpcReadOptions(included_fields=wanted))
    for k in range(first, reader.num_record_batches if last is None else last):
        yield from conform(reader.get_batch(k), target)


@dataclass
class _Spans(InputPartition):
    """Runs of batches: (file, first, after the last); without numbers the whole file."""

    spans: list[tuple[str, int, int | None]]


def plan_spans(footers: list[tuple[str, int, int | None]], partition_bytes: int) -> list[_Spans]:
    """Partitions of about ``partition_bytes`` over files (address, bytes, batches)."""
    out: list[_Spans] = []
    held: list[tuple[str, int, int | None]] = []
    size = 0

    def close() -> None:
        nonlocal held, size
        if held:
            out.append(_Spans(held))
        held, size = [], 0

    for address, total, batches in footers:
        if batches is None:
            if size and size + total > partition_bytes:
                close()
            held.append((address, 0, None))
            size += total
            continue
        each, at = total / max(batches, 1), 0
        while at < batches:
            room = int((partition_bytes - size) // each) if each else batches
            if room < 1 and held:
                close()
                continue
            take = min(max(room, 1), batches - at)
            held.append((address, at, at + take))
            at, size = at + take, size + take * each
        if size >= partition_bytes:
            close()
    close()
    return out


class _Reader(DataSourceReader):
    def __init__(self, files: list[str], schema: T.StructType, partition_bytes: int):
        self.files, self.schema, self.partition_bytes = files, schema, partition_bytes

    def partitions(self) -> list[InputPartition]:
        with ThreadPoolExecutor(THREADS) as pool:
            footers = list(pool.map(_footer, self.files))
        return plan_spans([(f, *x) for f, x in zip(self.files, footers)], self.partition_bytes) or [_Spans([])]

    def read(self, partition: _Spans) -> Iterator[pa.RecordBatch]:
        target = arrow_schema(self.schema)
        for address, first, last in partition.spans:
            source, footed = _open(address)
            with source:
                if footed:
                    yield from batches_of(source, target, first, last)
                else:
                    for batch in pa.ipc.open_stream(source):
                        yield from conform(batch, target)


class _Writer(Publisher):
    """Batches as they come, in files of a set number of rows."""

    suffix = "arrow"

    def __init__(self, address: str, schema: T.StructType, overwrite: bool, label: str, rows: int, times: list[str]):
        super().__init__(address, overwrite, label)
        self.rows = rows
        plain = arrow_schema(schema)
        self.target = pa.schema([f.with_type(pa.time32("s")) if f.name in times else f for f in plain])

    def _conform(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = []
        for column, field in zip(batch.columns, self.target):
            columns.append(clock_times(column) if pa.types.is_time(field.type) else column.cast(field.type))
        return pa.RecordBatch.from_arrays(columns, schema=self.target)

    def fill(self, task: Task, batches: Iterator[pa.RecordBatch]) -> None:
        slices = self._slices(map(self._conform, batches))
        following = next(slices, None)
        while following is not None:
            with task.file() as (sink, rows), pa.ipc.new_file(sink, self.target) as out:
                last = False
                while following is not None and not last:
                    batch, last = following
                    out.write_batch(batch)
                    rows.append(batch.num_rows)
                    following = next(slices, None)

    def _slices(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bool]]:
        """Batches cut where files end, and whether one ends with this piece."""
        held = 0
        for batch in batches:
            while batch.num_rows:
                head = batch.slice(0, self.rows - held)
                batch = batch.slice(head.num_rows)
                held = (held + head.num_rows) % self.rows
                yield head, not held

    def empty(self, sink: pa.NativeFile) -> None:
        with pa.ipc.new_file(sink, self.target):  # no batch, but the columns
            pass


def clock_times(column: pa.Array) -> pa.Array:
    """Text ``HH:mm:ss`` as seconds of the day; other text is an error, as in any cast."""
    import pyarrow.compute as pc

    stamps = pc.strptime(pc.binary_join_element_wise("1970-01-01 ", column, ""), "%Y-%m-%d %H:%M:%S", "s")
    return stamps.cast(pa.int64()).cast(pa.int32()).cast(pa.time32("s"))


class ArrowFiles(DataSource):
    """Options: ``files`` (JSON list) to read; ``path``, ``label``, ``rows`` and ``times`` to write."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        files = json.loads(self.options["files"])
        if not files:
            raise ValueError("no Arrow file to take the columns from")
        return spark_schema(file_schema(files[0]))

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(json.loads(self.options["files"]), schema, int(self.options.get("partition_bytes", PARTITION_BYTES)))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        given = self.options
        return _Writer(given["path"], schema, overwrite, given["label"], int(given["rows"]), json.loads(given.get("times", "[]")))
