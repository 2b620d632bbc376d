"""Exported files whose real size stays below a cap.

Each task cuts its rows, in their order, into files by the bytes it writes: lines of text by their
own length, Parquet by what the row groups before take in the file and the most the next one
can. Nothing is shuffled or counted beforehand, and the cap holds whatever the rows are; only
a single row above the cap makes a file above it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter

from tabbridge.functions.names import col
from tabbridge.functions.sizing import file_rows_for
from tabbridge.sources.arrow_files import arrow_schema
from tabbridge.sources.publish import Publisher, Task, openable, register, resolve

NAME = "tabbridge_capped"
GROUP_BYTES = 16 << 20
# what a column chunk takes beside its values: page and chunk headers, statistics of texts
_CHUNK_BYTES, _TEXT_STATISTICS, _FOOTER_BYTES = 512, 16 << 10, 2048


class Lines(Publisher):
    """One text column, a line each, behind a header line in every file."""

    def __init__(self, address: str, label: str, cap: int, suffix: str, separator: str, header: str | None):
        super().__init__(address, False, label)
        self.cap, self.suffix = cap, suffix
        self.separator = separator.encode()
        self.header = b"" if header is None else header.encode() + self.separator

    def empty(self, sink: pa.NativeFile) -> None:
        sink.write(self.header)

    def fill(self, task: Task, batches: Iterator[pa.RecordBatch]) -> None:
        pieces = self._pieces(batches)
        following = next(pieces, None)
        while following is not None:
            with task.file() as (sink, rows):
                sink.write(self.header)
                new = False
                while following is not None and not new:
                    lines, _ = following
                    rows.append(len(lines))
                    self._put(sink, lines)
                    following = next(pieces, None)
                    new = following is not None and following[1]

    def _put(self, sink: pa.NativeFile, lines: pa.Array) -> None:
        whole = pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines)
        sink.write(pc.binary_join(whole, self.separator.decode())[0].as_buffer())
        sink.write(self.separator)

    def _pieces(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, bool]]:
        """Lines of a batch up to where a file ends, and whether a new file begins with them."""
        held = len(self.header)
        for batch in batches:
            lines = batch.column(0).fill_null("").cast(pa.string())
            sizes = pc.binary_length(lines).to_numpy().astype(np.int64) + len(self.separator)
            ends = np.cumsum(sizes)
            lo, new = 0, False
            while lo < len(lines):
                before = int(ends[lo - 1]) if lo else 0
                hi = int(np.searchsorted(ends, before + self.cap - held, side="right"))
                if hi <= lo and held > len(self.header):  # the next line begins a file
                    held, new = len(self.header), True
                    continue
                hi = max(hi, lo + 1)
                yield lines.slice(lo, hi - lo), new
                held += int(ends[hi - 1]) - before
                lo, new = hi, False


class Parquet(Publisher):
    """Row groups of a set size, as many in a file as the cap allows."""

    suffix = "parquet"

    def __init__(self, address: str, label: str, cap: int, schema: T.StructType):
        super().__init__(address, False, label)
        self.cap, self.target = cap, arrow_schema(schema)
        texts = sum(pa.types.is_string(f.type) or pa.types.is_large_string(f.type) or pa.types.is_binary(f.type) for f in self.target)
        self.overhead = _CHUNK_BYTES * len(self.target) + _TEXT_STATISTICS * texts
        # small caps are for small files: their statistics take as little room
        if self.overhead * 4 > cap:
            self.overhead, self.statistics = _CHUNK_BYTES * len(self.target), False
        else:
            self.statistics = True
        self.group = max(min(GROUP_BYTES, (cap - _FOOTER_BYTES - self.overhead) // 8), 1)

    def empty(self, sink: pa.NativeFile) -> None:
        with pq.ParquetWriter(sink, self.target):
            pass

    def most_bytes(self, batch: pa.RecordBatch) -> int:
        """The most the values of a batch take: as they are, with a dictionary and its indexes beside."""
        total = 0
        for column in batch.columns:
            if pa.types.is_boolean(column.type):
                total += len(column)
            elif pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type):
                total += int(pc.sum(pc.binary_length(column)).as_py() or 0) + 4 * len(column)
            else:
                total += max(column.type.bit_width // 8, 4) * len(column)
        return total * 5 // 4 + 4 * batch.num_rows * batch.num_columns

    def _groups(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.RecordBatch], int]]:
        """Batches for one row group each, and the most bytes they take."""
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in self._small(batches):
            own = self.most_bytes(batch)
            if held and size + own > self.group:
                yield held, size
                held, size = [], 0
            held.append(batch)
            size += own
        if held:
            yield held, size

    def _small(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches below the size of a group, halved until they are."""
        for batch in batches:
            todo = [pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, self.target)], schema=self.target)]
            while todo:
                first = todo.pop()
                if first.num_rows > 1 and self.most_bytes(first) > self.group:
                    half = first.num_rows // 2
                    todo += [first.slice(half), first.slice(0, half)]
                elif first.num_rows:
                    yield first

    def fill(self, task: Task, batches: Iterator[pa.RecordBatch]) -> None:
        groups = self._groups(batches)
        following = next(groups, None)
        while following is not None:
            with task.file() as (sink, rows), pq.ParquetWriter(sink, self.target, write_statistics=self.statistics) as out:
                number = 0
                while following is not None:
                    held, most = following
                    number += 1
                    if number > 1 and sink.tell() + most + _FOOTER_BYTES + number * self.overhead > self.cap:
                        break
                    out.write_table(pa.Table.from_batches(held), row_group_size=1 << 30)
                    rows.append(sum(b.num_rows for b in held))
                    following = next(groups, None)


class CappedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        given = self.options
        common = given["path"], given["label"], int(given["cap"])
        if given["form"] == "parquet":
            return Parquet(*common, schema)
        return Lines(*common, given["suffix"], given["separator"], given.get("header"))


def _save(df: DataFrame, path: str, cap: int, **options: str) -> bool:
    """Write below the cap; False for stores that Arrow's own file systems do not know."""
    spark = df.sparkSession
    if cap < 1:
        raise ValueError("max_file_bytes must be positive")
    address, _ = resolve(spark, path, "error")
    if not openable(address):
        return False
    form = register(spark, CappedFiles)
    settings = {"label": uuid.uuid4().hex[:8], "cap": str(cap), **options}
    df.write.format(form).mode("append").options(**settings).save(address)
    return True


def save_parquet(df: DataFrame, path: str, cap: int) -> bool:
    return _save(df, path, cap, form="parquet")


def save_lines(df: DataFrame, path: str, cap: int, suffix: str, separator: str, header: str | None = None) -> bool:
    """One text column as lines, behind ``header`` in every file if one is given."""
    named = {} if header is None else {"header": header}
    return _save(df, path, cap, form="lines", suffix=suffix, separator=separator, **named)


def save_csv(df: DataFrame, path: str, cap: int, options: dict[str, str], line_separator: str = "\n") -> None:
    """CSV with the column names in every file; blanks in cells are kept, quotes are doubled."""
    given = {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", **options}
    cells = F.struct(*[col(c) for c in df.columns])
    names = df.sparkSession.range(1).select(F.to_csv(F.struct(*[F.lit(c).alias(f"c{i}") for i, c in enumerate(df.columns)]), given))
    line = F.to_csv(cells, given)
    if len(df.columns) == 1:  # an empty line would be no row
        line = F.when(F.coalesce(col(df.columns[0]).cast("string"), F.lit("")) == "", F.lit('""')).otherwise(line)
    lines = df.select(line.alias("line"))
    if not save_lines(lines, path, cap, "csv", line_separator, names.first()[0]):
        writer = df.write.option("header", True).option("lineSep", line_separator).options(**given)
        writer.option("maxRecordsPerFile", file_rows_for(df.schema, cap)).csv(path)
