"""Records of quoted text, read by many tasks of one file.

A quoted cell may hold line breaks, so a line break ends a record only if the quotes before it
are even.

1. Files are cut into blocks of bytes, and the quotes of every block are counted. The running
   sum over a file tells whether a block begins inside a cell: one small row for each block.
2. Each block then finds its first true record boundary and gives the records that begin in it,
   reading on behind its end until the last one is whole.

Nothing but the counts is shuffled, and a task holds one block at a time. The number of tasks
follows the bytes, so small blocks share them. The text follows the usual rule that a cell with
a quote is quoted and its quotes are doubled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabbridge.functions.names import col
from tabbridge.sources.publish import openable, store_of

BLOCK_BYTES = 32 << 20
FEW_TASKS = 256
MOST_TASKS = 100_000
_AHEAD = 1 << 16
_QUOTE, _BREAK = ord('"'), ord("\n")
#: file names of text that Spark unpacks as a whole
_PACKED = (".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate", ".xz")


def _quotes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = []
        for path, start, size in zip(*(batch.column(n).to_pylist() for n in ("path", "start", "size"))):
            store, name = store_of(path)
            with store.open_input_file(name) as source:
                counts.append(source.read_at(size, start).count(b'"'))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], [*batch.schema.names, "quotes"])


def block_records(source: pa.NativeFile, start: int, size: int, inside: bool) -> pa.Array | None:
    """Records that begin in bytes ``start`` to ``start + size`` of a file, with their line breaks.

    ``inside`` tells whether the block's first byte lies in a quoted cell.
    """
    length = source.size()
    # the byte before the block may be the break that ends the record before
    at = max(start - 1, 0)
    data = source.read_at(start - at + size, at)
    values = np.frombuffer(data, np.uint8)
    odd = int(inside) ^ int(start > 0 and len(data) > 0 and data[0] == _QUOTE)

    def breaks(part: np.ndarray, odd: int) -> tuple[np.ndarray, int]:
        parity = (np.cumsum(part == _QUOTE, dtype=np.uint8) & 1) ^ odd
        return np.flatnonzero((part == _BREAK) & (parity == 0)), int(parity[-1]) if len(part) else odd

    ends, odd = breaks(values, odd)
    begins = np.concatenate([[0], ends + 1]) if start == 0 else ends + 1
    begins = begins[begins < len(values)]
    if not len(begins):
        return None
    pieces = [data]
    have = at + len(data)
    open_ = not len(ends) or ends[-1] + 1 != len(values)  # the last record goes on behind the block
    while open_ and have < length:
        more = source.read_at(_AHEAD, have)
        found, odd = breaks(np.frombuffer(more, np.uint8), odd)
        if len(found):
            more, open_ = more[: int(found[0]) + 1], False
        pieces.append(more)
        have += len(more)
    whole = b"".join(pieces)
    offsets = np.concatenate([begins, [len(whole)]]).astype(np.int32)
    return pa.StringArray.from_buffers(len(begins), pa.py_buffer(offsets.tobytes()), pa.py_buffer(whole))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            store, name = store_of(row["path"])
            with store.open_input_file(name) as source:
                found = block_records(source, row["start"], row["size"], row["odd"])
            for lo in range(0, len(found) if found is not None else 0, 4096):
                records = pc.utf8_rtrim(found.slice(lo, 4096), characters="\r\n")
                first = pa.array([row["start"] == 0 and lo + k == 0 for k in range(len(records))])
                yield pa.RecordBatch.from_arrays([first, records], ["first", "record"])


def splittable(paths: Sequence[str]) -> bool:
    """Whether parts of these files can be read by themselves."""
    return not paths or (openable(paths[0]) and not any(p.lower().endswith(_PACKED) for p in paths))


def read_records(spark: SparkSession, files: Sequence[tuple[str, int]], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``record`` of every record of files (address, bytes), and whether it is the ``first`` of its file."""
    if block_bytes < 1:
        raise ValueError("block_bytes must be positive")
    sizes = spark.createDataFrame(list(files), "path string, length long")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(col("length") - 1, F.lit(0).cast("long")), F.lit(block_bytes).cast("long"))
    blocks = sizes.where("length > 0").select("path", "length", F.explode(starts).alias("start"))
    blocks = blocks.select("path", "start", F.least(F.lit(block_bytes).cast("long"), col("length") - col("start")).alias("size"))
    wanted = max(FEW_TASKS, -(-sum(n for _, n in files) // BLOCK_BYTES))  # small blocks share tasks
    tasks = min(sum(-(-n // block_bytes) for _, n in files) or 1, wanted, MOST_TASKS)
    counted = blocks.repartition(tasks).mapInArrow(_quotes, "path string, start long, size long, quotes long")
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    odd = F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2 == 1
    known = counted.select("path", "start", "size", odd.alias("odd"))
    return known.repartition(tasks).mapInArrow(_read, "first boolean, record string")


def read_cells(
    spark: SparkSession, files: Sequence[tuple[str, int]], names: Sequence[str], options: dict[str, str], block_bytes: int
) -> DataFrame:
    """The cells of headered CSV files as text columns by position; empty lines are left out."""
    places = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    records = read_records(spark, files, block_bytes).where("NOT first AND record <> ''")
    cells = records.select(F.from_csv("record", places.simpleString()[7:-1].replace(":", " "), options).alias("cells"))
    return cells.select([col("cells")[f"c{i}"].alias(n) for i, n in enumerate(names)])
