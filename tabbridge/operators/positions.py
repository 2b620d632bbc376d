"""Row positions without a one-task window: numbering, pages and chunk manifests."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from functools import reduce
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabbridge.functions.names import col
from tabbridge.functions.ordering import (
    TIE,
    SortRule,
    order_columns,
    parse_rules,
    range_partition,
    with_tie,
)
from tabbridge.functions.predicates import Filter, literal, where
from tabbridge.functions.text import FIELD_SEPARATOR, snapshot_text
from tabbridge.session import discard, stage, staged_folder, staging, workspace

ROW_ID_BITS = 33  # low bits of monotonically_increasing_id: index inside the partition
#: Rows that one task may order: a sample of sort keys, and the interval a page is looked for in.
NARROW_SAMPLE = 50_000

_ROW = "__row"


def _offsets(staged: DataFrame) -> DataFrame:
    """(partition, rows before it): one row per partition of the staged table.

    Only these counts pass through a single window task and are broadcast, so both are
    bounded by the number of partitions, whatever the number of rows.
    """
    counts = staged.groupBy(F.shiftright(col(_ROW), ROW_ID_BITS).alias("__part")).agg(
        F.count(F.lit(1)).alias("__n")
    )
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        "__part", "__n", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")
    )


def _with_row_id(df: DataFrame) -> DataFrame:
    return df.withColumn(_ROW, F.monotonically_increasing_id())


def _numbered(staged: DataFrame, offsets: DataFrame, name: str, start: int) -> DataFrame:
    """Place every row by the rows before its partition; one row per partition is broadcast."""
    index = col(_ROW).bitwiseAND(F.lit((1 << ROW_ID_BITS) - 1))
    return (
        staged.withColumn("__part", F.shiftright(col(_ROW), ROW_ID_BITS))
        .join(F.broadcast(offsets), "__part")
        .withColumn(name, col("__before") + index + F.lit(start))
        .drop("__part", "__before", _ROW)
    )


def _place(staged: DataFrame, name: str, start: int) -> DataFrame:
    return _numbered(staged, _offsets(staged).drop("__n"), name, start)


def number_unordered(df: DataFrame, name: str, start: int = 1) -> DataFrame:
    """Dense unique numbers in scan order: no shuffle, the rows are staged once."""
    return _place(stage(_with_row_id(df), "numbered"), name, start)


# Plans in which a row of a file comes out at most once, and where it lies is known.
_ROWWISE = {"Project", "Filter", "SubqueryAlias", "View", "LogicalRelation"}
FILE, AT = "__file", "__at"


def _scan_only(plan: Any) -> bool:
    children = plan.children()
    return (
        plan.getClass().getSimpleName() in _ROWWISE
        and plan.deterministic()
        and all(_scan_only(children.apply(i)) for i in range(children.size()))
    )


def numbered_scan(df: DataFrame, name: str, start: int = 1) -> DataFrame | None:
    """Dense numbers of the rows of a Parquet scan, by file and place in the file; nothing is staged.

    The rows of each file are counted from the scan's own row indexes, which reads no column.
    None if ``df`` is no such scan, or leaves rows out in the middle of a file.
    """
    if not _scan_only(df._jdf.queryExecution().analyzed()):
        return None
    try:
        place = [F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(AT)]
        counted = df.select(*place).groupBy(FILE).agg(F.count(F.lit(1)).alias("__n"), F.max(AT).alias("__last"))
        files = counted.collect()
    except AnalysisException:  # no file scan, or no Parquet
        return None
    if any(f["__n"] != f["__last"] + 1 for f in files):
        return None
    before, offsets = start, []
    for f in sorted(files):
        offsets.append((f[FILE], before))
        before += f["__n"]
    known = df.sparkSession.createDataFrame(offsets, f"{FILE} string, __before long")
    rows = df.select(*[col(c) for c in df.columns], *place)
    placed = rows.join(F.broadcast(known), FILE)
    return placed.select(*[col(c) for c in df.columns], (col("__before") + col(AT)).alias(name))


@contextmanager
def numbered(df: DataFrame, name: str, start: int = 1) -> Iterator[DataFrame]:
    """``number_unordered`` for the length of a block; the staged rows go afterwards."""
    with staging(_with_row_id(df), "numbered") as staged:
        yield _place(staged, name, start)


def total_order(df: DataFrame, rules: Iterable[SortRule]) -> list[Column]:
    """The sort rules, then a fingerprint of the whole row, so that only equal rows tie.

    A fingerprint instead of the other columns keeps the keys small that range
    partitioning samples, however long the texts of a row are.
    """
    return [*order_columns(df, rules), F.xxhash64(*[col(c) for c in df.columns])]


class Ordered:
    """The rows of a table in total order, with a sparse index, in a folder.

    The index has one entry for each range of the order: its first key, the position of its
    first row and its number of rows. A page, a chunk or a key is found by the entries it
    touches, and the scan skips every other row group. Ranges are bounded by the order's
    partitions, so the index stays small beside the rows.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._rows = spark.read.parquet(f"{folder}/rows")
        self.index = spark.read.parquet(f"{folder}/index")
        self.columns = [c for c in self._rows.columns if c != _ROW]

    def total(self) -> int:
        return self.index.agg(F.sum("rows")).first()[0] or 0

    def rows(self) -> DataFrame:
        """All rows; a scan does not keep their order."""
        return self._rows.drop(_ROW)

    def at(self, first: int, size: int) -> DataFrame:
        """Rows at positions first … first+size-1, in order."""
        end = first + size
        touched = self.index.where((col("before") < end) & (col("before") + col("rows") > first)).collect()
        intervals = [
            col(_ROW).between(
                (r["part"] << ROW_ID_BITS) + max(first - r["before"], 0),
                (r["part"] << ROW_ID_BITS) + min(end - r["before"], r["rows"]) - 1,
            )
            for r in touched
        ]
        wanted = reduce(lambda a, b: a | b, intervals, F.lit(False))
        return self._rows.where(wanted).orderBy(_ROW).drop(_ROW)

    def page(self, number: int, size: int) -> Page:
        """Page ``number`` (from 1) and the total; past the end it is empty."""
        _check_page(number, size)
        total = self.spark.createDataFrame([(self.total(),)], "total_rows long")
        return Page(self.at((number - 1) * size, size), total)

    def numbered(self, name: str, start: int = 0) -> DataFrame:
        """All rows with their position."""
        offsets = self.index.select(col("part").alias("__part"), col("before").alias("__before"))
        return _numbered(self._rows, offsets, name, start)

    def position_of(self, key: Sequence[Any]) -> int:
        """Rows before the first one whose leading sort keys are not before ``key``.

        Ranges whose first key is before it come first; of these only the last one is read.
        """
        keys = [(k["name"], k["ascending"]) for k in self._keys()][: len(key)]
        bound = [None if v is None else literal(v) for v in key]
        starts = self.index.select("before", "rows", "part", *[col("first")[n].alias(n) for n, _ in keys])
        last = starts.where(_sorts_before(keys, bound)).orderBy(F.desc("before")).limit(1).collect()
        if not last:
            return 0
        base = last[0]["part"] << ROW_ID_BITS
        inside = self._rows.where(col(_ROW).between(base, base + last[0]["rows"] - 1))
        return last[0]["before"] + inside.where(_sorts_before(keys, bound)).count()

    def _keys(self) -> list[Any]:
        first = self.index.select("keys").first()
        return first["keys"] if first else []

    def drop(self) -> None:
        discard(self.spark, self.folder)


def order_table(
    df: DataFrame, rules: Iterable[SortRule], folder: str | None = None, *, from_scan: bool = False
) -> Ordered:
    """The rows in total order with their index, in a folder the caller owns.

    Ranges are sorted in parallel. Without a folder it is one of the shared folder, which
    ``Ordered.drop`` or ``clear_staged`` removes.
    """
    rules, spark = list(rules), df.sparkSession
    order = [*total_order(df, rules), col(TIE)]
    ranged = range_partition(with_tie(df, from_scan), order).drop(TIE)
    folder = folder or staged_folder(spark, "ordered")
    _with_row_id(ranged).write.parquet(f"{folder}/rows")
    parsed = parse_rules(rules)
    key = F.struct(*[col(n) for n, _ in parsed]) if parsed else F.struct(F.lit(True).alias("any"))
    keys = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(a).alias("ascending")) for n, a in parsed])
    stored = spark.read.schema(ranged.withColumn(_ROW, F.lit(0).cast("long")).schema).parquet(f"{folder}/rows")
    part = F.shiftright(col(_ROW), ROW_ID_BITS).alias("part")
    ranges = stored.groupBy(part).agg(F.count(F.lit(1)).alias("rows"), F.min_by(key, col(_ROW)).alias("first"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    index = ranges.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    index.withColumn("keys", keys if parsed else F.array().cast("array<struct<name: string, ascending: boolean>>")).write.parquet(f"{folder}/index")
    return Ordered(spark, folder)


@contextmanager
def ordered(df: DataFrame, rules: Iterable[SortRule], *, from_scan: bool = False) -> Iterator[Ordered]:
    """``order_table`` for the length of a block; the ordered rows go afterwards."""
    folder = workspace(df.sparkSession, "ordered")
    try:
        yield order_table(df, rules, folder, from_scan=from_scan)
    finally:
        discard(df.sparkSession, folder)


def number_rows(
    df: DataFrame,
    rules: Iterable[SortRule],
    name: str = "position",
    start: int = 0,
    *,
    from_scan: bool = False,
) -> DataFrame:
    """Global position of every row in the given order.

    The position is the number of rows in earlier ranges plus the index inside the range. The
    ordered rows are the result, kept in the shared folder until ``clear_staged``.
    """
    return order_table(df, rules, from_scan=from_scan).numbered(name, start)


def rows_at(table: Ordered, first: int, size: int) -> DataFrame:
    """Rows at positions first … first+size-1, in order."""
    return table.at(first, size)


def _sorts_before(keys: Sequence[tuple[str, bool]], bound: Sequence[Column | None]) -> Column:
    """The row's key comes before ``bound`` (NULLs first ascending, last descending)."""
    out, same = F.lit(False), F.lit(True)
    for (name, ascending), value in zip(keys, bound):
        c = col(name)
        if value is None:
            less = F.lit(False) if ascending else c.isNotNull()
            equal = c.isNull()
        else:
            less = c.isNull() | (c < value) if ascending else F.coalesce(c > value, F.lit(False))
            equal = c.eqNullSafe(value)
        out, same = out | (same & less), same & equal
    return out


def _sorts_after(keys: Sequence[tuple[str, bool]], bound: Sequence[Column | None]) -> Column:
    """The row's key comes after ``bound``."""
    out, same = F.lit(False), F.lit(True)
    for (name, ascending), value in zip(keys, bound):
        c = col(name)
        if value is None:
            more = c.isNotNull() if ascending else F.lit(False)
            equal = c.isNull()
        else:
            more = F.coalesce(c > value, F.lit(False)) if ascending else c.isNull() | (c < value)
            equal = c.eqNullSafe(value)
        out, same = out | (same & more), same & equal
    return out


def _bounds(
    part: DataFrame, rules: Sequence[SortRule], first: int, end: int, inside: int, seed: int
) -> tuple[list[str | None] | None, list[str | None] | None]:
    """Keys, as text, somewhat before and behind rows first … end-1, from a sorted sample.

    The sample is ordered in one task, which its size bounds; two keys come to the driver.
    """
    names = [name for name, _ in parse_rules(rules)]
    sample = part.select([col(n) for n in names]).sample(min(1.0, NARROW_SAMPLE / inside), seed=seed)
    everything = Window.partitionBy(F.lit(0))
    placed = sample.select(
        *[col(n).cast("string").alias(n) for n in names],
        (F.row_number().over(Window.orderBy(*order_columns(sample, rules))) - 1).alias("__at"),
        F.count(F.lit(1)).over(everything).alias("__n"),
    )
    spare = F.floor(F.sqrt("__n") * 4) + 1
    low = F.floor(F.lit(first) * col("__n") / F.lit(inside)) - spare
    high = F.ceil(F.lit(end) * col("__n") / F.lit(inside)) + spare
    chosen = placed.where((col("__at") == low) | (col("__at") == high))
    found = chosen.select(*[col(n) for n in names], (col("__at") == low).alias("__low")).collect()
    keys = {r["__low"]: [r[n] for n in names] for r in found}
    return keys.get(True), keys.get(False)


def _narrow(
    df: DataFrame, rules: Sequence[SortRule], first: int, end: int, total: int
) -> tuple[DataFrame, int, int]:
    """A key interval that holds positions first … end-1, the rows before it and inside.

    Bounds come from sorted samples of the sort keys; exact counts of the rows on either
    side decide whether they are used. So a bad sample costs a wider interval, never a row.
    A round reads the key columns of the interval before and shuffles the sample only. A
    hot key ends the search: all its rows are one interval. Without rules there is no key to
    narrow by, and the whole table is the interval.
    """
    keys = parse_rules(rules)
    kinds = [df.schema[name].dataType for name, _ in keys]
    part, before, inside = df, 0, total
    if not keys or any(isinstance(k, T.BinaryType) for k in kinds):
        return part, before, inside
    while inside > NARROW_SAMPLE:
        low, high = _bounds(part, rules, first - before, end - before, inside, before)
        ahead = behind = F.lit(False)
        if low is not None:
            ahead = _sorts_before(keys, [None if v is None else F.lit(v).cast(k) for v, k in zip(low, kinds)])
        if high is not None:
            behind = _sorts_after(keys, [None if v is None else F.lit(v).cast(k) for v, k in zip(high, kinds)])
        cut = part.agg(F.count_if(ahead).alias("ahead"), F.count_if(behind).alias("behind")).first()
        kept = inside - cut["ahead"] - cut["behind"]
        if kept > inside // 2 or before + cut["ahead"] > first or end > before + cut["ahead"] + kept:
            break
        part, before, inside = part.where(~ahead & ~behind), before + cut["ahead"], kept
    return part, before, inside


class Page(NamedTuple):
    rows: DataFrame
    total: DataFrame  # one row: total_rows


def page(
    df: DataFrame,
    rules: Sequence[SortRule],
    number: int = 1,
    size: int = 10,
    filters: Iterable[Filter | Sequence[Any]] = (),
    *,
    from_scan: bool = False,
) -> Page:
    """Page ``number`` (from 1) of the filtered, ordered rows and the filtered total.

    Ties are broken by a fingerprint of the row, so repeated calls page alike. Every page is
    looked for in the same way: sorted samples narrow the table to an interval of sort keys of
    at most ``NARROW_SAMPLE`` rows, which one task orders and cuts. Only a key that more rows
    than that share keeps the interval larger; its rows are ordered in ranges and cut by
    position, and the page's rows stay in the shared folder. Past the end the page is empty.
    For many pages of one table keep an ``order_table``: its pages are pruned scans.
    """
    _check_page(number, size)
    rows, spark = where(df, filters), df.sparkSession
    count = rows.count()
    total = spark.createDataFrame([(count,)], "total_rows long")
    first = (number - 1) * size
    if first >= count:
        return Page(rows.limit(0), total)
    part, before, inside = _narrow(rows, rules, first, min(first + size, count), count)
    first -= before
    if inside <= NARROW_SAMPLE:
        return Page(part.orderBy(*total_order(part, rules)).offset(first).limit(size), total)
    with ordered(part, rules, from_scan=from_scan) as table:
        # one part file, so the rows come back in their order
        return Page(stage(table.at(first, size).coalesce(1), "page"), total)


def _check_page(number: int, size: int) -> None:
    if number < 1 or size < 1:
        raise ValueError("page number and size start at 1")


def row_text(df: DataFrame) -> Column:
    """All columns of a row as one line of separated text."""
    return F.concat_ws(
        FIELD_SEPARATOR, *[snapshot_text(col(f.name), f.dataType) for f in df.schema.fields]
    )


def _chunk_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and MD5 of the lines of each chunk; chunks follow each other, lines are in order.

    A digest goes on from batch to batch, so a task holds one batch whatever a chunk's size.
    """
    import hashlib

    done: list[tuple[int, int, str]] = []
    chunk, rows, digest = None, 0, hashlib.md5()
    for batch in batches:
        ids, lines = batch.column(0).to_numpy(), batch.column(1)
        starts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)] if len(ids) else []
        for lo, hi in zip(starts[:-1], starts[1:]):
            if ids[lo] != chunk:
                if chunk is not None:
                    done.append((int(chunk), rows, digest.hexdigest()))
                chunk, rows, digest = ids[lo], 0, hashlib.md5()
            for line in lines.slice(lo, hi - lo).to_pylist():
                digest.update(line.encode() if not rows else b"\n" + line.encode())
                rows += 1
    if chunk is not None:
        done.append((int(chunk), rows, digest.hexdigest()))
    columns = list(zip(*done)) or [(), (), ()]
    kinds = (pa.int64(), pa.int64(), pa.string())
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["chunk_id", "chunk_rows", "checksum"])


def chunk_manifest(
    df: DataFrame, rules: Sequence[SortRule], chunk_rows: int, *, from_scan: bool = False
) -> DataFrame:
    """One row per chunk of ``chunk_rows`` rows in the given order.

    ``checksum`` is the MD5 of the chunk text (rows in order, separated by newlines).
    ``end_offset`` is exclusive; ``next_chunk_id`` is -1 for the last chunk. A chunk is
    digested as a stream of its sorted rows. Only the manifest stays in the shared folder.
    """
    if chunk_rows < 1:
        raise ValueError("chunk_rows must be positive")
    with ordered(df, rules, from_scan=from_scan) as table:
        lines = table.numbered("__position").select(
            F.floor(col("__position") / F.lit(chunk_rows)).cast("long").alias("chunk_id"),
            "__position",
            row_text(df).alias("line"),
        )
        chunks = (
            lines.repartition("chunk_id")
            .sortWithinPartitions("chunk_id", "__position")
            .select("chunk_id", "line")
            .mapInArrow(_chunk_digests, "chunk_id long, chunk_rows long, checksum string")
        )
        total_chunks = -(-table.total() // chunk_rows)
        start = col("chunk_id") * F.lit(chunk_rows)
        manifest = chunks.select(
            "chunk_id",
            start.alias("start_offset"),
            (start + col("chunk_rows")).alias("end_offset"),
            "chunk_rows",
            F.lit(total_chunks).cast("long").alias("total_chunks"),
            F.when(col("chunk_id") + 1 < F.lit(total_chunks), col("chunk_id") + 1)
            .otherwise(F.lit(-1))
            .cast("long")
            .alias("next_chunk_id"),
            "checksum",
        )
        return stage(manifest, "manifest")


def read_chunk(
    table: Ordered, chunk_id: int, chunk_rows: int, resume: int = 0
) -> DataFrame:
    """Rows of one chunk of an ``order_table``, skipping ``resume`` rows already delivered."""
    if chunk_id < 0 or resume < 0:
        raise ValueError("chunk id and resume offset must not be negative")
    if resume >= chunk_rows:
        raise ValueError("resume offset exceeds the chunk")
    return rows_at(table, chunk_id * chunk_rows + resume, chunk_rows - resume)
