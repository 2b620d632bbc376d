"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of the benchmark items: runs of ``window`` words, or the whole
item where it has fewer. For patterns of one length m the search looks at the block of B
words that ends at a position. A shift table, indexed by a hash of the block, tells how far
the end can move without missing a pattern; where the shift is 0, the bucket of patterns
with that last block is compared word by word. Shorter items are scanned by tables of their
own length, so they never shorten the shifts of the others.

The tables are built from the benchmark in parts of at most ``PART_BYTES`` of pattern text
and broadcast one part at a time; the documents stream through one part after the other in a
chain of Arrow steps, so any size of benchmark works with bounded memory and no shuffle.

Defined results: null or wordless texts have no words and no hits; items without words match
nothing; a null item_id is written as an empty string; repeated items and ids count once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabbridge.llm.staging import released
from tabbridge.llm.words import PLAIN, Block, blocks

WINDOW = 10
BLOCK_WORDS = 2
PART_BYTES = 16 << 20
_TABLE_BITS = 18


class _Search:
    """Shift table and suffix buckets of the patterns of one length."""

    def __init__(self, length: int, windows: dict[bytes, set[str]], hashes: dict[bytes, np.ndarray]):
        self.length, self.span = length, min(BLOCK_WORDS, length)
        reach = length - self.span + 1
        self.shift = np.full(1 << _TABLE_BITS, min(reach, 255), np.uint8)
        self.buckets: dict[int, dict[bytes, set[str]]] = {}
        for text, items in windows.items():
            codes = _codes(hashes[text], self.span)
            slots = (codes >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
            for end, slot in enumerate(slots):
                self.shift[slot] = min(int(self.shift[slot]), reach - 1 - end)
            self.buckets.setdefault(int(slots[-1]), {})[text] = items

    def find(self, block: Block, lo: int, hi: int, shifts: bytes, slots: np.ndarray, text: bytes):
        """(first word, items) of every occurrence inside words lo … hi-1."""
        step, span, length = 0, self.span, self.length
        at = lo + length - span  # where the last block of a window at ``lo`` starts
        last = hi - span
        while at <= last:
            step = shifts[at]
            if step:
                at += step
                continue
            first = at + span - length
            bucket = self.buckets.get(int(slots[at]))
            if bucket is not None:
                words = b" ".join(text[s:e] for s, e in zip(block.start[first : first + length], block.end[first : first + length]))
                items = bucket.get(words)
                if items is not None:
                    yield first, items
            at += 1


def _codes(hashes: np.ndarray, span: int) -> np.ndarray:
    """A code for each run of ``span`` words."""
    if span == 1:
        return hashes
    return hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]


def _patterns(items: list[tuple[str, str]], window: int) -> list[_Search]:
    """Searches over (item, space-joined words) patterns."""
    by_length: dict[int, dict[bytes, set[str]]] = {}
    hashes: dict[bytes, np.ndarray] = {}
    for item, text in items:
        raw = text.encode()
        words = raw.count(b" ") + 1
        by_length.setdefault(words, {}).setdefault(raw, set()).add(item)
        if raw not in hashes:
            (block,) = blocks(pa.array([text]), PLAIN)
            hashes[raw] = block.hash
    return [_Search(n, windows, hashes) for n, windows in sorted(by_length.items())]


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (item, words): the windows of every item, words joined by one space."""
    words = F.split(
        F.trim(F.regexp_replace(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), " "
    )
    listed = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words.alias("words")
    ).where((F.size("words") > 0) & (F.element_at("words", 1) != ""))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (window - 1), F.lit(1)))
    return listed.select(
        "item", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("words", i, window), " "))).alias("words")
    ).distinct()


def _parts(windows: DataFrame) -> Iterator[list[tuple[str, str]]]:
    """The patterns in groups of bounded size, one at a time on the driver."""
    part, size = [], 0
    for row in windows.toLocalIterator():
        part.append((row["item"], row["words"]))
        size += len(row["words"]) + 64
        if size > PART_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


_FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("ranges", T.ArrayType(T.IntegerType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def _merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], hi)
        else:
            out.append((lo, hi))
    return out


def _scan(batch: pa.RecordBatch, searches: list[_Search]) -> pa.RecordBatch:
    texts, before = batch.column("text"), batch.column("found").to_pylist()
    found = []
    for block in blocks(texts, PLAIN):
        text = block.data.tobytes().lower()  # bytes: only A-Z change
        tables = []
        for search in searches:
            codes = _codes(block.hash, search.span)
            slots = (codes >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
            tables.append((search, search.shift[slots].tobytes(), slots))
        for k in range(len(block.bounds) - 1):
            lo, hi = int(block.bounds[k]), int(block.bounds[k + 1])
            old = before[block.first_doc + k]
            ranges = list(zip(old["ranges"][::2], old["ranges"][1::2])) if old else []
            items = set(old["items"]) if old else set()
            for search, shifts, slots in tables:
                for first, names in search.find(block, lo, hi, shifts, slots, text):
                    ranges.append((first - lo, first - lo + search.length))
                    items |= names
            flat = [x for pair in _merge(ranges) for x in pair]
            found.append({"n_words": hi - lo, "ranges": flat, "items": sorted(items)})
    column = pa.array(found, batch.schema.field("found").type)
    return batch.set_column(batch.schema.get_field_index("found"), "found", column)


def find_windows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with ``found``: n_words, hit word ranges (start, end, …) and item ids."""
    out = docs.withColumn("found", F.lit(None).cast(_FOUND))
    spark = docs.sparkSession
    for part in _parts_or_none(item_windows(benchmark, window)):
        shared = spark.sparkContext.broadcast(part)

        @released
        def scan(batches, shared=shared):
            searches = _patterns(shared.value, window)
            for batch in batches:
                yield _scan(batch, searches)

        out = out.mapInArrow(scan, out.schema)
    return out


def _parts_or_none(windows: DataFrame) -> Iterator[list[tuple[str, str]]]:
    """At least one part, so that words are counted even without patterns."""
    empty = True
    for part in _parts(windows):
        empty = False
        yield part
    if empty:
        yield []


def _digest(batches):
    for batch in batches:
        rows = []
        for found in batch.column("found").to_pylist():
            hits = sum(b - a for a, b in zip(found["ranges"][::2], found["ranges"][1::2]))
            joined = ",".join(found["items"])
            rows.append((found["n_words"], hits, len(found["items"]), hashlib.sha256(joined.encode()).hexdigest(), hits > 0))
        columns = [batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()))]]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = find_windows(docs.select("doc_id", "text"), benchmark, window).select("doc_id", "found")
    return found.mapInArrow(
        _digest,
        f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean",
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any benchmark window, with their columns."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    found = find_windows(packed, benchmark, window)
    return found.where(F.size("found.ranges") == 0).select("row.*")
