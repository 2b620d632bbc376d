"""Runs: stretches of words that repeat with a period, found as maximal pairs.

A maximal pair (i, j) of length l is two places from which the same l words follow, with other
words (or an end of the text) before and after both. If their distance q = j - i is at most
l / 3, the stretch from i over l + q words has period q, is four periods long at least, and no
neighbouring word goes on with it: it is a run, and every run is such a pair. So

1. the suffixes of a text are sorted by prefix doubling, and the lengths of the prefixes that
   neighbours have in common are taken from the order (LCP);
2. the tree of LCP intervals is walked bottom-up with a stack. An interval holds the places of
   its suffixes in lists by left word. Where two intervals meet, places of the smaller one are
   looked up in the lists of other left words of the larger one, within the distance allowed;
   every place found is a maximal pair, so nothing is extended or checked afterwards;
3. of pairs with the same stretch, that with the smallest distance tells the period.

Most words lie in no run, and are set aside before the sort: a run of period q has 3q - 2 words
in a row, at least, whose three words come again within q. Words without this go, in up to
``ROUNDS`` rounds; the rest is sorted with the words around it, so that every run is whole.

Texts are analysed one by one, whatever their number of copies; a batch is worked through in
blocks of about ``BLOCK_BYTES``. A longer text is a block of its own, and takes about 100 bytes
for each of its words that repeat.

Defined results: a null text is an empty one, with no words and no runs. Rows are judged one by
one, repeated rows each for themselves; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabbridge.llm.words import BLOCK_BYTES

#: a run is this many periods long at least
PERIODS = 4
SHORTEST = 6
#: rounds of setting words aside; what is left after fewer rounds is only more to sort
ROUNDS = 12
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
Words = list[bytes]


def _next_distance(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Distance from each place to the next one of its text with the same three words; 0: none.

    Triples are told by a 64-bit hash. Two triples with one hash can only keep words that
    would have been set aside.
    """
    n = len(ids) - 2
    out = np.zeros(len(ids), np.int64)
    if n <= 0:
        return out
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    words = ids.astype(np.uint64)
    key = ((words[:n] * _MULTIPLIER) ^ (words[1 : n + 1] + np.uint64(1))) * _MULTIPLIER
    key = ((key ^ (key >> np.uint64(29))) + words[2:]) * _MULTIPLIER
    order = np.argsort(key, kind="stable")
    same = (key[order[1:]] == key[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    out[order[:-1][same]] = np.diff(order)[same]
    last = bounds[1:]
    out[np.concatenate([last[last > 0] - 1, last[last > 1] - 2])] = 0  # no three words left
    return out


def _stretches(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each stretch of true values."""
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def pieces(ids: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the stretches of words that hold every run of the texts between ``bounds``."""
    ahead = _next_distance(ids, bounds)
    open_ = ahead > 0
    start, end = _stretches(open_)
    for _ in range(ROUNDS):
        # a stretch of m places has room for periods up to (m + 2) / 3
        most = np.repeat((end - start + 2) // (PERIODS - 1), end - start)
        at = np.flatnonzero(open_)
        gone = at[ahead[at] > most]
        if not len(gone):
            break
        open_[gone] = False
        start, end = _stretches(open_)
    if not len(start):
        return []
    # one word before, the last period and its triple after, and one word more; never out of a text
    text = np.searchsorted(bounds, start, side="right") - 1
    lo = np.maximum(start - 1, bounds[text])
    hi = np.minimum(end + (end - start + 2) // (PERIODS - 1) + 3, bounds[text + 1])
    out: list[tuple[int, int]] = []
    for a, b, inside in zip(lo.tolist(), hi.tolist(), bounds[text].tolist()):
        if out and a <= out[-1][1] and out[-1][0] >= inside:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def suffix_order(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order, and each one's place in it, by prefix doubling."""
    n = len(symbols)
    _, rank = np.unique(symbols, return_inverse=True)
    rank, step = rank.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while True:
        if n and rank[order[-1]] == n - 1:
            return order, rank
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.zeros(n, np.int64)
        new[1:] = np.cumsum(ordered[1:] != ordered[:-1])
        rank = np.empty(n, np.int64)
        rank[order] = new
        step *= 2


def common_prefixes(symbols: list[int], order: list[int], place: list[int]) -> list[int]:
    """Words that each suffix shares with the one before it in the order."""
    n, shared = len(symbols), 0
    out = [0] * n
    for at in range(n):
        if place[at]:
            other = order[place[at] - 1]
            while at + shared < n and other + shared < n and symbols[at + shared] == symbols[other + shared]:
                shared += 1
            out[place[at]] = shared
            shared -= shared > 0
        else:
            shared = 0
    return out


class _Interval:
    """Places of the suffixes of an LCP interval, in order, by the word before them."""

    __slots__ = ("lists", "size")

    def __init__(self, place: int, left: int):
        self.lists, self.size = {left: [place]}, 1


def _meet(a: _Interval, b: _Interval, shared: int, shortest: int, report: Callable[[int, int, int], None]) -> _Interval:
    """Report the pairs between two intervals that share ``shared`` words, and join their lists."""
    if a.size < b.size:
        a, b = b, a
    reach = shared // (PERIODS - 1)
    for left, places in b.lists.items():
        for other, known in a.lists.items():
            if other == left:
                continue
            for x in places:
                for y in known[bisect_left(known, x - reach) : bisect_right(known, x + reach)]:
                    distance = abs(x - y)
                    if shared + distance >= shortest:
                        report(min(x, y), shared + distance, distance)
    for left, places in b.lists.items():
        known = a.lists.setdefault(left, places)
        if known is places:
            continue
        if places[0] > known[-1]:
            known.extend(places)
        else:
            for x in places:
                insort(known, x)
    a.size += b.size
    return a


def maximal_pairs(
    order: list[int], lcp: list[int], left: list[int], shortest: int, report: Callable[[int, int, int], None]
) -> None:
    """Walk the LCP intervals bottom-up; ``left`` is the word before each suffix."""
    least = PERIODS - 1  # no pair that shares less can be a run
    stack: list[tuple[int, _Interval]] = []
    for k, at in enumerate(order):
        shared = lcp[k + 1] if k + 1 < len(lcp) else 0
        if shared < least and not stack:
            continue
        held = _Interval(at, left[at])
        while stack and stack[-1][0] > shared:
            depth, others = stack.pop()
            held = _meet(others, held, depth, shortest, report)
        if shared < least:
            stack.clear()
        elif stack and stack[-1][0] == shared:
            stack[-1] = shared, _meet(stack[-1][1], held, shared, shortest, report)
        else:
            stack.append((shared, held))


def runs_of(ids: np.ndarray, bounds: np.ndarray, shortest: int = SHORTEST) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of every run of the texts between ``bounds``, by start and period."""
    spans = pieces(ids, bounds)
    if not spans:
        return
    sizes = [b - a for a, b in spans]
    place = np.concatenate([np.arange(a, b) for a, b in spans])
    # a piece has symbols of its own, so suffixes of two pieces share nothing
    symbols = np.repeat(np.arange(len(spans)), sizes) * (int(ids.max()) + 1) + ids[place]
    left = ids[np.maximum(place - 1, 0)]
    left[np.isin(place, bounds[:-1])] = -1  # the beginning of a text
    order, rank = suffix_order(symbols)
    ordered = order.tolist()
    lcp = common_prefixes(symbols.tolist(), ordered, rank.tolist())
    best: dict[tuple[int, int], int] = {}
    at = place.tolist()

    def report(start: int, length: int, period: int) -> None:
        key = at[start], length
        if period < best.get(key, period + 1):
            best[key] = period

    maximal_pairs(ordered, lcp, left.tolist(), shortest, report)
    yield from sorted((start, length, period) for (start, length), period in best.items())


def _blocks(batch: pa.RecordBatch, change) -> Iterator[tuple[int, list[Words]]]:
    """Words of the rows of a batch, in blocks of about BLOCK_BYTES of text."""
    held, size, first = [], 0, 0
    identifiers = batch.column("doc_id")
    for k, text in enumerate(batch.column("text")):
        raw = (text.as_py() or "").encode()
        words = raw.split()
        held.append(words if change is None else change(identifiers[k].as_py(), words))
        size += len(raw)
        if size >= BLOCK_BYTES:
            yield first, held
            held, size, first = [], 0, k + 1
    if held:
        yield first, held


def _number(texts: list[Words]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words (equal words, equal numbers), and the bounds of the texts."""
    known: dict[bytes, int] = {}
    number = known.setdefault
    ids = np.array([number(w, len(known)) for words in texts for w in words], np.int64)
    return ids, np.concatenate([[0], np.cumsum([len(words) for words in texts])]).astype(np.int64)


def _collapse(words: Words, runs: list[tuple[int, int, int]]) -> Words:
    """The words no run contains after its first period."""
    if not runs:
        return words
    cover = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        cover[start + period] += 1
        cover[start + length] -= 1
    gone = np.cumsum(cover)[:-1] > 0
    return [w for w, g in zip(words, gone.tolist()) if not g]


def _analyse(shortest: int, change):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _blocks(batch, change):
                ids, bounds = _number(texts)
                runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
                for start, length, period in runs_of(ids, bounds, shortest):
                    doc = int(np.searchsorted(bounds, start, side="right")) - 1
                    runs[doc].append((start - int(bounds[doc]), length, period))
                kept = [b" ".join(_collapse(w, r)).decode() for w, r in zip(texts, runs)]
                values = [dict(zip(("start", "length", "period"), run)) for found in runs for run in found]
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, len(texts)),
                        pa.array(np.diff(bounds)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, _RUN)),
                        pa.array(kept, pa.string()),
                    ],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    return work


def periodic_runs(
    docs: DataFrame, shortest: int = SHORTEST, change: Callable[[object, Words], Words] | None = None
) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period; by start, then period) and the
    collapsed text of every row: its words but those a run repeats, joined by one space.

    ``change(doc_id, words)`` may give other words for a row; they are analysed in their stead.
    """
    if shortest < PERIODS:
        raise ValueError(f"a run has {PERIODS} words at least")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _analyse(shortest, change),
        f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string",
    )


def repeat_tails(doc_id: object, words: Words) -> Words:
    """The words with a periodic tail in one document of ten, chosen by the CRC-32 of its number."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + period]
    return words[:a] + (tail * ((n - a) // period + 1))[: n - a]


def run_digests(found: DataFrame) -> DataFrame:
    """Per row of ``periodic_runs``: the number of runs, the longest one and digests."""
    longest = F.array_sort(
        F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period")))
    )
    top = F.get(longest, F.lit(0))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), lines.alias("lines"), "collapsed").select(
        "doc_id", "n_runs",
        F.col("top.start").alias("start"),
        (-F.col("top.shorter")).alias("length"),
        F.col("top.period").alias("period"),
        F.expr("(1000 * -top.shorter) div top.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", "lines"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
