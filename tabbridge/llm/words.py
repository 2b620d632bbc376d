"""Words of whole texts as NumPy arrays, for operators that work inside Arrow batches.

A batch is cut into blocks of whole documents of at most ``BLOCK_BYTES`` of text. A longer
document is its own block and is hashed in slices cut between words, so the working memory
is a few arrays over ``BLOCK_BYTES`` plus 24 bytes for each word of the block.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64), np.ones(1, np.uint64)


class Alphabet(NamedTuple):
    """Which bytes of UTF-8 text belong to words, and what they count as."""

    inside: np.ndarray  # bool[256]
    folded: np.ndarray  # uint8[256]


def _alphabet(separators: list[int], fold: bool) -> Alphabet:
    inside = np.ones(256, bool)
    inside[separators] = False
    folded = np.arange(256, dtype=np.uint8)
    if fold:
        folded[65:91] += 32
    return Alphabet(inside, folded)


_BLANKS = [0x20, *range(0x09, 0x0E)]
#: words ``[^\x20\x09-\x0D]+``, as they are and with A-Z lower-cased
EXACT = _alphabet(_BLANKS, fold=False)
FOLDED = _alphabet(_BLANKS, fold=True)
#: words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z
PLAIN = _alphabet(
    [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)], fold=True
)


class Block(NamedTuple):
    """The words of documents ``first_doc`` … ``first_doc + len(bounds) - 2`` of a batch."""

    first_doc: int
    data: np.ndarray  # uint8 text bytes of the block
    start: np.ndarray  # byte where each word starts
    end: np.ndarray  # byte after each word
    hash: np.ndarray  # uint64 of each word
    bounds: np.ndarray  # words before each document, and their number


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS
    if len(_POWERS[0]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        size = max(n, BLOCK_BYTES)
        tables = []
        for base in (_BASE, inverse):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        _POWERS = tables[0], tables[1]
    return _POWERS


def _slices(data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Word ranges whose bytes stay below the block size, one word at least."""
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + BLOCK_BYTES)))
        yield lo, hi
        lo = hi


def _hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, folded: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), np.uint64)
    for lo, hi in _slices(data, start):
        base, last = int(start[lo]), int(end[hi - 1])
        power, inverse = _powers(last - base)
        values = folded[data[base:last]].astype(np.uint64)
        values += np.uint64(1)
        values *= power[: last - base]
        total = np.zeros(last - base + 1, np.uint64)
        np.cumsum(values, out=total[1:])
        s, e = start[lo:hi] - base, end[lo:hi] - base
        out[lo:hi] = (total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64)
    return mix(out)


def _block(first: int, data: np.ndarray, offsets: np.ndarray, alphabet: Alphabet) -> Block:
    inside = alphabet.inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # words end where a document does
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    start = np.flatnonzero(inside & ~(before & ~edge[:-1]))
    end = np.flatnonzero(inside & ~(after & ~edge[1:])) + 1
    bounds = np.searchsorted(start, offsets)
    return Block(first, data, start, end, _hash(data, start, end, alphabet.folded), bounds)


def blocks(texts: pa.Array, alphabet: Alphabet) -> Iterator[Block]:
    """The words of every text of a batch, in blocks; a null text has none."""
    texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return
    at = texts.offset
    offsets = np.frombuffer(texts.buffers()[1], kind)[at : at + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = int(np.searchsorted(offsets, offsets[lo] + BLOCK_BYTES, side="right")) - 1
        hi = min(max(hi, lo + 1), len(texts))
        base = offsets[lo]
        yield _block(lo, data[base : offsets[hi]], offsets[lo : hi + 1] - base, alphabet)
        lo = hi


def shingles(block: Block, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``length`` words and the first word of each.

    Runs do not cross documents.
    """
    words = block.hash
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value = np.zeros(n, np.uint64)
    for k in range(length):
        value = value * _BASE + words[k : n + k]
    at = np.arange(n)
    last = np.repeat(block.bounds[1:], np.diff(block.bounds))[:n]  # end of each word's document
    whole = at + length <= last
    return mix(value[whole]), at[whole]


def byte_blocks(texts: pa.Array, most_docs: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, bytes, offsets) of up to ``most_docs`` texts and about BLOCK_BYTES each."""
    texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at, lo = texts.offset, 0
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], kind)[at : at + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    while lo < len(texts):
        hi = int(np.searchsorted(offsets, offsets[lo] + BLOCK_BYTES, side="right")) - 1
        hi = min(max(hi, lo + 1), lo + most_docs, len(texts))
        yield lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
