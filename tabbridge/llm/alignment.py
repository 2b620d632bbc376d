"""Token ids of two tokenizers for the same text, aligned where both end a token.

1. Texts are encoded by both tokenizers in blocks. The byte where each token ends, counted over
   the whole block, gives two ordered lists. A byte-level file whose merges stand in the order
   of their ids is a table of ranks: its vocabulary then runs in the quicker of two libraries.
2. Their merge is cut on diagonals: the binary search on the diagonal ``d`` finds how many of the
   first ``d`` ends of the merge come from each list. Pieces between two diagonals hold ``PIECE``
   ends, whatever the texts: a long one is many pieces, many short ones share one. Every piece
   emits the overlaps it holds, the ends that both lists have.
3. Pieces stand by themselves but for the group that is open at their edge: the overlaps are
   stitched into groups by counting on from the last overlap of the piece before.

The last tokens of a group, one of each tokenizer, end together: a link. Two linked tokens
cover the same bytes at their end, so the bytes of one are the last bytes of the other, and all
possible links of two vocabularies are known without any text (``possible_links``). Counts of
links over a corpus are therefore bounded by the vocabularies, and may be broadcast.

Defined results: texts that are null, empty, or not given back byte by byte by both
tokenizers have no tokens. Special tokens' strings inside a text are plain text. An empty table
gives no rows; repeated rows are judged one by one and all count; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabbridge.llm.staging import Scratch, result, scratch
from tabbridge.llm.words import BLOCK_BYTES

#: ends of both lists in a piece of the merge
PIECE = 1 << 14
_SPACE = "▁"
# Fixed value: how byte-level files split a text before the merges.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LONG_BLANK = re.compile(r"\s{500}")  # more than the quicker library's pattern matcher stands


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Side(NamedTuple):
    """One tokenizer: its function from texts to ids behind a space, and the bytes of every id."""

    encode: Callable[[list[str]], list[list[int]]]
    tokens: list[bytes]
    sizes: np.ndarray


def _byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


def _side(encode, tokens: list[bytes]) -> Side:
    return Side(encode, tokens, np.array([len(t) for t in tokens], np.int64))


def _ranked(tokenizer, tokens: list[bytes]) -> Callable[[str], list[int]] | None:
    """The same vocabulary by ranks, if the file's merges say no more than its ids do."""
    import tiktoken

    told = json.loads(tokenizer.to_str())
    model, words = told["model"], told.get("pre_tokenizer") or {}
    vocabulary, merges = model["vocab"], model["merges"]
    plain = told.get("normalizer") is None and words.get("type") == "ByteLevel" and words.get("use_regex", True)
    plain = plain and not model.get("ignore_merges") and not model.get("dropout") and not words.get("add_prefix_space")
    first = len(vocabulary) - len(merges) - sum(t["content"] in vocabulary for t in told["added_tokens"])
    if not plain or first != 256 or any(vocabulary.get(x + y) != first + k for k, (x, y) in enumerate(merges)):
        return None
    ranks = {tokens[k]: k for k in range(first + len(merges))}
    return tiktoken.Encoding("ranks", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@cache
def byte_side(path: str) -> Side:
    """A byte-level tokenizer file; texts are encoded behind one space."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    byte, vocabulary = _byte_level(), tokenizer.get_vocab()
    tokens = [b""] * (max(vocabulary.values()) + 1)
    for token, number in vocabulary.items():
        tokens[number] = bytes(map(byte.__getitem__, token)) if set(token) <= byte.keys() else token.encode()
    ranked = _ranked(tokenizer, tokens)

    def encode_one(text: str) -> list[int]:
        if ranked is None or _LONG_BLANK.search(text):
            (found,) = tokenizer.encode_batch_fast([text], add_special_tokens=False)
            return found.ids
        return ranked(text)

    def encode(texts: list[str]) -> list[list[int]]:
        return [encode_one(" " + t) for t in texts]

    return _side(encode, tokens)


@cache
def piece_side(path: str) -> Side:
    """A sentencepiece model, which puts the space before a text itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    tokens = []
    for number in range(model.get_piece_size()):
        piece = model.id_to_piece(number)
        byte = model.is_byte(number)
        tokens.append(bytes([int(piece[3:5], 16)]) if byte else piece.replace(_SPACE, " ").encode())


    def encode(texts: list[str]) -> list[list[int]]:
        return model.encode(texts, num_threads=1)

    return _side(encode, tokens)


def diagonal_cuts(a: np.ndarray, b: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge of two ordered lists is cut every ``piece`` elements: their index in each list.

    Equal elements stay together: of both lists' equals the cut is before or behind both.
    """
    d = np.arange(0, len(a) + len(b) + piece, piece)
    d = np.minimum(d, len(a) + len(b))
    lo, hi = np.maximum(d - len(b), 0), np.minimum(d, len(a))
    while (open_ := lo < hi).any():
        middle = (lo + hi) // 2
        other = d - middle - 1
        # of the first d ends, more than ``middle`` are from a if a[middle] comes before b[other]
        take = np.zeros(len(d), bool)
        take[open_] = a[middle[open_]] <= b[other[open_]]
        lo = np.where(open_ & take, middle + 1, lo)
        hi = np.where(open_ & ~take, middle, hi)
    i, j = lo, d - lo
    # a went first where both are equal: its partner in b belongs to the same piece
    known = (i > 0) & (j < len(b))
    known[known] = a[i[known] - 1] == b[j[known]]
    return i, j + known


def overlaps(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Indexes in ``a`` and in ``b`` of the elements both have, piece by piece of their merge."""
    cut_a, cut_b = diagonal_cuts(a, b, piece)
    found_a, found_b = [], []
    for a0, a1, b0, b1 in zip(cut_a[:-1], cut_a[1:], cut_b[:-1], cut_b[1:]):
        mine, theirs = a[a0:a1], b[b0:b1]
        if not len(mine) or not len(theirs):
            continue
        at = np.searchsorted(theirs, mine)
        same = theirs[np.minimum(at, len(theirs) - 1)] == mine
        found_a.append(a0 + np.flatnonzero(same))
        found_b.append(b0 + at[same])
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_a), np.concatenate(found_b)


def _given_back(side: Side, ids: list[list[int]], raw: list[bytes]) -> list[bool]:
    """Whether the bytes of the ids are those of the text behind a space."""
    tokens = side.tokens
    return [b"".join([tokens[i] for i in own]) == r for own, r in zip(ids, raw)]


def encode_both(a: Side, b: Side, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
    """Ids of every text by both; none for texts that are not given back."""
    given = [t for t in texts if t]
    raw = [b" " + t.encode() for t in given]
    ids_a, ids_b = a.encode(given), b.encode(given)
    found = iter(zip(ids_a, ids_b, _given_back(a, ids_a, raw), _given_back(b, ids_b, raw)))
    pairs = [next(found) if t else ([], [], True, True) for t in texts]
    return tuple([own[side] if own[2] and own[3] else [] for own in pairs] for side in (0, 1))


def _ids(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a block, and the ids before each text."""
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    return np.concatenate([np.zeros(0, np.int64), *(np.array(x, np.int64) for x in lists)]), bounds


class Aligned(NamedTuple):
    """The ids of a block's texts, and the ids up to the end of each group (of the block and of its text)."""

    a_ids: np.ndarray
    b_ids: np.ndarray
    a_bounds: np.ndarray  # ids before each text
    b_bounds: np.ndarray
    a_at: np.ndarray  # last id of each group
    b_at: np.ndarray
    bounds: np.ndarray  # groups before each text


def aligned_block(side_a: Side, side_b: Side, texts: list[str | None]) -> Aligned:
    lists_a, lists_b = encode_both(side_a, side_b, texts)
    (a, a_bounds), (b, b_bounds) = _ids(lists_a), _ids(lists_b)
    a_at, b_at = overlaps(np.cumsum(side_a.sizes[a]), np.cumsum(side_b.sizes[b]))
    return Aligned(a, b, a_bounds, b_bounds, a_at, b_at, np.searchsorted(a_at, a_bounds))


def _list_array(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.astype(np.int32)))


def _list_arrays(found: Aligned) -> list[pa.Array]:
    groups = np.diff(found.bounds)
    cuts = [at + 1 - np.repeat(before[:-1], groups) for at, before in ((found.a_at, found.a_bounds), (found.b_at, found.b_bounds))]
    ids = _list_array(found.a_ids, found.a_bounds), _list_array(found.b_ids, found.b_bounds)
    return [*ids, *(_list_array(c, found.bounds) for c in cuts)]


def _blocks(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    held, size, first = [], 0, 0
    for k, text in enumerate(texts):
        held.append(text.as_py())
        size += len(held[-1] or "")
        if size >= BLOCK_BYTES:
            yield first, held
            held, size, first = [], 0, k + 1
    if held:
        yield first, held


def _align(path_a: str, path_b: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = byte_side(path_a), piece_side(path_b)
        for batch in batches:
            for first, texts in _blocks(batch.column("text")):
                columns = _list_arrays(aligned_block(*sides, texts))
                doc = batch.column("doc_id").slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([doc, *columns], names=["doc_id", "a_ids", "b_ids", "a_cuts", "b_cuts"])

    return work


def align(docs: DataFrame, byte_tokenizer: str | None = None, piece_tokenizer: str | None = None) -> DataFrame:
    """doc_id, a_ids, b_ids, a_cuts, b_cuts of every row.

    Group ``k`` holds the ids ``a_ids[a_cuts[k - 1] : a_cuts[k]]`` of the first tokenizer (a
    byte-level one, on the text behind a space) and likewise those of the second (a
    sentencepiece one). Every id is in a group.
    """
    path_a, path_b = default_tokenizers()
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _align(byte_tokenizer or path_a, piece_tokenizer or path_b),
        f"doc_id {kind}, a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>",
    )


@cache
def possible_links(path_a: str, path_b: str) -> np.ndarray:
    """All pairs of ids that can end together, as ``a << 32 | b``, in order.

    The bytes of one are the last bytes of the other: at most one pair for each suffix of each
    token, and each id with those bytes.
    """
    a, b = byte_side(path_a).tokens, piece_side(path_b).tokens
    found: set[tuple[int, int]] = set()
    for longer, shorter, swap in ((a, b, False), (b, a, True)):
        by_bytes: dict[bytes, list[int]] = {}
        for number, token in enumerate(shorter):
            if token:
                by_bytes.setdefault(token, []).append(number)
        for number, token in enumerate(longer):
            for k in range(len(token)):
                for other in by_bytes.get(token[k:], ()):
                    found.add((other, number) if swap else (number, other))
    pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
    return pairs[:, 0] << 32 | pairs[:, 1]


class GroupText:
    """``a1,a2|b1;a3|b2,b3``: the groups of a text as text, for all texts of a block."""

    def __init__(self, a: Side, b: Side):
        # an id of either side, behind it what separates it from the next one
        self.pieces = [f"{i}{mark}" for n, end in ((len(a.tokens), "|"), (len(b.tokens), ";")) for mark in (",", end) for i in range(n)]
        self.n_a, self.n_b = len(a.tokens), len(b.tokens)

    def of(self, found: Aligned) -> list[str]:
        code_a, code_b = found.a_ids.copy(), found.b_ids + 2 * self.n_a
        code_a[found.a_at] += self.n_a
        code_b[found.b_at] += self.n_b
        # a token comes behind the other side's tokens of all groups before (b: of its own group, too)
        a_before = np.concatenate([[0], found.a_at + 1])
        b_before = np.concatenate([[0], found.b_at + 1])
        codes = np.empty(len(code_a) + len(code_b), np.int64)
        codes[np.arange(len(code_a)) + np.repeat(b_before[:-1], np.diff(a_before))] = code_a
        codes[np.arange(len(code_b)) + np.repeat(a_before[1:], np.diff(b_before))] = code_b
        text = list(map(self.pieces.__getitem__, codes.tolist()))
        ends = (found.a_bounds + found.b_bounds).tolist()
        return ["".join(text[i:j])[:-1] for i, j in zip(ends[:-1], ends[1:])]


def _pack(links: np.ndarray, pairs: np.ndarray) -> bytes:
    """The different links of a text by number among the possible ones, and how often each comes."""
    keys, times = np.unique(links, return_counts=True)
    numbers = np.searchsorted(pairs, keys)
    return zlib.compress(np.concatenate([np.diff(numbers, prepend=0), times]).astype("<u4").tobytes(), 1)


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    deltas, times = np.frombuffer(zlib.decompress(packed), "<u4").astype(np.int64).reshape(2, -1)
    return np.cumsum(deltas), times


def _profile(path_a: str, path_b: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = byte_side(path_a), piece_side(path_b)
        pairs, writer = possible_links(path_a, path_b), GroupText(*sides)
        for batch in batches:
            for first, texts in _blocks(batch.column("text")):
                found = aligned_block(*sides, texts)
                links = found.a_ids[found.a_at] << 32 | found.b_ids[found.b_at]
                packed = [_pack(links[i:j], pairs) for i, j in zip(found.bounds[:-1], found.bounds[1:])]
                digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in writer.of(found)]
                sizes = [pa.array(np.diff(x)) for x in (found.a_bounds, found.b_bounds, found.bounds)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, len(texts)), *sizes, pa.array(digests, pa.string()), pa.array(packed, pa.binary())],
                    names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"],
                )

    return work


def _count(path_a: str, path_b: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = possible_links(path_a, path_b)
        total = np.zeros(len(pairs), np.int64)
        for batch in batches:
            for packed in batch.column("links").to_pylist():
                numbers, times = _unpack(packed)
                total[numbers] += times
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(pairs[some] >> 32), pa.array(pairs[some] & 0xFFFFFFFF), pa.array(total[some])], names=["a_id", "b_id", "n"]
        )

    return work


def profile_alignment(docs: DataFrame, byte_tokenizer: str | None = None, piece_tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, digest of the groups and the packed links of every row."""
    path_a, path_b = default_tokenizers()
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _profile(byte_tokenizer or path_a, piece_tokenizer or path_b),
        f"doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, links binary",
    )


def link_counts(profiles: DataFrame, byte_tokenizer: str | None = None, piece_tokenizer: str | None = None) -> DataFrame:
    """a_id, b_id, n: how many links of the corpus hold a pair. At most ``possible_links`` rows."""
    path_a, path_b = default_tokenizers()
    counted = profiles.select("links").mapInArrow(
        _count(byte_tokenizer or path_a, piece_tokenizer or path_b), "a_id long, b_id long, n long"
    )
    return counted.groupBy("a_id", "b_id").agg(F.sum("n").alias("n"))


def _held(spark, counts: DataFrame, pairs: np.ndarray):
    """Broadcast counts of the possible links, and which are the highest of their second id."""
    found = counts.toArrow()
    if found.num_rows > len(pairs):
        raise RuntimeError("more links than the vocabularies allow")
    a, b, n = (found.column(c).to_numpy() for c in ("a_id", "b_id", "n"))
    total = np.zeros(len(pairs), np.int64)
    total[np.searchsorted(pairs, a << 32 | b)] = n
    second = pairs & 0xFFFFFFFF
    highest = np.zeros(int(second.max(initial=0)) + 1, np.int64)
    np.maximum.at(highest, second, total)
    return spark.sparkContext.broadcast((total, total == highest[second]))


def _measure(counts):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, highest = counts.value
        for batch in batches:
            n_best, count_sum = [], []
            for packed in batch.column("links").to_pylist():
                numbers, times = _unpack(packed)
                n_best.append(int(times[highest[numbers]].sum()))
                count_sum.append(int((times * total[numbers]).sum()))
            names = ["doc_id", "n_a", "n_b", "n_groups", "n_groups", "groups_sha256"]
            columns = [batch.column(c) for c in names]
            columns[5:5] = [pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())]
            names[4:5] = ["n_links", "n_best", "count_sum"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return work


def measure_alignment(
    docs: DataFrame, tables: Scratch, byte_tokenizer: str | None = None, piece_tokenizer: str | None = None
) -> DataFrame:
    """Per row the numbers of tokens, groups and links, how common its links are, and a digest.

    A group has one link: its last tokens.
    """
    paths = tuple(given or own for given, own in zip((byte_tokenizer, piece_tokenizer), default_tokenizers()))
    profiles = tables.put(profile_alignment(docs, *paths))
    counts = _held(docs.sparkSession, link_counts(profiles, *paths), possible_links(*paths))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return profiles.mapInArrow(
        _measure(counts),
        f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string",
    )


def alignment_digests(docs: DataFrame) -> DataFrame:
    with scratch(docs.sparkSession, "alignment") as tables:
        return result(measure_alignment(docs, tables), "alignment")
