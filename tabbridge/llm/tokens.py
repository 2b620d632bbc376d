"""Token ids of documents as Parquet files made for selective reads.

Texts are ranged by document id, encoded in Arrow batches and written once. A file holds
``doc_id``, ``n_tokens``, ``local_start`` and ``part`` beside the list column ``ids``. Ids are
dictionary encoded, and delta encoded once a dictionary page is full (format version 2);
row groups and pages are of a set size and page indexes are written, so a reader can take the
metadata without the ids, or a range of documents without the other pages.

Encoding uses the tokenizers library on the pieces of a text. A byte-level tokenizer that
splits texts into words first gives the same ids for a text as for its pieces, cut where two
words of that split always meet: before a space with a visible character behind it (the space
goes with that character, and whatever stands before ends there), and between an ASCII letter
and a mark or line end. The pieces of an Arrow batch are numbered by Arrow's dictionary; each
distinct one is encoded once, unless a bounded table still holds it from a batch before, and
the ids of the texts are gathered from the table. Added tokens like ``<|endoftext|>`` are never
divided, nor cut from a space before them; files of another kind encode texts whole.

Defined results: a null text is an empty one and has only the end id; documents without id
come first, documents with the same id follow each other by a hash of their text; an empty
table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabbridge.llm.staging import released, step_settings
from tabbridge.session import workspace

END = 0
CACHE_BYTES = 16 << 20
CALL_PIECES = 128
PART_PIECES = 1 << 18
ROW_GROUP_BYTES = 16 << 20
PAGE_ROWS = 2048


class Cuts(NamedTuple):
    """Bytes of UTF-8 that show a cut: before the space in front of them, or between a letter and them."""

    behind_space: np.ndarray
    behind_letter: np.ndarray


class Pieces(NamedTuple):
    """Distinct pieces, and where in ``ids`` those of each begin and how many they are."""

    pieces: pa.Array
    ids: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray

    def volume(self) -> int:
        return sum(x.nbytes for x in self)


_KNOWN: dict[str, Pieces] = {}
_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
#: a piece that starts behind a letter is encoded behind this one
_LEAD = b" a"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _encode(tokenizer, text: str) -> np.ndarray:
    (found,) = tokenizer.encode_batch_fast([text], add_special_tokens=False)
    return np.asarray(found.ids, "<u4")


@cache
def _token_bytes(path: str) -> np.ndarray:
    """Bytes of each token; a byte-level vocabulary writes one character for a byte."""
    vocabulary = _tokenizer(path).get_vocab()
    sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
    for token, number in vocabulary.items():
        sizes[number] = len(token)
    return sizes


def _plain(tokenizer) -> bool:
    """Whether the file is a byte-level one that does no more than split, merge and find added tokens."""
    from tokenizers import models, pre_tokenizers

    words, model = tokenizer.pre_tokenizer, tokenizer.model
    if not isinstance(words, pre_tokenizers.ByteLevel) or not isinstance(model, models.BPE):
        return False
    changes = [tokenizer.normalizer, tokenizer.truncation, tokenizer.padding, words.add_prefix_space, not words.use_regex]
    changes += [model.dropout, model.continuing_subword_prefix, model.end_of_word_suffix]
    changes += [not set(words.alphabet()) <= tokenizer.get_vocab().keys()]
    for token in tokenizer.get_added_tokens_decoder().values():
        changes += [token.lstrip, token.rstrip, token.single_word, " " in token.content, not token.content.isascii()]
    return not any(changes)


@cache
def _cuts(path: str) -> Cuts:
    """Where texts may be cut: nowhere if the file is of another kind.

    A space goes with the visible character behind it. White space that is not ASCII begins with the
    bytes C2, E1, E2 or E3, so other first bytes are visible characters. Letters end before any other
    character of ASCII. No cut shows in front of an added token or divides one.
    """
    space, letter, tokenizer = np.zeros(256, bool), np.zeros(256, bool), _tokenizer(path)
    if _plain(tokenizer):
        space[0x21:0x7F] = space[0xC3:0xE0] = space[0xE4:0xF5] = True
        letter[0x21:0x7F] = letter[0x09:0x0E] = True
        letter[_LETTER] = letter[list(b"0123456789")] = False
        for token in tokenizer.get_added_tokens_decoder().values():
            raw = token.content.encode()
            space[raw[0]] = letter[list(raw)] = False
    return Cuts(space, letter)


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each of the texts begins (and the last ends), and the bytes."""
    _, bounds, values = texts.buffers()
    return np.frombuffer(bounds, np.int64)[texts.offset :][: len(texts) + 1], np.frombuffer(values or b"", np.uint8)


def _cut(texts: pa.Array, path: str) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts, and where those of each text begin."""
    cuts, texts = _cuts(path), texts.fill_null("").cast(pa.large_binary())
    bounds, data = _buffers(texts)
    lo, hi = bounds[[0, -1]]
    here, after = data[lo : max(hi - 1, lo)], data[lo + 1 : max(hi, lo + 1)]
    starts = np.zeros(hi - lo + 1, bool)
    starts[: len(here)] = (here == 0x20) & cuts.behind_space[after]
    starts[1 : len(here) + 1] |= _LETTER[here] & cuts.behind_letter[after]
    starts[bounds - lo] = True
    starts = np.flatnonzero(starts) + lo
    pieces = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), texts.buffers()[2]])
    return pieces, np.searchsorted(starts, bounds)


def _encode_joined(path: str, pieces: pa.Array, together: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the pieces, so many in one call, one after the other; where those of each begin (and the last end)."""
    bounds, data = _buffers(pieces)
    calls = bounds[[*range(0, len(pieces), together), len(pieces)]].tolist()
    raw, tokenizer = memoryview(data), _tokenizer(path)
    found = [_encode(tokenizer, str(raw[a:b], "utf-8")) for a, b in zip(calls[:-1], calls[1:])]
    ids = np.concatenate([np.zeros(0, "<u4"), *found])
    if together == 1:
        return ids, np.cumsum([0, *map(len, found)])
    ends = np.searchsorted(np.cumsum(_token_bytes(path)[ids]), bounds[1:] - bounds[0]) + 1
    return ids, np.concatenate([[0], ends])


def _encode_new(path: str, pieces: pa.Array) -> Pieces:
    """Pieces that a cut sets apart from what stands before are encoded many in one call, others alone."""
    bounds, data = _buffers(pieces)
    first, second = data[bounds[:-1]], data[np.minimum(bounds[:-1] + 1, bounds[1:] - 1)]
    spaced = (first == 0x20) & _cuts(path).behind_space[second]
    joined = _cuts(path).behind_letter[first]
    starts, sizes, ids = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64), [np.zeros(0, "<u4")]
    for mine, lead, together in ((spaced, b"", CALL_PIECES), (joined, _LEAD, CALL_PIECES), (~spaced & ~joined, b"", 1)):
        own = pieces.filter(pa.array(mine))
        if lead:
            own = pc.binary_join_element_wise(pa.scalar(lead, own.type), own, pa.scalar(b"", own.type))
        found, at = _encode_joined(path, own, together)
        skip = len(_encode(_tokenizer(path), lead.decode()))
        starts[mine] = sum(map(len, ids)) + at[:-1] + skip
        sizes[mine] = np.diff(at) - skip
        ids.append(found)
    return Pieces(pieces, np.concatenate(ids), starts, sizes)


def _gather(table: Pieces, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the pieces ``at``, one after the other; where those of each begin (and the last end)."""
    sizes = table.sizes[at]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    index = np.repeat((table.starts[at] - starts[:-1]).astype(np.int32), sizes)
    index += np.arange(len(index), dtype=np.int32)
    return table.ids[index], starts


def _number(texts: pa.Array, path: str) -> tuple[Pieces, np.ndarray, np.ndarray]:
    """A table of pieces, the number there of each text's pieces and its end, and where those of each text begin."""
    # the end id stands in the table as that of the empty piece, which no text has
    empty = Pieces(pa.array([b""], pa.large_binary()), np.array([END], "<u4"), np.array([0]), np.array([1]))
    known = _KNOWN.get(path, empty)
    pieces, bounds = _cut(texts, path)
    # the known pieces come first and are distinct, so they keep their numbers
    numbered = pa.concat_arrays([known.pieces, pieces]).dictionary_encode()
    new = _encode_new(path, numbered.dictionary[len(known.pieces) :])
    table = Pieces(
        numbered.dictionary,
        np.concatenate([known.ids, new.ids]),
        np.concatenate([known.starts, len(known.ids) + new.starts]),
        np.concatenate([known.sizes, new.sizes]),
    )
    at = np.insert(numbered.indices.to_numpy()[len(numbered) - len(pieces) :], bounds[1:], 0)
    _keep(path, table, at)
    return table, at, bounds + np.arange(len(bounds))


def _keep(path: str, table: Pieces, at: np.ndarray) -> None:
    """For the next batch: the table, or only the pieces of this batch; what was kept before if neither has room."""
    if table.volume() > CACHE_BYTES:
        used = np.zeros(len(table.pieces), bool)
        used[0] = used[at] = True
        ids, starts = _gather(table, np.flatnonzero(used))
        table = Pieces(table.pieces.filter(pa.array(used)), ids, starts[:-1], table.sizes[used])
    if table.volume() <= CACHE_BYTES:
        _KNOWN[path] = table


def encode_batch(texts: pa.Array, path: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids of some of the texts after others, each with the end id; where those of each begin (and the last end)."""
    table, at, bounds = _number(texts, path)
    edges = np.searchsorted(bounds, range(PART_PIECES, len(at), PART_PIECES))
    edges = np.unique([0, *edges, len(texts)])
    for a, b in zip(edges[:-1], edges[1:]):
        lo, hi = bounds[[a, b]]
        ids, starts = _gather(table, at[lo:hi])
        yield ids, starts[bounds[a : b + 1] - lo]


def encode_texts(texts: list[str | None], path: str) -> list[bytes]:
    """Little-endian 32-bit ids of every text, without the end id."""
    out = []
    for ids, starts in encode_batch(pa.array(texts, pa.string()), path):
        out += [ids[a : b - 1].tobytes() for a, b in zip(starts[:-1], starts[1:])]
    return out


def _encoder(path: str):
    @released
    def encode(batches):
        start = 0
        for batch in batches:
            row = 0
            for ids, starts in encode_batch(batch.column("text"), path):
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[row : row + len(starts) - 1],
                        pa.array(np.diff(starts)),
                        pa.array(start + starts[:-1]),
                        pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids.view(np.int32))),
                    ],
                    names=["doc_id", "n_tokens", "local_start", "ids"],
                )
                row += len(starts) - 1
                start += int(starts[-1])

    return encode


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None) -> None:
    """Write the token files of ``docs`` to a new folder."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    order = [F.col("doc_id"), F.col("tie")]
    with step_settings(spark):
        ranged = (
            docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
            .repartitionByRange(*order)
            .sortWithinPartitions(*order)
            .select("doc_id", "text")
        )
        encoded = ranged.mapInArrow(
            _encoder(tokenizer or default_tokenizer()),
            f"doc_id {kind}, n_tokens long, local_start long, ids array<int>",
        )
        (
            encoded.withColumn("part", F.spark_partition_id())
            .write.option("parquet.writer.version", "PARQUET_2_0")
            .option("parquet.block.size", str(ROW_GROUP_BYTES))
            .option("parquet.page.row.count.limit", str(PAGE_ROWS))
            .option("parquet.page.size", str(1 << 20))
            .option("parquet.dictionary.page.size", str(256 << 10))
            .option("compression", "zstd")
            .parquet(folder)
        )


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The files as a table: select columns or filter doc_id to read only those pages."""
    return spark.read.parquet(folder)


def part_starts(tokens: DataFrame) -> DataFrame:
    """(part, part_start): ids in the files before. One row per written range of documents."""
    sums = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_start"))


@released
def _checksums(batches):
    for batch in batches:
        lists = batch.column("ids")
        offsets = lists.offsets.to_numpy() * 4
        raw = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes())
        sums = [zlib.crc32(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
        names = ["doc_id", "part", "local_start", "n_tokens"]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(n) for n in names], pa.array(sums, pa.int64())], names=[*names, "ids_crc32"]
        )


def token_index(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    tokens = read_tokens(spark, folder)
    kind = tokens.schema["doc_id"].dataType.simpleString()
    summed = tokens.select("doc_id", "part", "local_start", "n_tokens", "ids").mapInArrow(
        _checksums, f"doc_id {kind}, part int, local_start long, n_tokens long, ids_crc32 long"
    )
    return summed.join(part_starts(tokens), "part").select(
        "doc_id", (F.col("part_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def tokenize_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the token files in the shared folder and return the index read back from them."""
    folder = workspace(docs.sparkSession, "tokens")
    write_tokens(docs, folder, tokenizer)
    return token_index(docs.sparkSession, folder)
