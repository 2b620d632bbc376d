"""Substring dedup with repeated-phrase automata.

A window of ``window`` words that occurs twice has its anchor, the smallest hash among its
runs of ``anchor`` words (winnowing), twice as well. So:

1. the anchors of every text are counted, about one for every twelve words;
2. of the texts with recurring anchors, the windows over such anchors are counted exactly;
   these are the recurring passages;
3. the texts are taken in batches, each with its own recurring windows. The phrases under
   them, the anchors' words, are compiled into an Aho-Corasick automaton per batch (the
   shards: an automaton never holds more than one Arrow batch needs), and every text of the
   batch streams through it. Each place where a phrase occurs opens the windows around it;
   those that recur are covered, and their words go.

Counting is by key and sorted runs: a run of two different texts, or a text that holds the
key twice, makes it recurring. Keys that a task sees very often are split over tasks. Exact
copies are told by text: they count once, and a text that occurs twice is covered entirely
if it has a window at all.

Defined results: null and wordless texts have no words and the digest of the empty text;
texts with fewer words than a window keep all of them; rows are judged one by one, so a
repeated row is a copy of the other.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabbridge.llm.grouping import HotKeys, by_key, keyed_batch, runs, seen_before
from tabbridge.llm.staging import result, scratch
from tabbridge.llm.words import EXACT, Block, blocks, shingles

WINDOW = 35
ANCHOR = 12
_U = np.uint64
_ODD = _U(1)


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


class Windows:
    """The windows of a block: hash, first word and anchor of each."""

    def __init__(self, block: Block, window: int, anchor: int):
        self.hash, self.at = shingles(block, window)
        self.anchor_at = np.zeros(0, np.int64)
        self.anchor = np.zeros(0, np.uint64)
        if not len(self.at):
            return
        phrase = np.full(len(block.hash), np.iinfo(np.uint64).max, np.uint64)
        value, first = shingles(block, anchor)
        phrase[first] = value
        # the high bits of the hash, then the place: the least is the leftmost minimum
        rank = (phrase & ~_U((1 << 27) - 1)) | np.arange(len(phrase), dtype=np.uint64)
        least, span, width = rank, 1, window - anchor + 1
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        self.anchor_at = (least[self.at] & _U((1 << 27) - 1)).astype(np.int64)
        self.anchor = phrase[self.anchor_at]


def _doc_of(block: Block, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(block.bounds, at, side="right") - 1


def _counted(keys: np.ndarray, doc: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (key, id of its text); the id is odd where the text holds the key twice."""
    order = np.lexsort((keys, doc))
    keys, doc = keys[order], doc[order]
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    count = np.diff(np.append(np.flatnonzero(first), len(keys)))
    own = ids[doc[first]].view(np.uint64)
    return keys[first], ((own & ~_ODD) | (count > 1).astype(np.uint64)).view(np.int64)


def _profile(batches):
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            words = text.encode().split() if text else []
            rows.append((len(words), _sha(words)))
        n, sha = zip(*rows) if rows else ((), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("id"), pa.array(n, pa.int64()), pa.array(sha, pa.string())],
            names=["doc_id", "id", "n_words", "sha"],
        )


def _anchors(window: int, anchor: int):
    def emit(batches):
        hot, known = HotKeys(), set()
        for batch in batches:
            for ids, block in _with_ids(batch):
                fresh = ~seen_before(known, ids)
                found = Windows(block, window, anchor)
                places = np.unique(found.anchor_at)
                doc = _doc_of(block, places)
                new = fresh[doc]
                # several windows may share an anchor: places, not windows, are counted
                values = np.zeros(len(block.hash), np.uint64)
                values[found.anchor_at] = found.anchor
                keys, of = _counted(values[places[new]], doc[new], ids)
                yield keyed_batch(*hot.route(keys, of))

    return emit


def _with_ids(batch):
    ids = batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
    for block in blocks(batch.column("text"), EXACT):
        yield ids[block.first_doc : block.first_doc + len(block.bounds) - 1], block


def _candidates(window: int, anchor: int):
    def emit(batches):
        hot = HotKeys()
        for batch in batches:
            lists = batch.column("anchors")
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            for ids, block in _with_ids(batch):
                lo, hi = offsets[block.first_doc], offsets[block.first_doc + len(ids)]
                found = Windows(block, window, anchor)
                if not len(found.at):
                    continue
                some = np.isin(found.anchor, values[lo:hi].view(np.uint64))
                keys, of = _counted(found.hash[some], _doc_of(block, found.at[some]), ids)
                yield keyed_batch(*hot.route(keys, of))

    return emit


def _recurring(batches):
    """(key, id) of the keys that two texts share or one text holds twice."""
    held, odd = None, np.int64(1)  # the first row of the open run, while it has no second
    open_run = None
    for key, salt, id, start in runs(batches):
        text = id & ~odd
        if open_run == (int(key[0]), int(salt[0])):
            start[0] = False
        at = np.flatnonzero(start)
        run = np.cumsum(start)  # 0: the run left open by the last batch
        n_runs = len(at) + 1
        # a run recurs when a row differs from the row before it, or is odd
        differs = np.zeros(len(key), bool)
        differs[1:] = ~start[1:] & (text[1:] != text[:-1])
        if not start[0] and held is not None:
            differs[0] = text[0] != held[1] & ~odd
        good = np.bincount(run, weights=differs | ((id & odd) == 1), minlength=n_runs) > 0
        good[0] |= held is None and open_run is not None and not start[0]  # known to recur
        out_key, out_id = [key[good[run]]], [text[good[run]]]
        if held is not None and good[0] and not start[0]:
            out_key.append(np.array([held[0]])), out_id.append(np.array([held[1] & ~odd]))
        last_good = bool(good[run[-1]])
        open_run = (int(key[-1]), int(salt[-1]))
        if last_good:
            held = None
        elif len(at) == 0 and held is not None:
            pass  # still the same single text
        else:
            held = (key[-1], id[-1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(out_key)), pa.array(np.concatenate(out_id))], names=["key", "id"]
        )


def _remove(window: int, anchor: int):
    def clean(batches):
        for batch in batches:
            lists = batch.column("windows")
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            out = []
            for ids, block in _with_ids(batch):
                first = block.first_doc
                recurring = values[offsets[first] : offsets[first + len(ids)]].view(np.uint64)
                gone = _covered(block, np.unique(recurring), window, anchor)
                text = block.data.tobytes()
                for d in range(len(ids)):
                    lo, hi = int(block.bounds[d]), int(block.bounds[d + 1])
                    kept = [text[s:e] for s, e, g in zip(block.start[lo:hi], block.end[lo:hi], gone[lo:hi]) if not g]
                    out.append((int(ids[d]), hi - lo - len(kept), _sha(kept)))
            columns = list(zip(*out)) or [(), (), ()]
            kinds = (pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)], names=["id", "n_removed", "kept_sha256"]
            )

    return clean


def _covered(block: Block, recurring: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """Words of the block inside a recurring window, found by their phrases."""
    found = Windows(block, window, anchor)
    gone = np.zeros(len(block.hash) + 1, np.int64)
    if not len(found.at) or not len(recurring):
        return gone[:-1] > 0
    text = block.data.tobytes()
    spoken = b" ".join(text[s:e] for s, e in zip(block.start, block.end)).decode("latin-1")
    length = block.end - block.start
    begin = np.cumsum(length + 1) - length - 1  # of each word in ``spoken``
    phrases = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    wanted = np.isin(found.hash, recurring)
    for w in np.unique(found.anchor_at[wanted]).tolist():
        phrases.add_word(spoken[begin[w] : begin[w + anchor - 1] + length[w + anchor - 1]])
    if not len(phrases):
        return gone[:-1] > 0
    phrases.make_automaton()
    ends = np.array([(end + 1, size) for end, size in phrases.iter(spoken)], np.int64).reshape(-1, 2)
    word = np.searchsorted(begin, ends[:, 0] - ends[:, 1])
    word = np.minimum(word, len(begin) - 1)
    after = np.append(begin + length, -1)
    last = np.minimum(word + anchor - 1, len(begin) - 1)
    whole = (begin[word] == ends[:, 0] - ends[:, 1]) & (after[last] == ends[:, 0])
    # windows that hold a phrase: those that start up to window - anchor words before it
    near = np.zeros(len(block.hash) + 1, np.int64)
    np.add.at(near, np.maximum(word[whole] - (window - anchor), 0), 1)
    np.add.at(near, word[whole] + 1, -1)
    open_windows = np.cumsum(near)[found.at] > 0
    hit = found.at[open_windows & np.isin(found.hash, recurring)]
    np.add.at(gone, hit, 1)
    np.add.at(gone, hit + window, -1)
    return np.cumsum(gone)[:-1] > 0


def remove_repeated_passages(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    even = F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit(~1))
    rows = docs.select("doc_id", "text", even.alias("id"))
    with scratch(docs.sparkSession, "passages") as tables:
        profiles = tables.put(rows.mapInArrow(_profile, f"doc_id {kind}, id long, n_words long, sha string"))
        texts = tables.put(
            profiles.groupBy("id").agg(
                F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max("n_words").alias("n_words")
            )
        )
        keyed = "key long, salt int, id long"
        marks = by_key(rows.select("id", "text").mapInArrow(_anchors(window, anchor), keyed))
        common = marks.mapInArrow(_recurring, "key long, id long")
        wanted = tables.put(common.groupBy("id").agg(F.collect_set("key").alias("anchors")))
        reps = wanted.join(texts.select("id", "rep"), "id")
        same = (rows["id"] == reps["id"]) & rows["doc_id"].eqNullSafe(reps["rep"])
        chosen = tables.put(rows.join(reps, same).select(rows["id"], "text", "anchors"))
        tables.drop(wanted)
        spans = by_key(chosen.mapInArrow(_candidates(window, anchor), keyed))
        windows = tables.put(spans.mapInArrow(_recurring, "key long, id long").groupBy("id").agg(F.collect_set("key").alias("windows")))
        cut = tables.put(
            chosen.select("id", "text").join(windows, "id")
            .mapInArrow(_remove(window, anchor), "id long, n_removed long, kept_sha256 string")
            .dropDuplicates(["id"])
        )
        tables.drop(chosen, windows)
        of_text = texts.join(cut, "id", "left")
        whole = (F.col("copies") > 1) & (F.col("all_words") >= window)
        found = of_text.where((F.col("copies") > 1) | F.col("n_removed").isNotNull()).select(
            "id", "copies", F.col("n_words").alias("all_words"), "n_removed", "kept_sha256"
        )
        return result(
            profiles.join(found, "id", "left").select(
                "doc_id", "n_words",
                F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
                F.when(whole, F.lit(_sha([]))).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
            ),
            "passages",
        )
