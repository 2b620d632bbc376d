"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage of the whole text is
encoded from measures of its bytes and words and one hidden layer. A gated attention,
``softmax(w . (tanh(V h) * sigmoid(U h)))`` over the document's passages, weighs them, and the
weighted mean representation gives the probability of label 1. Encoder, attention and output
are trained together from document labels, by gradient descent on the log loss.

Training uses a bounded sample of whole documents: the ``most_docs`` labelled ones with the
least hashes, as far as all their passages stay within ``passage_budget``; a document that no
longer fits is left out whole. Scoring uses every passage in Arrow batches; the parameters are
a few hundred numbers.

Defined results: null and wordless texts are one empty passage, scored like any other; a
document with several labels counts with their mean, rounded up from one half; null labels are
no labels; without any label every score is 0.5; repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabbridge.llm.language import held_out
from tabbridge.llm.staging import Scratch, result, scratch
from tabbridge.llm.words import EXACT, Block, blocks

PASSAGE = 64
_KINDS = np.zeros((256, 6), np.float32)  # upper, lower, digit, punctuation, symbol, beyond ASCII
_KINDS[65:91, 0] = _KINDS[97:123, 1] = _KINDS[48:58, 2] = _KINDS[128:, 5] = 1
_KINDS[[ord(c) for c in ".,;:!?'\"()-"], 3] = 1
_KINDS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"], 4] = 1
MEASURES = 18


def passages(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(measures of every passage, document of every passage); a document has one at least."""
    count = np.diff(block.bounds)
    per_doc = np.maximum(-(-count // PASSAGE), 1)
    doc = np.repeat(np.arange(len(count)), per_doc)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    lo = block.bounds[doc] + nth * PASSAGE
    hi = np.minimum(lo + PASSAGE, block.bounds[doc + 1])
    n = hi - lo
    out = np.zeros((len(doc), MEASURES), np.float32)
    full = np.flatnonzero(n > 0)
    out[:, 0], out[:, 1] = n / PASSAGE, n == 0
    if not len(full):
        return out, doc
    lo, hi, n = lo[full], hi[full], n[full]
    length = (block.end - block.start).astype(np.float32)

    def mean(values: np.ndarray) -> np.ndarray:  # over the words of each passage
        total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
        return (total[hi] - total[lo]) / n

    first_byte, last_byte = block.start[lo], block.end[hi - 1]
    size = last_byte - first_byte
    for k in range(6):
        total = np.concatenate([[0], np.cumsum(_KINDS[:, k][block.data], dtype=np.int64)])
        out[full, 2 + k] = (total[last_byte] - total[first_byte]) / size
    lines = np.concatenate([[0], np.cumsum(block.data == 10, dtype=np.int64)])
    out[full, 8] = (lines[last_byte] - lines[first_byte]) / n
    out[full, 9] = mean(length) / 10
    out[full, 10] = np.sqrt(np.maximum(mean(length * length) - mean(length) ** 2, 0)) / 10
    again = np.zeros(len(length), np.float32)
    again[1:] = block.hash[1:] == block.hash[:-1]
    out[full, 11] = mean(again)
    starts, ends = block.data[block.start], block.data[block.end - 1]
    out[full, 12] = mean((starts >= 65) & (starts <= 90))
    out[full, 13] = mean((ends == 33) | (ends == 63))
    out[full, 14] = mean(np.isin(ends, [46, 44, 59, 58]))
    out[full, 15] = mean(length <= 2)
    out[full, 16] = mean(length > 14)
    of = np.repeat(np.arange(len(full)), n)
    words = block.hash[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(len(of))]
    order = np.lexsort((words, of))
    new = np.ones(len(of), bool)
    new[1:] = (words[order][1:] != words[order][:-1]) | (of[order][1:] != of[order][:-1])
    out[full, 17] = np.bincount(of[order][new], minlength=len(full)) / n
    return out, doc


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Attention:
    """Encoder, gated attention and output over bags of passages."""

    def __init__(self, hidden: int = 16, gates: int = 8, seed: int = 11):
        draw = np.random.default_rng(seed)
        size = lambda *s: draw.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {"W": size(MEASURES, hidden), "b": np.zeros(hidden), "V": size(hidden, gates), "U": size(hidden, gates),
                  "w": size(gates), "c": size(hidden), "d": np.zeros(1)}
        self.mean, self.spread = np.zeros(MEASURES), np.ones(MEASURES)

    def _forward(self, x: np.ndarray, doc: np.ndarray, start: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        a, b = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (a * b) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, start)[doc])
        weight = e / np.add.reduceat(e, start)[doc]
        z = np.add.reduceat(weight[:, None] * h, start)
        return {"h": h, "a": a, "b": b, "weight": weight, "z": z, "score": _sigmoid(z @ p["c"] + p["d"])}

    def score(self, x: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Of documents 0, 1, … whose passages are in order."""
        start = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        return self._forward((x - self.mean) / self.spread, doc, start)["score"]

    def fit(self, x: np.ndarray, doc: np.ndarray, label: np.ndarray, steps: int = 250, rate: float = 0.03, decay: float = 1e-4) -> None:
        self.mean, self.spread = x.mean(0), np.maximum(x.std(0), 1e-3)
        x = (x - self.mean) / self.spread
        start = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for t in range(1, steps + 1):
            for k, g in self._gradient(x, doc, start, label).items():
                g = g + decay * self.p[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.p[k] = self.p[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)

    def _gradient(self, x, doc, start, label) -> dict[str, np.ndarray]:
        p, f = self.p, self._forward(x, doc, start)
        h, a, b, weight = f["h"], f["a"], f["b"], f["weight"]
        ds = (f["score"] - label) / len(label)
        dz = ds[:, None] * p["c"][None, :]
        along = (h * dz[doc]).sum(1)
        de = weight * (along - np.add.reduceat(weight * along, start)[doc])
        gate = de[:, None] * p["w"][None, :]
        da, db = gate * b * (1 - a * a), gate * a * b * (1 - b)
        dh = (weight[:, None] * dz[doc] + da @ p["V"].T + db @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ da, "U": h.T @ db, "w": (a * b).T @ de,
                "c": f["z"].T @ ds, "d": np.array([ds.sum()])}


def _bags(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(measures, document, documents) of each block of a batch."""
    for block in blocks(texts, EXACT):
        yield *passages(block), len(block.bounds) - 1


def _whole_bags(batches):
    for batch in batches:
        sizes, packed = [], []
        for x, doc, docs in _bags(batch.column("text")):
            bounds = np.searchsorted(doc, np.arange(docs + 1))
            sizes += np.diff(bounds).tolist()
            packed += [x[lo:hi].tobytes() for lo, hi in zip(bounds[:-1], bounds[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("place"), batch.column("label"), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())],
            names=["place", "label", "n", "x"],
        )


def _within(sizes: list, budget: int) -> list[tuple[int, int]]:
    """(place, label) of the documents taken in order while all their passages fit."""
    taken = []
    for row in sizes:
        if row["n"] <= budget:
            taken.append((row["place"], row["label"]))
            budget -= row["n"]
    return taken


def learn(
    rows: DataFrame, labels: DataFrame, most_docs: int, passage_budget: int, steps: int, tables: Scratch
) -> Attention | None:
    """Fit on labelled rows (doc_id, text) with labels (doc_id, label)."""
    each = labels.where(F.col("label").isNotNull()).groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    # ids of rows that exist, before any text moves
    marks = rows.select("doc_id").join(each, "doc_id", "left_semi").distinct()
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs).join(each, "doc_id")
    picked = rows.join(F.broadcast(chosen), "doc_id").select(F.xxhash64("doc_id", "text").alias("place"), "label", "text")
    once = picked.dropDuplicates(["place", "label"])  # before anything goes to the driver
    bags = tables.put(once.mapInArrow(_whole_bags, "place long, label int, n long, x binary"))
    sizes = bags.select("place", "label", "n").orderBy("place", "label").limit(most_docs).collect()
    taken = _within(sizes, passage_budget)
    if not taken:
        return None
    kept = rows.sparkSession.createDataFrame(taken, "place long, label int")
    found = bags.join(F.broadcast(kept), ["place", "label"]).select("place", "label", "x").collect()
    found.sort(key=lambda r: (r["place"], r["label"]))
    bags = [np.frombuffer(r["x"], np.float32).reshape(-1, MEASURES) for r in found]
    doc = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    model = Attention()
    model.fit(np.concatenate(bags).astype(np.float64), doc, np.array([r["label"] for r in found], float), steps)
    return model


def _scores(shared):
    def score(batches):
        model = shared.value
        for batch in batches:
            scores = []
            for x, doc, docs in _bags(batch.column("text")):
                scores += model.score(x, doc).tolist() if model is not None else [0.5] * docs
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(scores, pa.float64())], names=[*kept, "score"])

    return score


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    folds: int = 5,
    fold: int = 0,
    threshold: float = 0.3,
    most_docs: int = 6000,
    passage_budget: int = 288_000,
    steps: int = 250,
) -> DataFrame:
    """doc_id, held_out, score and predicted; the held-out fold's labels are not learned from."""
    rows = docs.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "text")
    known = labels.select("doc_id", F.col("quality").alias("label"))
    with scratch(docs.sparkSession, "quality") as tables:
        train = rows.where(~F.col("held_out")).select("doc_id", "text")
        model = learn(train, known, most_docs, passage_budget, steps, tables)
        kind = docs.schema["doc_id"].dataType.simpleString()
        shared = docs.sparkSession.sparkContext.broadcast(model)
        scored = rows.mapInArrow(_scores(shared), f"doc_id {kind}, held_out boolean, score double")
        return result(scored.withColumn("predicted", (F.col("score") >= threshold).cast("int")), "quality")
