"""Language identification by hierarchical discrimination.

Counts of hashed byte pairs and triples of the whole text, letters only, square-rooted and
brought to length 1, go through two levels: linear support vector machines tell the language
families apart, then one-versus-one machines choose among the languages of that family. The
winner has the most duels won, then the larger sum of margins. The score is the product over
both levels of the logistic of the winner's closest duel.

The machines are fitted on a bounded, hashed sample: ``per_language`` texts of each language
and ``most_rows`` texts at most, by dual coordinate descent. Families are a parameter; a
language that is in none of them is a family of its own. Texts stay with their rows and are
scored in Arrow batches; only the sample's features go to the driver.

Defined results: ``und`` with score 0 for null texts, texts without any letter, and where
nothing could be learned; repeated rows get equal results; labels that are null or empty and
texts that are null are never learned from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabbridge.llm.staging import released, result, scratch, step_settings
from tabbridge.llm.words import BLOCK_BYTES, byte_blocks

FAMILIES = {
    "germanic": ("de", "en", "nl", "sv", "da", "no"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "uk", "pl", "cs", "bg", "sr"),
}
UNKNOWN = "und"
PAIRS, TRIPLES = 1024, 2048
WIDTH = PAIRS + TRIPLES
STEEPNESS = 4.0

_LETTER = re.compile(r"[A-Za-z]")
_FOLD = np.full(256, 32, np.uint8)  # everything that is no letter counts as a blank
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def _counts(data: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Counts of the hashed pairs and triples of each document; none crosses documents."""
    x = _FOLD[data].astype(np.uint32)
    out = np.zeros(docs * WIDTH)
    if len(x) > 1:
        pair = x[:-1] * np.uint32(257) + x[1:]
        same = doc[:-1] == doc[1:]
        code = ((pair * np.uint32(2654435761)) >> np.uint32(22)).astype(np.int64)
        out += np.bincount((doc[:-1] * WIDTH + code)[same], minlength=len(out))
    if len(x) > 2:
        triple = pair[:-1] * np.uint32(65599) + x[2:]
        same = doc[:-2] == doc[2:]
        code = PAIRS + ((triple * np.uint32(2654435761)) >> np.uint32(21)).astype(np.int64)
        out += np.bincount((doc[:-2] * WIDTH + code)[same], minlength=len(out))
    return out.reshape(docs, WIDTH)


def features(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first text, matrix) for groups of texts."""
    for first, data, offsets in byte_blocks(texts, 128):
        docs = len(offsets) - 1
        counts = np.zeros((docs, WIDTH))
        if docs == 1:  # of any length: in slices that share two bytes
            for lo in range(0, max(len(data), 1), BLOCK_BYTES):
                part = data[lo : lo + BLOCK_BYTES + 2]
                counts += _counts(part, np.zeros(len(part), np.int64), 1)
        else:
            counts = _counts(data, np.repeat(np.arange(docs), np.diff(offsets)), docs)
        rows = np.sqrt(counts)
        length = np.sqrt((rows * rows).sum(1, keepdims=True))
        yield first, (rows / np.where(length > 0, length, 1)).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return bool(text) and (_LETTER.search(text) is not None or any(c.isalpha() for c in text))


def fit_machine(x: np.ndarray, sign: np.ndarray, c: float = 4.0, epochs: int = 12) -> np.ndarray:
    """A linear support vector machine by dual coordinate descent; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight, alpha = np.zeros(x.shape[1], np.float32), np.zeros(len(x), np.float32)
    square, order = (x * x).sum(1), np.random.default_rng(7)
    # a class with fewer texts weighs as much as the other
    most = np.where(sign > 0, len(sign) / (2 * (sign > 0).sum()), len(sign) / (2 * (sign < 0).sum())) * c
    for _ in range(epochs):
        for i in order.permutation(len(x)):
            step = alpha[i] - (sign[i] * (weight @ x[i]) - 1) / square[i]
            step = min(max(step, 0.0), most[i])
            if step != alpha[i]:
                weight += (step - alpha[i]) * sign[i] * x[i]
                alpha[i] = step
    return weight


class Duels:
    """One-versus-one machines among some classes."""

    def __init__(self, x: np.ndarray, labels: np.ndarray):
        self.classes = sorted(set(labels.tolist()))
        self.pairs = list(combinations(range(len(self.classes)), 2))
        self.weights = []
        for a, b in self.pairs:
            rows = np.flatnonzero((labels == self.classes[a]) | (labels == self.classes[b]))
            self.weights.append(fit_machine(x[rows], np.where(labels[rows] == self.classes[a], 1.0, -1.0)))

    def judge(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class index, confidence) of every row."""
        n, k = len(x), len(self.classes)
        wins, sums, closest = np.zeros((n, k)), np.zeros((n, k)), np.full((n, k), np.inf)
        for (a, b), weight in zip(self.pairs, self.weights):
            margin = x @ weight[:-1] + weight[-1]
            for one, m in ((a, margin), (b, -margin)):
                wins[:, one] += m > 0
                sums[:, one] += m
                closest[:, one] = np.minimum(closest[:, one], m)
        best = np.argmax(wins + 0.5 * np.tanh(sums) / 2, axis=1)
        margin = closest[np.arange(n), best]
        return best, 1 / (1 + np.exp(-STEEPNESS * np.clip(margin, -20, 20)))


class Model:
    """Families first, then the languages of each family."""

    def __init__(self, x: np.ndarray, langs: list[str], families: dict[str, tuple[str, ...]]):
        of = {lang: name for name, members in families.items() for lang in members}
        langs = np.array(langs, object)
        kin = np.array([of.get(lang, f"={lang}") for lang in langs], object)
        self.top = Duels(x, kin)
        self.within = {name: Duels(x[kin == name], langs[kin == name]) for name in self.top.classes}

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        family, score = self.top.judge(x)
        names = np.empty(len(x), object)
        for k, name in enumerate(self.top.classes):
            rows = np.flatnonzero(family == k)
            if len(rows):
                duels = self.within[name]
                best, sure = duels.judge(x[rows])
                names[rows] = [duels.classes[b] for b in best]
                score[rows] *= sure
        return names.tolist(), score


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def _sample_features(batches):
    for batch in batches:
        rows = [m for _, m in features(batch.column("text"))]
        packed = [v.tobytes() for m in rows for v in m]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("place"), pa.array(packed, pa.binary())], names=["lang", "place", "x"])


def learn(docs: DataFrame, per_language: int, most_rows: int, families: dict) -> Model | None:
    """Fit on the texts of ``docs`` (doc_id, text, lang) with the least hashes."""
    place = F.xxhash64("doc_id", "text")
    known = docs.where(F.col("text").isNotNull() & (F.coalesce("lang", F.lit("")) != "") & (F.col("lang") != UNKNOWN))
    marks = known.select("lang", place.alias("place")).distinct()  # a repeated row takes one place
    langs = max(1, known.select("lang").distinct().count())
    each = max(1, min(per_language, most_rows // langs))
    by_hash = Window.partitionBy("lang").orderBy("place")
    chosen = marks.withColumn("n", F.row_number().over(by_hash)).where(F.col("n") <= each).select("lang", "place")
    rows = known.withColumn("place", place).join(F.broadcast(chosen), ["lang", "place"]).select("lang", "place", "text")
    once = rows.dropDuplicates(["lang", "place"])  # before anything goes to the driver
    found = once.mapInArrow(_sample_features, "lang string, place long, x binary").collect()
    if not found:
        return None
    found.sort(key=lambda r: (r["lang"], r["place"]))
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in found), np.float32).reshape(len(found), WIDTH)
    return Model(x, [r["lang"] for r in found], families)


def _predict(model):
    @released
    def predict(batches):
        fitted = model.value
        for batch in batches:
            texts = batch.column("text")
            langs, scores = [], []
            for _, x in features(texts):
                if fitted is None:
                    names, score = [UNKNOWN] * len(x), np.zeros(len(x))
                else:
                    names, score = fitted.predict(x)
                langs += names
                scores += score.tolist()
            for i, text in enumerate(texts.to_pylist()):
                if not has_letter(text):
                    langs[i], scores[i] = UNKNOWN, 0.0
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=[*keep, "lang_pred", "score"],
            )

    return predict


def predict_language(
    docs: DataFrame,
    keep: list[str],
    train: DataFrame,
    per_language: int = 400,
    most_rows: int = 8000,
    families: dict[str, tuple[str, ...]] = FAMILIES,
) -> DataFrame:
    """The columns ``keep`` of ``docs`` with lang_pred and score, learned from ``train``."""
    model = docs.sparkSession.sparkContext.broadcast(learn(train, per_language, most_rows, families))
    from pyspark.sql import types as T

    schema = T.StructType([docs.schema[c] for c in keep])
    schema = schema.add("lang_pred", T.StringType()).add("score", T.DoubleType())
    rows = docs.select(*[F.col(f"`{c}`") for c in keep if c != "text"], "text")
    if "text" in keep:
        raise ValueError("pass the row as a struct to keep its text")
    return rows.mapInArrow(_predict(model), schema)


def identify(docs: DataFrame, folds: int = 4, fold: int = 2, **options) -> DataFrame:
    """doc_id, held_out, lang_pred and score; rows of the held-out fold are not learned from."""
    rows = docs.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "text", "lang")
    with scratch(docs.sparkSession, "language"):
        train = rows.where(~F.col("held_out"))
        return result(predict_language(rows, ["doc_id", "held_out"], train, **options), "language")


def keep_known(docs: DataFrame, least_score: float = 0.2, **options) -> DataFrame:
    """The documents whose language is recognised, with their columns.

    Only the ids of the others are staged; the rows are taken from ``docs`` when they are read.
    """
    tie = F.xxhash64("text").alias("tie")  # a text's language depends on nothing else
    train = docs.where(~held_out(F.col("doc_id"), 4, 2)).select("doc_id", "text", "lang")
    with step_settings(docs.sparkSession):
        judged = predict_language(docs.select("doc_id", tie, "text"), ["doc_id", "tie"], train, **options)
        known = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)
        other = judged.where(~F.coalesce(known, F.lit(False)))
        other = result(other.select(F.col("doc_id").alias("other_id"), F.col("tie").alias("other_tie")).distinct(), "language")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", tie)
    same = rows["doc_id"].eqNullSafe(other["other_id"]) & (rows["tie"] == other["other_tie"])
    return rows.join(other, same, "left_anti").select("row.*")
