"""Sets with a common passage that cannot be similar do not become candidate pairs."""

import itertools
import random

from pyspark.sql import functions as F

from tabbridge.llm import ngram_join
from tabbridge.llm.staging import scratch

KIND = "id long, component long"


def _words(rng, n):
    return ["".join(rng.choices("abcdefgh", k=9)) for _ in range(n)]


def _candidates(spark, texts):
    """{(a, b)} by the numbers of the texts."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    with scratch(spark, "test") as tables:
        docs = tables.put(docs)
        tied = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
        sets = tables.put(tied.mapInArrow(ngram_join._profiles, f"doc_id long, {ngram_join._PROFILE}"))
        number = {r["id"]: r["doc_id"] for r in sets.collect()}
        pairs = ngram_join._by_rarest(sets.select("id"), spark.createDataFrame([], KIND), docs, sets, tables).collect()
    return {tuple(sorted((number[r["a"]], number[r["b"]]))) for r in pairs}


def test_common_passage(spark):
    rng = random.Random(1)
    passage = _words(rng, 120)
    texts = [" ".join(_words(rng, 14) + passage + _words(rng, 14)) for _ in range(60)]
    texts.append(texts[0].rsplit(" ", 1)[0] + " other")  # two of 144 shingles differ
    assert _candidates(spark, texts) == {(0, 60)}


def test_every_similar_pair_is_a_candidate(spark):
    rng = random.Random(2)
    texts = []
    for _ in range(12):
        base = _words(rng, rng.randint(12, 90))
        for _ in range(8):  # cut, lengthened and edited at the ends, near the threshold
            cut = base[rng.randint(0, len(base) // 8) : len(base) - rng.randint(0, len(base) // 8)]
            texts.append(" ".join(_words(rng, rng.randint(0, len(base) // 10)) + cut + _words(rng, rng.randint(0, len(base) // 10))))
    texts, sets = list(dict.fromkeys(texts)), []
    for text in texts:
        words = text.split(" ")
        sets.append(frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)))
    near = set()
    for a, b in itertools.combinations(range(len(sets)), 2):
        same = len(sets[a] & sets[b])
        if 7 * same >= 3 * (len(sets[a]) + len(sets[b])):
            near.add((a, b))
    assert len(near) > 50 and near <= _candidates(spark, texts)
