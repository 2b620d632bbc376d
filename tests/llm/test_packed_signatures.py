"""Signatures go to the buckets packed by slices of their range, and texts are split into sets once for them."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tabbridge.llm import ngram_join
from tabbridge.llm.words import FOLDED, blocks


def _texts():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(4000)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 400))) for _ in range(300)]
    passage = rng.choices(words, k=300)
    # one word more at the end: most signatures are common to all of these
    texts += [" ".join([*passage, f"end{i}"]) for i in range(1300)]
    return [*texts, None, "", "three words only", *texts[:20]]


def _batch(texts):
    n = len(texts)
    return pa.RecordBatch.from_pydict({"doc_id": pa.array(range(n)), "text": texts, "tie": pa.array([0] * n)})


def _signed(texts):
    """{signature: ids}"""
    found = {}
    for block in blocks(_batch(texts).column("text"), FOLDED):
        sets = ngram_join.Sets(block)
        for _, _, _, signature, doc in sets.signatures():
            for key, id in zip(signature.view(np.int64).tolist(), sets.id[doc].tolist()):
                found.setdefault(key, set()).add(id)
    return found


def test_packed_rows_hold_every_signature(monkeypatch):
    monkeypatch.setattr(ngram_join, "PACK", 20_000)
    texts, calls = _texts(), []
    whole = _batch(texts)
    sets = ngram_join.Sets
    monkeypatch.setattr(ngram_join, "Sets", lambda block: calls.append(len(block.bounds) - 1) or sets(block))
    rows = [r for b in ngram_join._profile_and_sign(whole.slice(k, 100) for k in range(0, len(texts), 100)) for r in b.to_pylist()]
    assert sum(calls) == len(texts)  # each text once
    monkeypatch.setattr(ngram_join, "Sets", sets)

    profiles, packed = [r for r in rows if r["slice"] < 0], [r for r in rows if r["slice"] >= 0]
    assert [r["doc_id"] for r in profiles] == list(range(len(texts)))
    found = {}
    for r in packed:
        keys, ids = (np.frombuffer(r[c], np.int64) for c in ("keys", "ids"))
        assert set((keys.view(np.uint64) >> np.uint64(64 - ngram_join.SLICE_BITS)).tolist()) == {r["slice"]}
        for key, id in zip(keys.tolist(), ids.tolist()):
            found.setdefault(key, set()).add(id)
    assert found == _signed(texts)
    assert any(r["salt"] for r in packed)  # beyond the limit of a key
    n = sum(len(r["keys"]) for r in packed) // 8
    assert len(packed) < n / 3


def test_buckets(spark):
    texts = _texts()
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = rows.select("doc_id", "text", F.lit(0).cast("long").alias("tie"))
    kind = f"doc_id long, {ngram_join._PROFILE}"
    signed = rows.mapInArrow(ngram_join._profile_and_sign, f"{kind}, {ngram_join._SIGNED}")
    dealt = signed.repartition(3, "slice", "salt").sortWithinPartitions("slice", "salt")
    found = dealt.mapInArrow(ngram_join._buckets, f"{kind}, {ngram_join._FOUND}").collect()

    assert sorted(r["doc_id"] for r in found if r["large"] is None) == list(range(len(texts)))
    shared = {key: ids for key, ids in _signed(texts).items() if len(ids) > 1}
    got, centres = {}, {}
    for r in found:
        if r["large"] is not None:
            got.setdefault(r["key"], set()).add(r["id"])
            centres.setdefault(r["key"], set()).add((r["centre"], r["large"]))
    assert got == shared
    for key, ids in shared.items():
        if len(ids) <= 500:  # no key with salts
            assert centres[key] == {(min(ids), len(ids) > ngram_join.SMALL)}


def test_no_texts():
    assert list(ngram_join._buckets(iter([]))) == list(ngram_join._profile_and_sign(iter([]))) == []
    empty = list(ngram_join._buckets(ngram_join._profile_and_sign([_batch([None, ""])])))
    assert sum(map(len, empty)) == 2
