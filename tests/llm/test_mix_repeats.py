"""Repeated rows are rounded one by one, so a source still meets its target."""

import random
from collections import Counter

import pytest

from tabbridge.llm import mixing
from tabbridge.llm.staging import scratch


def words(n):
    return " ".join(["w"] * n)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_a_third_of_the_rows_equal(spark, seed):
    rng = random.Random(4)
    rows = [(7, words(100), "b")] * 400 + [(1000 + i, words(rng.randint(20, 150)), "b") for i in range(200)]
    rows += [(None, words(80), "a")] * 150 + [(5000 + i, words(60), "c") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    with scratch(spark, "test") as tables:
        sized, sources = mixing.plan_mix(docs, tables, seed=seed)
        got = mixing.copies(sized, sources, seed=seed).collect()
    taken, largest = Counter(), Counter()
    for r in got:
        taken[r["source"]] += r["copies"] * r["size"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert 0 <= r["copies"] <= 2
    targets = {r["source"]: r["target"] for r in got}
    for source, target in targets.items():
        assert abs(taken[source] - target) <= largest[source], source
    mixed = Counter()
    for r in mixing.mix(docs, seed=seed).collect():
        mixed[r["source"]] += len(r["text"].split())
    assert mixed == taken


def test_numbers_of_repeated_rows(spark):
    rows = [(1, 5)] * 300 + [(None, 5)] * 40 + [(1, 6), (2, 5), (None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, size long").repartition(7)
    with scratch(spark, "test") as tables:
        got = mixing.number_repeats(tables.put(docs), tables).collect()
    numbers = {}
    for r in got:
        numbers.setdefault((r["doc_id"], r["size"]), []).append(r["repeat"])
    assert {k: sorted(v) for k, v in numbers.items()} == {
        (1, 5): list(range(300)), (None, 5): list(range(40)), (1, 6): [0], (2, 5): [0], (None, 7): [0]
    }


def test_no_repeats_no_numbers(spark):
    with scratch(spark, "test") as tables:
        got = mixing.number_repeats(spark.range(9).selectExpr("id AS doc_id", "id * 2 AS size"), tables)
        assert {r["repeat"] for r in got.collect()} == {0}


def test_a_mix_that_does_not_converge_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "_LIMIT", 1)
    docs = spark.createDataFrame([(i, words(i % 90 + 1), "ab"[i % 2]) for i in range(300)], "doc_id long, text string, source string")
    with pytest.raises(RuntimeError, match="not converged"):
        mixing.mix(docs)
