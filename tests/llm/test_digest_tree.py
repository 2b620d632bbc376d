"""Exact dedup by a tree of runs, against plain Python."""

import hashlib
import random
from collections import defaultdict

import pytest

from tabbridge.llm.digest_tree import equal_texts

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, largest=True):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(FOLD)].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = (max if largest else min)(known) if known else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        first = True
        for i in ids:
            out.append((i, best, len(ids), i == best and first, sha))
            first = first and i != best
    return sorted(out, key=str)


def found(spark, rows, parts=7, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return sorted(map(tuple, equal_texts(docs, **options).collect()), key=str)


def some_rows(seed=5, n=600):
    rng = random.Random(seed)
    words = ["Ab", "aB", "ÄÖ", "äö", "x" * 50, "", "ß", "SS", "K", "k"]
    rows = [(i, rng.choice(words) + rng.choice(words)) for i in range(n)]
    rows += [(n + i, "THE SAME TEXT" if i % 2 else "the same text") for i in range(n // 2)]  # a third of all
    rows += [(None, "the same text"), (None, None), (None, "only without an id"), (3 * n, None), (3 * n, ""), (5, "ab")]
    return rows + [rows[7]] * 20


@pytest.mark.parametrize("fan", [2, 3, 16])
def test_largest_id_of_equal_texts_stays(spark, fan):
    rows = some_rows()
    assert found(spark, rows, parts=9, fan=fan) == brute(rows)


def test_smallest_id_of_equal_texts_stays(spark):
    rows = some_rows(seed=6, n=90)
    assert found(spark, rows, keep="smallest") == brute(rows, largest=False)


def test_one_run_needs_no_round(spark):
    rows = some_rows(seed=8, n=40)
    assert found(spark, rows, parts=1) == brute(rows)


def test_text_above_a_megabyte(spark):
    long = "Wort " * 400_000
    rows = [(1, long), (2, long.upper()), (3, long + "x"), (4, long)]
    assert found(spark, rows, parts=4) == brute(rows)


def test_texts_with_one_digest_stay_apart(spark, monkeypatch):
    """Runs are ordered by a short digest; the merge proves equality by SHA-256 and length."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(F, "xxhash64", lambda *_: F.lit(1).cast("long"))
    rows = some_rows(seed=9, n=60)
    assert found(spark, rows) == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    assert found(spark, []) == []
    rows = [(1, "a"), (2, "A"), (3, "b")]
    docs = spark.createDataFrame([(i, t, "x", 0, 0, b"", "y") for i, t in rows], "doc_id long, text string, run string, row int, digest int, sha binary, best string")
    assert sorted(map(tuple, equal_texts(docs).collect()), key=str) == brute(rows)


def test_arguments_are_checked(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    with pytest.raises(ValueError):
        equal_texts(docs, keep="first")
    with pytest.raises(ValueError):
        equal_texts(docs, fan=1)


def test_identifiers_may_be_text(spark):
    docs = spark.createDataFrame([("b", "x"), ("a", "X"), (None, "x")], "doc_id string, text string")
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in equal_texts(docs).collect()} == {("b", "b", True), ("a", "b", False), (None, "b", False)}
