"""Periodic runs against their definition, tried at every start and period."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tabbridge.llm import periodic
from tabbridge.llm.queries import QUERIES

COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def all_runs(words, shortest=6):
    """(start, length, period) by trying every period at every place."""
    n, best = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(shortest, 4 * q):
                best.setdefault((i, j + q - i), q)  # smaller periods came first
            i = j
    return sorted((s, length, q) for (s, length), q in best.items())


def collapsed(words, runs):
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    return [w for k, w in enumerate(words) if k not in gone]


def altered(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def digest(doc_id, text):
    words = altered(doc_id, (text or "").encode().split())
    runs = all_runs(words)
    sha = [hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()]
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return doc_id, len(runs), *(top or (None,) * 3), top and 1000 * top[1] // top[2], *sha


def random_words(rng):
    """Words of few kinds with repeated stretches, one inside the other, cut at odd places."""
    words = [rng.choice("abcdefgh"[: rng.randint(1, 8)]) for _ in range(rng.randint(0, 40))]
    for _ in range(rng.randint(0, 4)):
        piece = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
        tail = (piece * rng.randint(1, 9))[: rng.randint(1, 60)]
        at = rng.randint(0, len(words))
        words[at:at] = tail
    return words


def numbered(texts):
    return periodic._number([[w.encode() for w in words] for words in texts])


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_random_words(seed):
    rng = random.Random(seed)
    texts = [random_words(rng) for _ in range(250)]
    texts += [texts[3], texts[3], [], ["a"], list("aaaaaa"), list("abababab"), list("ab" * 3), ["a"] * 300]
    ids, bounds = numbered(texts)
    got = list(periodic.runs_of(ids, bounds))
    want = [(s + int(bounds[d]), n, q) for d, words in enumerate(texts) for s, n, q in all_runs(words)]
    assert got == sorted(want)


@pytest.mark.parametrize("before", [[], [[]], [[], []], [["a"]], [["a"], []], [["a", "a"]], [["b"] * 6]])
def test_run_at_the_first_word_of_a_text(before):
    ids, bounds = numbered([*before, ["a"] * 6, [], ["a"] * 6])
    at = int(bounds[len(before)])
    assert list(periodic.runs_of(ids, bounds))[-2:] == [(at, 6, 1), (at + 6, 6, 1)]


@pytest.mark.parametrize("rounds", [0, 1])
def test_setting_aside_less_changes_nothing(monkeypatch, rounds):
    rng = random.Random(21)
    ids, bounds = numbered([random_words(rng) for _ in range(200)])
    want = list(periodic.runs_of(ids, bounds))
    monkeypatch.setattr(periodic, "ROUNDS", rounds)
    assert list(periodic.runs_of(ids, bounds)) == want


def test_shortest_length_is_a_parameter():
    texts = [list("aaaa"), list("aaaaa"), list("xababababx")]
    ids, bounds = numbered(texts)
    assert list(periodic.runs_of(ids, bounds, 4)) == [(0, 4, 1), (4, 5, 1), (10, 8, 2)]
    assert list(periodic.runs_of(ids, bounds, 9)) == []


def test_pieces_leave_out_plain_words_and_keep_whole_runs():
    rng = random.Random(1)
    plain = [f"w{rng.randint(0, 400)}" for _ in range(3000)]
    words = plain[:1500] + ["x", "y", "z"] * 5 + plain[1500:]
    ids, bounds = numbered([words])
    spans = periodic.pieces(ids, bounds)
    assert sum(b - a for a, b in spans) < 100
    assert any(a < 1500 and b > 1515 for a, b in spans)


def test_suffix_order_and_common_prefixes():
    rng = random.Random(4)
    symbols = [rng.randint(0, 2) for _ in range(300)]
    order, rank = periodic.suffix_order(np.array(symbols))
    assert order.tolist() == sorted(range(300), key=lambda i: symbols[i:])
    lcp = periodic.common_prefixes(symbols, order.tolist(), rank.tolist())
    for k in range(1, 300):
        a, b = symbols[order[k - 1] :], symbols[order[k] :]
        same = 0
        while same < min(len(a), len(b)) and a[same] == b[same]:
            same += 1
        assert lcp[k] == same


def test_equal_pairs_are_not_enumerated():
    """One word 60,000 times: a run, found without its 10^9 pairs of places."""
    ids, bounds = numbered([["a"] * 60_000 + ["b"], ["c"] * 7])
    assert list(periodic.runs_of(ids, bounds)) == [(0, 60_000, 1), (60_001, 7, 1)]


def make(spark, rows, kind="long"):
    return spark.createDataFrame(rows, f"doc_id {kind}, text string, runs string, n_words string, collapsed int, period int")


def corpus():
    rng = random.Random(11)
    rows = []
    for k in range(400):
        blank = rng.choice([" ", "\n", "\t ", "  ", " \x0b"])
        rows.append((k, blank.join(random_words(rng)) + rng.choice(["", " ", "\n"]), "r", "n", 1, 2))
    rows += [(400, "", "", "", 0, 0), (401, None, None, None, None, None), (402, " \n\t", "", "", 0, 0), (None, "a a a a a a a", "", "", 0, 0)]
    return rows + [rows[5]] * 3 + [(k, "Zeile eins Zeile zwei " * 30, "", "", 0, 0) for k in range(500, 560)]


def test_digests_of_documents(spark):
    rows = corpus()
    got = periodic.run_digests(periodic.periodic_runs(make(spark, rows).repartition(4), change=periodic.repeat_tails))
    assert got.columns == COLUMNS
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(digest(r[0], r[1])) for r in rows)
    kinds = dict(got.dtypes)
    assert all(kinds[c] == "bigint" for c in COLUMNS[1:6])


def test_runs_and_collapsed_text(spark):
    (row,) = periodic.periodic_runs(make(spark, [(1, "so  la la la\tla la la\nna", "", "", 0, 0)])).collect()
    assert (row["n_words"], row["collapsed"]) == (8, "so la na")
    assert [tuple(r) for r in row["runs"]] == [(1, 6, 1)]


def test_long_text_in_blocks(spark):
    rng = random.Random(2)
    words = [f"wort{rng.randint(0, 9000)}" for _ in range(150_000)]
    words[40_000:40_000] = ["ein", "lied"] * 4000
    words += [f"k{i}" for i in range(700)] * 5
    text = " ".join(words)
    assert len(text) > 1 << 20
    got = periodic.periodic_runs(make(spark, [(1, text, "", "", 0, 0), (2, "a " * 50, "", "", 0, 0), (3, text, "", "", 0, 0)])).collect()
    runs = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in got}
    assert (40_000, 8000, 2) in runs[1] and (158_000, 3500, 700) in runs[1] and runs[1] == runs[3]
    assert runs[2] == [(0, 50, 1)]


def test_empty_table(spark):
    assert periodic.run_digests(periodic.periodic_runs(make(spark, []))).collect() == []


def test_shortest_is_checked(spark):
    with pytest.raises(ValueError):
        periodic.periodic_runs(make(spark, []), shortest=3)


def test_query_on_all_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op11_periodic_runs"](spark, sf).select(COLUMNS).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(digest(*r)) for r in docs)
