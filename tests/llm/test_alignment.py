"""Alignment of two tokenizers against a plain walk over the bytes of each text."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tabbridge.llm import alignment
from tabbridge.llm.queries import QUERIES

PATHS = alignment.default_tokenizers()
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    """Both libraries used directly: (ids, bytes of each token) of a text."""
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.decoders import ByteLevel

    first = Tokenizer.from_file(PATHS[0])
    first.encode_special_tokens = True
    characters = [c for c in ByteLevel.alphabet()] if hasattr(ByteLevel, "alphabet") else None
    second = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    table = {}
    shift = 0
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte <= 255:
            table[chr(byte)] = byte
        else:
            table[chr(256 + shift)] = byte
            shift += 1
    assert characters is None or set(characters) == set(table)

    def a(text):
        ids = first.encode(" " + text, add_special_tokens=False).ids
        return ids, [bytes(table[c] for c in first.id_to_token(i)) for i in ids]

    def b(text):
        ids = second.encode(text)
        pieces = [second.id_to_piece(i) for i in ids]
        return ids, [bytes.fromhex(p[3:5]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, pieces)]

    return a, b


def brute(rows, libraries):
    docs = []
    for doc_id, text in rows:
        if not text:
            docs.append((doc_id, [], [], []))
            continue
        (a, a_bytes), (b, b_bytes) = (side(text) for side in libraries)
        if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            docs.append((doc_id, [], [], []))
            continue
        ends = [[len(b"".join(x[: k + 1])) for k in range(len(x))] for x in (a_bytes, b_bytes)]
        groups, ga, gb, j = [], [], [], 0
        for k, end in enumerate(ends[0]):
            ga.append(a[k])
            while j < len(b) and ends[1][j] <= end:
                gb.append(b[j])
                j += 1
            if j and ends[1][j - 1] == end:
                groups.append((ga, gb))
                ga, gb = [], []
        docs.append((doc_id, a, b, groups))
    counts = Counter((ga[-1], gb[-1]) for *_, groups in docs for ga, gb in groups)
    highest = {}
    for (_, b), n in counts.items():
        highest[b] = max(n, highest.get(b, 0))
    out = []
    for doc_id, a, b, groups in docs:
        links = [(ga[-1], gb[-1]) for ga, gb in groups]
        text = ";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in groups)
        best = sum(counts[x] == highest[x[1]] for x in links)
        sha = hashlib.sha256(text.encode()).hexdigest() if a else ""
        out.append((doc_id, len(a), len(b), len(groups), len(links), best, sum(counts[x] for x in links), sha))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(17)
    parts = ["the ", "Straße", " naïve", "日本語", "\n\n", "\t", "   ", "1234567", "<|endoftext|>", "<s>", "</s>", "<0x41>", "unbelievable", "é", "🙂", "%%%", ".", "a", " ", "\u0000", "　", "ﬁ"]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randint(1, 30)))) for k in range(150)]
    rows += [(200, None), (201, ""), (202, " "), (203, "\n"), (204, "with ▁ inside"), (205, " lead"), (206, "trail  "), (None, "no id")]
    return rows + [(k, "The same words are here many times.") for k in range(300, 380)] + [rows[4]] * 5


def test_overlaps_of_pieces_of_any_size():
    rng = random.Random(3)
    for _ in range(200):
        a, b = (np.array(sorted(rng.sample(range(60), rng.randint(0, 40))), np.int64) for _ in range(2))
        both = sorted(set(a.tolist()) & set(b.tolist()))
        for piece in (1, 2, 3, 7, 1000):
            i, j = alignment.overlaps(a, b, piece)
            assert a[i].tolist() == b[j].tolist() == both


def test_pieces_are_of_equal_work():
    rng = np.random.default_rng(5)
    a, b = (np.unique(rng.integers(0, 10**6, n)) for n in (40_000, 900))
    i, j = alignment.diagonal_cuts(a, b, 1000)
    work = np.diff(i + j)
    assert work.max() <= 1001 and i[-1] == len(a) and j[-1] == len(b)
    merged = np.sort(np.concatenate([a, b]))
    for k in range(len(i) - 1):
        own = np.sort(np.concatenate([a[i[k] : i[k + 1]], b[j[k] : j[k + 1]]]))
        assert own.tolist() == merged[i[k] + j[k] : i[k + 1] + j[k + 1]].tolist()


def test_every_link_is_a_possible_one(libraries):
    possible = alignment.possible_links(*PATHS)
    assert len(possible) < 1_000_000 and (np.diff(possible) > 0).all()
    known = set(possible.tolist())
    found = alignment.aligned_block(*sides(), [text for _, text in corpus()])
    links = found.a_ids[found.a_at] << 32 | found.b_ids[found.b_at]
    assert len(links) and set(links.tolist()) <= known


def sides():
    return alignment.byte_side(PATHS[0]), alignment.piece_side(PATHS[1])


def test_ranks_give_the_ids_of_the_file():
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(PATHS[0])
    first.encode_special_tokens = True
    rng = random.Random(23)
    parts = ["a", "word", " ", "  ", "\n", "\t", "\u00a0", "\u2028", "\x1c", "\x85", "é", "'s", "'S", "12", "%", "日本", "▁", "　", "\x00", "🙂", "²", "½", "ǅ", "\u0301"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(5000)]
    texts += [" " * 5000 + "x", "\n" * 499, "\n" * 3000, "a" * 30_000, "^" * 30_000, "日" * 9000, "<|endoftext|>"]
    for text, ids in zip(texts, sides()[0].encode(texts)):
        assert ids == first.encode(" " + text, add_special_tokens=False).ids, text


def test_files_with_other_merges_keep_their_library(tmp_path):
    import json

    told = json.load(open(PATHS[0]))
    told["model"]["merges"][:2] = told["model"]["merges"][1::-1]
    path = tmp_path / "other.json"
    path.write_text(json.dumps(told))
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(str(path))
    assert alignment._ranked(other, alignment.byte_side(str(path)).tokens) is None
    assert alignment.byte_side(str(path)).encode(["the tea at that"]) == [other.encode(" the tea at that", add_special_tokens=False).ids]


def make(spark, rows):
    more = [(i, t, "x", "y", 1, [2]) for i, t in rows]
    return spark.createDataFrame(more, "doc_id long, text string, a_ids string, n string, b_id int, b_cuts array<int>")


def test_digests_of_documents(spark, libraries):
    got = alignment.alignment_digests(make(spark, corpus()).repartition(3))
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == brute(corpus(), libraries)


def test_groups_give_back_the_text(spark):
    rows = [r for r in corpus() if r[1]]
    texts = dict((r["doc_id"], r) for r in alignment.align(make(spark, rows)).collect())
    for doc_id, text in rows:
        row = texts[doc_id]
        if not row["a_ids"]:
            assert "▁" in text
            continue
        for ids, cuts, tokens in (("a_ids", "a_cuts", sides()[0].tokens), ("b_ids", "b_cuts", sides()[1].tokens)):
            assert b"".join(tokens[i] for i in row[ids]) == (" " + text).encode() and row[cuts][-1] == len(row[ids])


def test_text_above_a_megabyte(spark, libraries):
    long = "Ein langer Text mit 12345 Zahlen und naïve words. " * 24_000
    assert len(long) > 1 << 20
    rows = [(1, long), (2, "kurz"), (3, long[:5000])]
    got = {r["doc_id"]: r for r in alignment.alignment_digests(make(spark, rows)).collect()}
    own = [side(long) for side in libraries]
    ends = [set(np.cumsum([len(t) for t in tokens]).tolist()) for _, tokens in own]
    assert (got[1]["n_a"], got[1]["n_b"], got[1]["n_groups"]) == (len(own[0][0]), len(own[1][0]), len(ends[0] & ends[1]))


def test_empty_table(spark):
    assert alignment.alignment_digests(make(spark, [])).collect() == []


def test_query_on_all_documents(spark, sf, libraries):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op12_merge_path_alignment"](spark, sf).select(COLUMNS).collect()
    numbers = {r["doc_id"]: r for r in got}
    assert len(numbers) == len(docs) and sum(r["n_links"] for r in got) > 0
    assert sorted(map(tuple, got), key=str) == walk(docs, libraries)


def walk(rows, libraries):
    docs = []
    for doc_id, text in rows:
        (a, a_bytes), (b, b_bytes) = (side(text) if text else ([], []) for side in libraries)
        if not text or not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            docs.append((doc_id, [], [], [], []))
            continue
        ends = [np.cumsum([len(t) for t in x]).tolist() for x in (a_bytes, b_bytes)]
        at = [{end: k + 1 for k, end in enumerate(x)} for x in ends]
        both = sorted(set(at[0]) & set(at[1]))
        docs.append((doc_id, a, b, [at[0][e] for e in both], [at[1][e] for e in both]))
    counts = Counter((a[i - 1], b[j - 1]) for _, a, b, ca, cb in docs for i, j in zip(ca, cb))
    highest = {}
    for (_, b), n in counts.items():
        highest[b] = max(n, highest.get(b, 0))
    out = []
    for doc_id, a, b, ca, cb in docs:
        links = [(a[i - 1], b[j - 1]) for i, j in zip(ca, cb)]
        text = ";".join(
            f"{','.join(map(str, a[i0:i1]))}|{','.join(map(str, b[j0:j1]))}" for i0, i1, j0, j1 in zip([0, *ca], ca, [0, *cb], cb)
        )
        sha = hashlib.sha256(text.encode()).hexdigest() if a else ""
        best = sum(counts[x] == highest[x[1]] for x in links)
        out.append((doc_id, len(a), len(b), len(links), len(links), best, sum(counts[x] for x in links), sha))
    return sorted(out, key=str)
