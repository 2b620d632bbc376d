"""Every operator against a brute-force version on small tables with odd rows."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import types as T

from check_queries import compare, connect
from tabbridge.llm import decontamination, language, mixing, neighbours, ngram_join, passages, quality, sharding, tokens, urls
from tabbridge.llm.queries import ORACLES
from tabbridge.llm.staging import scratch

BLANK_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
        # names that the operators use inside
        T.StructField("key", T.StringType()), T.StructField("size", T.StringType()), T.StructField("row", T.StringType()),
    ]
)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def corpus():
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdeéß"), rng.integers(2, 7)))
    texts = [" ".join(word() for _ in range(n)) for n in (3, 5, 6, 40, 80, 120, 200, 400, 3000)]
    base = texts[7].split(" ")
    for k in range(25):  # a group of near copies
        copy = list(base)
        for at in rng.integers(0, len(copy), 1 + k % 9):
            copy[at] = word()
        texts.append(" ".join(copy))
    passage = " ".join(word() for _ in range(50))
    texts += [f"{' '.join(word() for _ in range(n))} {passage} {' '.join(word() for _ in range(n))}" for n in (4, 9, 9, 30, 60)]
    texts += [texts[4]] * 12 + [f"{texts[3]}\n\n {texts[3]}  ", "", " \t\n", None, None, "Ab c", "aB  c", "12 %% 7"]
    return texts


def frame(spark, texts):
    rows = [(i, t, "xy"[i % 2], [None, "s1", "s2", ""][i % 4], None, "k", "big", "r") for i, t in enumerate(texts)]
    rows += [(None, "no id here at all but words", None, None, 1, "k", "s", "r"), rows[3], rows[3]]
    return spark.createDataFrame(rows, DOCS).repartition(5), rows


@pytest.fixture(scope="module")
def docs(spark):
    df, rows = frame(spark, corpus())
    with scratch(spark, "test") as tables:
        yield tables.put(df), rows


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf, name):
    assert compare(spark, connect(sf), sf, name) is None


def test_ngram_join_finds_every_link(docs):
    df, rows = docs
    sets = []
    for row in rows:
        words = BLANK_WORDS.findall(lower(row[1] or ""))
        runs = [tuple(words[k : k + 5]) for k in range(len(words) - 4)] or ([tuple(words)] if words else [])
        sets.append(set(runs))
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            same = len(sets[a] & sets[b])
            if same and 100 * same >= 75 * (len(sets[a]) + len(sets[b]) - same):
                group = [group[b] if g == group[a] else g for g in group]
    ids = collections.defaultdict(list)
    for row, g in zip(rows, group):
        ids[g].append(row[0])
    least = [min((x for x in ids[g] if x is not None), default=None) for g in group]
    want = sorted((str(r[0]), len(s), str(c)) for r, s, c in zip(rows, sets, least))
    got = sorted((str(r[0]), r[1], str(r[2])) for r in ngram_join.ngram_join(df).collect())
    assert got == want
    kept = ngram_join.keep_one_of_each(df)
    assert kept.columns == df.columns
    empties = sum(not s for s in sets)
    assert kept.count() == len({g for g, s in zip(group, sets) if s}) + empties


def test_passages(docs):
    df, rows = docs
    words = [BLANK_WORDS.findall(r[1] or "") for r in rows]
    count = collections.Counter(tuple(w[k : k + 35]) for w in words for k in range(len(w) - 34))
    want = []
    for row, w in zip(rows, words):
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if count[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        kept = [x for x, g in zip(w, gone) if not g]
        want.append((str(row[0]), len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    got = [(str(r[0]), r[1], r[2], r[3]) for r in passages.remove_repeated_passages(df).collect()]
    assert sorted(got) == sorted(want)


def test_decontamination(spark, docs):
    df, rows = docs
    items = [(7, rows[8][1][:400]), (8, "Ab C"), (9, None), (10, "..."), (11, rows[8][1][200:900]), (None, "ab, c"), (8, "12-7")]
    windows = set()
    for item, text in items:
        w = PLAIN_WORDS.findall(lower(text or ""))
        n = min(10, len(w))
        windows |= {("" if item is None else str(item), tuple(w[k : k + n])) for k in range(len(w) - n + 1) if n}
    want = []
    for row in rows:
        w = PLAIN_WORDS.findall(lower(row[1] or ""))
        hit, names = set(), set()
        for item, window in windows:
            for k in range(len(w) - len(window) + 1):
                if tuple(w[k : k + len(window)]) == window:
                    hit |= set(range(k, k + len(window)))
                    names.add(item)
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        want.append((str(row[0]), len(w), len(hit), len(names), digest, bool(hit)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contamination(df, bench).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)
    clean = decontamination.clean_documents(df, bench)
    assert clean.columns == df.columns and clean.count() == sum(not w[-1] for w in want)
    assert decontamination.contamination(df, bench.limit(0)).where("contaminated").count() == 0


def test_mix(spark, docs):
    df, rows = docs
    with scratch(spark, "test") as tables:
        sized, sources = mixing.plan_mix(df, tables)
        got = mixing.copies(sized, sources).collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(BLANK_WORDS.findall(r[1] or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    capped, goal = set(), 1.5 * sum(sizes.values())
    while True:
        level = (goal - sum(2 * sizes[s] for s in capped)) / max(1, sum(weight[s] for s in names if s not in capped))
        more = {s for s in names if s not in capped and weight[s] * level > 2 * sizes[s]}
        if not more:
            break
        capped |= more
    taken, largest = collections.Counter(), collections.Counter()
    for r in got:
        assert 0 <= r.copies <= 2 and 0 <= r.rate <= 2
        taken[r.source] += r.copies * r.size
        largest[r.source] = max(largest[r.source], r.size)
        assert r.target == pytest.approx(2 * sizes[r.source] if r.source in capped else weight[r.source] * level)
    targets = {r.source: r.target for r in got}
    assert all(abs(taken[s] - t) <= 3 * largest[s] for s, t in targets.items())
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in got)


def test_shards(docs):
    df, rows = docs
    got = sharding.shard_documents(df, 7).collect()
    assert len(got) == len(rows)
    assert sorted((str(r.doc_id), r.size, str(r.text_crc32)) for r in got) == sorted(
        (str(r[0]), len((r[1] or "").encode()) + 16, str(None if r[1] is None else zlib.crc32(r[1].encode()))) for r in rows
    )
    by_shard = collections.defaultdict(list)
    for r in got:
        by_shard[r.shard].append(r)
    assert all(sorted(r.slot for r in rs) == list(range(len(rs))) for rs in by_shard.values())
    sizes = [sum(r.size for r in by_shard[k]) for k in range(7)]
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in got)


def test_urls(spark):
    pages = [
        (1, "http://A.Example.com/de/x9?q", "example.com/de/", "block"), (2, "https://m.a.net", None, None),
        (3, "http://b.example.net/en/1", "example.net/en/", "allow"), (4, "ftp://x.net/q", "net/", "block"), (5, None, None, None),
        (6, "no scheme/net/", None, None), (7, "http://www.z.org/fr/", "org/fr/", "allow"), (8, "http://notnet/", None, None),
        (8, "http://notnet/", None, None),
    ]
    got = urls.judge_urls(spark.createDataFrame([p[:2] for p in pages], "page_id long, url string")).collect()
    assert sorted((r.page_id, str(r.rule)) for r in got) == sorted((p[0], str(p[2])) for p in pages)
    assert all(r.verdict == p[3] for r in got for p in pages if p[0] == r.page_id and p[3])
    assert {r.verdict for r in got} == {"block", "allow"}
    hosts = {r.page_id: (r.host, r.path) for r in got}
    assert hosts[1] == ("a.example.com", "/de/x9") and hosts[2] == ("m.a.net", "") and hosts[5] == ("", "")


def test_urls_reject_a_template(spark):
    rows = [(i, f"http://h.org/ad/{i}") for i in range(40)] + [(100 + i, f"http://h.org/news/{i}") for i in range(40)]
    rules = [urls.Rule("block", "org/ad/1"), urls.Rule("block", "org/ad/2"), urls.Rule("allow", "org/news/1")]
    got = urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()
    assert {r.verdict for r in got if r.page_id < 100} == {"block"}
    assert {r.verdict for r in got if r.page_id >= 100} == {"allow"}


def test_urls_test_every_labelled_child(spark):
    names = [f"{a}{b}" for a in "klmnopqrst" for b in "abcdefgh"]  # 80, all more frequent than /de
    rows = [(k * 100 + i, f"http://h.org/{name}/{i}") for k, name in enumerate(names) for i in range(12)]
    rows += [(10_000 + i, f"http://h.org/de/{i}") for i in range(10)]
    got = urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), [urls.Rule("block", "org/de/")]).collect()
    assert len(got) == len(rows)
    assert {(r.template, r.verdict) for r in got if r.page_id >= 10_000} == {("/de/*", "block")}
    assert {(r.template, r.verdict) for r in got if r.page_id < 10_000} == {("/*/*", "allow")}


def test_top_k_with_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(120)]
    rows += [(200, rows[3][1]), (201, rows[3][1]), (250, rows[3][1]), (300, None), (350, [1.0, float("nan")] * 4), (400, [None] * 8), (None, rows[1][1])]
    got = neighbours.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    whole = {i: np.floor(256 * np.array(v)).astype(int) for i, v in rows[:123]}
    want = []
    for q in (x for x in whole if x % 50 == 0):
        order = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(order)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_tokens_read_back(docs):
    df, rows = docs
    got = tokens.tokenize_documents(df).collect()
    tokenizer = tokens._tokenizer(tokens.default_tokenizer())
    encode = lambda t: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
    want = sorted((str(r[0]), len(encode(r[1])), zlib.crc32(encode(r[1]).tobytes())) for r in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == want
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start) if r.doc_id is not None]
    assert ids == sorted(ids)


@pytest.mark.parametrize("text", ["  a  b", " a", "a ", "a\n b", "a \n", "\n", "a\n\nb c", "it's 12 don't <|endoftext|> x", "é ß  c", "  "])
def test_pieces_give_the_same_ids(text):
    path = tokens.default_tokenizer()
    assert tokens.encode_texts([text], path) == [tokens._encode(tokens._tokenizer(path), text).tobytes()]


SPECIAL = ["see <|endoftext|> here", "<|endoftext|>", "a<|endoftext|>b c", "<|endoftext|> <|endoftext|><|endoftext|> x", "a\n<|endoftext|>\nb <|end oftext|> é", " <|endoftext|> ", "x  <|endoftext|>  y"]


def test_tokens_are_those_of_the_file(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.default_tokenizer())
    encode = lambda t: np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4")
    assert encode(SPECIAL[0]).tolist() == [3826, 220, 50256, 994]
    assert tokens.encode_texts(SPECIAL, tokens.default_tokenizer()) == [encode(t).tobytes() for t in SPECIAL]
    got = tokens.tokenize_documents(spark.createDataFrame(list(enumerate(SPECIAL)), "doc_id long, text string")).collect()
    want = [(i, len(encode(t)) + 1, zlib.crc32(encode(t).tobytes() + bytes(4))) for i, t in enumerate(SPECIAL)]
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want


def test_language_of_held_out_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([Row(doc_id=-1, text=None), Row(doc_id=-2, text="12 %"), Row(doc_id=-3, text="")])
    got = language.identify(docs.unionByName(odd, allowMissingColumns=True)).join(docs.select("doc_id", "lang"), "doc_id", "left").collect()
    held = [r for r in got if r.held_out and r.doc_id >= 0]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id < 0)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_quality_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    odd = spark.createDataFrame([Row(doc_id=-1, text=None), Row(doc_id=-2, text="")])
    got = quality.score_quality(docs.unionByName(odd, allowMissingColumns=True), labels).collect()
    label = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in got if r.held_out and r.doc_id in label]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert sum(label[r.doc_id] == r.predicted for r in held) >= 0.93 * len(held)


def test_empty_tables(spark, empty):
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert ngram_join.ngram_join(empty).count() == 0
    assert passages.remove_repeated_passages(empty).count() == 0
    assert decontamination.contamination(empty, bench).count() == 0
    assert mixing.mix(empty).count() == 0
    assert sharding.shard_documents(empty).count() == 0
    assert tokens.tokenize_documents(empty).count() == 0
    assert language.identify(empty).count() == 0
    assert quality.score_quality(empty, nothing).count() == 0
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert neighbours.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
