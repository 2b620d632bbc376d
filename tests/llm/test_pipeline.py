"""The pipeline, stage by stage, against brute force on a small corpus with planted rows."""

import collections
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline as pipeline
from tabbridge.llm import tokens

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path, sf = str(tmp_path_factory.mktemp("corpus")), "/root/testdata/sf0.001"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    long = docs.where("length(text) > 400").orderBy("doc_id").first()
    item = bench.where("length(text) > 80").orderBy("item_id").first()
    odd = [
        (10**6, None, "en", "web", 0), (10**6 + 1, "12 % 7", "en", "web", 6), (10**6 + 2, "", None, None, 0),
        (10**6 + 3, long.text, long.lang, "web", 1), (10**6 + 4, long.text + " end", long.lang, None, 1),
        (10**6 + 5, f"{long.text[:200]} {item.text} {long.text[200:]}", long.lang, "web", 1),
    ]
    docs.unionByName(spark.createDataFrame(odd, docs.schema)).write.parquet(f"{path}/documents.parquet")
    bench.write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    outputs = [docs]
    for n, (_, stage) in enumerate(pipeline.STAGES):
        path = f"{folder}/stage{n}"
        stage(spark, outputs[-1], folder).write.parquet(path)
        outputs.append(spark.read.parquet(path))
    assert all(o.columns == docs.columns for o in outputs[:-1])
    given, known, alone, clean, mixed, index = [o.collect() for o in outputs]

    # language: rows without a letter go, nearly all others stay
    kept = {r.doc_id for r in known}
    spoken = {r.doc_id for r in given if any(c.isalpha() for c in r.text or "")}
    assert kept <= spoken and len(kept) >= 0.98 * len(spoken) and len(known) == len(kept)

    # near duplicates: the smallest id of each group
    sets = {}
    for r in known:
        w = WORDS.findall(r.text.lower() if r.text.isascii() else "".join(c.lower() if c.isascii() else c for c in r.text))
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    least = {d: d for d in sets}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if 4 * small >= 3 * large and least[a] != least[b]:
                same = len(sets[a] & sets[b])
                if 100 * same >= 75 * (small + large - same):
                    low, high = sorted((least[a], least[b]))
                    least = {d: low if v == high else v for d, v in least.items()}
    assert sorted(r.doc_id for r in alone) == sorted(set(least.values()))

    # decontamination: no document with a window of an item
    words = lambda t: PLAIN.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
    windows = set()
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        w = words(r.text)
        n = min(10, len(w))
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1) if n}
    lengths = {len(w) for w in windows}
    hit = lambda w: any(tuple(w[k : k + n]) in windows for n in lengths for k in range(len(w) - n + 1))
    assert sorted(r.doc_id for r in clean) == sorted(r.doc_id for r in alone if not hit(words(r.text)))
    assert 10**6 + 5 not in {r.doc_id for r in clean}

    # mix: no document more than twice, each source near its target
    size = {r.doc_id: len(WORDS.findall(r.text or "")) for r in clean}
    source = {r.doc_id: r.source for r in clean}
    taken = collections.Counter(r.doc_id for r in mixed)
    assert set(taken) <= set(size) and max(taken.values()) <= 2
    total, got = collections.Counter(), collections.Counter()
    for d, n in size.items():
        total[source[d]] += n
        got[source[d]] += n * taken[d]
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    capped, more = set(), {None}
    while more:
        open_weight = sum(w for s, w in weight.items() if s not in capped)
        level = (1.5 * sum(total.values()) - sum(2 * total[s] for s in capped)) / max(1, open_weight)
        more = {s for s in names if s not in capped and weight[s] * level > 2 * total[s]}
        capped |= more
    for s in names:
        target = 2 * total[s] if s in capped else weight[s] * level
        assert abs(got[s] - target) <= 3 * max(size[d] for d in size if source[d] == s)

    # tokens: those of the mix, one after the other
    tokenizer = tokens._tokenizer(tokens.default_tokenizer())
    encode = lambda t: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
    want = [(r.doc_id, len(x), zlib.crc32(x.tobytes())) for r in mixed for x in [encode(r.text)]]
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in index) == sorted(want)
    starts = sorted((r.start, r.n_tokens) for r in index)
    assert [s for s, _ in starts] == list(np.cumsum([0, *[n for _, n in starts]])[:-1])

    # the whole run gives the rows of its stages
    assert sorted(map(tuple, pipeline.run(spark, folder).collect())) == sorted(map(tuple, index))
