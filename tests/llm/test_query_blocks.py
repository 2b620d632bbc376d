"""Blocks of queries are bounded whatever the ids, and empty vectors are vectors."""

import numpy as np
from pyspark.sql.classic.dataframe import DataFrame

from tabbridge.llm import neighbours


def _top(rows, k=5):
    found = {}
    for q, a in rows:
        if q % 50 == 0:
            found.setdefault(q, []).extend(
                (-int(np.floor(256 * np.array(a)) @ np.floor(256 * np.array(b))), x) for x, b in rows if x != q and len(a) == len(b)
            )
    return [(q, n + 1, x, -s) for q, best in found.items() for n, (s, x) in enumerate(sorted(best)[:k])]


def test_one_id_in_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    vector = lambda: [float(x) for x in rng.normal(size=6).astype(np.float32)]
    same = vector()
    rows = [(50, vector()) for _ in range(200)] + [(100, same)] * 90 + [(i, vector()) for i in range(1, 180, 3)]
    sizes, collect = [], DataFrame.collect
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    with monkeypatch.context() as patched:
        patched.setattr(DataFrame, "collect", lambda self: (got := collect(self), sizes.append(len(got)))[0])
        top = neighbours.top_k(df, query_block=32)
    assert max(sizes) <= 32
    assert sorted(tuple(r) for r in top.collect()) == sorted(_top(rows))


def test_empty_vectors(spark):
    rows = [(50, []), (51, []), (100, [1.0, 2.0]), (7, [3.0, 1.0]), (150, [])]
    got = neighbours.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted(tuple(r) for r in got) == sorted(_top(rows))
