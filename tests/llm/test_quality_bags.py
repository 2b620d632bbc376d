"""Learning sees whole documents."""

import numpy as np
import pytest

from tabbridge.llm import quality
from tabbridge.llm.quality import PASSAGE


@pytest.mark.parametrize(("options", "want"), [({}, [10, 10, 200]), ({"passage_budget": 100}, [10, 10])])
def test_every_passage_is_learned_from(spark, monkeypatch, options, want):
    seen = []
    monkeypatch.setattr(quality.Attention, "fit", lambda self, x, doc, label, steps: seen.extend(np.bincount(doc).tolist()))
    sizes = [(1, 200), (2, 10), (3, 10)]
    docs = [(i, f"w{i} " * (n * PASSAGE)) for i, n in sizes] + [(2, "w2 " * (10 * PASSAGE))] * 50
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in sizes], "doc_id long, quality int, toxic int")
    quality.score_quality(spark.createDataFrame(docs, "doc_id long, text string"), labels, folds=1, fold=1, steps=1, **options)
    assert sorted(seen) == want
