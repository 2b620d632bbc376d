"""A pipeline stage leaves ids and plans in the shared folder, not the texts that its rows take from their table."""

import random
from pathlib import Path

import pytest

from tabbridge.llm import language, mixing, ngram_join

COMMON = {"en": "the and of to in is that it was for".split(), "de": "der und die das ist nicht ein zu mit auf".split()}


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        lang = "en" if i % 2 else "de"
        words = [rng.choice(COMMON[lang]) if rng.random() < 0.6 else "".join(rng.choices("abcdefghiklmnoprstuvw", k=8)) for _ in range(600)]
        rows.append((i, " ".join(words), lang, f"s{i % 3}"))
    path = str(tmp_path_factory.mktemp("docs") / "d")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(2).write.parquet(path)
    return spark.read.parquet(path), path


def _bytes(folder):
    return sum(f.stat().st_size for f in Path(folder.removeprefix("file:")).rglob("*.parquet"))


@pytest.mark.parametrize("stage", [language.keep_known, ngram_join.keep_one_of_each, mixing.mix])
def test_texts_are_not_staged(spark, docs, stage):
    rows, path = docs
    shared = spark.conf.get("spark.checkpoint.dir")
    before = _bytes(shared)
    kept = stage(rows)
    assert _bytes(shared) - before < _bytes(path) / 10
    assert kept.columns == rows.columns and kept.count() > 200
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, kept.collect()))
