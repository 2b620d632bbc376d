"""What operators take to the driver is bounded also where rows repeat, and holds whole documents."""

import numpy as np
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from tabbridge.llm import language


@pytest.fixture
def collected(monkeypatch):
    """Numbers of rows that ``collect`` took to the driver."""
    sizes, collect = [], DataFrame.collect

    def counted(self):
        rows = collect(self)
        sizes.append(len(rows))
        return rows

    monkeypatch.setattr(DataFrame, "collect", counted)
    return sizes


def test_language_sample_holds_a_repeated_row_once(spark, collected):
    rows = [(1, "das ist ein deutscher text", "de")] * 300
    rows += [(i, f"ein anderer text {chr(97 + i)}", "de") for i in range(2, 12)]
    rows += [(i, f"this is some english text {chr(97 + i - 20)}", "en") for i in range(20, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = language.learn(docs, 20, 100, language.FAMILIES)
    assert max(collected) == 21  # the different texts
    assert model.predict(np.zeros((1, language.WIDTH), np.float32))[0][0] in ("de", "en")
