import json

import pytest
from pyspark.errors import PySparkException

from tabbridge.operators.reshape import (
    columns_to_rows,
    columns_to_rows_long,
    columns_to_table,
    documents_to_rows,
    json_to_columns,
)


def document_rows(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, doc string")
    out = documents_to_rows(df, "doc", ["n"]).orderBy("n", "pos").collect()
    return [json.loads(r["row"]) for r in out]


@pytest.mark.parametrize(
    ("texts", "want"),
    [
        (["  "], []),
        (
            ['{"trips":[{"from":"Oslo","km":12.5},{"from":"Bergen","km":0},{"from":null,"km":-3}]}'],
            [
                {"trips": {"from": "Oslo", "km": 12.5}},
                {"trips": {"from": "Bergen", "km": 0}},
                {"trips": {"from": None, "km": -3}},
            ],
        ),
        (
            ['{"sensor": ["north", "south"], "reading": [[1, 2], []], "site": [{"lat":60.1,"tags":["a"]},{"lat":59.9}]}'],
            [
                {"sensor": "north", "reading": [1, 2], "site": {"lat": 60.1, "tags": ["a"]}},
                {"sensor": "south", "reading": [], "site": {"lat": 59.9}},
            ],
        ),
        (
            ['[{"ship":"Fram","crew":13},{"ship":"Maud"},{"ship":"Belgica","crew":null}]'],
            [{"ship": "Fram", "crew": 13}, {"ship": "Maud"}, {"ship": "Belgica", "crew": None}],
        ),
        (['{"weather":"rain until noon"}'], []),
        (
            ['{"lap":[{"runner":7,"sec":58}]}', "", '{"lap":[{"runner":9,"sec":61},{"runner":4,"sec":63}]}'],
            [{"lap": {"runner": 7, "sec": 58}}, {"lap": {"runner": 9, "sec": 61}}, {"lap": {"runner": 4, "sec": 63}}],
        ),
        (['{"a":[1,2,3],"b":["x"]}'], [{"a": 1, "b": "x"}, {"a": 2}, {"a": 3}]),
        (['{"a":"[1, {\\"b\\": 2}]","c":5}'], [{"a": 1}, {"a": {"b": 2}}]),
        (['{"a":[1,null],"c":true}'], [{"a": 1}, {"a": None}]),
        (['{"a":"[broken]"}'], []),
        (["{}"], []),
        (["[]"], []),
        (['{"a":[]}'], []),
        (['{"q\\"uote":["a\\nb"]}'], [{'q"uote': "a\nb"}]),
    ],
)
def test_documents(spark, texts, want):
    assert document_rows(spark, texts) == want


@pytest.mark.parametrize("bad", ["{invalid json}", "5", '"text"', "[1, 2]"])
def test_bad_documents_fail(spark, bad):
    with pytest.raises(PySparkException, match="cannot parse JSON"):
        document_rows(spark, ['[{"a":1}]', bad])


COLUMN_DOCS = [
    ("j", '{"id":{"value":[1,2,3],"party_id":"p","party_name":"P","asset_name":"A","item_idx":1}}'),
    ("j", '{"name":{"value":["x","y"],"item_idx":0},"o":{"value":[{"b":1,"a":[2]}],"party_name":"P","item_idx":2}}'),
    ("k", '{"id":{"value":[9],"item_idx":0}}'),
]


@pytest.fixture(scope="module")
def column_docs(spark):
    return spark.createDataFrame(COLUMN_DOCS, "job string, doc string")


def test_columns_to_rows(column_docs):
    got = columns_to_rows(column_docs, "doc", ["job"]).orderBy("job", "pos").collect()
    assert [(r["job"], r["pos"], r["row"]) for r in got] == [
        ("j", 0, '{"name":"x","P.A.id":1,"o":{"a":[2],"b":1}}'),
        ("j", 1, '{"name":"y","P.A.id":2}'),
        ("j", 2, '{"P.A.id":3}'),
        ("k", 0, '{"id":9}'),
    ]


def test_columns_long_and_wide(column_docs):
    long = columns_to_rows_long(column_docs, "doc", ["job"])
    assert long.count() == 7
    wide = columns_to_table(column_docs, "doc", ["P.A.id", "name"], ["job"])
    assert wide.columns == ["job", "pos", "P.A.id", "name"]
    got = {(r["job"], r["pos"]): (r["P.A.id"], r["name"]) for r in wide.collect()}
    assert got[("j", 2)] == ("3", None)
    assert got[("j", 0)] == ("1", '"x"')


def test_later_document_replaces_a_column(spark):
    df = spark.createDataFrame(
        [
            (2, '{"a":{"value":["new"],"item_idx":0}}'),
            (1, '{"a":{"value":["old","rest"],"item_idx":0},"b":{"value":[1],"item_idx":1}}'),
        ],
        "n int, doc string",
    )
    got = [r["row"] for r in columns_to_rows(df, "doc", order="n").orderBy("pos").collect()]
    assert got == ['{"a":"new","b":1}', '{"a":"rest"}']


def test_bad_column_document_fails(spark):
    df = spark.createDataFrame([("{oops",)], "doc string")
    with pytest.raises(PySparkException, match="cannot parse JSON"):
        columns_to_rows_long(df, "doc").collect()


def test_json_to_columns(spark):
    df = spark.createDataFrame(
        [
            (2, '{"b":"x","unlisted":1}'),
            (1, '{"b":1,"a":{"z":[1,2]},"c":null,"d":true}'),
        ],
        "n int, doc string",
    )
    got = json_to_columns(df, "doc", "n", ["n"], "first")
    assert got.columns == ["n", "b", "a", "c", "d"]
    assert [tuple(r) for r in got.orderBy("n").collect()] == [
        (1, "1", '{"z":[1,2]}', "", "true"),
        (2, "x", "", "", ""),
    ]
    every = json_to_columns(df, "doc", "n", ["n"])
    assert every.columns == ["n", "b", "a", "c", "d", "unlisted"]
    assert [r["unlisted"] for r in every.orderBy("n").collect()] == ["", "1"]
