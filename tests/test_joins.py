import random

import pytest

from tabbridge.operators import joins


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def sides(spark):
    """One key holds a third of the left rows, another most of the right rows; NULL keys too."""
    rng = random.Random(3)
    left = [(None if i % 7 == 0 else 1 if i % 3 == 0 else rng.randrange(40), i) for i in range(600)]
    right = [(None if i % 9 == 0 else 2 if i % 2 else 20 + rng.randrange(40), -i) for i in range(90)]
    right.append((1, -1000))
    return (
        spark.createDataFrame(left, "k int, l int").repartition(3),
        spark.createDataFrame(right, "k long, r int").repartition(3),
        left,
        right,
    )


def brute(left, right, how):
    out = []
    used = set()
    for k, lv in left:
        hits = [j for j, (rk, _) in enumerate(right) if k is not None and rk == k]
        used.update(hits)
        out += [(k, lv, right[j][1]) for j in hits]
        if not hits and how in ("left", "outer"):
            out.append((k, lv, None))
    if how in ("right", "outer"):
        out += [(k, None, rv) for j, (k, rv) in enumerate(right) if j not in used]
    return sorted(out, key=repr)


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
@pytest.mark.parametrize("share", [None, 0.05, 0.9])
def test_join_equals_brute_force(sides, how, share):
    left, right, left_rows, right_rows = sides
    got = joins.join(left, right, ["k"], how, hot_share=share, hot_rows=1)
    assert got.columns == ["k", "l", "r"]
    assert rows(got) == brute(left_rows, right_rows, how)


@pytest.mark.parametrize("scan", [True, False])
@pytest.mark.parametrize("how", ["left", "right", "outer"])
def test_hot_join_without_broadcast(spark, sides, how, scan):
    left, right, left_rows, right_rows = sides
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = joins.join(left, right, ["k"], how, hot_rows=5, from_scan=scan)
        assert rows(got) == brute(left_rows, right_rows, how)
        plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("SortMergeJoin") == 1 and "Broadcast" not in plan


@pytest.mark.parametrize("how", ["left", "right", "outer"])
def test_keys_that_are_hot_on_both_sides_or_only_one(spark, how):
    """Parts of one side times parts of the other; a hot key the other side lacks; equal rows."""
    left = [(1, 7)] * 40 + [(1, i) for i in range(30)] + [(2, i) for i in range(50)] + [(9, 1), (None, 2)]
    right = [(1, -i) for i in range(45)] + [(3, 5)] * 60 + [(9, 1), (9, 2), (None, 3)]
    a = spark.createDataFrame(left, "k int, l int").repartition(4)
    b = spark.createDataFrame(right, "k int, r int").repartition(4)
    assert {h.key: h.parts for h in joins.hot_keys(a, ["k"], 0.1, 10)} == {(1,): 8, (2,): 6}
    for scan in (True, False):
        assert rows(joins.join(a, b, ["k"], how, 0.1, 10, from_scan=scan)) == brute(left, right, how)


def test_hot_text_and_fraction_keys(spark):
    a = spark.createDataFrame([("x", 0.0, i) for i in range(30)] + [("y", float("nan"), 1)] * 9, "s string, f double, l int")
    b = spark.createDataFrame([("x", -0.0, 1), ("y", float("nan"), 2), ("z", 1.0, 3)], "s string, f double, r int")
    got = joins.join(a, b, ["s", "f"], "outer", 0.05, 4)
    plain = joins.join(a, b, ["s", "f"], "outer", None)
    assert list(map(repr, rows(got))) == list(map(repr, rows(plain))) and got.count() == 40


def test_key_types_are_equal_for_all_kinds(spark):
    a = spark.createDataFrame([(1, 2.5, "a")], "k int, f float, l string")
    b = spark.createDataFrame([(1, 2.5, "b")], "k long, f double, r string")
    for how in ("inner", "left", "right", "outer"):
        for share in (None, 0.05):
            got = joins.join(a, b, ["k", "f"], how, share, 1)
            assert got.dtypes[:2] == [("k", "bigint"), ("f", "double")] and rows(got) == [(1, 2.5, "a", "b")]


def test_hot_keys_are_found(sides):
    left, _, left_rows, _ = sides
    (found,) = joins.hot_keys(left, ["k"], 0.1, 1)
    assert found.key == (1,) and found.parts == sum(k == 1 for k, _ in left_rows) + 1


def test_small_groups_are_not_hot(sides):
    left, _, _, _ = sides
    assert joins.hot_keys(left, ["k"]) == []
    assert joins.hot_keys(left.where("k IS NULL"), ["k"], 0.1, 1) == []


def test_join_type_names():
    assert [joins.join_type(t) for t in ("JOIN_TYPE_LEFT", "outer", "nonsense", "INNER")] == [
        "left", "outer", "inner", "inner",
    ]


def test_several_join_columns(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, None, 3)], "a int, b string, v int")
    b = spark.createDataFrame([(1, "x", 9), (2, None, 8)], "a int, b string, w int")
    assert rows(joins.join(a, b, ["a", "b"], "outer")) == sorted(
        [(1, "x", 1, 9), (1, "y", 2, None), (2, None, 3, None), (2, None, None, 8)], key=repr
    )


def test_psi_join(spark):
    table = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b"), (None, "n"), (1, "a2")], "k int, v string")
    one = spark.createDataFrame([(1,), (1,), (3,), (None,)], "k int")
    two = spark.createDataFrame([(3,), (1,), (5,), (None,)], "k int")
    got = joins.psi_join(table, [one, two], ["k"], ("v", "DESC"))
    assert [tuple(r) for r in got.collect()] == [(3, "c"), (1, "a2"), (1, "a")]
    assert joins.psi_join(table, [one, two], ["k"], "v", ["v"]).columns == ["v"]


def test_in_file_filter_keeps_repeats(spark):
    table = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, v string")
    keys = spark.createDataFrame([(1,), (1,), (None,)], "id int")
    assert rows(joins.in_file_filter(table, "k", keys, "id")) == [(1, "a"), (1, "b")]


def test_hash_column_order(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "k int, v string, w double")
    assert joins.add_hash_column(df, ["k"], ["w", "v"]).columns == ["w", "v", "join_hash"]
    assert joins.add_hash_column(df, ["k"]).columns == ["k", "v", "w", "join_hash"]
