from __future__ import annotations

import random
from collections import Counter

import pytest

from keelstone.operators import changes
from keelstone.operators import merge as M
from keelstone.operators.changes import change_feed, difference_count
from keelstone.sinks.tables import empty_frame
from tests.util import plan, rows

SCHEMA = "k int, j string, v int, w string"


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame(
        [(1, "a", 10, "x"), (2, "b", 20, None), (3, "c", 30, "z"), (None, "n", 40, "kept")], SCHEMA
    )


@pytest.fixture(scope="module")
def source(spark):
    return spark.createDataFrame(
        [(2, "b", 21, "new"), (3, "c", None, None), (4, "d", 41, "q"), (None, "n", 99, "lost")], SCHEMA
    )


EXPECTED = [(1, "a", 10, "x"), (2, "b", 21, "new"), (3, "c", None, None), (4, "d", 41, "q"), (None, "n", 40, "kept")]


@pytest.mark.parametrize("small", [False, True])
def test_upsert(spark, target, source, small):
    merged = M.merge(target, source, ["k", "j"], small_source=small)
    assert merged.schema.simpleString() == target.schema.simpleString()
    assert rows(merged) == rows(spark.createDataFrame(EXPECTED, SCHEMA))
    # A NULL in the source overwrites: presence is a flag, not a value.
    again = M.merge(merged, source, ["k", "j"], small_source=small)
    assert difference_count(merged, again).first()[0] == 0


def test_small_source_leaves_the_target_unshuffled(spark, target, source):
    merged = M.merge(target, source, ["k", "j"], small_source=True, source_is_unique=True)
    assert "FullOuter" not in plan(merged) and "LeftOuter" in plan(merged)


def test_null_keys(target, source):
    assert [r["w"] for r in M.null_key_rows(source, ["k", "j"]).collect()] == ["lost"]
    with pytest.raises(Exception, match="NULL in merge key"):
        M.merge(target, source, ["k", "j"], on_null_key="fail").collect()
    with pytest.raises(ValueError):
        M.merge(target, source, ["k"], on_null_key="ignore")


def test_duplicate_source_key_fails(spark, target, source):
    twice = source.unionByName(source.filter("k = 2"))
    with pytest.raises(Exception, match="merge source rows are not unique"):
        M.merge(target, twice, ["k", "j"]).collect()


def test_update_subset_and_insert_subset(spark, target, source):
    merged = M.merge(target, source, ["k", "j"], update_columns=["v"], insert_columns=["w"])
    expected = [(1, "a", 10, "x"), (2, "b", 21, None), (3, "c", None, "z"), (4, "d", None, "q"), (None, "n", 40, "kept")]
    assert rows(merged) == rows(spark.createDataFrame(expected, SCHEMA))
    with pytest.raises(ValueError, match="not in both"):
        M.merge(target, source, ["k"], update_columns=["nope"])


def test_source_without_a_column_keeps_it(spark, target, source):
    merged = M.merge(target, source.drop("w"), ["k", "j"])
    found = {r["k"]: r["w"] for r in merged.collect()}
    assert found == {1: "x", 2: None, 3: "z", 4: None, None: "kept"}


def test_empty_target_folds_to_the_source(spark, source):
    merged = M.merge(empty_frame(spark, SCHEMA), source, ["k", "j"], source_is_unique=True)
    assert rows(merged) == rows(source.filter("k is not null"))
    assert "Join" not in plan(merged) and "Exchange" not in plan(merged)


def test_insert_only(spark, target, source):
    assert sorted(r["v"] for r in M.insert_missing(target, source, ["k", "j"]).collect()) == [10, 20, 30, 40, 41]
    once = M.insert_missing_rows(target, source)
    assert once.count() == 8  # four kept, four that differ somewhere
    assert rows(M.insert_missing_rows(once, source)) == rows(once)


def test_update_matched_touches_no_other_rows(spark):
    versions = spark.createDataFrame([(1, 10, True), (1, 5, False), (2, 20, True), (3, 30, None)], "k int, v int, live boolean")
    source = spark.createDataFrame([(1, 11), (3, 31), (9, 90)], "k int, v int")
    updated = M.update_matched(versions, source, ["k"], only_where="live")
    assert rows(updated) == rows(
        spark.createDataFrame([(1, 11, True), (1, 5, False), (2, 20, True), (3, 30, None)], "k int, v int, live boolean")
    )
    everywhere = M.update_matched(versions, source, ["k"])
    assert sorted(r["v"] for r in everywhere.collect()) == [11, 11, 20, 31]


def test_change_feed(spark):
    before = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (4, None)], "k int, v string")
    after = spark.createDataFrame([(1, "a"), (2, "b"), (4, None), (5, "e")], "k int, v string")
    feed = sorted(tuple(r) for r in change_feed(before, after, ["k"]).na.fill("-").collect())
    assert feed == [
        (2, "-", "update_preimage"),
        (2, "b", "update_postimage"),
        (3, "c", "delete"),
        (5, "e", "insert"),
    ]


def test_difference_counts_copies(spark):
    one = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    two = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "a int, b string")
    assert difference_count(one, two).first()[0] == 2
    assert difference_count(one, one).first()[0] == 0


def test_null_keys_of_an_update_are_no_duplicates(spark):
    target = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string")
    source = spark.createDataFrame([(1, "b"), (None, "x"), (None, "y")], "k int, v string")
    assert rows(M.update_matched(target, source, ["k"])) == ["(1, 'b')", "(None, 'n')"]


def test_change_feed_of_repeated_and_null_keys(spark):
    before = spark.createDataFrame([(1, "a"), (None, "n"), (None, "n"), (None, "o")], "k int, v string")
    after = spark.createDataFrame([(1, "b"), (None, "n"), (None, "p"), (None, "o")], "k int, v string")
    assert rows(change_feed(before, after, ["k"])) == [
        "(1, 'a', 'update_preimage')", "(1, 'b', 'update_postimage')", "(None, 'n', 'delete')", "(None, 'p', 'insert')",
    ]
    with pytest.raises(Exception, match="not unique by k"):
        change_feed(before.unionByName(before), after, ["k"]).collect()


@pytest.mark.parametrize("buckets", [1, 3, 4096])
def test_difference_count_equals_counting(spark, monkeypatch, buckets):
    monkeypatch.setattr(changes, "BUCKETS", buckets)
    made = random.Random(buckets)
    values = [(made.choice([None, 1, 2]), made.choice([None, "", "a", "1"]), made.choice([None, [], [None, "x"], ["x", None], ["x, y"], ["x", "y"]])) for _ in range(200)]
    schema = "a int, b string, c array<string>"
    for left, right in ((values, made.sample(values, 200)), (values, values[:150] + values[:20]), (values, []), ([], [])):
        counts = Counter(map(repr, left))
        counts.subtract(Counter(map(repr, right)))
        found = difference_count(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)).first()[0]
        assert found == sum(map(abs, counts.values()))


def test_rows_that_only_look_alike_differ(spark):
    def one(*values):
        return spark.createDataFrame([values], "a int, b int, c array<int>")

    for left, right in (((None, 1, None), (1, None, None)), ((0, 1, [None, 1]), (0, 1, [1, None])), ((0, 1, []), (0, 1, None))):
        assert difference_count(one(*left), one(*right)).first()[0] == 2


def test_equal_states_shuffle_no_rows(spark):
    left = spark.range(0, 50_000, 1, 4).selectExpr("id", "id * 7 AS v")
    right = spark.range(0, 50_000, 1, 3).selectExpr("id", "id * 7 AS v")
    counted = difference_count(left, right)
    assert counted.first()[0] == 0
    # What is left of the plan when it has run: the rows' branch is gone.
    counted.collect()
    final = counted._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "BroadcastHashJoin" not in final and final.count("Exchange") <= 2
