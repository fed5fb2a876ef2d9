from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from keelstone.operators.joins import (
    NULL_SALTS,
    _salted_join,
    fits_broadcast,
    hot_keys,
    keyed_join,
    measured_bytes,
    unique_or_fail,
)
from keelstone.operators.lookup import Lookup, lookup, lookup_rejects
from tests.util import plan, rows


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows under one key, a third without a key, whole copies among them."""
    n = F.col("id")
    key = F.when(n % 3 == 0, 7).when(n % 3 == 1, F.lit(None)).otherwise(n % 500)
    return spark.range(0, 9000, 1, 6).select(
        key.cast("bigint").alias("k"), F.when(n % 2 == 0, 1).otherwise(n).cast("bigint").alias("v")
    )


@pytest.fixture(scope="module")
def keyed(spark):
    return spark.range(0, 400).select(F.col("id").alias("k"), (F.col("id") * 10).alias("sk"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(skewed, keyed, how):
    salted = keyed_join(skewed, keyed, ["k"], how, rows_per_task=100)
    plain = skewed.join(keyed, "k", how).select(*salted.columns)
    assert rows(salted) == rows(plain)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_broadcast_join_equals_plain_join(skewed, keyed, how):
    joined = keyed_join(skewed, keyed, ["k"], how, broadcast=True)
    assert "BroadcastHashJoin" in plan(joined)
    assert rows(joined) == rows(skewed.join(keyed, "k", how).select(*joined.columns))


def test_salted_join_on_two_keys(spark, skewed):
    left = skewed.withColumn("j", F.pmod("v", F.lit(2)).cast("int"))
    right = spark.range(0, 400).select(
        F.col("id").alias("k"), (F.col("id") % 2).cast("int").alias("j"), (F.col("id") * 10).alias("sk")
    )
    salted = _salted_join(left, right, ["k", "j"], "left", 100)
    assert rows(salted) == rows(left.join(right, ["k", "j"], "left").select(*salted.columns))


@pytest.fixture
def no_auto_broadcast(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for name in names:
        spark.conf.set(name, "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for name in names:
        spark.conf.unset(name)


def test_salted_join_shuffles_the_keyed_side(skewed, keyed, no_auto_broadcast):
    salted = _salted_join(skewed, keyed, ["k"], "left", 100)
    assert "SortMergeJoin [k#" in plan(salted) and "_salt#" in plan(salted)


def test_hot_keys_are_exact_and_sized(skewed):
    found = {r["k"]: r["_salts"] for r in hot_keys(skewed, ["k"], 100).collect()}
    assert found == {7: 31, None: 30}  # 3,006 of 7, 3,000 without key


def test_hot_key_spreads_over_its_salts(skewed, keyed, no_auto_broadcast):
    hot = skewed.filter("k = 7")
    joined = _salted_join(hot, keyed, ["k"], "inner", 100)
    sizes = joined.withColumn("p", F.spark_partition_id()).groupBy("p").count()
    largest = sizes.agg(F.max("count")).first()[0]
    assert largest < hot.count() * 0.6
    assert NULL_SALTS > 1


def test_measured_bytes_counts_text(spark):
    df = spark.createDataFrame([("abc", 1), (None, 2)], "s string, n int")
    assert measured_bytes(df) == 16 * 4 + 3
    assert fits_broadcast(df, 67) and not fits_broadcast(df, 66)
    nested = spark.createDataFrame([([1],)], "a array<int>")
    assert measured_bytes(nested) is None and not fits_broadcast(nested)


def test_unique_or_fail(spark):
    ok = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert rows(unique_or_fail(ok, ["k"])) == rows(ok)
    twice = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="not unique by k"):
        unique_or_fail(twice, ["k"], "things").collect()
    # The check survives when only the key is used afterwards.
    with pytest.raises(Exception, match="not unique by k"):
        unique_or_fail(twice, ["k"], "things").select("k").collect()


def test_lookup_policies(spark):
    fact = spark.createDataFrame([(1, 10), (2, 99), (3, None)], "id int, product int")
    dim = spark.createDataFrame(
        [(100, 10, "a", True), (101, 10, "old", False), (102, 11, "b", True)],
        "sk bigint, productid bigint, name string, flag boolean",
    )
    spec = {"on": {"product": "productid"}, "current": "flag"}
    take = {"sk": "sk", "name": "name"}
    ignore = lookup(fact, Lookup(dim, take=take, miss="ignore", **spec))
    assert rows(ignore.select("id", "sk", "name")) == rows_of([(1, 100, "a"), (2, None, None), (3, None, None)])
    default = lookup(fact, Lookup(dim, take=take, miss="default", defaults={"name": "Unknown"}, **spec))
    assert rows(default.select("id", "sk", "name")) == rows_of([(1, 100, "a"), (2, -1, "Unknown"), (3, -1, "Unknown")])
    drop = Lookup(dim, miss="drop", **spec)
    assert [r["id"] for r in lookup(fact, drop).collect()] == [1]
    assert sorted(r["id"] for r in lookup_rejects(fact, drop).collect()) == [2, 3]


def test_lookup_fails_on_two_current_rows(spark):
    fact = spark.createDataFrame([(1, 10)], "id int, product int")
    dim = spark.createDataFrame([(100, 10), (101, 10)], "sk bigint, productid int")
    with pytest.raises(Exception, match="not unique"):
        lookup(fact, Lookup(dim, {"product": "productid"}, {"sk": "sk"})).collect()


def test_lookup_key_too_large_for_the_fact_matches_nothing(spark):
    fact = spark.createDataFrame([(1, 10)], "id int, product int")
    dim = spark.createDataFrame([(100, 10), (101, 10_000_000_000)], "sk bigint, productid bigint")
    found = lookup(fact, Lookup(dim, {"product": "productid"}, {"sk": "sk"}))
    assert [r["sk"] for r in found.collect()] == [100]


def test_lookup_rejects_bad_input(spark):
    fact = spark.createDataFrame([(1, 10)], "id int, product int")
    with pytest.raises(ValueError, match="miss"):
        lookup(fact, Lookup(fact, {"product": "product"}, miss="guess"))
    with pytest.raises(ValueError, match="overwrite"):
        lookup(fact, Lookup(fact, {"product": "product"}, {"id": "id"}))


def rows_of(values):
    return sorted(repr(tuple(v)) for v in values)
