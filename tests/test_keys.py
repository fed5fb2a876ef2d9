from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from keelstone.operators import keys
from keelstone.operators.keys import add_unknown_member, assign_surrogate_keys, number_rows
from keelstone.sinks.tables import empty_frame
from tests.util import plan, rows

DIM = "sk bigint, code string, name string, price decimal(9,2), since date, live boolean"


@pytest.mark.parametrize("partitions", [1, 7])
def test_numbering_equals_one_global_row_number(spark, partitions):
    # A third of the rows share the first key column.
    df = spark.range(0, 5000, 1, partitions).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("a"),
        F.reverse(F.col("id").cast("string")).alias("b"),
    )
    expected = df.withColumn("n", F.row_number().over(Window.orderBy("a", "b")).cast("bigint") + 100)
    assert rows(number_rows(df, ["a", "b"], "n", after=100)) == rows(expected)


def test_numbering_uses_several_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(0, 20000, 1, 4).withColumn("a", F.col("id") % 2)
        numbered = number_rows(df, ["a", "id"], "n").filter("n > 0")
        used = numbered.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(used) > 4 and max(r["count"] for r in used) < 20000 / 2


def test_plan_does_not_grow_with_the_ranges(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    df = spark.range(0, 20000, 1, 4).select(F.when(F.col("id") % 9 > 0, F.col("id") % 70).alias("a"), F.col("id").cast("decimal(20,0)").alias("b"))
    plans = {}
    try:
        for partitions in ("8", "2000"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            numbered = number_rows(df, ["a", "b"], "n")
            plans[partitions] = len(numbered._jdf.queryExecution().optimizedPlan().toString())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    expected = df.withColumn("n", F.row_number().over(Window.orderBy("a", "b")).cast("bigint"))
    assert rows(numbered) == rows(expected)
    assert abs(plans["8"] - plans["2000"]) < 50


def test_numbering_evaluates_its_input_once_more_at_most(spark):
    """The rows are written once; what reads the result does not go back to the input."""
    numbered = number_rows(spark.range(0, 20000, 1, 4), ["id"], "n")
    text = plan(numbered)
    assert "Range (" not in text and text.count("Scan parquet") == 2  # the rows, and their places alone
    assert "ReadSchema: struct<_at:bigint>" in text
    assert numbered.filter("n <> id + 1").count() == 0


def test_null_keys_are_numbered_first(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("a"), "id")
    expected = df.withColumn("n", F.row_number().over(Window.orderBy("a", "id")).cast("bigint"))
    assert rows(number_rows(df, ["a", "id"], "n")) == rows(expected)


def test_numbering_nothing(spark):
    assert number_rows(spark.range(0), ["id"], "n").collect() == []


def test_keys_stay_and_new_ones_follow(spark):
    target = spark.createDataFrame([(5, "b"), (9, "d"), (-1, "Unknown")], "sk bigint, code string")
    source = spark.createDataFrame([("d", 1), ("a", 2), ("c", 3), ("b", 4), (None, 5)], "code string, v int")
    keyed = assign_surrogate_keys(source, target, ["code"], "sk")
    found = {r["code"]: r["sk"] for r in keyed.collect()}
    assert found == {"b": 5, "d": 9, "a": 10, "c": 11, None: None}
    # A second run over the grown target numbers nothing.
    grown = target.unionByName(keyed.filter("sk is not null").select("sk", "code")).distinct()
    assert rows(assign_surrogate_keys(source, grown, ["code"], "sk")) == rows(keyed)


@pytest.mark.parametrize("most", [200_000, 0])
def test_source_and_target_meet_once(spark, monkeypatch, most):
    monkeypatch.setattr(keys, "ONE_TASK_ROWS", most)
    target = spark.range(0, 900, 3).select((F.col("id") + 1).alias("sk"), F.col("id").alias("a"), F.lit("x").alias("b"))
    source = spark.range(0, 1000).select(
        F.when(F.col("id") % 50 > 0, F.col("id") - F.col("id") % 2).alias("a"), F.lit("x").alias("b"), F.col("id").alias("v")
    )
    keyed = assign_surrogate_keys(source, target, ["a", "b"], "sk")
    assert "Range (0, 1000" not in plan(keyed)  # the source is not read again
    new = sorted({r.a for r in source.collect() if r.a is not None and r.a % 3})
    new += [a for a in {r.a for r in source.collect() if r.a is not None} if not a % 3 and a >= 900]
    number = {a: 898 + k + 1 for k, a in enumerate(sorted(new))} | {a: a + 1 for a in range(0, 900, 3)}
    assert rows(keyed) == sorted(repr((r.a, "x", r.v, number.get(r.a))) for r in source.collect())


def test_first_key_is_one(spark):
    source = spark.createDataFrame([("y",), ("x",)], "code string")
    for target in (
        empty_frame(spark, "sk bigint, code string"),
        spark.createDataFrame([(-1, "Unknown")], "sk bigint, code string"),
    ):
        found = {r["code"]: r["sk"] for r in assign_surrogate_keys(source, target, ["code"], "sk").collect()}
        assert found == {"x": 1, "y": 2}


def test_repeated_business_keys_share_a_number(spark):
    source = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "code string, v int")
    target = empty_frame(spark, "sk bigint, code string")
    keyed = assign_surrogate_keys(source, target, ["code"], "sk")
    assert sorted((r["code"], r["sk"]) for r in keyed.collect()) == [("x", 1), ("x", 1), ("y", 2)]


def test_target_with_two_keys_for_one_member_fails(spark):
    target = spark.createDataFrame([(1, "x"), (2, "x")], "sk bigint, code string")
    source = spark.createDataFrame([("x",)], "code string")
    with pytest.raises(Exception, match="not unique"):
        assign_surrogate_keys(source, target, ["code"], "sk").collect()


def test_unknown_member_is_typed_and_added_once(spark):
    dim = empty_frame(spark, DIM)
    once = add_unknown_member(dim, "sk", ["code"], {"live": False})
    assert once.schema.simpleString() == dim.schema.simpleString()
    (row,) = once.collect()
    assert (row["sk"], row["code"], row["name"], float(row["price"]), row["since"], row["live"]) == (
        -1, "-1", "Unknown", 0.0, None, False,
    )
    assert rows(add_unknown_member(once, "sk", ["code"])) == rows(once)


def test_unknown_member_numeric_business_key(spark):
    dim = empty_frame(spark, "sk bigint, id int, qty int")
    assert [tuple(r) for r in add_unknown_member(dim, "sk", ["id"]).collect()] == [(-1, -1, 0)]
