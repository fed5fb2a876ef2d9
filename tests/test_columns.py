from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelstone import types
from keelstone.functions import legacy
from keelstone.operators import columns as C
from keelstone.operators import dedupe as D
from keelstone.operators import incremental as I
from keelstone.sinks.tables import empty_frame
from tests.util import plan, rows


def test_type_names():
    assert types.spark_type("DT_NUMERIC(4,3)") == T.DecimalType(4, 3)
    assert types.spark_type("numeric(10, 2)") == T.DecimalType(10, 2)
    assert types.spark_type("money") == T.DecimalType(19, 4)
    assert types.spark_type("DT_I2") == T.ShortType() and types.spark_type("bigint") == T.LongType()
    assert types.spark_type("BIT") == T.BooleanType()
    assert types.spark_type("datetime") == T.TimestampNTZType()
    assert types.spark_type("nvarchar(max)") == T.StringType()
    assert types.declared_length("nvarchar(40)") == 40
    assert types.declared_length("nvarchar(max)") is None and types.declared_length("int") is None
    assert types.schema_from_legacy({"a": "int", "b": "money"}).simpleString() == "struct<a:int,b:decimal(19,4)>"
    for bad in ("geometry", "", "a b c"):
        with pytest.raises(ValueError):
            types.spark_type(bad)


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame([("1", "abc"), ("x", "abcdef"), (None, None)], "n string, s string")


def test_strict_schema_fails_on_a_bad_value(raw):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        C.enforce_schema(raw, "n int").collect()


def test_strict_schema_fails_on_a_long_value(raw):
    with pytest.raises(Exception, match="value too long for s"):
        C.enforce_schema(raw, "s string", lengths={"s": 3}).collect()


def test_permissive_schema_reports(raw):
    typed = C.enforce_schema(raw, "s string, n int", "permissive", {"s": 3}, report=True)
    assert [tuple(r) for r in typed.collect()] == [
        ("abc", 1, []),
        ("abcdef", None, ["n:cast", "s:length"]),
        (None, None, []),
    ]
    with pytest.raises(ValueError, match="missing"):
        C.enforce_schema(raw, "q int")
    with pytest.raises(ValueError, match="mode"):
        C.enforce_schema(raw, "n int", "lenient")


def test_mapping_rules(spark):
    df = spark.createDataFrame([(" Ab ", None, "7")], "a string, b string, c string")
    M = C.ColumnMapping
    mapped = C.apply_mapping(
        df,
        [
            M("a", "A", rules=("TRIM", "LOWER")),
            M("b", rules=("COALESCE",), default_value="none"),
            M("c", "n", target_datatype="int", rules=("CAST",)),
            M("c", "twice", rules=("CUSTOM",), logic="c || a"),
        ],
    )
    assert mapped.columns == ["A", "b", "n", "twice"]
    assert tuple(mapped.first()) == ("ab", "none", 7, "7 Ab ")
    for bad in (M("a", rules=("CUSTOM",)), M("a", rules=("CAST",)), M("a", rules=("COALESCE",)), M("a", rules=("HASH",))):
        with pytest.raises(ValueError):
            C.mapped_column(bad)


def test_masks_keep_null(spark):
    df = spark.createDataFrame([("x", "y"), (None, None)], "a string, b string")
    masked = C.mask_columns(df, {"a": "sha256", "b": "redact"}).collect()
    assert len(masked[0]["a"]) == 64 and masked[0]["b"] == "REDACTED"
    assert tuple(masked[1]) == (None, None)


def test_legacy_functions(spark):
    df = spark.sql("SELECT 'a' AS a, CAST(NULL AS STRING) AS b, TIMESTAMP_NTZ '2024-01-31 10:00:00' AS t, 2 AS n")
    row = df.select(
        legacy.plus_concat("a", "b").alias("plus"),
        legacy.joined_concat("-", "a", "b").alias("joined"),
        legacy.timestamp_add_days("t", 1).alias("later"),
        legacy.date_add_days(F.to_date("t"), F.col("n")).alias("day"),
        legacy.is_null("b", F.lit(5), "string").alias("filled"),
        legacy.substring("a", 1, 5).alias("sub"),
        legacy.if_then_else(F.col("b") == "x", F.lit(1), F.lit(2)).alias("branch"),
        legacy.load_time().alias("now"),
    )
    first = row.first()
    assert (first["plus"], first["joined"], str(first["later"]), str(first["day"])) == (
        None, "a", "2024-02-01 10:00:00", "2024-02-02",
    )
    assert (first["filled"], first["sub"], first["branch"]) == ("5", "a", 2)
    assert row.schema["now"].dataType == T.TimestampNTZType()


def test_delete_keeps_unknown(spark):
    df = spark.createDataFrame([(1,), (9,), (None,)], "q int")
    assert [r["q"] for r in C.delete_where(df, "q < 5").collect()] == [9, None]


def test_latest_per_key_with_a_hot_key_and_ties(spark):
    df = spark.range(0, 6000, 1, 4).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"),
        (F.col("id") % 40).alias("t"),
        F.col("id").alias("v"),
    )
    best = {}
    for r in df.collect():
        held = best.get(r["k"])
        if held is None or (-r["t"], r["v"]) < (-held["t"], held["v"]):
            best[r["k"]] = r
    found = D.latest_per_key(df, ["k"], "t")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, best.values()))
    # One row per key and task before the shuffle.
    text = plan(found)
    assert text.index("Partial") > text.index("Exchange") > text.index("Final")


def test_union_pads(spark):
    a, b = spark.sql("SELECT 1 AS x, 2 AS y"), spark.sql("SELECT 3 AS y, 'z' AS z")
    assert rows(D.union_all(a, b, pad_missing=True)) == ["(1, 2, None)", "(None, 3, 'z')"]


def test_marks_of_an_empty_target(spark):
    source = spark.sql(
        """SELECT * FROM VALUES (-9223372036854775808L, -5S, '', -1.5D, TIMESTAMP_NTZ '0001-01-01 00:00:00', DATE '0001-01-01', -0.1),
                  (0L, 0S, 'b', 0D, TIMESTAMP_NTZ '2024-01-01 00:00:00', DATE '2024-01-01', 0.0),
                  (9223372036854775807L, 7S, 'c', 2D, TIMESTAMP_NTZ '2024-01-02 00:00:00', DATE '2024-01-02', 0.1),
                  (NULL, NULL, NULL, NULL, NULL, NULL, NULL) AS v (id, s, c, f, t, d, m)"""
    )
    empty = empty_frame(spark, source.schema)
    for column in source.columns:
        assert I.incremental_extract(source, empty, column).count() == 3
        assert I.unmarked_rows(source, column).count() == 1
        kept = source.orderBy(F.col(column).asc_nulls_last()).limit(2)
        assert I.incremental_extract(source, kept, column).count() == 1
        assert I.incremental_extract(source, source, column).count() == (column == "id")
    assert I.high_water_mark(empty, "id").first()["mark"] == 0


def test_incremental_merge_of_nothing_new(spark):
    target = spark.createDataFrame([(1, 5, "a")], "k int, t int, v string")
    source = spark.createDataFrame([(1, 5, "b"), (2, 4, "c")], "k int, t int, v string")
    assert rows(I.incremental_merge(target, source, ["k"], "t")) == rows(target)
    newer = spark.createDataFrame([(1, 6, "b"), (1, 7, "c"), (2, 6, "d")], "k int, t int, v string")
    assert sorted(map(tuple, I.incremental_merge(target, newer, ["k"], "t").collect())) == [(1, 7, "c"), (2, 6, "d")]
