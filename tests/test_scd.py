from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from keelstone.operators import scd as S
from keelstone.operators.changes import difference_count
from keelstone.plans.catalog.base import table
from keelstone.plans.catalog.dimensions import SPEC as PRODUCT
from keelstone.sinks.tables import empty_frame
from tests.conftest import SMALL
from tests.util import rows

SPEC = S.ScdSpec("sk", ("id",), changing=("name",), historical=("grp",), fixed=("born",))
DIM = "sk bigint, id int, name string, grp string, born int, flag boolean"
SRC = "id int, name string, grp string, born int"


@pytest.fixture(scope="module")
def dim(spark):
    return spark.createDataFrame(
        [
            (1, 1, "same", "g", 1, True),
            (2, 2, "old", "g", 1, True),
            (3, 3, "n", "old", 1, True),
            (4, 4, "old", "old", 1, True),
            (5, 5, None, None, None, True),
            (6, 5, "gone", "g", 2, False),
            (7, 6, "n", "g", 1, True),
            (8, 7, None, "g", 1, True),
            (9, 8, "n", "older", 1, False),
            (10, 3, "n", "oldest", 1, False),
            (11, 99, "only here", "g", 1, True),
        ],
        DIM,
    )


@pytest.fixture(scope="module")
def source(spark):
    return spark.createDataFrame(
        [
            (1, "same", "g", 1),
            (2, "new", "g", 1),
            (3, "n", "new", 1),
            (4, "new", "new", 1),
            (5, "late", "g", 3),
            (6, "n", "g", 2),
            (7, None, "g", 1),
            (8, "n", "g", 1),
            (20, "n", "g", 1),
            (None, "n", "g", 1),
        ],
        SRC,
    )


def test_classes(source, dim):
    found = {r["id"]: r[S.CLASSES] for r in S.scd_classify(source, dim, SPEC).collect()}
    assert found == {
        1: ["Unchanged"],
        2: ["Changing"],
        3: ["Historical"],
        4: ["Changing", "Historical"],
        5: ["Inferred"],
        6: ["Fixed"],
        7: ["Unchanged"],  # NULL equals NULL
        8: ["New"],  # only an expired version
        20: ["New"],
    }


def test_mixed_load(spark, source, dim):
    expected = [
        (1, 1, "same", "g", 1, True),
        (2, 2, "new", "g", 1, True),
        (3, 3, "n", "old", 1, False),
        (4, 4, "old", "old", 1, False),  # the expired version keeps its values
        (5, 5, "late", "g", 3, True),
        (6, 5, "late", "g", 3, False),  # an inferred member: all versions
        (7, 6, "n", "g", 1, True),
        (8, 7, None, "g", 1, True),
        (9, 8, "n", "older", 1, False),
        (10, 3, "n", "oldest", 1, False),
        (11, 99, "only here", "g", 1, True),
        (12, 3, "n", "new", 1, True),
        (13, 4, "new", "new", 1, True),
        (14, 8, "n", "g", 1, True),
        (15, 20, "n", "g", 1, True),
    ]
    loaded = S.scd_load(source, dim, SPEC, on_null_key="reject")
    assert loaded.schema.simpleString() == dim.schema.simpleString()
    assert rows(loaded) == rows(spark.createDataFrame(expected, DIM))
    assert difference_count(loaded, S.scd_load(source, loaded, SPEC, on_null_key="reject")).first()[0] == 0


def test_first_load(spark, source):
    loaded = S.scd_load(source, empty_frame(spark, DIM), SPEC, on_null_key="reject")
    assert sorted((r["sk"], r["id"]) for r in loaded.collect()) == [
        (n + 1, i) for n, i in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 20])
    ]


def test_bad_inputs_fail(spark, source, dim):
    with pytest.raises(Exception, match="dimension source rows are not unique"):
        S.scd_load(source.unionByName(source), dim, SPEC, on_null_key="reject").collect()
    with pytest.raises(Exception, match="NULL in merge key"):
        S.scd_load(source, dim, SPEC)
    two_current = dim.unionByName(dim.filter("sk = 1"))
    with pytest.raises(Exception, match="current dimension rows are not unique"):
        S.scd_load(source, two_current, SPEC, on_null_key="reject").collect()
    with pytest.raises(ValueError):
        S.scd_load(source, dim, replace(SPEC, valid_from="f"))


def test_intervals_do_not_overlap(spark):
    """Three loads; the versions of a member follow each other without gap or overlap."""
    spec = replace(PRODUCT, flag="is_current", valid_from="valid_from", valid_to="valid_to")
    source = table(spark, SMALL, "src_part")
    schema = "productkey bigint, " + ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields
    ) + ", is_current boolean, valid_from timestamp_ntz, valid_to timestamp_ntz"
    state = empty_frame(spark, schema)
    for month, rows_in in enumerate(
        [
            source,
            source.withColumn("categoryid", F.when(F.col("productid") % 3 == 0, "moved").otherwise(F.col("categoryid"))),
            source.withColumn("unitprice", F.col("unitprice").cast("decimal(19,4)")),
        ],
        start=1,
    ):
        state = S.scd_load(rows_in, state, spec, as_of=f"2024-0{month}-01 00:00:00").checkpoint()
    following = Window.partitionBy("productid").orderBy("valid_from")
    joined = state.withColumn("next_from", F.lead("valid_from").over(following))
    assert joined.filter("NOT (valid_to <=> next_from)").count() == 0
    assert state.filter("is_current").count() == source.count()
    assert state.filter("is_current <> (valid_to IS NULL)").count() == 0
    assert state.select("productkey").distinct().count() == state.count()
    moved = source.filter("productid % 3 = 0 and categoryid <> 'moved'").count()
    assert state.count() == source.count() + 2 * moved


def test_inferred_members_are_filled_later(spark, dim):
    fact = spark.createDataFrame([(5,), (30,), (30,), (31,), (None,)], "pid int")
    grown = S.add_inferred_members(dim, fact, "pid", SPEC)
    added = grown.filter("id in (30, 31)")
    assert sorted(tuple(r) for r in added.collect()) == [
        (12, 30, None, None, None, True),
        (13, 31, None, None, None, True),
    ]
    arrived = spark.createDataFrame([(30, "n", "g", 4)], SRC)
    loaded = S.scd_load(arrived, grown, SPEC).filter("id = 30")
    assert [tuple(r) for r in loaded.collect()] == [(12, 30, "n", "g", 4, True)]


def test_scd1(spark):
    target = spark.createDataFrame([(1, "a", 1)], "k int, v string, t int")
    source = spark.createDataFrame([(1, "b", 2), (1, "c", 3), (2, "d", 1)], "k int, v string, t int")
    assert sorted(tuple(r) for r in S.scd1_upsert(target, source, ["k"], "t").collect()) == [(1, "c", 3), (2, "d", 1)]
    with pytest.raises(Exception, match="not unique"):
        S.scd1_upsert(target, source, ["k"]).collect()
