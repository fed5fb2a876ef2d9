from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from keelstone.operators import aggregates as A
from keelstone.operators.aggregates import AggregateSpec, aggregate_rows, maintain_aggregate
from keelstone.operators.changes import CHANGE_TYPE, change_feed
from keelstone.operators.merge import FEED, PART, STATE, merge, merge_tagged
from keelstone.plans import load as L
from keelstone.plans.gold import refresh_aggregate
from keelstone.session import cut_lineage, scratch_table
from keelstone.sinks import tables
from tests.util import plan, rows

SCHEMA = "id int, g string, v int, w decimal(9,2)"
SPEC = AggregateSpec(("g",), {"total": "v", "paid": "w"}, {"low": "v"}, {"high": "w"})


def state(seed, count=120):
    made = random.Random(seed)
    return [
        (i, made.choice([None, "", "a", "b", "c"]), made.choice([None, *range(6)]), made.choice([None, 1, 2, 3]))
        for i in range(count)
        if made.random() < 0.8
    ]


def frame(spark, values):
    return spark.createDataFrame([(i, g, v, None) for i, g, v, _ in values], SCHEMA).drop("w").join(
        spark.createDataFrame([(i, w) for i, _, _, w in values], "id int, w int").withColumn("w", F.col("w").cast("decimal(9,2)")), "id"
    )


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_maintained_aggregates_equal_new_ones(spark, seed):
    before, middle, after = (frame(spark, state(seed * 10 + k)) for k in range(3))
    stored = aggregate_rows(before, SPEC)
    feed = change_feed(before, middle, ["id"])
    both = feed.unionByName(change_feed(middle, after, ["id"]))  # two versions at once
    assert rows(maintain_aggregate(stored, feed, middle, SPEC)) == rows(aggregate_rows(middle, SPEC))
    assert rows(maintain_aggregate(stored, both, after, SPEC)) == rows(aggregate_rows(after, SPEC))
    assert maintain_aggregate(stored, change_feed(before, before.limit(0), ["id"]), before.limit(0), SPEC).collect() == []


def test_the_table_is_read_for_lost_extremes_only(spark, tmp_path):
    path = str(tmp_path / "fact")
    frame(spark, [(i, "ab"[i % 2], i, i) for i in range(20)]).write.parquet(path)
    fact = spark.read.parquet(path)
    stored = aggregate_rows(fact, SPEC)

    def changed(values):
        return spark.createDataFrame(values, f"id int, g string, v int, w int, {CHANGE_TYPE} string").withColumn("w", F.col("w").cast("decimal(9,2)"))

    kept = maintain_aggregate(stored, changed([(3, "b", 3, 3, "update_preimage"), (3, "b", 4, 3, "update_postimage"), (50, "a", -5, 99, "insert")]), fact, SPEC)
    assert path not in plan(kept)
    assert {r.g: (r.n_rows, r.total, r.low, float(r.high)) for r in kept.collect()} == {"a": (11, 85, -5, 99.0), "b": (10, 101, 1, 19.0)}
    # The least of b goes: its rows are read again, those of the table after the change.
    fewer = fact.filter("id <> 1")
    lost = maintain_aggregate(stored, changed([(1, "b", 1, 1, "delete")]), fewer, SPEC)
    assert rows(lost) == rows(aggregate_rows(fewer, SPEC))


def test_changes_are_shuffled_once_as_sums(spark, tmp_path, monkeypatch):
    path, plans = str(tmp_path / "fact"), []
    frame(spark, [(i, "ab"[i % 2], i, i) for i in range(20)]).write.parquet(path)
    fact = spark.read.parquet(path)
    stored = aggregate_rows(fact, SPEC).localCheckpoint()
    monkeypatch.setattr(A, "scratch_table", lambda df, name: plans.append(plan(df)) or scratch_table(df, name))

    def maintained(values, after):
        plans.clear()
        changed = spark.createDataFrame(values, f"id int, g string, v int, w int, {CHANGE_TYPE} string").withColumn("w", F.col("w").cast("decimal(9,2)"))
        return maintain_aggregate(stored, changed, after, SPEC)

    # The least of a goes for a lesser one.
    after = fact.withColumn("v", F.expr("if(id = 0, -1, v)"))
    moved = maintained([(0, "a", 0, 0, "update_preimage"), (0, "a", -1, 0, "update_postimage")], after)
    assert [p.count("Exchange hashpartitioning") for p in plans] == [1] and path not in plan(moved)
    assert rows(moved) == rows(aggregate_rows(after, SPEC))
    # Rows with the extremes are updated beside them: netted, and the table is not read.
    same = maintained([(k, "ab"[k % 2], k, k, f"update_{way}image") for k in (0, 1, 18, 19) for way in ("pre", "post")], fact)
    assert len(plans) == 2 and path not in plan(same)
    assert rows(same) == rows(aggregate_rows(fact, SPEC))
    # What came in one version and went in the next leaves the stored least; that of b went for good.
    values = [(9, "b", 9, 9, "update_preimage"), (9, "b", 1, 9, "update_postimage"), (9, "b", 1, 9, "delete"), (1, "b", 1, 1, "delete")]
    fewer = fact.filter("id not in (1, 9)")
    assert rows(maintained(values, fewer)) == rows(aggregate_rows(fewer, SPEC))
    assert rows(maintained(values[:3], fact.filter("id <> 9"))) == rows(aggregate_rows(fact.filter("id <> 9"), SPEC))


def test_a_large_increment_is_shuffled_by_key_once(spark, tmp_path, monkeypatch):
    target, source = (spark.range(a, a + 50).select(F.col("id").cast("int"), F.lit(a).alias("v")) for a in (0, 30))
    path, options, kept = str(tmp_path / "t"), L.LoadOptions(L.INCREMENTAL, ("id",), change_feed=True), []
    monkeypatch.setattr("keelstone.operators.merge.fits_broadcast", lambda df: False)
    monkeypatch.setattr("keelstone.plans.load.fits_broadcast", lambda df: False, raising=False)
    monkeypatch.setattr("keelstone.plans.load.cut_lineage", lambda df: kept.append(plan(df)) or cut_lineage(df))
    merged = L.next_state(source, target, options)
    assert sum(p.count("Exchange hashpartitioning") for p in [*kept, plan(merged)]) == 2
    assert merged.filter(F.col(PART) == STATE).count() == 80
    with pytest.raises(Exception, match="not unique by id"):
        L.next_state(source.unionByName(source), target, options).collect()
    # Both parts are written by the tasks of the merge.
    L.load(target, path, "id int, v int", options)
    monkeypatch.setattr(type(target), "hint", lambda *a: pytest.fail("gathered by a shuffle"))
    assert L.load(source, path, "id int, v int", options).count() == 80
    assert tables.read_feed(spark, path, 1).count() == 70


@pytest.mark.parametrize("small", [True, False])
def test_tagged_merge_is_the_merge_and_its_feed(spark, small):
    target, source = frame(spark, [*state(1), (None, "n", 1, 1)]), frame(spark, state(2))
    target = target.unionByName(spark.createDataFrame([(None, "n", 1, None)], SCHEMA))
    options = {"source_is_unique": True, "small_source": small, "update_columns": ["v", "w"]}
    tagged = merge_tagged(target, source, ["id"], **options).checkpoint()
    merged = merge(target, source, ["id"], **options)
    assert rows(tagged.filter(F.col(PART) == STATE).select(*target.columns)) == rows(merged)
    feed = tagged.filter(F.col(PART) == FEED).drop(PART)
    assert rows(feed) == rows(change_feed(target, merged, ["id"]).select(*feed.columns))
    if not small:
        assert plan(merge_tagged(target, source, ["id"], **options)).count("FullOuter") == 1


def test_versions_with_feeds(spark, tmp_path):
    path, options = str(tmp_path / "t"), L.LoadOptions(L.INCREMENTAL, ("id",), change_feed=True)
    first, second = frame(spark, state(4)), frame(spark, state(5))
    assert rows(L.load(first, path, SCHEMA, options).select(*first.columns)) == rows(first)
    loaded = L.load(second, path, SCHEMA, options)
    after_first, after_second = tables.versions(spark, path)
    assert rows(loaded) == rows(tables.read_current(spark, path)) == rows(merge(tables.read_version(spark, path, after_first), second, ["id"]))
    feed = tables.read_feed(spark, path, after_first)
    wanted = change_feed(tables.read_version(spark, path, after_first), loaded, ["id"])
    assert rows(feed.select(*wanted.columns)) == rows(wanted)
    assert rows(tables.read_feed(spark, path, after_second).select("id")) == []
    # Nothing new: no change, and the table stays.
    L.load(second.limit(0), path, SCHEMA, options)
    assert rows(tables.read_feed(spark, path, after_second).select("id")) == []
    assert rows(tables.read_current(spark, path)) == rows(merge(first, second, ["id"]).select("id", "g", "v", "w"))
    # A version without a feed ends what can be followed.
    tables.commit(first.limit(3), path)
    assert tables.read_feed(spark, path, after_second) is None
    with pytest.raises(ValueError, match="change feed"):
        L.load(first, path, SCHEMA, L.LoadOptions(L.FULL_OVERWRITE, ("id",), change_feed=True))


def test_aggregates_follow_the_versions(spark, tmp_path, monkeypatch):
    fact, gold = str(tmp_path / "fact"), str(tmp_path / "gold")
    options = L.LoadOptions(L.INCREMENTAL, ("id",), change_feed=True)

    def wanted():
        current = tables.read_current(spark, fact)
        return rows(aggregate_rows(current, SPEC).drop("n_total", "n_paid"))

    L.load(frame(spark, state(6)), fact, SCHEMA, options)
    assert rows(refresh_aggregate(spark, fact, gold, SPEC)) == wanted()
    for seed in (7, 8):
        L.load(frame(spark, state(seed)), fact, SCHEMA, options)
    with monkeypatch.context() as patch:
        patch.setattr("keelstone.plans.gold.aggregate_rows", lambda *a: pytest.fail("taken from all rows"))
        assert rows(refresh_aggregate(spark, fact, gold, SPEC)) == wanted()
        assert rows(refresh_aggregate(spark, fact, gold, SPEC)) == wanted()
    tables.commit(frame(spark, state(9)), fact)  # not followed: taken from all rows
    assert rows(refresh_aggregate(spark, fact, gold, SPEC)) == wanted()
    tables.commit(frame(spark, state(9)).limit(0), fact)
    assert refresh_aggregate(spark, fact, gold, SPEC).count() == 0
