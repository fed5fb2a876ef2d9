from __future__ import annotations

import random
from datetime import date
from decimal import Decimal

import pytest

from keelstone.operators.scd import ScdSpec
from keelstone.plans import load as L
from keelstone.plans import medallion as M
from keelstone.sinks import folders, partitions, tables
from tests.util import rows

TEXTS = ["", "~", "~~", "~a", "%", "%41", "a/b", "a=b", "__HIVE_DEFAULT_PARTITION__", "null", "01", "1", " ", " x ", ".", "..", "ä\n漢", "\t"]
TYPES = {
    "string": TEXTS,
    "date": [date(1, 1, 1), date(1999, 12, 31), date(2024, 2, 29)],
    "decimal(20,2)": [Decimal("0.00"), Decimal("1.50"), Decimal("-123456789012345678.01")],
    "int": [0, -1, 7],
    "boolean": [True, False],
}


def deliveries(kind, seed):
    """Two deliveries of ``id, v, p``; a later row replaces the same id and partition."""
    made = random.Random(seed)
    values = TYPES[kind]
    one = [(i, made.randrange(9), made.choice(values)) for i in range(40)]
    two = [(i, made.randrange(10, 19), p) for i, _, p in made.sample(one, 15)]
    two += [(100 + i, 5, made.choice(values)) for i in range(15)]
    return one, two


@pytest.mark.parametrize("kind", list(TYPES))
def test_loads_by_partition_equal_whole_ones(spark, tmp_path, kind):
    schema = f"id int, v int, p {kind}"
    one, two = deliveries(kind, 3)
    wanted = {(i, p): v for i, v, p in one} | {(i, p): v for i, v, p in two}
    options = L.LoadOptions(L.INCREMENTAL, ("id", "p"))
    for delivery in (one, two, two):
        frame = spark.createDataFrame(delivery, schema)
        parts = L.load_partitioned(frame, str(tmp_path / "parts"), schema, options, ["p"])
        whole = L.load(frame, str(tmp_path / "whole"), schema, options)
    assert rows(parts.select("id", "v", "p")) == rows(whole) == sorted(repr((i, v, p)) for (i, p), v in wanted.items())
    fact = M.FactTable("f", ("id", "p"), quantity="v", price="v", partition_by=("p",))
    for run, delivery in enumerate((one, two)):
        frame = spark.createDataFrame(delivery, schema)
        gold = M.run_layers(spark, {"f": frame}, [], [fact], str(tmp_path / "layers"), "erp", f"2024-02-0{run + 1} 00:00:00")
    assert rows(gold["f"].select("id", "v", "p")) == rows(whole)


@pytest.mark.parametrize("kind", ["string", "date"])
def test_history_by_partition_equals_the_whole_one(spark, tmp_path, kind):
    schema = f"sk bigint, id int, v int, flag boolean, p {kind}"
    options = L.LoadOptions(L.SCD_2, ("id", "p"), scd=ScdSpec("sk", ("id", "p"), historical=("v",)))
    for delivery in deliveries(kind, 5):
        frame = spark.createDataFrame(delivery, f"id int, v int, p {kind}")
        parts = L.load_partitioned(frame, str(tmp_path / "parts"), schema, options, ["p"])
        whole = L.load(frame, str(tmp_path / "whole"), schema, options)
    assert rows(parts.select("id", "v", "p", "flag")) == rows(whole.select("id", "v", "p", "flag"))
    assert parts.select("sk").distinct().count() == parts.count()


def test_null_and_empty_partitions_stay_apart(spark, tmp_path):
    schema = "id int, p string"
    values = [*enumerate(TEXTS), (90, None), (91, None)]
    frame = spark.createDataFrame(values, schema)
    path, options = str(tmp_path / "t"), L.LoadOptions(L.FULL_OVERWRITE, ("id",))
    stored = L.load_partitioned(frame, path, schema, options, ["p"])
    assert rows(stored) == rows(frame)
    # Only the folder of the empty text is replaced, then only that of NULL.
    for given, gone in ((spark.createDataFrame([(1000, "")], schema), TEXTS.index("")), (spark.createDataFrame([(1001, None)], schema), None)):
        before = {r.id for r in stored.collect()}
        stored = L.load_partitioned(given, path, schema, options, ["p"])
        after = {r.id for r in stored.collect()}
        assert before - after == ({gone} if gone is not None else {90, 91})
    committed = tables.commit(frame, str(tmp_path / "c"), ["p"])
    assert rows(committed) == rows(tables.read_current(spark, str(tmp_path / "c"), ["p"]).select("id", "p")) == rows(frame)
    partitions.append_evolving(frame, str(tmp_path / "e"), ["p"])
    assert rows(partitions.read_evolving(spark, str(tmp_path / "e"), schema, ["p"])) == rows(frame)


def test_filters_on_text_values_choose_folders(spark, tmp_path):
    path = str(tmp_path / "t")
    partitions.write_partitioned(spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, p string"), path, ["p"])
    stored = partitions.read_known(spark, path, "id int, p string", ["p"])
    for text in TEXTS:
        picked = stored.filter(stored.p == text)
        assert [r.id for r in picked.collect()] == [TEXTS.index(text)]
        plan = picked._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan
    touched = partitions.touched_partitions(spark.createDataFrame([("",), ("~",)], "p string"), ["p"])
    picked = stored.filter(touched)
    assert picked.count() == 2
    assert picked._jdf.queryExecution().executedPlan().toString().count("PartitionFilters: []") == 0


def test_folder_names_are_reversible(spark):
    frame = spark.createDataFrame([(t,) for t in [*TEXTS, None]], "p string")
    named = folders.to_folders(frame, ["p"])
    assert named.filter("p = '' OR p = '__HIVE_DEFAULT_PARTITION__'").count() == 0
    assert named.distinct().count() == len(TEXTS) + 1
    assert rows(folders.from_folders(named, ["p"])) == rows(frame)
