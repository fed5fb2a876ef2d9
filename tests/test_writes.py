from __future__ import annotations

import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from keelstone.operators.changes import change_feed, difference_count
from keelstone.plans import load as L
from keelstone.plans import medallion as M
from keelstone.plans.catalog.base import table
from keelstone.plans.facts import fact_load
from keelstone.operators.lookup import Lookup
from keelstone.sinks import layout, partitions, tables
from keelstone.sources import jdbc, scans
from keelstone.streaming.micro_batches import load_stream
from tests.conftest import SMALL
from tests.util import plan, rows


def test_commits_are_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    assert not tables.table_exists(spark, path)
    with pytest.raises(FileNotFoundError):
        tables.read_current(spark, path)
    assert tables.load_or_empty(spark, path, "id bigint").count() == 0
    tables.commit(spark.range(1), path)
    # A state computed from the current one.
    tables.commit(tables.read_current(spark, path).unionByName(spark.range(5, 6)), path)
    assert tables.versions(spark, path) == [1, 2]
    feed = change_feed(tables.read_version(spark, path, 1), tables.read_current(spark, path), ["id"])
    assert [tuple(r) for r in feed.collect()] == [(5, "insert")]
    tables.commit(spark.range(9), path)
    assert tables.versions(spark, path) == [1, 2, 3]  # readers of the first one have a week
    tables.commit(spark.range(2), path, retention_hours=0)
    assert tables.versions(spark, path) == [3, 4]
    tables.roll_back(spark, path)
    tables.commit(spark.range(2), path, keep=1, retention_hours=0)
    assert tables.versions(spark, path) == [4]
    tables.commit(spark.range(5), path)
    assert tables.roll_back(spark, path).count() == 2
    with pytest.raises(ValueError):
        tables.roll_back(spark, path)


def test_failed_write_is_never_current(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.commit(spark.range(3), path)
    broken = spark.range(3).select(F.raise_error(F.lit("broken on purpose")).cast("bigint").alias("id"))
    with pytest.raises(Exception, match="broken on purpose"):
        tables.commit(broken, path)
    assert tables.read_current(spark, path).count() == 3
    tables.commit(spark.range(4), path)
    assert tables.read_current(spark, path).count() == 4


def test_partitions_merge_touches_only_what_it_must(spark, tmp_path):
    path = str(tmp_path / "p")
    base = spark.range(100).select("id", (F.col("id") % 4).cast("int").alias("day"), F.lit("old").alias("v"))
    partitions.write_partitioned(base, path, ["day"])
    before = {f for f in spark.read.parquet(path).inputFiles() if "day=2" not in f}
    increment = spark.createDataFrame([(2, 2, "new"), (1000, 2, "new")], "id bigint, day int, v string")
    partitions.merge_partitions(increment, path, ["id", "day"], ["day"])
    stored = spark.read.parquet(path)
    assert stored.count() == 101 and sorted(r["id"] for r in stored.filter("v = 'new'").collect()) == [2, 1000]
    assert before == {f for f in stored.inputFiles() if "day=2" not in f}
    with pytest.raises(ValueError, match="part of the merge key"):
        partitions.merge_partitions(increment, path, ["id"], ["day"])


def _leaves(df):
    """Metrics of the leaves of a plan that has run."""
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    for i in range(leaves.size()):
        metrics, names = leaves.apply(i).metrics(), []
        keys = metrics.keysIterator()
        while keys.hasNext():
            names.append(keys.next())
        yield {name: metrics.apply(name).value() for name in names}


def test_touched_partitions_prune_folders(spark, tmp_path):
    path = str(tmp_path / "p")
    base = spark.range(10).withColumn("day", F.when(F.col("id") < 8, F.col("id") % 4).cast("int"))
    partitions.write_partitioned(base, path, ["day"])
    stored = spark.read.parquet(path)
    picked = stored.filter(partitions.touched_partitions(base.filter("day = 1"), ["day"]))
    assert re.search(r"PartitionFilters: \[\(?array_contains\(.*[Ss]ubquery", plan(picked)) and picked.count() == 2
    # The subquery is evaluated before the scan, which opens one folder of five.
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        picked = stored.filter(partitions.touched_partitions(base.filter("day = 1"), ["day"]))
        picked._jdf.queryExecution().executedPlan().execute().count()
        (scan,) = [leaf for leaf in _leaves(picked) if "numPartitions" in leaf]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert scan["numPartitions"] == 1
    # The folder of NULLs is a partition like any other.
    assert stored.filter(partitions.touched_partitions(base.filter("day is null"), ["day"])).count() == 2


def test_hot_partition_is_split(spark, tmp_path):
    path = str(tmp_path / "hot")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64KB")
    try:
        df = spark.range(0, 60000, 1, 8).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 20).alias("day"))
        partitions.write_partitioned(df, path, ["day"])
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = spark.read.parquet(path).inputFiles()
    assert sum("day=0/" in f for f in files) > 1
    assert spark.read.parquet(path).count() == 60000


def test_fixed_append_fails_on_a_bad_value(spark, tmp_path):
    df = spark.sql("SELECT 'x' AS n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        partitions.append_fixed(df, str(tmp_path / "a"), "n int")


def test_evolving_read_with_a_named_schema(spark, tmp_path):
    path = str(tmp_path / "e")
    partitions.append_evolving(spark.sql("SELECT 1 AS a"), path)
    partitions.append_evolving(spark.sql("SELECT 2 AS a, 'x' AS b"), path)
    named = partitions.read_evolving(spark, path, "a int, b string")
    assert rows(named) == rows(partitions.read_evolving(spark, path)) == ["(1, None)", "(2, 'x')"]


def test_clustering_narrows_every_column(spark, tmp_path):
    df = spark.range(0, 20000, 1, 4).select(
        (F.xxhash64("id") % 1000).alias("a"), (F.xxhash64("id", F.lit(1)) % 1000).alias("b"), F.col("id").cast("string").alias("s")
    )
    clustered = layout.compact_and_cluster(df, ["a", "b"], 16)
    spans = clustered.groupBy(F.spark_partition_id().alias("p")).agg(
        (F.max("a") - F.min("a")).alias("a"), (F.max("b") - F.min("b")).alias("b")
    )
    average = spans.agg(F.avg("a").alias("a"), F.avg("b").alias("b")).first()
    assert average["a"] < 1400 and average["b"] < 1400  # unclustered files span all 2,000
    assert difference_count(df, clustered).first()[0] == 0
    sampled = layout.compact_and_cluster(df, ["a", "b"], 16, border_sample=0.1)
    assert difference_count(df, sampled).first()[0] == 0


def test_clustering_splits_a_crowded_cell(spark):
    df = spark.range(0, 9000, 1, 6).select(F.when(F.col("id") % 3 > 0, 5).otherwise(F.col("id")).alias("a"), F.lit("same").alias("b"))
    clustered = layout.compact_and_cluster(df, ["a", "b"], 9)
    sizes = clustered.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
    assert sizes < 3000 and clustered.count() == 9000
    with pytest.raises(ValueError):
        layout.compact_and_cluster(df.withColumn("arr", F.array("a")), ["arr", "a"], 2)


def test_clustering_on_prefixed_text(spark):
    customers = spark.read.parquet(f"{SMALL}/customer.parquet").select("c_name", "c_custkey")
    cells = layout.with_z_value(customers, ["c_name"], bits=6)
    assert cells.select("_z").distinct().count() > 50
    files = layout.compact_and_cluster(customers, ["c_name"], 10)
    spans = files.groupBy(F.spark_partition_id()).agg(F.min("c_name").alias("low"), F.max("c_name").alias("high"))
    ends = sorted(tuple(r)[1:] for r in spans.collect())
    assert len(ends) == 10 and all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))
    assert layout.range_bits(1 << 20, 2) == layout.MOST_BITS and layout.range_bits(8, 3) == layout.LEAST_BITS


# ---------------------------------------------------------------- loads

ORDERS = "id int, v string, t int"


def test_load_strategies(spark, tmp_path):
    source = spark.createDataFrame([("1", "a", 1), ("1", "b", 2), ("2", "c", 2)], "id string, v string, t int")
    path = str(tmp_path / "inc")
    options = L.LoadOptions(L.INCREMENTAL, ("id",), watermark="t", ignore_duplicates=True)
    assert rows(L.load(source, path, ORDERS, options)) == ["(1, 'b', 2)", "(2, 'c', 2)"]
    later = spark.createDataFrame([("2", "late", 2), ("2", "d", 3), ("3", "e", 3)], "id string, v string, t int")
    assert rows(L.load(later, path, ORDERS, options)) == ["(1, 'b', 2)", "(2, 'd', 3)", "(3, 'e', 3)"]
    # Without a watermark the source is the increment, late rows too.
    plain = L.LoadOptions(L.INCREMENTAL, ("id",), newest_by="t", ignore_duplicates=True)
    assert rows(L.load(source.filter("id = '2'"), path, ORDERS, plain))[1] == "(2, 'c', 2)"
    with pytest.raises(Exception, match="source rows are not unique"):
        L.load(source, path, ORDERS, L.LoadOptions(L.FULL_OVERWRITE, ("id",)))
    bad = spark.createDataFrame([("x", "a", 1)], "id string, v string, t int")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        L.load(bad, path, ORDERS, L.LoadOptions(L.FULL_OVERWRITE, ("id",)))
    loose = L.LoadOptions(L.FULL_OVERWRITE, ("id",), strict_types=False)
    with pytest.raises(Exception, match="NULL key in a source row"):
        L.load(bad, path, ORDERS, loose)
    aside = str(tmp_path / "aside")
    assert rows(L.load(bad, path, ORDERS, replace(loose, quarantine=aside))) == []
    assert rows(spark.read.parquet(aside)) == ["(None, 'a', 1, 'NULL key')"]
    limited = L.LoadOptions(L.FULL_OVERWRITE, ("id",), ignore_duplicates=True, lengths={"v": 1})
    assert L.load(source, path, ORDERS, limited).count() == 2
    with pytest.raises(Exception, match="value too long for v"):
        L.load(source.withColumn("v", F.lit("xy")), path, ORDERS, limited)
    with pytest.raises(ValueError, match="columns missing"):
        L.load(source.drop("v"), path, ORDERS, limited)
    for wrong in (L.LoadOptions("MAGIC", ("id",)), L.LoadOptions(L.SCD_2, ("id",))):
        with pytest.raises(ValueError):
            L.next_state(bad, bad, wrong)


def test_load_by_partition(spark, tmp_path):
    path, schema = str(tmp_path / "parts"), "id int, v string, t int, day string"
    options = L.LoadOptions(L.INCREMENTAL, ("id", "day"), watermark="t", ignore_duplicates=True)

    def arrive(values):
        df = spark.createDataFrame(values, schema)
        return L.load_partitioned(df, path, schema, options, ["day"])

    arrive([(1, "a", 1, "mon"), (2, "b", 2, "tue"), (2, "c", 3, "tue")])
    kept = {f for f in spark.read.parquet(path).inputFiles() if "day=mon" in f}
    state = arrive([(1, "old", 1, "mon"), (2, "d", 4, "tue"), (3, "e", 4, "wed")])
    assert rows(state) == ["(1, 'a', 1, 'mon')", "(2, 'd', 4, 'tue')", "(3, 'e', 4, 'wed')"]
    assert kept == {f for f in spark.read.parquet(path).inputFiles() if "day=mon" in f}
    assert rows(arrive([(1, "old", 1, "mon")])) == rows(state)  # nothing above the mark
    replaced = spark.createDataFrame([(9, "z", 9, "mon")], schema)
    full = L.load_partitioned(replaced, path, schema, L.LoadOptions(L.FULL_OVERWRITE, ("id",)), ["day"])
    assert rows(full) == ["(2, 'd', 4, 'tue')", "(3, 'e', 4, 'wed')", "(9, 'z', 9, 'mon')"]
    with pytest.raises(ValueError):
        L.load_partitioned(replaced, path, schema, L.LoadOptions("MAGIC", ("id",)), ["day"])


def test_loads_of_nothing_leave_a_table_that_can_be_loaded(spark, tmp_path):
    schema = "id int, v string, day string"
    some = spark.createDataFrame([(1, "a", "mon")], schema)
    for strategy in (L.INCREMENTAL, L.FULL_OVERWRITE):
        path, options = str(tmp_path / strategy), L.LoadOptions(strategy, ("id", "day"))
        assert L.load_partitioned(some.limit(0), path, schema, options, ["day"]).count() == 0
        assert rows(L.load_partitioned(some, path, schema, options, ["day"])) == ["(1, 'a', 'mon')"]
    assert tables.commit(some.limit(0), str(tmp_path / "c"), ["day"]).columns == ["id", "v", "day"]


def test_null_keys_fail_or_go_aside_in_every_load(spark, tmp_path):
    schema = "id int, t int, day string"
    source = spark.createDataFrame([(1, 1, "mon"), (None, 1, "mon"), (None, 2, "mon"), (2, None, "mon")], schema)
    for number, run in enumerate((L.load, lambda *a: L.load_partitioned(*a, ["day"]))):
        path, aside = str(tmp_path / f"t{number}"), str(tmp_path / f"aside{number}")
        options = L.LoadOptions(L.INCREMENTAL, ("id", "day"), watermark="t")
        for _ in range(2):
            with pytest.raises(Exception, match="in a source row"):
                run(source, path, schema, options)
            state = run(source, path, schema, replace(options, quarantine=aside))
            assert rows(state) == ["(1, 1, 'mon')"]
        reasons = spark.read.parquet(aside).groupBy("_reason").count()
        assert rows(reasons) == ["('NULL key', 4)", "('NULL watermark', 2)"]


def test_thousands_of_two_column_partitions(spark, tmp_path):
    path = str(tmp_path / "many")
    rows_in = spark.range(5000).select("id", (F.col("id") % 100).alias("a"), (F.col("id") / 100).cast("int").alias("b"))
    chosen = partitions.touched_partitions(rows_in, ["a", "b"])
    folders = rows_in.filter("id < 300")
    partitions.write_partitioned(folders, path, ["a", "b"])
    assert spark.read.parquet(path).filter(chosen).count() == 300
    assert rows_in.filter(chosen).count() == 5000


def test_late_members_reach_old_partitions(spark, tmp_path):
    def run(name, partition_by):
        gold = None
        for day, products in enumerate(([1], [1, 2])):
            sources = {
                "product": spark.createDataFrame([(p, f"p{p}") for p in products], "productid int, name string"),
                "sales": spark.createDataFrame([(1, 1, 1, 2.0, "a"), (2, 2, 1, 3.0, "b")][: 2 - day], "orderid int, productid int, qty int, price double, part string"),
            }
            gold = M.run_layers(
                spark,
                sources,
                [M.DimensionTable("product", ("productid",), "productkey")],
                [M.FactTable("sales", ("orderid", "part"), {"productid": ("product", "productid")}, price="price", partition_by=partition_by)],
                str(tmp_path / name),
                "erp",
                f"2024-02-0{day + 1} 00:00:00",
            )
        return rows(gold["sales"].select("orderid", "productkey"))

    assert run("whole", ()) == run("parts", ("part",)) == ["(1, 1)", "(2, 2)"]


def test_a_repeated_run_replaces_its_bronze(spark, tmp_path):
    for _ in range(2):
        bronze = M.bronze_ingest(spark.range(3), str(tmp_path / "b"), "erp", "2024-02-01 00:00:00")
        assert bronze.count() == 3
    assert M.bronze_ingest(spark.range(3), str(tmp_path / "b"), "erp", "2024-02-01 01:00:00").count() == 6


def test_tables_by_name(spark, tmp_path):
    name = f"by_name_{tmp_path.name.replace('-', '_')}"
    tables.commit_table(spark.createDataFrame([(1, "a")], "id int, v string"), name, str(tmp_path / "t"))
    later = spark.createDataFrame([(1, "b"), (2, "c")], "id int, v string")
    assert rows(L.load(later, name, "id int, v string", L.LoadOptions(L.INCREMENTAL, ("id",)))) == ["(1, 'b')", "(2, 'c')"]
    view = tables.publish_catalog_view(spark, f"{name}_view", f"SELECT v FROM {name} WHERE id = 2")
    assert rows(view) == ["('c',)"]
    assert {r[0]: r[2] for r in scans.catalog_inventory(spark).collect()}[name] == 2


def test_stage_replaces(spark, tmp_path):
    path = str(tmp_path / "stage")
    tables.stage(spark.range(5), path)
    assert tables.stage(spark.range(2), path).count() == 2


def test_execute_task(spark, tmp_path):
    spark.range(10).selectExpr("CAST(id AS INT) AS id", "'v' AS v", "CAST(id AS INT) AS t").createOrReplaceTempView("task_source")
    context = {
        "source": "SELECT * FROM task_source WHERE id > :lo",
        "variables": {"lo": 6},
        "target": str(tmp_path / "task"),
        "schema": ORDERS,
        "business_keys": ["id"],
        "load_strategy": L.INCREMENTAL,
        "watermark": "t",
    }
    assert L.execute_task(spark, context).count() == 3
    context |= {"source": "task_source", "variables": None}
    assert L.execute_task(spark, context).count() == 3  # nothing above the mark


def test_layers_run_twice_change_nothing(spark, tmp_path):
    sources = {"product": table(spark, SMALL, "src_part"), "sales": table(spark, SMALL, "lines_dirty")}
    dims = [M.DimensionTable("product", ("productid",), "productkey")]
    facts = [M.FactTable("sales", ("l_orderkey", "l_linenumber"), {"l_partkey": ("product", "productid")}, price="price")]
    first = M.run_layers(spark, sources, dims, facts, str(tmp_path), "erp", "2024-02-01 00:00:00")
    first = {n: df.checkpoint() for n, df in first.items()}
    second = M.run_layers(spark, sources, dims, facts, str(tmp_path), "erp", "2024-02-02 00:00:00")
    for name in first:
        assert difference_count(first[name], second[name]).first()[0] == 0
    assert second["product"].filter("productkey = -1").count() == 1
    lines = sources["sales"].select("l_orderkey", "l_linenumber").distinct().count()
    assert second["sales"].count() == lines
    assert second["sales"].filter("productkey IS NULL").count() == 0


def test_partitioned_facts_equal_rewritten_ones(spark, tmp_path):
    lines = table(spark, SMALL, "lines_dirty").withColumn("part", F.concat(F.lit("0"), F.pmod("l_orderkey", F.lit(5)).cast("string")))
    product = table(spark, SMALL, "src_part")
    dims = [M.DimensionTable("product", ("productid",), "productkey")]
    keys, refs = ("l_orderkey", "l_linenumber", "part"), {"l_partkey": ("product", "productid")}
    more = lines.filter("part IN ('02', '03')").withColumn("qty", F.lit(3).cast("smallint"))
    gold = {}
    for name, by in (("whole", ()), ("parts", ("part",))):
        facts = [M.FactTable("sales", keys, refs, price="price", partition_by=by)]
        for day, rows_in in (("01", lines), ("02", more)):
            sources = {"product": product, "sales": rows_in}
            state = M.run_layers(spark, sources, dims, facts, str(tmp_path / name), "erp", f"2024-02-{day} 00:00:00")
            if day == "01":
                first = {f for f in state["sales"].inputFiles() if "part=02" not in f and "part=03" not in f}
        gold[name] = state["sales"].select(*sorted(state["sales"].columns))
    assert gold["whole"].schema.simpleString() == gold["parts"].schema.simpleString()
    assert difference_count(gold["whole"], gold["parts"]).first()[0] == 0
    kept = {f for f in gold["parts"].inputFiles() if "part=02" not in f and "part=03" not in f}
    assert kept == first and len(kept) >= 3


def test_text_partitions_stay_text(spark, tmp_path):
    path = str(tmp_path / "t")
    partitions.write_partitioned(spark.createDataFrame([(1, "01", "a")], "id int, p string, v string"), path, ["p"])
    partitions.merge_partitions(spark.createDataFrame([(1, "01", "b")], "id int, p string, v string"), path, ["id", "p"], ["p"])
    stored = spark.read.schema("id int, v string, p string").parquet(path)
    assert rows(stored) == ["(1, 'b', '01')"]


def test_fact_load_into_a_target(spark):
    dim = spark.createDataFrame([(7, 1)], "pk bigint, pid int")
    spec = Lookup(dim, {"pid": "pid"}, {"pk": "pk"})
    schema = "oid int, pid int, qty int"
    first = fact_load(spark.createDataFrame([(2, 1, 5), (1, None, 6)], schema), [spec], ["oid", "pid"], "sk")
    assert sorted(map(tuple, first.collect())) == [(-1, 1, 6, -1, 1), (1, 2, 5, 7, 2)]
    again = spark.createDataFrame([(2, 1, 50), (0, 1, 9), (2, 1, 50)], schema)
    second = fact_load(again, [spec], ["oid", "pid"], "sk", target=first)
    assert sorted(map(tuple, second.select("sk", "oid", "pid", "qty", "pk").collect())) == [
        (1, 1, -1, 6, -1), (2, 2, 1, 50, 7), (3, 0, 1, 9, 7),
    ]


def test_silver_masks(spark):
    from keelstone.operators.columns import ColumnMapping, add_ingest_columns

    bronze = add_ingest_columns(spark.sql("SELECT 1 AS id, 'a@b.c' AS email"), "crm", "2024-02-01 00:00:00")
    silver = M.silver_load(bronze, None, ["id"], "id bigint, email string", [ColumnMapping("email", is_pii=True, mask="redact")])
    assert [tuple(r) for r in silver.collect()] == [(1, "REDACTED")]


def test_stream_of_files(spark, tmp_path):
    inbox, path = tmp_path / "inbox", str(tmp_path / "table")
    options = L.LoadOptions(L.INCREMENTAL, ("id",), newest_by="t", ignore_duplicates=True)

    def deliver(values):
        spark.createDataFrame(values, ORDERS).coalesce(1).write.mode("append").parquet(str(inbox))
        stream = spark.readStream.schema(ORDERS).parquet(str(inbox))
        query = load_stream(stream, path, ORDERS, options, str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination(120)

    deliver([(1, "a", 1), (1, "b", 2), (2, "c", 1)])
    deliver([(2, "d", 5), (3, "e", 1)])
    assert rows(tables.read_current(spark, path)) == ["(1, 'b', 2)", "(2, 'd', 5)", "(3, 'e', 1)"]


# ---------------------------------------------------------------- sources


def test_csv_modes(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_text("id,name\n1,a\nx,b\n3,c\n")
    loose = scans.scan_csv(spark, str(path), "id int, name string", strict=False)
    assert rows(loose) == ["(1, 'a', None)", "(3, 'c', None)", "(None, 'b', 'x,b')"]
    with pytest.raises(Exception, match="(?i)malformed"):
        scans.scan_csv(spark, str(path), "id int, name string").collect()


def test_query_values_are_bound(spark):
    names = spark.createDataFrame([("a",), ("a' OR '1'='1",)], "n string")
    found = scans.scan_query(spark, "SELECT * FROM {names} WHERE n = :n", {"names": names}, {"n": "a' OR '1'='1"})
    assert found.count() == 1


def test_catalog_inventory(spark):
    found = scans.dataset_inventory({"a": spark.range(3), "b": spark.range(0)})
    assert rows(found) == ["('a', 'TABLE', 3)", "('b', 'TABLE', 0)"]


def test_jdbc_options():
    read = jdbc.jdbc_read_options("jdbc:x", "SELECT 1", "id", 0, 100, 8)
    assert read["dbtable"] == "(SELECT 1) AS src" and read["numPartitions"] == "8"
    assert "partitionColumn" not in jdbc.jdbc_read_options("jdbc:x", "SELECT 1")
    with pytest.raises(ValueError):
        jdbc.jdbc_read_options("jdbc:x", "SELECT 1", "id")
    write = jdbc.jdbc_write_options("jdbc:x", "t", 4, 500, truncate="true")
    assert (write["numPartitions"], write["batchsize"], write["truncate"]) == ("4", "500", "true")
