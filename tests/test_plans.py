"""Physical plans: pushdown, pruning, one scan, no needless shuffle."""

from __future__ import annotations

import re
import uuid

import pytest

from keelstone.operators import dedupe as D
from keelstone.operators import incremental as I
from keelstone.operators.merge import merge
from keelstone.plans import medallion as M
from keelstone.plans.catalog import QUERIES
from keelstone.plans.catalog.base import table
from tests.conftest import SMALL
from tests.util import plan


@pytest.fixture
def large(spark):
    """Plans as for large tables: no join is small enough to broadcast by estimate."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def formatted(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def test_extract_pushes_the_mark_into_the_scan(spark):
    part = table(spark, SMALL, "part")
    text = formatted(I.incremental_extract(part, part.filter("p_partkey < 50"), "p_partkey").select("p_name"))
    assert "GreaterThanOrEqual(p_partkey,ScalarSubquery" in text
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string>" in text


def test_suite_reads_only_its_columns(spark):
    text = formatted(QUERIES["dq_invalid_percent"](spark, SMALL))
    assert "ReadSchema: struct<c_custkey:bigint,c_mktsegment:string>" in text
    assert text.count(") Scan parquet") == 1


def test_filter_reaches_the_scan(spark):
    assert re.search(r"GreaterThan\(o_orderkey,\d+\)", formatted(QUERIES["scan_param"](spark, SMALL)))


def test_dedupe_and_merge_share_one_shuffle(large):
    lines = table(large, SMALL, "bronze_lines")
    keys = ["l_orderkey", "l_linenumber"]
    target = table(large, SMALL, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey")
    merged = merge(target, D.latest_per_key(lines, keys, "_ingestion_timestamp"), keys, source_is_unique=True)
    assert plan(merged).count("Exchange") == 2  # one per side


def test_silver_load_shuffles_each_side_once(large):
    lines = table(large, SMALL, "bronze_lines")
    target = table(large, SMALL, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey")
    silver = M.silver_load(lines, target, ["l_orderkey", "l_linenumber"], target.schema)
    assert plan(silver).count("Exchange") == 2


def test_numbering_has_no_single_partition_for_its_rows(large):
    text = plan(QUERIES["fact_load_default"](large, SMALL))
    # The one single-partition exchange holds a row per range, above an aggregate.
    assert text.count("Exchange SinglePartition") == 1
    after = text.split("Exchange SinglePartition", 1)[1]
    assert re.match(r"HashAggregate\(keys=\[_\w+#\d+L\], functions=\[count\(1\)\], output=\[_range", after.split("+-", 2)[1].strip())
    # What precedes was written once: only the written rows and their places are read.
    assert "lineitem.parquet" not in text and "ReadSchema: struct<_at:bigint>" in text


def jobs_started(spark, build) -> int:
    """Jobs that building a frame starts, before any action."""
    group = f"plan-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, "planning")
    build()
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_joins_measure_nothing_while_planning(spark):
    for name in ("fact_stage", "lookup_default", "fact_load_star"):
        QUERIES[name](spark, SMALL)  # schemas of the files are read here
        files = jobs_started(spark, lambda: [table(spark, SMALL, n) for n in ("orders", "lineitem", "part", "supplier")])
        assert jobs_started(spark, lambda: QUERIES[name](spark, SMALL)) <= 2 * max(files, 4), name


def test_three_lookups_read_the_fact_once(large):
    text = plan(QUERIES["fact_load_star"](large, SMALL))
    assert text.count("lineitem.parquet") == 1
    assert "CartesianProduct" not in text


def test_referential_check_shrinks_the_fact_first(large):
    text = plan(QUERIES["dq_referential"](large, SMALL))
    assert text.index("SortMergeJoin") < text.index("partial_count")


def test_bronze_history_is_not_opened(spark, tmp_path):
    path = str(tmp_path / "bronze")
    source = table(spark, SMALL, "src_part")
    for day in ("2024-02-01", "2024-02-02"):
        bronze = M.bronze_ingest(source, path, "erp", f"{day} 00:00:00")
    added = M.added_since(bronze, "2024-02-02 00:00:00")
    assert added.count() == source.count()
    assert "PartitionFilters: [isnotnull(_ingestion_date" in plan(added)
