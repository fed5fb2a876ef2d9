"""Every registered query returns what its SQL returns on DuckDB."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry
from keelstone.operators import joins, keys, lookup, merge, scd
from keelstone.plans import facts
from keelstone.plans.catalog import ORACLES, QUERIES
from tests.check import compare, duck
from tests.conftest import SMALL
from tests.util import plan

# Keys the operator inventory names.
INVENTORY = """
scan_table scan_query scan_param scan_csv sample_rows dataset_inventory column_mapping
derive_expression string_length_check enforce_schema bronze_ingest filter_not_null delete_where
fk_to_unknown mask_sha256 mask_redact mask_by_mapping fn_coalesce fn_date_add fn_date_diff fn_string
fn_case fn_concat fn_nested join_inner fact_stage lookup_ignore lookup_default lookup_rejects
fact_load_validated fact_load_default dedupe_latest dedupe_distinct high_water_mark
incremental_extract incremental_merge union_all union_missing_columns merge_upsert
merge_update_subset merge_insert_only merge_first_load merge_composite_key keyed_update
surrogate_keys unknown_member scd1_upsert scd_classify scd_mixed scd2_dates inferred_members
change_feed full_load partition_replace partitioned_write bronze_append_evolve load_dispatch
layout_preserves_rows load_audit layer_reconcile quarantine_split dq_not_null dq_type
dq_invalid_percent dq_suite dq_key_integrity dq_referential idempotency_check gold_fact_view
load_null_keys first_load_all_rows fact_load_star load_dispatch_partitioned load_table_by_name
unknown_member_text_key gold_revenue_by_customer gold_counts gold_aggregate profile_keys profile_table_type profile_pii
profile_volume profile_partition_key suggest_mapping silver_load medallion_end_to_end
""".split()


def queries():
    return QUERIES


def oracle_sql():
    return ORACLES


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_sql(spark, con, name):
    def planned(session, sf_dir):
        df = queries()[name](session, sf_dir)
        text = plan(df)
        for operator in ("CartesianProduct", "NestedLoopJoin", "EvalPython", "InPandas"):
            assert operator not in text
        return df

    assert compare(spark, con, name, planned, oracle_sql()[name], SMALL) is None


@pytest.mark.parametrize(
    "name", ["fact_load_default", "fact_load_validated", "fact_stage", "keyed_update", "lookup_rejects", "scd_mixed"]
)
def test_query_with_sides_too_large_to_broadcast(spark, con, name, monkeypatch):
    """The same rows when every key over 20 rows is salted."""
    used = []

    def spread(left, right, keys, how="left", rows_per_task=None, broadcast=False):
        used.append(how)
        if how in ("left_semi", "left_anti"):
            right = right.select(*keys).distinct()
        return joins._salted_join(left, right, list(keys), how, 20)

    for module in (facts, keys, lookup, merge, scd):
        if hasattr(module, "keyed_join"):
            monkeypatch.setattr(module, "keyed_join", spread)
    assert compare(spark, con, name, queries()[name], oracle_sql()[name], SMALL) is None
    assert used


def test_inventory_is_covered():
    assert set(INVENTORY) <= set(queries())
    assert set(queries()) == set(oracle_sql())


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["custid", "revenue", "n_lines"]
    assert df.count() > 0
