from __future__ import annotations

from itertools import combinations

import pytest
from pyspark.sql import functions as F

from keelstone.operators import audit as A
from keelstone.operators import profile as R
from keelstone.operators import quality as Q
from keelstone.operators.columns import ColumnMapping
from keelstone.sinks.tables import empty_frame
from tests.util import plan, rows


def test_contract_from_mappings():
    checks = Q.suite_from_mappings(
        [
            ColumnMapping("email", source_datatype="varchar", is_nullable=False, is_pii=True),
            ColumnMapping("age", source_datatype="integer"),
        ]
    )
    assert [(c.kind, c.column) for c in checks] == [
        ("not_null", "email"), ("missing_count", "email"), ("type", "email"), ("invalid_percent", "email"), ("type", "age"),
    ]
    assert [c.arg for c in checks if c.kind == "type"] == ["String", "Integer"]
    assert checks[3].percent == 5.0
    assert Q.suite_from_mappings([]) is None
    assert Q.suite_from_mappings([ColumnMapping("x", source_datatype="money")]) is None


def test_suite_is_one_scan(spark):
    df = spark.createDataFrame([(1, "a@b.co"), (None, "bad"), (3, None)], "id int, email string")
    checks = Q.suite_from_mappings([ColumnMapping("id", source_datatype="int", is_nullable=False), ColumnMapping("email", is_pii=True)])
    result = Q.run_suite(df, checks)
    assert plan(result).count("Scan") == 1
    assert [tuple(r) for r in result.collect()] == [
        ("not_null", "id", 1, 3, False),
        ("missing_count", "id", 1, 3, False),
        ("type", "id", 0, 3, True),
        ("not_null", "email", 1, 3, False),
        ("invalid_percent", "email", 1, 3, False),
    ]


def test_invalid_percent_is_strictly_below(spark):
    df = spark.range(100).select(F.when(F.col("id") < 5, "bad").otherwise("ok").alias("s"))
    result = [Q.run_suite(df, [Q.Check("invalid_percent", "s", "^ok$", p)]).first()["passed"] for p in (5.0, 5.1)]
    assert result == [False, True]


def test_suite_on_no_rows(spark):
    empty = empty_frame(spark, "id int, s string")
    result = Q.run_suite(empty, [Q.Check("not_null", "id"), Q.Check("invalid_percent", "s", "x", 5.0), Q.Check("max_length", "s", 1), Q.Check("rule", "id", "id > 0")])
    assert {(r["failed"], r["total"], r["passed"]) for r in result.collect()} == {(0, 0, True)}
    with pytest.raises(ValueError):
        Q.run_suite(empty, [])
    with pytest.raises(ValueError):
        Q.run_suite(empty, [Q.Check("magic", "id")])


def test_type_check_on_text(spark):
    df = spark.createDataFrame([("1",), ("1.5",), ("x",), (None,)], "s string")
    failed = {k: Q.run_suite(df, [Q.Check("type", "s", k)]).first()["failed"] for k in Q.TYPE_FAMILIES}
    assert failed == {"Integer": 2, "Float": 1, "Boolean": 2, "String": 0}


def test_quarantine_keeps_every_row(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (None, -1)], "k int, q int")
    good, bad = Q.quarantine_split(df, {"key": "k IS NOT NULL", "positive": "q > 0"})
    assert rows(good) == ["(1, 5)"]
    assert {tuple(r["_violations"]) for r in bad.collect()} == {("positive",), ("key", "positive")}
    assert good.count() + bad.count() == df.count()


def test_key_integrity(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 1), (2, None), (3, 1)], "a int, b int")
    found = {r["check_name"]: (r["failed"], r["total"], r["passed"]) for r in Q.key_integrity(df, ["a", "b"]).collect()}
    assert found == {"null_key": (1, 5, False), "duplicate_key": (2, 5, False)}


def test_referential_integrity_with_a_hot_orphan(spark):
    fact = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 77).otherwise(F.col("id") % 10).cast("int").alias("fk"))
    fact = fact.unionByName(spark.createDataFrame([(None,)], "fk int"))
    dim = spark.range(20).select(F.col("id").alias("id"))
    row = Q.referential_integrity(fact, {"fk": (dim, "id")}).first()
    assert tuple(row) == ("referential", "fk", 1000, 3001, False)


def test_key_search_measures_what_may_be_a_key(spark, monkeypatch):
    # Twelve columns of some values each; seven of them say nothing together.
    n = 6000
    columns = {f"x{k}_id": F.pmod(F.xxhash64(F.lit(k), F.col("id") % 89), F.lit(1000)) for k in range(7)}
    columns |= {"a_id": F.col("id") % 80, "b_id": (F.col("id") / 80).cast("int"), "c_id": F.col("id") % 75, "d_id": (F.col("id") / 75).cast("int")}
    columns |= {"e_id": F.when(F.col("id") > 5, F.col("id"))}
    df = spark.range(n).select(*[c.alias(name) for name, c in columns.items()]).repartition(4).checkpoint()
    measured, sketched = [], []

    def seen(frame, candidate, real=R._measured):
        measured.append(tuple(candidate))
        return real(frame, candidate)

    def screened(frame, candidates, rows, real=R._nearly_unique):
        sketched.append(len(candidates))
        return real(frame, candidates, rows)

    with monkeypatch.context() as patch:
        patch.setattr(R, "_measured", seen)
        patch.setattr(R, "_nearly_unique", screened)
        found = {r.candidate: r for r in R.find_keys(df).collect()}
    keys = {c for c, r in found.items() if r.is_key and "," in c}
    # Every pair and triple by brute force, minimal ones only.
    values = [tuple(r) for r in df.drop("e_id").collect()]
    names = df.drop("e_id").columns
    wanted = set()
    for width in (2, 3):
        for picked in combinations(range(len(names)), width):
            if not any(set(k.split(",")) <= {names[i] for i in picked} for k in wanted):
                if len({tuple(v[i] for i in picked) for v in values}) == n:
                    wanted.add(",".join(names[i] for i in picked))
    assert {"a_id,b_id", "c_id,d_id"} <= wanted and {k for k in keys if k.count(",") < 3} == wanted
    assert sum(sketched) > 100 and len(measured) - 12 < sum(sketched) / 2
    for c, r in found.items():
        assert r.distinct_rows == df.select(*c.split(",")).distinct().count() and r.n_rows == n


def test_profile_keys_and_candidates(spark):
    assert R.key_like(["order_id", "ZipCode", "amount"]) == ["order_id", "ZipCode"]
    df = spark.createDataFrame([(1, 1), (1, 2), (2, None)], "a_id int, b_id int")
    found = {r["candidate"]: (r["distinct_rows"], r["null_rows"], r["is_key"]) for r in R.profile_keys(df).collect()}
    assert found == {"a_id": (2, 0, False), "b_id": (3, 1, False)}  # b_id has a NULL
    wide = spark.range(60).selectExpr("id % 3 AS x_id", "id div 3 % 4 AS y_id", "id div 12 AS z_id", "id % 2 AS w_id", "'v' AS v")
    found = {r["candidate"]: r["is_key"] for r in R.profile_keys(wide).collect()}
    # 3 x 4 values cannot be unique over 60 rows: no pair is measured, and no wider key than needed.
    assert found == {"x_id": False, "y_id": False, "z_id": False, "w_id": False, "x_id,y_id,z_id": True} | {
        c: False for c in found if "w_id" in c and c != "w_id"
    }
    assert "Expand" not in plan(R.profile_table_type("t", wide))
    with pytest.raises(ValueError):
        R.profile_keys(spark.sql("SELECT 1 AS x"))


def test_table_type_name_wins(spark):
    df = spark.sql("SELECT 1 AS order_id, 2.5 AS amount")
    kinds = [R.profile_table_type(n, df).first()["table_type"] for n in ("FactX", "dim_x", "x")]
    assert kinds == ["FACT", "DIMENSION", "DIMENSION"]


def test_pii_by_name_and_by_value(spark):
    df = spark.createDataFrame(
        [("1", "a@b.com", "123-45-6789"), ("2", "c@d.org", "+49 30 1234567"), ("3", None, "n")],
        "home_address string, contact string, note string",
    )
    found = {r["column_name"]: (r["name_hit"], r["email_hits"], r["phone_hits"], r["ssn_hits"], r["is_pii"]) for r in R.profile_pii(df).collect()}
    assert found == {
        "home_address": (True, 0, 0, 0, True),
        "contact": (False, 2, 0, 0, True),
        "note": (False, 0, 2, 1, True),
    }


def test_partition_key_prefers_most_days(spark):
    df = spark.range(100).selectExpr("date_add(DATE '2024-01-01', CAST(id % 30 AS INT)) AS sold", "DATE '2024-01-01' AS loaded")
    found = {r["column_name"]: (r["n_days"], r["max_rows_per_day"], r["suggested"]) for r in R.profile_partition_key(df).collect()}
    assert found == {"sold": (30, 4, True), "loaded": (1, 100, False)}


def test_suggested_types():
    assert [R.suggested_type(t) for t in ("INT", "VARCHAR", "DATETIME", "DECIMAL(19,4)")] == ["BIGINT", "STRING", "TIMESTAMP", "DECIMAL(19,4)"]


def test_suggest_mapping_without_text(spark):
    row = R.suggest_mapping(spark.sql("SELECT 1 AS Phone_No")).first()
    assert (row["target_column"], row["target_datatype"], row["transformation_rule"], row["is_pii"]) == ("phone_no", "BIGINT", "CAST", True)


def test_audit_counts_come_with_the_write(spark, tmp_path):
    df = spark.range(10)
    counted, counter = A.observed(df, "run-1", {"read": None, "even": F.col("id") % 2 == 0})
    counted.write.parquet(str(tmp_path / "out"))
    found = A.audit_rows(spark, "job", counter, "2024-02-01 00:00:00")
    assert {r["step"]: r["n_rows"] for r in found.collect()} == {"read": 10, "even": 5}


def test_reconcile_reports_an_imbalance(spark):
    found = A.reconcile({"a": spark.range(5), "b": spark.range(3), "c": spark.range(1)}, {"a": ["b", "c"]})
    assert [tuple(r) for r in found.collect()] == [("a", 5, 4, False), ("b", 3, 3, True), ("c", 1, 1, True)]
