"""Quality suites, quarantine, integrity and profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelstone.operators import profile as R
from keelstone.operators import quality as Q
from keelstone.operators.columns import VIOLATIONS
from keelstone.plans.catalog.base import TABLES, query, table
from keelstone.plans.catalog.rows import CUSTOMER_MAPPINGS

EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
EMAIL_SQL = r"NOT regexp_matches(email, '^[^@\s]+@[^@\s]+\.[^@\s]+$')"


def _check(name: str, column: str, failing: str, rows: str = "cust_raw", percent: float = 0) -> str:
    failed = f"COUNT(*) FILTER (WHERE {failing})"
    passed = f"{failed} * 100.0 < COUNT(*) * {percent}" if percent else f"{failed} = 0"
    return f"""SELECT '{name}' AS check_name, '{column}' AS column_name, {failed} AS failed,
                      COUNT(*) AS total, {passed} AS passed FROM {rows}"""


def _union(*parts: str) -> str:
    return " UNION ALL ".join(parts)


NOT_NULL_SQL = [
    _check("not_null", c, f"{c} IS NULL") for c in ("custid", "contactname", "segment")
] + [_check("missing_count", "acctbal", "acctbal IS NULL")]


@query("dq_not_null", _union(*NOT_NULL_SQL), "cust_raw")
def dq_not_null(spark, sf):
    checks = [Q.Check("not_null", c) for c in ("custid", "contactname", "segment")]
    return Q.run_suite(table(spark, sf, "cust_raw"), [*checks, Q.Check("missing_count", "acctbal")])


@query(
    "dq_type",
    _union(
        _check("type", "custid", "FALSE"),
        _check("type", "acctbal", "acctbal IS NOT NULL AND TRY_CAST(acctbal AS DOUBLE) IS NULL"),
        _check("type", "segment", "FALSE"),
        _check("type", "c_nationkey", "TRUE"),
    ),
    "cust_raw",
)
def dq_type(spark, sf):
    expected = {"custid": "Integer", "acctbal": "Float", "segment": "String", "c_nationkey": "Boolean"}
    return Q.run_suite(
        table(spark, sf, "cust_raw"), [Q.Check("type", c, kind) for c, kind in expected.items()]
    )


@query(
    "dq_invalid_percent",
    _union(
        _check("invalid_percent", "email", EMAIL_SQL, percent=5),
        _check("invalid_percent", "segment", "NOT regexp_matches(segment, '^[A-Z]+$')", percent=5),
    ),
    "cust_raw",
)
def dq_invalid_percent(spark, sf):
    checks = [
        Q.Check("invalid_percent", "email", EMAIL, 5.0),
        Q.Check("invalid_percent", "segment", "^[A-Z]+$", 5.0),
    ]
    return Q.run_suite(table(spark, sf, "cust_raw"), checks)


CONTACT_SQL = r"NOT regexp_matches(contactname, '^[^@\s]+@[^@\s]+\.[^@\s]+$')"


@query(
    "dq_suite",
    _union(
        _check("not_null", "custid", "custid IS NULL"),
        _check("missing_count", "custid", "custid IS NULL"),
        _check("type", "custid", "FALSE"),
        _check("not_null", "contactname", "contactname IS NULL"),
        _check("type", "contactname", "FALSE"),
        _check("invalid_percent", "contactname", CONTACT_SQL, percent=5),
        _check("type", "acctbal", "FALSE"),
        _check("type", "segment", "FALSE"),
        _check("not_null", "email", "email IS NULL"),
        _check("type", "email", "FALSE"),
        _check("invalid_percent", "email", EMAIL_SQL, percent=5),
        _check("max_length", "segment", "LENGTH(segment) > 9"),
        _check("rule", "acctbal", "NOT COALESCE(TRY_CAST(acctbal AS DECIMAL(19,4)) >= 0, FALSE)"),
    ),
    "cust_raw",
)
def dq_suite(spark, sf):
    checks = Q.suite_from_mappings(CUSTOMER_MAPPINGS, EMAIL) or []
    more = [
        Q.Check("max_length", "segment", 9),
        Q.Check("rule", "acctbal", "try_cast(acctbal AS DECIMAL(19,4)) >= 0"),
    ]
    return Q.run_suite(table(spark, sf, "cust_raw"), [*checks, *more])


def _integrity(rows: str, keys: str) -> str:
    null = " OR ".join(f"{k} IS NULL" for k in keys.split(","))
    return f"""SELECT check_name, '{keys}' AS column_name, CAST(failed AS BIGINT) AS failed,
                      CAST(total AS BIGINT) AS total, failed = 0 AS passed
               FROM (SELECT 'null_key' AS check_name, COUNT(*) FILTER (WHERE {null}) AS failed,
                            COUNT(*) AS total FROM {rows}
                     UNION ALL
                     SELECT 'duplicate_key', SUM(CASE WHEN {null} THEN 0 ELSE n - 1 END), SUM(n)
                     FROM (SELECT {keys}, COUNT(*) AS n FROM {rows} GROUP BY {keys}) g) c"""


@query(
    "dq_key_integrity",
    _union(_integrity("lines_dirty", "l_orderkey,l_linenumber"), _integrity("lines_dirty", "l_orderkey,l_partkey")),
    "lines_dirty",
)
def dq_key_integrity(spark, sf):
    lines = table(spark, sf, "lines_dirty")
    return Q.key_integrity(lines, ["l_orderkey", "l_linenumber"]).unionByName(
        Q.key_integrity(lines, ["l_orderkey", "l_partkey"])
    )


def _reference(fk: str, dim: str, key: str) -> str:
    failing = f"f.{fk} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {dim} d WHERE d.{key} = f.{fk})"
    return f"""SELECT 'referential' AS check_name, '{fk}' AS column_name, COUNT(*) FILTER (WHERE bad) AS failed,
                      COUNT(*) AS total, COUNT(*) FILTER (WHERE bad) = 0 AS passed
               FROM (SELECT {failing} AS bad FROM lines_dirty f) t"""


@query(
    "dq_referential",
    _union(
        _reference("l_partkey", "dim_part", "productid"),
        _reference("l_suppkey", "supplier", "s_suppkey"),
        _reference("l_orderkey", "orders", "o_orderkey"),
    ),
    "lines_dirty",
    "dim_part",
)
def dq_referential(spark, sf):
    return Q.referential_integrity(
        table(spark, sf, "lines_dirty"),
        {
            "l_partkey": (table(spark, sf, "dim_part"), "productid"),
            "l_suppkey": (table(spark, sf, "supplier"), "s_suppkey"),
            "l_orderkey": (table(spark, sf, "orders"), "o_orderkey"),
        },
    )


LINE_RULES = {"has_product": "l_partkey IS NOT NULL", "has_quantity": "qty IS NOT NULL", "price_positive": "price > 0"}


@query(
    "quarantine_split",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, qty, price, discount,
              CONCAT_WS(',', CASE WHEN l_partkey IS NULL THEN 'has_product' END,
                             CASE WHEN qty IS NULL THEN 'has_quantity' END,
                             CASE WHEN NOT COALESCE(price > 0, FALSE) THEN 'price_positive' END)
                  AS violations
       FROM lines_dirty""",
    "lines_dirty",
)
def quarantine_split(spark, sf):
    good, bad = Q.quarantine_split(table(spark, sf, "lines_dirty"), LINE_RULES)
    listed = bad.withColumn("violations", F.array_join(VIOLATIONS, ",")).drop(VIOLATIONS)
    return good.withColumn("violations", F.lit("")).unionByName(listed)


# ---------------------------------------------------------------- profiling

CANDIDATES = {
    "lineitem": [("l_orderkey",), ("l_orderkey", "l_linenumber"), ("l_orderkey", "l_partkey"), ("l_partkey", "l_suppkey")],
    "orders": [("o_orderkey",), ("o_custkey",), ("o_custkey", "o_orderkey")],
}


def _key_sql(name: str, keys: tuple[str, ...]) -> str:
    listed, null = ", ".join(keys), " OR ".join(f"{k} IS NULL" for k in keys)
    return f"""SELECT '{name}' AS table_name, '{','.join(keys)}' AS candidate, n_rows, distinct_rows, null_rows,
                      distinct_rows = n_rows AND null_rows = 0 AS is_key
               FROM (SELECT COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE {null}) AS null_rows FROM {name}) a,
                    (SELECT COUNT(*) AS distinct_rows FROM (SELECT DISTINCT {listed} FROM {name}) d) b"""


@query("profile_keys", _union(*[_key_sql(n, k) for n, keys in CANDIDATES.items() for k in keys]))
def profile_keys(spark, sf):
    found = [
        R.profile_keys(table(spark, sf, name), keys).select(F.lit(name).alias("table_name"), "*")
        for name, keys in CANDIDATES.items()
    ]
    return found[0].unionByName(found[1])


# Table -> key-like columns, number of measures, number of date columns.
SHAPES = {
    "region": (["r_regionkey"], 0, 0),
    "nation": (["n_nationkey", "n_regionkey"], 0, 0),
    "customer": (["c_custkey", "c_nationkey"], 1, 0),
    "supplier": (["s_suppkey", "s_nationkey"], 1, 0),
    "part": (["p_partkey"], 2, 0),
    "orders": (["o_orderkey", "o_custkey"], 1, 1),
    "lineitem": (["l_orderkey", "l_partkey", "l_suppkey"], 5, 1),
    "events": (["event_id", "user_id"], 1, 1),
}


def _type_sql(name: str) -> str:
    keys, measures, dates = SHAPES[name]
    foreign = " + ".join(f"CAST(COUNT(DISTINCT {k}) < COUNT(*) AS BIGINT)" for k in keys)
    return f"""SELECT '{name}' AS table_name, n_foreign_keys,
                      CAST({measures} AS BIGINT) AS n_measures, CAST({dates} AS BIGINT) AS n_dates,
                      CASE WHEN n_foreign_keys > 0 AND {measures} > 0 AND {dates} > 0 THEN 'FACT'
                           ELSE 'DIMENSION' END AS table_type
               FROM (SELECT {foreign} AS n_foreign_keys FROM {name}) k"""


@query("profile_table_type", _union(*[_type_sql(n) for n in TABLES]))
def profile_table_type(spark, sf):
    found = None
    for name in TABLES:
        one = R.profile_table_type(name, table(spark, sf, name))
        found = one if found is None else found.unionByName(one)
    return found


def _pii_sql(column: str, by_name: bool, rows: str) -> str:
    patterns = {
        "email": r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$",
        "phone": r"^\+?[0-9][0-9 ()\-]{6,}[0-9]$",
        "ssn": r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$",
    }
    hits = ", ".join(
        f"COUNT(*) FILTER (WHERE regexp_matches({column}, '{p}')) AS {n}_hits" for n, p in patterns.items()
    )
    most = "GREATEST(email_hits, phone_hits, ssn_hits)"
    return f"""SELECT '{column}' AS column_name, {by_name} AS name_hit, values_present, email_hits, phone_hits,
                      ssn_hits, {by_name} OR (values_present > 0 AND {most} >= values_present * 0.5) AS is_pii
               FROM (SELECT COUNT({column}) AS values_present, {hits} FROM {rows}) c"""


@query(
    "profile_pii",
    _union(
        _pii_sql("contactname", True, "logins"),
        _pii_sql("acctbal", False, "logins"),
        _pii_sql("segment", False, "logins"),
        _pii_sql("login", False, "logins"),
    ),
    "cust_raw",
    logins="SELECT custid, contactname, acctbal, segment, email AS login FROM cust_raw",
)
def profile_pii(spark, sf):
    # The address column is renamed: only its values give it away.
    logins = table(spark, sf, "cust_raw").withColumnRenamed("email", "login").drop("c_nationkey")
    return R.profile_pii(logins)


@query(
    "profile_volume",
    _union(
        *[
            f"""SELECT '{n}' AS table_name, COUNT(*) AS n_rows,
                       CASE WHEN COUNT(*) >= 1000000 THEN 'HIGH' WHEN COUNT(*) >= 10000 THEN 'MED'
                            ELSE 'LOW' END AS volume FROM {n}"""
            for n in TABLES
        ]
    ),
)
def profile_volume(spark, sf):
    return R.profile_volume({n: table(spark, sf, n) for n in TABLES})


@query(
    "profile_partition_key",
    """SELECT 'l_shipdate' AS column_name, COUNT(day) AS n_days, MAX(n) AS max_rows_per_day,
              CAST(SUM(n) AS BIGINT) AS n_rows, TRUE AS suggested
       FROM (SELECT CAST(l_shipdate AS DATE) AS day, COUNT(*) AS n FROM lineitem GROUP BY 1) d""",
)
def profile_partition_key(spark, sf):
    return R.profile_partition_key(table(spark, sf, "lineitem"))


@query(
    "suggest_mapping",
    """SELECT source_column, source_datatype, target_column, target_datatype, transformation_rule, is_pii
       FROM (VALUES
         ('custid', 'BIGINT', 'custid', 'BIGINT', NULL, FALSE),
         ('contactname', 'STRING', 'contactname', 'STRING', NULL, TRUE),
         ('acctbal', 'STRING', 'acctbal', 'STRING', NULL, FALSE),
         ('segment', 'STRING', 'segment', 'STRING', NULL, FALSE),
         ('c_nationkey', 'INT', 'c_nationkey', 'BIGINT', 'CAST', FALSE))
         m(source_column, source_datatype, target_column, target_datatype, transformation_rule, is_pii)
       UNION ALL
       SELECT 'login', 'STRING', 'login', 'STRING', NULL,
              COUNT(*) FILTER (WHERE regexp_matches(email, '^[^@\\s]+@[^@\\s]+\\.[A-Za-z]{2,}$'))
              >= COUNT(email) * 0.5
       FROM cust_raw""",
    "cust_raw",
)
def suggest_mapping(spark, sf):
    return R.suggest_mapping(table(spark, sf, "cust_raw").withColumnRenamed("email", "login"))
