"""Scans, projections, functions, filters, masks, dedupe, unions and extracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelstone.functions import legacy
from keelstone.operators import columns as C
from keelstone.operators import dedupe as D
from keelstone.operators import incremental as I
from keelstone.operators.columns import ColumnMapping
from keelstone.plans.catalog.base import AS_OF, TABLES, query, table
from keelstone.session import scratch_path
from keelstone.sources import scans

PART_SCHEMA = (
    "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
)
PART_SQL = "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part"

# ---------------------------------------------------------------- scans


@query("scan_table", PART_SQL)
def scan_table(spark, sf):
    return scans.scan_table(spark, f"{sf}/part.parquet")


@query(
    "scan_query",
    """SELECT o.o_orderkey, c.c_name, CAST(o.o_totalprice AS DECIMAL(19,4)) AS total
       FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
       WHERE o.o_orderstatus = 'F'""",
)
def scan_query(spark, sf):
    return scans.scan_query(
        spark,
        """SELECT o.o_orderkey, c.c_name, CAST(o.o_totalprice AS DECIMAL(19,4)) AS total
           FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
           WHERE o.o_orderstatus = 'F'""",
        {name: table(spark, sf, name) for name in ("orders", "customer")},
    )


@query(
    "scan_param",
    """SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DECIMAL(19,4)) AS total
       FROM orders WHERE o_orderkey > (SELECT FLOOR(MAX(o_orderkey) / 2) FROM orders)""",
)
def scan_param(spark, sf):
    # The variable of an earlier step: one value.
    loaded = table(spark, sf, "orders").agg(F.floor(F.max("o_orderkey") / 2)).first()[0]
    return scans.scan_query(
        spark,
        """SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DECIMAL(19,4)) AS total
           FROM {orders} WHERE o_orderkey > :lo""",
        {"orders": table(spark, sf, "orders")},
        {"lo": loaded},
    )


@query("scan_csv", PART_SQL)
def scan_csv(spark, sf):
    path = scratch_path(spark, "part-csv")
    table(spark, sf, "part").write.option("header", "true").csv(path)
    return scans.scan_csv(spark, path, PART_SCHEMA)


@query("sample_rows", PART_SQL + " ORDER BY p_partkey LIMIT 5")
def sample_rows(spark, sf):
    return scans.sample_rows(table(spark, sf, "part"), ["p_partkey"], 5)


@query(
    "dataset_inventory",
    " UNION ALL ".join(
        f"SELECT '{n}' AS name, 'TABLE' AS kind, COUNT(*) AS n_rows FROM {n}" for n in TABLES
    ),
)
def dataset_inventory(spark, sf):
    return scans.dataset_inventory({n: table(spark, sf, n) for n in TABLES})


# ---------------------------------------------------------------- projections

CUSTOMER_MAPPINGS = (
    ColumnMapping("custid", "customer_id", "int", "BIGINT", ("CAST",), is_nullable=False),
    ColumnMapping("contactname", "contact", "nvarchar(40)", "STRING", ("TRIM", "UPPER", "COALESCE"), is_pii=True, default_value="UNKNOWN"),
    ColumnMapping("acctbal", "balance", "varchar", "MONEY", ("CAST", "COALESCE"), default_value="0"),
    ColumnMapping("segment", None, "varchar", None, ("LOWER",), default_value="none"),
    ColumnMapping("email", "email", "varchar", is_pii=True, mask="redact"),
    ColumnMapping("c_nationkey", "zone", rules=("CUSTOM",), logic="CASE WHEN c_nationkey < 10 THEN 'near' ELSE 'far' END"),
)

MAPPED_SQL = """SELECT custid AS customer_id, COALESCE(UPPER(TRIM(contactname)), 'UNKNOWN') AS contact,
                       COALESCE(TRY_CAST(acctbal AS DECIMAL(19,4)), 0) AS balance,
                       COALESCE(LOWER(segment), 'none') AS segment, email,
                       CASE WHEN c_nationkey < 10 THEN 'near' ELSE 'far' END AS zone
                FROM cust_raw"""


@query("column_mapping", MAPPED_SQL, "cust_raw")
def column_mapping(spark, sf):
    return C.apply_mapping(table(spark, sf, "cust_raw"), CUSTOMER_MAPPINGS, strict=False)


@query(
    "derive_expression",
    """SELECT l_orderkey, l_linenumber, l_partkey,
              CAST(CAST(l_extendedprice AS DECIMAL(19,4)) * (1 - CAST(l_discount AS DECIMAL(4,3)))
                   AS DECIMAL(19,4)) AS net_price,
              CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'medium'
                   ELSE 'large' END AS band
       FROM lineitem""",
)
def derive_expression(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount"
    )
    derived = C.derive(
        lines,
        {
            "net_price": "CAST(l_extendedprice AS DECIMAL(19,4)) * (1 - CAST(l_discount AS DECIMAL(4,3)))",
            "band": "CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'medium' ELSE 'large' END",
        },
        {"net_price": "decimal(19,4)"},
    )
    return derived.drop("l_quantity", "l_extendedprice", "l_discount")


@query(
    "string_length_check",
    """SELECT p_partkey, 'p_name' AS column_name, CAST(LENGTH(p_name) AS INTEGER) AS length,
              10 AS max_length, p_name AS value FROM part WHERE LENGTH(p_name) > 10
       UNION ALL
       SELECT p_partkey, 'p_type', CAST(LENGTH(p_type) AS INTEGER), 7, p_type
       FROM part WHERE LENGTH(p_type) > 7""",
)
def string_length_check(spark, sf):
    return C.length_violations(table(spark, sf, "part"), {"p_name": 10, "p_type": 7}, ["p_partkey"])


@query(
    "enforce_schema",
    """SELECT CAST(custid AS INTEGER) AS custid, TRY_CAST(acctbal AS DECIMAL(18,2)) AS acctbal,
              segment, CAST(c_nationkey AS SMALLINT) AS c_nationkey,
              CASE WHEN acctbal IS NOT NULL AND TRY_CAST(acctbal AS DECIMAL(18,2)) IS NULL
                   THEN 'acctbal:cast' ELSE '' END
              || CASE WHEN LENGTH(segment) > 9
                      THEN CASE WHEN TRY_CAST(acctbal AS DECIMAL(18,2)) IS NULL THEN ';' ELSE '' END
                           || 'segment:length' ELSE '' END AS violations
       FROM cust_raw""",
    "cust_raw",
)
def enforce_schema(spark, sf):
    typed = C.enforce_schema(
        table(spark, sf, "cust_raw"),
        "custid int, acctbal decimal(18,2), segment string, c_nationkey smallint",
        mode="permissive",
        lengths={"segment": 9},
        report=True,
    )
    return typed.withColumn("violations", F.array_join(C.VIOLATIONS, ";")).drop(C.VIOLATIONS)


@query(
    "bronze_ingest",
    f"""SELECT *, TIMESTAMP '{AS_OF}' AS _ingestion_timestamp, 'crm' AS _source_system
        FROM customer""",
)
def bronze_ingest(spark, sf):
    return C.add_ingest_columns(table(spark, sf, "customer"), "crm", AS_OF)


@query("filter_not_null", "SELECT * FROM lines_dirty WHERE l_partkey IS NOT NULL", "lines_dirty")
def filter_not_null(spark, sf):
    return C.keep_not_null(table(spark, sf, "lines_dirty"), "l_partkey")


@query("delete_where", "SELECT * FROM lines_dirty WHERE NOT COALESCE(qty < 5, FALSE)", "lines_dirty")
def delete_where(spark, sf):
    return C.delete_where(table(spark, sf, "lines_dirty"), "qty < 5")


@query(
    "fk_to_unknown",
    """SELECT l_orderkey, l_linenumber, COALESCE(l_partkey, -1) AS l_partkey, l_suppkey, qty, price,
              discount FROM lines_dirty""",
    "lines_dirty",
)
def fk_to_unknown(spark, sf):
    return C.null_keys_to_unknown(table(spark, sf, "lines_dirty"), "l_partkey")


# ---------------------------------------------------------------- masks


@query("mask_sha256", "SELECT custid, sha256(email) AS email, sha256(contactname) AS contactname FROM cust_raw", "cust_raw")
def mask_sha256(spark, sf):
    raw = table(spark, sf, "cust_raw").select("custid", "email", "contactname")
    return C.mask_columns(raw, {"email": "sha256", "contactname": "sha256"})


@query(
    "mask_redact",
    """SELECT custid, CASE WHEN contactname IS NOT NULL THEN 'REDACTED' END AS contactname,
              segment FROM cust_raw""",
    "cust_raw",
)
def mask_redact(spark, sf):
    raw = table(spark, sf, "cust_raw").select("custid", "contactname", "segment")
    return C.mask_columns(raw, {"contactname": "redact"})


@query(
    "mask_by_mapping",
    f"""SELECT customer_id, sha256(contact) AS contact, balance, segment,
               CASE WHEN email IS NOT NULL THEN 'REDACTED' END AS email, zone
        FROM ({MAPPED_SQL}) mapped""",
    "cust_raw",
)
def mask_by_mapping(spark, sf):
    mapped = C.apply_mapping(table(spark, sf, "cust_raw"), CUSTOMER_MAPPINGS, strict=False)
    return C.mask_by_mapping(mapped, CUSTOMER_MAPPINGS)


# ---------------------------------------------------------------- functions


@query(
    "fn_coalesce",
    """SELECT custid, COALESCE(segment, 'none') AS segment,
              COALESCE(TRY_CAST(acctbal AS DECIMAL(19,4)), CAST(0 AS DECIMAL(19,4))) AS balance
       FROM cust_raw""",
    "cust_raw",
)
def fn_coalesce(spark, sf):
    amount = F.col("acctbal").try_cast("decimal(19,4)")
    return table(spark, sf, "cust_raw").select(
        "custid",
        legacy.is_null("segment", F.lit("none")).alias("segment"),
        legacy.is_null(amount, F.lit(0), "decimal(19,4)").alias("balance"),
    )


@query(
    "fn_date_add",
    """SELECT o_orderkey, o_orderdate + INTERVAL 30 DAY AS due_at,
              CAST(CAST(o_orderdate AS DATE) + INTERVAL 7 DAY AS DATE) AS ship_by FROM orders""",
)
def fn_date_add(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey",
        legacy.timestamp_add_days("o_orderdate", 30).alias("due_at"),
        legacy.date_add_days(F.to_date("o_orderdate"), 7).alias("ship_by"),
    )


@query(
    "fn_date_diff",
    f"""SELECT o_orderkey,
               CAST(DATE_DIFF('day', CAST(o_orderdate AS DATE), CAST(TIMESTAMP '{AS_OF}' AS DATE))
                    AS INTEGER) AS age_days
        FROM orders""",
)
def fn_date_diff(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", legacy.date_diff_days(legacy.load_time(AS_OF), "o_orderdate").alias("age_days")
    )


@query(
    "fn_string",
    """SELECT custid, SUBSTRING(segment, 2, 3) AS part_text, UPPER(email) AS email_upper,
              LOWER(segment) AS segment_lower, TRIM(contactname) AS contact FROM cust_raw""",
    "cust_raw",
)
def fn_string(spark, sf):
    return table(spark, sf, "cust_raw").select(
        "custid",
        legacy.substring("segment", 2, 3).alias("part_text"),
        F.upper("email").alias("email_upper"),
        F.lower("segment").alias("segment_lower"),
        F.trim("contactname").alias("contact"),
    )


@query(
    "fn_case",
    """SELECT custid, CASE WHEN segment = 'BUILDING' THEN 'B' ELSE 'other' END AS kind FROM cust_raw""",
    "cust_raw",
)
def fn_case(spark, sf):
    is_building = F.col("segment") == "BUILDING"
    return table(spark, sf, "cust_raw").select(
        "custid", legacy.if_then_else(is_building, F.lit("B"), F.lit("other")).alias("kind")
    )


@query(
    "fn_concat",
    """SELECT custid, contactname || ' ' || segment AS plus_text,
              CONCAT_WS(' ', contactname, segment) AS joined_text FROM cust_raw""",
    "cust_raw",
)
def fn_concat(spark, sf):
    return table(spark, sf, "cust_raw").select(
        "custid",
        legacy.plus_concat("contactname", F.lit(" "), "segment").alias("plus_text"),
        legacy.joined_concat(" ", "contactname", "segment").alias("joined_text"),
    )


@query("fn_nested", "SELECT custid, UPPER(COALESCE(segment, 'n/a')) AS segment FROM cust_raw", "cust_raw")
def fn_nested(spark, sf):
    return table(spark, sf, "cust_raw").select(
        "custid",
        legacy.CANONICAL["TO_UPPER"](legacy.is_null("segment", F.lit("n/a"))).alias("segment"),
    )


# ---------------------------------------------------------------- dedupe, unions, extracts


@query(
    "dedupe_latest",
    """SELECT l_orderkey, l_linenumber, l_partkey, qty, price, _ingestion_timestamp, _source_system
       FROM (SELECT *, ROW_NUMBER() OVER (
                 PARTITION BY l_orderkey, l_linenumber
                 ORDER BY _ingestion_timestamp DESC NULLS LAST, l_partkey NULLS FIRST,
                          qty NULLS FIRST, price NULLS FIRST, _source_system NULLS FIRST) AS rn
             FROM bronze_lines) ranked WHERE rn = 1""",
    "bronze_lines",
)
def dedupe_latest(spark, sf):
    return D.latest_per_key(
        table(spark, sf, "bronze_lines"), ["l_orderkey", "l_linenumber"], "_ingestion_timestamp"
    )


@query(
    "dedupe_distinct",
    "SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, qty, price FROM bronze_lines",
    "bronze_lines",
)
def dedupe_distinct(spark, sf):
    return D.distinct_rows(table(spark, sf, "bronze_lines"))


# FLOOR: one engine would round half of an odd key, the other cut it.
HALF = "p_partkey <= (SELECT CAST(FLOOR(MAX(p_partkey) / 2) AS BIGINT) FROM part)"


def half_of_part(spark, sf):
    """The parts an earlier load has brought: the lower half of the keys."""
    part = table(spark, sf, "part")
    middle = part.agg((F.max("p_partkey") / 2).cast("bigint")).scalar()
    return part.filter(F.col("p_partkey") <= middle)


@query("high_water_mark", f"SELECT COALESCE(MAX(p_partkey), 0) AS mark FROM part WHERE {HALF}")
def high_water_mark(spark, sf):
    return I.high_water_mark(half_of_part(spark, sf), "p_partkey", 0)


@query(
    "incremental_extract",
    f"{PART_SQL} WHERE p_partkey > (SELECT COALESCE(MAX(p_partkey), 0) FROM part WHERE {HALF})",
)
def incremental_extract(spark, sf):
    return I.incremental_extract(table(spark, sf, "part"), half_of_part(spark, sf), "p_partkey", default=0)


@query(
    "incremental_merge",
    """SELECT user_id, event_type, event_id, ts, CAST(value AS DECIMAL(19,4)) AS value
       FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, event_type
                                          ORDER BY ts DESC, event_id) AS rn
             FROM events WHERE ts > (SELECT MAX(ts) FROM events WHERE ts < TIMESTAMP '2024-01-16')
            ) latest
       WHERE rn = 1
       UNION ALL
       SELECT user_id, event_type, event_id, ts, CAST(value AS DECIMAL(19,4))
       FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, event_type
                                          ORDER BY ts DESC, event_id) AS rn
             FROM events WHERE ts < TIMESTAMP '2024-01-16') older
       WHERE rn = 1 AND NOT EXISTS (
             SELECT 1 FROM events e
             WHERE e.user_id = older.user_id AND e.event_type = older.event_type
               AND e.ts > (SELECT MAX(ts) FROM events WHERE ts < TIMESTAMP '2024-01-16'))""",
)
def incremental_merge(spark, sf):
    events = table(spark, sf, "events").select(
        "user_id", "event_type", "event_id", "ts", F.col("value").cast("decimal(19,4)").alias("value")
    )
    keys = ["user_id", "event_type"]
    earlier = events.filter(F.col("ts") < F.lit("2024-01-16 00:00:00").cast("timestamp_ntz"))
    target = D.latest_per_key(earlier, keys, "ts")
    return I.incremental_merge(target, events, keys, "ts")


@query(
    "union_all",
    "SELECT c_custkey, c_name FROM customer UNION ALL SELECT NULL, NULL",
)
def union_all(spark, sf):
    names = table(spark, sf, "customer").select("c_custkey", "c_name")
    blank = spark.range(0, 1, 1, 1).select(
        F.lit(None).cast("bigint").alias("c_custkey"), F.lit(None).cast("string").alias("c_name")
    )
    return D.union_all(names, blank)


@query(
    "union_missing_columns",
    """SELECT p_partkey AS id, p_name AS name, p_brand AS brand, NULL AS nation FROM part
       UNION ALL
       SELECT s_suppkey, s_name, NULL, s_nationkey FROM supplier""",
)
def union_missing_columns(spark, sf):
    parts = table(spark, sf, "part").selectExpr("p_partkey AS id", "p_name AS name", "p_brand AS brand")
    suppliers = table(spark, sf, "supplier").selectExpr(
        "s_suppkey AS id", "s_name AS name", "s_nationkey AS nation"
    )
    return D.union_all(parts, suppliers, pad_missing=True)
