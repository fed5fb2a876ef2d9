"""Surrogate keys, unknown members and slowly changing dimensions."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from keelstone.operators import scd as S
from keelstone.operators.columns import null_keys_to_unknown
from keelstone.operators.keys import add_unknown_member, assign_surrogate_keys
from keelstone.plans import load as L
from keelstone.plans.catalog.base import AS_OF, query, table
from keelstone.session import scratch_path

SPEC = S.ScdSpec(
    sk="productkey",
    keys=("productid",),
    changing=("productname", "unitprice", "discontinued"),
    historical=("supplierid", "categoryid"),
)

CUR = {"cur": "SELECT * FROM dim_part WHERE flag"}


@query(
    "surrogate_keys",
    """SELECT s.*, COALESCE(c.productkey,
                  (SELECT GREATEST(COALESCE(MAX(productkey), 0), 0) FROM cur)
                  + ROW_NUMBER() OVER (PARTITION BY c.productkey IS NULL ORDER BY s.productid)
              ) AS productkey
       FROM src_part s LEFT JOIN cur c ON c.productid = s.productid""",
    "src_part",
    "dim_part",
    **CUR,
)
def surrogate_keys(spark, sf):
    dim = table(spark, sf, "dim_part").filter("flag")
    source = table(spark, sf, "src_part")
    return assign_surrogate_keys(source, dim, ["productid"], "productkey")


@query(
    "unknown_member",
    """SELECT * FROM dim_part
       UNION ALL
       SELECT -1, -1, 'Unknown', 'Unknown', 'Unknown', 0, NULL, TRUE""",
    "dim_part",
)
def unknown_member(spark, sf):
    dim = table(spark, sf, "dim_part")
    once = add_unknown_member(dim, "productkey", ["productid"], {"flag": True})
    return add_unknown_member(once, "productkey", ["productid"], {"flag": True})


@query(
    "unknown_member_text_key",
    """SELECT fk, n_orphans, n_members FROM (
           SELECT 'code' AS fk, 0 AS n_orphans, (SELECT COUNT(*) FROM part) + 1 AS n_members) x""",
)
def unknown_member_text_key(spark, sf):
    """Facts without a key and the unknown member of a text-keyed dimension meet."""
    dim = table(spark, sf, "part").select(
        F.col("p_partkey").alias("sk"), F.concat(F.lit("P"), "p_partkey").alias("code"), F.col("p_name").alias("name")
    )
    dim = add_unknown_member(dim, "sk", ["code"])
    facts = table(spark, sf, "lineitem").select(
        F.when(F.col("l_orderkey") % 3 > 0, F.concat(F.lit("P"), "l_partkey")).alias("code")
    )
    facts = null_keys_to_unknown(facts, "code")
    orphans = facts.join(dim, "code", "left_anti").agg(F.count(F.lit(1)).alias("n_orphans"))
    return orphans.select(F.lit("code").alias("fk"), "n_orphans", dim.agg(F.count(F.lit(1))).scalar().alias("n_members"))


@query(
    "scd1_upsert",
    """SELECT c.productkey, s.productid, s.productname, s.supplierid, s.categoryid, s.unitprice,
              s.discontinued, c.flag
       FROM src_part s LEFT JOIN cur c ON c.productid = s.productid
       UNION ALL
       SELECT * FROM cur c WHERE NOT EXISTS (SELECT 1 FROM src_part s WHERE s.productid = c.productid)""",
    "src_part",
    "dim_part",
    **CUR,
)
def scd1_upsert(spark, sf):
    dim = table(spark, sf, "dim_part").filter("flag")
    return S.scd1_upsert(dim, table(spark, sf, "src_part"), ["productid"])


def classified_ctes(dim: str = "dim_part", again: str = "") -> dict[str, str]:
    """CTEs that classify src_part against ``dim``; ``again`` tells a second set apart."""
    return {
        f"cur{again}": f"SELECT * FROM {dim} WHERE flag",
        f"tested{again}": _TESTED.format(cur=f"cur{again}"),
        f"classified{again}": _CLASSES.format(tested=f"tested{again}"),
    }


_TESTED = """
        SELECT s.*, c.productid IS NOT NULL AS matched,
               c.productname IS NULL AND c.supplierid IS NULL AND c.categoryid IS NULL
               AND c.unitprice IS NULL AND c.discontinued IS NULL AS inferred,
               c.productname IS DISTINCT FROM s.productname
               OR c.unitprice IS DISTINCT FROM s.unitprice
               OR c.discontinued IS DISTINCT FROM s.discontinued AS changing,
               c.supplierid IS DISTINCT FROM s.supplierid
               OR c.categoryid IS DISTINCT FROM s.categoryid AS historical
        FROM src_part s LEFT JOIN {cur} c ON c.productid = s.productid"""
_CLASSES = """
        SELECT productid, productname, supplierid, categoryid, unitprice, discontinued,
               CASE WHEN NOT matched THEN 'New' WHEN inferred THEN 'Inferred'
                    WHEN changing AND historical THEN 'Changing,Historical'
                    WHEN changing THEN 'Changing' WHEN historical THEN 'Historical'
                    ELSE 'Unchanged' END AS classes
        FROM {tested}"""
CLASSIFIED = classified_ctes()


@query("scd_classify", "SELECT productid, classes FROM classified", "src_part", "dim_part", **CLASSIFIED)
def scd_classify(spark, sf):
    found = S.scd_classify(table(spark, sf, "src_part"), table(spark, sf, "dim_part"), SPEC)
    return found.select("productid", F.array_join(S.CLASSES, ",").alias("classes"))


def versions_sql(interval: bool, dim: str = "dim", again: str = "") -> str:
    """``dim`` after a mixed load, as SQL; ``interval`` adds the validity columns."""
    attributes = ["productname", "supplierid", "categoryid", "unitprice", "discontinued"]
    updated = ", ".join(
        f"CASE WHEN s.classes = 'Inferred'{extra} THEN s.{a} ELSE d.{a} END AS {a}"
        for a in attributes
        for extra in [" OR s.classes = 'Changing'" if a in SPEC.changing else ""]
    )
    past = ", ".join(
        f"CASE WHEN s.classes = 'Inferred' THEN s.{a} ELSE d.{a} END AS {a}" for a in attributes
    )
    expired = "COALESCE(s.classes LIKE '%Historical', FALSE)"
    kept_interval = f", d.valid_from, CASE WHEN {expired} THEN TIMESTAMP '{AS_OF}' ELSE d.valid_to END AS valid_to"
    return f"""
        SELECT d.productkey, d.productid, {updated}, NOT {expired} AS flag
               {kept_interval if interval else ''}
        FROM {dim} d LEFT JOIN classified{again} s ON s.productid = d.productid WHERE d.flag
        UNION ALL
        SELECT d.productkey, d.productid, {past}, d.flag {', d.valid_from, d.valid_to' if interval else ''}
        FROM {dim} d LEFT JOIN classified{again} s ON s.productid = d.productid WHERE NOT d.flag
        UNION ALL
        SELECT (SELECT GREATEST(COALESCE(MAX(productkey), 0), 0) FROM {dim})
               + ROW_NUMBER() OVER (ORDER BY productid),
               productid, {', '.join(attributes)}, TRUE
               {f", TIMESTAMP '{AS_OF}', NULL" if interval else ''}
        FROM classified{again} WHERE classes = 'New' OR classes LIKE '%Historical'"""


DATED_DIM = f"""SELECT *, TIMESTAMP '2020-01-01 00:00:00' AS valid_from,
                CASE WHEN flag THEN CAST(NULL AS TIMESTAMP) ELSE TIMESTAMP '2021-01-01 00:00:00' END
                    AS valid_to FROM dim_part"""


@query("scd_mixed", versions_sql(False), "src_part", "dim_part", **CLASSIFIED, dim="SELECT * FROM dim_part")
def scd_mixed(spark, sf):
    return S.scd_load(table(spark, sf, "src_part"), table(spark, sf, "dim_part"), SPEC)


@query(
    "scd2_dates",
    f"SELECT * EXCLUDE (flag), flag AS is_current FROM ({versions_sql(True)}) v",
    "src_part",
    "dim_part",
    **CLASSIFIED,
    dim=DATED_DIM,
)
def scd2_dates(spark, sf):
    dim = table(spark, sf, "dim_part").withColumnsRenamed({"flag": "is_current"})
    dim = dim.withColumns(
        {
            "valid_from": F.lit("2020-01-01 00:00:00").cast("timestamp_ntz"),
            "valid_to": F.when(~F.col("is_current"), F.lit("2021-01-01 00:00:00")).cast("timestamp_ntz"),
        }
    )
    spec = replace(SPEC, flag="is_current", valid_from="valid_from", valid_to="valid_to")
    return S.scd_load(table(spark, sf, "src_part"), dim, spec, as_of=AS_OF)


@query(
    "inferred_members",
    """SELECT * FROM dim_part
       UNION ALL
       SELECT (SELECT GREATEST(COALESCE(MAX(productkey), 0), 0) FROM dim_part)
              + ROW_NUMBER() OVER (ORDER BY l_partkey), l_partkey, NULL, NULL, NULL, NULL, NULL, TRUE
       FROM (SELECT DISTINCT l_partkey FROM lines_dirty f
             WHERE l_partkey IS NOT NULL
               AND NOT EXISTS (SELECT 1 FROM dim_part d WHERE d.productid = f.l_partkey)) orphans""",
    "dim_part",
    "lines_dirty",
)
def inferred_members(spark, sf):
    return S.add_inferred_members(
        table(spark, sf, "dim_part"), table(spark, sf, "lines_dirty"), "l_partkey", SPEC
    )


# A customer's orders as states that hold from their day on; the status has no history.
STATES = """SELECT o_custkey AS custid, o_orderpriority AS priority, o_orderstatus AS status,
                   CAST(o_orderdate AS DATE) AS since, o_orderkey % 3 AS delivery FROM orders"""
STATE_SPEC = S.ScdSpec(
    "sk", ("custid",), changing=("status",), historical=("priority",), valid_from="valid_from", valid_to="valid_to", confirmed="confirmed"
)


@query(
    "scd2_history",
    """SELECT custid, priority, status, valid_from,
              LEAD(valid_from) OVER (PARTITION BY custid ORDER BY valid_from) AS valid_to,
              LEAD(valid_from) OVER (PARTITION BY custid ORDER BY valid_from) IS NULL AS flag, n_confirmed, TRUE AS keyed
       FROM (SELECT custid, version, ANY_VALUE(priority) AS priority, ANY_VALUE(last_status) AS status,
                    MIN(since) AS valid_from, COUNT(*) - 1 AS n_confirmed
             FROM (SELECT *, SUM(begins) OVER (PARTITION BY custid ORDER BY since) AS version FROM (
                       SELECT custid, priority, since,
                              LAST_VALUE(status) OVER (PARTITION BY custid ORDER BY since
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_status,
                              CASE WHEN LAG(priority) OVER (PARTITION BY custid ORDER BY since) IS NOT DISTINCT FROM priority
                                   THEN 0 ELSE 1 END AS begins
                       FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY custid, since
                                 ORDER BY priority DESC, status DESC) AS rn FROM states) r WHERE rn = 1) e) v
             GROUP BY custid, version) w""",
    states=STATES,
)
def scd2_history(spark, sf):
    """Three deliveries whose states interleave; the last one brings the earliest orders of many."""
    states = spark.sql(STATES.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf, "orders"))
    path = scratch_path(spark, "history")
    schema = "sk bigint, custid bigint, priority string, status string, valid_from date, valid_to date, flag boolean, confirmed array<date>"
    options = L.LoadOptions(L.SCD_2, ("custid",), scd=STATE_SPEC, effective="since")
    for delivery in (1, 0, 2):
        held = L.load(states.filter(F.col("delivery") == delivery).drop("delivery"), path, schema, options)
    # Every version has a surrogate key of its own.
    unique = held.agg(F.count_distinct("sk") == F.count(F.lit(1))).scalar()
    return held.select(
        "custid", "priority", "status", "valid_from", "valid_to", "flag", (F.size("confirmed")).cast("bigint").alias("n_confirmed"), unique.alias("keyed")
    )
