"""Merges, keyed updates, change feed and idempotency."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelstone.operators import merge as M
from keelstone.operators.aggregates import AggregateSpec
from keelstone.operators.changes import CHANGE_TYPE, difference_count
from keelstone.operators.changes import change_feed as changes_between
from keelstone.operators.dedupe import latest_per_key
from keelstone.operators.scd import scd_load
from keelstone.plans import load as L
from keelstone.plans.catalog.base import query, table
from keelstone.plans.catalog.dimensions import SPEC, classified_ctes, versions_sql
from keelstone.plans.gold import refresh_aggregate
from keelstone.session import scratch_path, scratch_table
from keelstone.sinks import tables
from keelstone.sinks.tables import load_or_empty

PRODUCT = ["productid", "productname", "supplierid", "categoryid", "unitprice", "discontinued"]
CURRENT = {"cur": "SELECT * FROM dim_part WHERE flag"}
INSERTS = """SELECT CAST(NULL AS BIGINT) AS productkey, s.*, CAST(NULL AS BOOLEAN) AS flag
             FROM src_part s WHERE NOT EXISTS (SELECT 1 FROM cur c WHERE c.productid = s.productid)"""
MERGED = f"""SELECT c.productkey, c.productid,
                    CASE WHEN s.productid IS NULL THEN c.productname ELSE s.productname END AS productname,
                    CASE WHEN s.productid IS NULL THEN c.supplierid ELSE s.supplierid END AS supplierid,
                    CASE WHEN s.productid IS NULL THEN c.categoryid ELSE s.categoryid END AS categoryid,
                    CASE WHEN s.productid IS NULL THEN c.unitprice ELSE s.unitprice END AS unitprice,
                    CASE WHEN s.productid IS NULL THEN c.discontinued ELSE s.discontinued END AS discontinued,
                    c.flag
             FROM cur c LEFT JOIN src_part s ON s.productid = c.productid
             UNION ALL {INSERTS}"""


def current(spark, sf):
    return table(spark, sf, "dim_part").filter("flag")


@query("merge_upsert", MERGED, "src_part", "dim_part", **CURRENT)
def merge_upsert(spark, sf):
    return M.merge(current(spark, sf), table(spark, sf, "src_part"), ["productid"])


@query(
    "merge_update_subset",
    f"""SELECT c.productkey, c.productid, c.productname, c.supplierid, c.categoryid,
               CASE WHEN s.productid IS NULL THEN c.unitprice ELSE s.unitprice END AS unitprice,
               c.discontinued, c.flag
        FROM cur c LEFT JOIN src_part s ON s.productid = c.productid
        UNION ALL
        SELECT productkey, productid, productname, NULL, NULL, unitprice, NULL, flag FROM ({INSERTS}) i""",
    "src_part",
    "dim_part",
    **CURRENT,
)
def merge_update_subset(spark, sf):
    return M.merge(
        current(spark, sf),
        table(spark, sf, "src_part"),
        ["productid"],
        update_columns=["unitprice"],
        insert_columns=["productname", "unitprice"],
    )


@query("merge_insert_only", f"SELECT * FROM cur UNION ALL {INSERTS}", "src_part", "dim_part", **CURRENT)
def merge_insert_only(spark, sf):
    source = table(spark, sf, "src_part").selectExpr(
        "CAST(NULL AS BIGINT) AS productkey", "*", "CAST(NULL AS BOOLEAN) AS flag"
    )
    return M.insert_missing(current(spark, sf), source, ["productid"])


@query(
    "merge_insert_rows",
    f"""SELECT {', '.join(PRODUCT)} FROM cur
        UNION ALL
        SELECT * FROM (SELECT {', '.join(PRODUCT)} FROM src_part
                       EXCEPT SELECT {', '.join(PRODUCT)} FROM cur) missing""",
    "src_part",
    "dim_part",
    **CURRENT,
)
def merge_insert_rows(spark, sf):
    return M.insert_missing_rows(current(spark, sf).select(*PRODUCT), table(spark, sf, "src_part"))


@query("merge_first_load", "SELECT * FROM src_part", "src_part")
def merge_first_load(spark, sf):
    source = table(spark, sf, "src_part")
    target = load_or_empty(spark, f"{sf}/no-such-table", source.schema)
    return M.merge(target, source, ["productid"])


LATEST_LINES = """SELECT l_orderkey, l_linenumber, l_partkey, qty, price FROM (
    SELECT *, ROW_NUMBER() OVER (
        PARTITION BY l_orderkey, l_linenumber
        ORDER BY _ingestion_timestamp DESC NULLS LAST, l_partkey NULLS FIRST, qty NULLS FIRST,
                 price NULLS FIRST, _source_system NULLS FIRST) AS rn
    FROM bronze_lines) ranked WHERE rn = 1"""
MERGED_LINES = f"""{LATEST_LINES}
    UNION ALL
    SELECT b.* FROM silver_before b
    LEFT JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) n
        ON n.l_orderkey = b.l_orderkey AND n.l_linenumber = b.l_linenumber
    WHERE n.l_orderkey IS NULL"""


@query("merge_composite_key", MERGED_LINES, "bronze_lines", "silver_before")
def merge_composite_key(spark, sf):
    keys = ["l_orderkey", "l_linenumber"]
    latest = latest_per_key(table(spark, sf, "bronze_lines"), keys, "_ingestion_timestamp")
    return M.merge(table(spark, sf, "silver_before"), latest, keys, source_is_unique=True)


@query(
    "keyed_update",
    """SELECT d.productkey, d.productid, d.productname, d.supplierid, d.categoryid,
              CASE WHEN d.flag AND s.productid IS NOT NULL THEN s.unitprice ELSE d.unitprice END
                  AS unitprice,
              d.discontinued, d.flag
       FROM dim_part d LEFT JOIN src_part s ON s.productid = d.productid""",
    "src_part",
    "dim_part",
)
def keyed_update(spark, sf):
    return M.update_matched(
        table(spark, sf, "dim_part"), table(spark, sf, "src_part"), ["productid"], ["unitprice"], only_where="flag"
    )


@query(
    "merge_change_feed",
    """SELECT l_orderkey, l_linenumber, r.kind AS change_type, r.l_partkey, r.qty, r.price FROM (
           SELECT n.l_orderkey, n.l_linenumber, unnest(CASE WHEN b.l_orderkey IS NULL
                      THEN [{'kind': 'insert', 'l_partkey': n.l_partkey, 'qty': n.qty, 'price': n.price}]
                      ELSE [{'kind': 'update_preimage', 'l_partkey': b.l_partkey, 'qty': b.qty, 'price': b.price},
                            {'kind': 'update_postimage', 'l_partkey': n.l_partkey, 'qty': n.qty, 'price': n.price}] END) AS r
           FROM latest n LEFT JOIN silver_before b ON b.l_orderkey = n.l_orderkey AND b.l_linenumber = n.l_linenumber
           WHERE b.l_orderkey IS NULL OR b.l_partkey IS DISTINCT FROM n.l_partkey OR b.qty IS DISTINCT FROM n.qty
              OR b.price IS DISTINCT FROM n.price) x
       UNION ALL SELECT l_orderkey, l_linenumber, 'state', l_partkey, qty, price FROM merged""",
    "bronze_lines",
    "silver_before",
    latest=LATEST_LINES,
    merged=MERGED_LINES,
)
def merge_change_feed(spark, sf):
    """The new state and what changed, from one join and one write."""
    keys, path = ["l_orderkey", "l_linenumber"], scratch_path(spark, "with-feed")
    before = tables.commit(table(spark, sf, "silver_before"), path)
    latest = latest_per_key(table(spark, sf, "bronze_lines"), keys, "_ingestion_timestamp")
    state = tables.commit_tagged(M.merge_tagged(before, latest, keys, source_is_unique=True), path)
    feed = tables.read_feed(spark, path, tables.versions(spark, path)[0])
    kind = F.col(CHANGE_TYPE).alias("change_type")
    return feed.select(*keys, kind, "l_partkey", "qty", "price").unionByName(
        state.select(*keys, F.lit("state").alias("change_type"), "l_partkey", "qty", "price")
    )


PART_SALES = AggregateSpec(("l_partkey",), {"qty": "qty", "amount": "price"}, {"least_price": "price"}, {"most_qty": "qty"})


@query(
    "gold_increment",
    """SELECT l_partkey, COUNT(*) AS n_rows, CAST(SUM(qty) AS BIGINT) AS qty, CAST(SUM(price) AS DECIMAL(29,4)) AS amount,
              MIN(price) AS least_price, MAX(qty) AS most_qty
       FROM merged GROUP BY l_partkey""",
    "bronze_lines",
    "silver_before",
    merged=MERGED_LINES,
)
def gold_increment(spark, sf):
    """Sums and extremes by product after two increments, of which only the changes are added."""
    keys, path, gold = ["l_orderkey", "l_linenumber"], scratch_path(spark, "facts"), scratch_path(spark, "sums")
    tables.commit(table(spark, sf, "silver_before"), path)
    refresh_aggregate(spark, path, gold, PART_SALES)
    latest = latest_per_key(table(spark, sf, "bronze_lines"), keys, "_ingestion_timestamp")
    # Two deliveries are made of these rows.
    latest = scratch_table(latest.select(*keys, "l_partkey", "qty", "price"), "latest")
    # What comes first is put right by the second delivery: extremes move both ways.
    early = latest.filter("l_orderkey % 5 < 3").withColumns(
        {"qty": (F.col("qty") + 90).cast("smallint"), "price": (F.col("price") / 1000).cast("decimal(19,4)")}
    )
    schema = "l_orderkey bigint, l_linenumber int, l_partkey bigint, qty smallint, price decimal(19,4)"
    for source in (early, latest):
        L.load(source, path, schema, L.LoadOptions(L.INCREMENTAL, tuple(keys), change_feed=True))
        sums = refresh_aggregate(spark, path, gold, PART_SALES)
    return sums


DIFFERENT = " OR ".join(f"b.{c} IS DISTINCT FROM a.{c}" for c in PRODUCT[1:])
FEED_COLUMNS = ["productkey", *PRODUCT, "flag"]


def _feed(alias: str, kind: str, where: str) -> str:
    columns = ", ".join(f"{alias}.{c}" for c in FEED_COLUMNS)
    return f"""SELECT {columns}, '{kind}' AS _change_type
               FROM cur b FULL JOIN merged a ON a.productid = b.productid WHERE {where}"""


@query(
    "change_feed",
    " UNION ALL ".join(
        [
            _feed("a", "insert", "b.productid IS NULL"),
            _feed("b", "delete", "a.productid IS NULL"),
            _feed("b", "update_preimage", f"a.productid = b.productid AND ({DIFFERENT})"),
            _feed("a", "update_postimage", f"a.productid = b.productid AND ({DIFFERENT})"),
        ]
    ),
    "src_part",
    "dim_part",
    **CURRENT,
    merged=f"SELECT * FROM ({MERGED}) m WHERE productname IS DISTINCT FROM 'retired'",
)
def change_feed(spark, sf):
    before = current(spark, sf)
    # Members the source no longer has are removed, so that all change types occur.
    after = M.merge(before, table(spark, sf, "src_part"), ["productid"])
    return changes_between(before, after.filter("productname IS DISTINCT FROM 'retired'"), ["productid"])


def _difference(once: str, twice: str) -> str:
    sides = [f"SELECT * FROM (SELECT * FROM {a} EXCEPT ALL SELECT * FROM {b}) d" for a, b in ((once, twice), (twice, once))]
    return f"(SELECT COUNT(*) FROM ({' UNION ALL '.join(sides)}) differing)"


@query(
    "idempotency_check",
    f"""SELECT 'merge' AS load_name, {_difference('merged_once', 'merged_twice')} AS differing_rows
        UNION ALL SELECT 'scd', {_difference('loaded_once', 'loaded_twice')}""",
    "src_part",
    "dim_part",
    **classified_ctes(),
    merged_once=MERGED,
    merged_twice=MERGED.replace("cur c", "merged_once c"),
    loaded_once=versions_sql(False, "dim_part"),
    **classified_ctes("loaded_once", "_again"),
    loaded_twice=versions_sql(False, "loaded_once", "_again"),
)
def idempotency_check(spark, sf):
    source, dim = table(spark, sf, "src_part"), table(spark, sf, "dim_part")
    merged = M.merge(dim.filter("flag"), source, ["productid"])
    loaded = scd_load(source, dim, SPEC)
    checks = {
        "merge": difference_count(merged, M.merge(merged, source, ["productid"])),
        "scd": difference_count(loaded, scd_load(source, loaded, SPEC)),
    }
    named = [df.select(F.lit(name).alias("load_name"), "differing_rows") for name, df in checks.items()]
    return named[0].unionByName(named[1])
