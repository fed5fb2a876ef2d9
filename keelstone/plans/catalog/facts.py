"""Joins, lookups, fact loads and gold measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelstone.operators import dedupe as D
from keelstone.operators.columns import enforce_schema, null_keys_to_unknown
from keelstone.operators.joins import keyed_join
from keelstone.operators.lookup import Lookup, lookup, lookup_many, lookup_rejects
from keelstone.plans import facts as P
from keelstone.plans.catalog.base import query, table
from keelstone.sinks.tables import publish_view

LINE_KEYS = ["l_orderkey", "l_partkey", "l_linenumber"]
SUM = "decimal(38,4)"


@query(
    "join_inner",
    """SELECT o.o_orderkey, c.c_custkey, c.c_name, o.o_orderstatus
       FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""",
)
def join_inner(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_orderstatus"
    )
    customers = table(spark, sf, "customer").select("c_custkey", "c_name")
    return keyed_join(orders, customers, ["c_custkey"], "inner")


STAGED_SQL = """SELECT o.o_orderkey AS orderid, l.l_linenumber AS linenumber, o.o_custkey AS custid,
                       p.p_type AS categoryid, l.l_suppkey AS supplierid,
                       CAST(l.l_quantity AS SMALLINT) AS qty,
                       CAST(p.p_retailprice AS DECIMAL(19,4)) AS unitprice,
                       CAST(l.l_discount AS DECIMAL(4,3)) AS discount, l.l_partkey AS productid
                FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey
                JOIN part p ON p.p_partkey = l.l_partkey"""


def staged(spark, sf):
    return P.stage_order_lines(*[table(spark, sf, n) for n in ("orders", "lineitem", "part")])


@query("fact_stage", STAGED_SQL)
def fact_stage(spark, sf):
    return staged(spark, sf)


# ---------------------------------------------------------------- lookups


def product_lookup(spark, sf, miss, take=True):
    return Lookup(
        table(spark, sf, "dim_part"),
        {"l_partkey": "productid"},
        {"productkey": "productkey"} if take else {},
        miss=miss,
        current="flag",
    )


def _lookup_sql(key: str, condition: str = "") -> str:
    return f"""SELECT f.*, {key} AS productkey FROM lines_dirty f
               LEFT JOIN (SELECT productid, productkey FROM dim_part WHERE flag) d
               ON f.l_partkey = d.productid {condition}"""


@query("lookup_ignore", _lookup_sql("d.productkey"), "lines_dirty", "dim_part")
def lookup_ignore(spark, sf):
    return lookup(table(spark, sf, "lines_dirty"), product_lookup(spark, sf, "ignore"))


@query("lookup_default", _lookup_sql("COALESCE(d.productkey, -1)"), "lines_dirty", "dim_part")
def lookup_default(spark, sf):
    return lookup(table(spark, sf, "lines_dirty"), product_lookup(spark, sf, "default"))


@query(
    "fact_load_star",
    """SELECT f.l_orderkey, f.l_linenumber, COALESCE(p.productkey, -1) AS productkey,
              CASE WHEN f.l_suppkey % 10 = 0 THEN NULL ELSE f.l_suppkey END AS supplierkey,
              o.o_custkey AS customerkey,
              CASE WHEN p.productid IS NULL THEN CASE WHEN f.l_suppkey % 10 = 0 THEN 'product,supplier' ELSE 'product' END
                   ELSE CASE WHEN f.l_suppkey % 10 = 0 THEN 'supplier' ELSE '' END END AS missed
       FROM lines_dirty f
       LEFT JOIN (SELECT productid, productkey FROM dim_part WHERE flag) p ON f.l_partkey = p.productid
       LEFT JOIN orders o ON o.o_orderkey = f.l_orderkey""",
    "lines_dirty",
    "dim_part",
)
def fact_load_star(spark, sf):
    """Three dimensions in one pass over the lines; matches and misses in one result."""
    supplier = table(spark, sf, "supplier").filter("s_suppkey % 10 <> 0")
    customer = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    found = lookup_many(
        table(spark, sf, "lines_dirty"),
        {
            "product": product_lookup(spark, sf, "default"),
            "supplier": Lookup(supplier, {"l_suppkey": "s_suppkey"}, {"s_suppkey": "supplierkey"}, miss="ignore"),
            "customer": Lookup(customer, {"l_orderkey": "o_orderkey"}, {"o_custkey": "customerkey"}, miss="ignore"),
        },
        missed="missed",
    )
    return found.select(
        "l_orderkey", "l_linenumber", "productkey", "supplierkey", "customerkey", F.array_join("missed", ",").alias("missed")
    )


REJECTED = """SELECT f.* FROM lines_dirty f WHERE NOT EXISTS (
                  SELECT 1 FROM dim_part d WHERE d.flag AND d.productid = f.l_partkey)"""


@query("lookup_rejects", REJECTED, "lines_dirty", "dim_part")
def rejects(spark, sf):
    return lookup_rejects(table(spark, sf, "lines_dirty"), product_lookup(spark, sf, "drop"))


# ---------------------------------------------------------------- fact loads

ONE_PER_KEY = """SELECT * EXCLUDE (rn) FROM (
                     SELECT *, ROW_NUMBER() OVER (
                         PARTITION BY l_orderkey, l_partkey, l_linenumber
                         ORDER BY l_suppkey, qty NULLS FIRST, price, discount) AS rn
                     FROM ({rows}) r) k WHERE rn = 1"""
NUMBER = "ROW_NUMBER() OVER (ORDER BY l_orderkey, l_partkey, l_linenumber) AS saleskey"
TOTAL = "CAST(CAST(qty AS DECIMAL(10,0)) * price AS DECIMAL(19,4)) AS total_amount"

VALID_ROWS = """SELECT f.* FROM lines_dirty f WHERE EXISTS (
                    SELECT 1 FROM dim_part d WHERE d.flag AND d.productid = f.l_partkey)"""
FILLED_ROWS = """SELECT f.l_orderkey, f.l_linenumber, COALESCE(f.l_partkey, -1) AS l_partkey,
                        f.l_suppkey, f.qty, f.price, f.discount FROM lines_dirty f"""
DEFAULT_FACT = f"""SELECT f.*, COALESCE(d.productkey, -1) AS productkey
                   FROM ({ONE_PER_KEY.format(rows=FILLED_ROWS)}) f
                   LEFT JOIN (SELECT productid, productkey FROM dim_part WHERE flag) d
                   ON f.l_partkey = d.productid"""


@query(
    "fact_load_validated",
    f"SELECT *, {NUMBER}, {TOTAL} FROM ({ONE_PER_KEY.format(rows=VALID_ROWS)}) f",
    "lines_dirty",
    "dim_part",
)
def fact_load_validated(spark, sf):
    lines = P.fact_load(
        table(spark, sf, "lines_dirty"),
        [product_lookup(spark, sf, "drop", take=False)],
        LINE_KEYS,
        "saleskey",
    )
    return P.with_total(lines, "qty", "price")


@query("fact_load_default", f"SELECT *, {NUMBER}, {TOTAL} FROM ({DEFAULT_FACT}) f", "lines_dirty", "dim_part")
def fact_load_default(spark, sf):
    lines = P.fact_load(
        table(spark, sf, "lines_dirty"), [product_lookup(spark, sf, "default")], LINE_KEYS, "saleskey"
    )
    return P.with_total(lines, "qty", "price")


# ---------------------------------------------------------------- gold


def gold_lines(spark, sf):
    """Keyed fact lines with their total; the line number is no measure and left out."""
    lines = null_keys_to_unknown(table(spark, sf, "lines_dirty"), "l_partkey")
    lines = D.first_per_key(lines, LINE_KEYS)
    return P.with_total(lookup(lines, product_lookup(spark, sf, "default")), "qty", "price")


GOLD = {"gold": f"SELECT *, {TOTAL} FROM ({DEFAULT_FACT}) f"}


@query("gold_fact_view", "SELECT * FROM gold", "lines_dirty", "dim_part", **GOLD)
def gold_fact_view(spark, sf):
    return publish_view(gold_lines(spark, sf), "gold_fact_lines")


@query(
    "gold_revenue_by_customer",
    """SELECT o.o_custkey AS custid, CAST(SUM(g.total_amount) AS DECIMAL(38,4)) AS revenue
       FROM gold g JOIN orders o ON g.l_orderkey = o.o_orderkey GROUP BY o.o_custkey""",
    "lines_dirty",
    "dim_part",
    **GOLD,
)
def gold_revenue_by_customer(spark, sf):
    # Lines shrink to one row per order before they meet the orders.
    per_order = D.aggregate(gold_lines(spark, sf), ["l_orderkey"], {"revenue": F.sum("total_amount").cast(SUM)})
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("custid")
    )
    return D.aggregate(
        per_order.join(orders, "l_orderkey"), ["custid"], {"revenue": F.sum("revenue").cast(SUM)}
    )


@query(
    "gold_counts",
    """SELECT productkey = -1 AS unknown_product, COUNT(*) AS n_rows,
              COUNT(total_amount) AS n_amounts FROM gold GROUP BY 1""",
    "lines_dirty",
    "dim_part",
    **GOLD,
)
def gold_counts(spark, sf):
    marked = gold_lines(spark, sf).withColumn("unknown_product", F.col("productkey") == -1)
    return D.aggregate(
        marked, ["unknown_product"], {"n_rows": F.count(F.lit(1)), "n_amounts": F.count("total_amount")}
    )


@query(
    "gold_aggregate",
    """SELECT l_suppkey, CAST(SUM(total_amount) AS DECIMAL(38,4)) AS revenue, MAX(qty) AS max_qty,
              MIN(price) AS min_price, COUNT(*) AS n_lines FROM gold GROUP BY l_suppkey""",
    "lines_dirty",
    "dim_part",
    **GOLD,
)
def gold_aggregate(spark, sf):
    return D.aggregate(
        gold_lines(spark, sf),
        ["l_suppkey"],
        {
            "revenue": "CAST(SUM(total_amount) AS DECIMAL(38,4))",
            "max_qty": "MAX(qty)",
            "min_price": "MIN(price)",
            "n_lines": "COUNT(*)",
        },
    )


def flagship(spark, sf):
    """Stage, look up with a default, enforce the schema, measure, revenue by customer."""
    spec = Lookup(
        table(spark, sf, "dim_part"),
        {"productid": "productid"},
        {"productkey": "productkey"},
        miss="default",
        current="flag",
    )
    typed = enforce_schema(
        lookup(staged(spark, sf), spec),
        "orderid bigint, custid bigint, productkey bigint, qty smallint, unitprice decimal(19,4)",
    )
    return D.aggregate(
        P.with_total(typed),
        ["custid"],
        {"revenue": F.sum("total_amount").cast(SUM), "n_lines": F.count(F.lit(1))},
    )
