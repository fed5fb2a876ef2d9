"""Registry of queries and the input tables they derive from the given ones."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Load time of every reproducible run.
AS_OF = "2024-02-01 00:00:00"

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

# Inputs with dirt in them; the given tables are clean. ``{name}`` is a given table. The
# same text runs on Spark and as a CTE of the comparison SQL.
DERIVED: dict[str, str] = {
    # Incoming product snapshot.
    "src_part": """
        SELECT p_partkey AS productid, p_name AS productname, p_brand AS supplierid,
               p_type AS categoryid, CAST(p_retailprice AS DECIMAL(19,4)) AS unitprice,
               p_size > 40 AS discontinued
        FROM {part}""",
    # Versioned product dimension: new, changed, historical, inferred, expired and
    # retired members relative to src_part.
    "dim_part": """
        SELECT CAST(p_partkey * 10 + 1 AS BIGINT) AS productkey, p_partkey AS productid,
               CASE WHEN p_partkey % 13 = 3 THEN NULL ELSE p_name END AS productname,
               CASE WHEN p_partkey % 13 = 3 THEN NULL
                    WHEN p_partkey % 19 = 5 THEN 'Brand#OLD' ELSE p_brand END AS supplierid,
               CASE WHEN p_partkey % 13 = 3 THEN NULL
                    WHEN p_partkey % 11 = 2 THEN 'OLD' ELSE p_type END AS categoryid,
               CASE WHEN p_partkey % 13 = 3 THEN NULL
                    WHEN p_partkey % 7 = 1
                    THEN CAST(CAST(p_retailprice AS DECIMAL(19,4)) - 1 AS DECIMAL(19,4))
                    ELSE CAST(p_retailprice AS DECIMAL(19,4)) END AS unitprice,
               CASE WHEN p_partkey % 13 = 3 THEN NULL ELSE p_size > 40 END AS discontinued,
               TRUE AS flag
        FROM {part} WHERE p_partkey % 5 <> 0
        UNION ALL
        SELECT CAST(p_partkey * 10 AS BIGINT), p_partkey, p_name, p_brand, 'ANCIENT',
               CAST(CAST(p_retailprice AS DECIMAL(19,4)) - 5 AS DECIMAL(19,4)),
               p_size > 40, FALSE
        FROM {part} WHERE p_partkey % 5 <> 0 AND p_partkey % 17 = 4
        UNION ALL
        SELECT CAST(p_partkey * 10 + 10000000000005 AS BIGINT), p_partkey + 1000000000000, 'retired',
               p_brand, p_type, CAST(p_retailprice AS DECIMAL(19,4)), TRUE, TRUE
        FROM {part} WHERE p_partkey % 50 = 1""",
    # Fact lines with NULL and orphan product keys and NULL quantities.
    "lines_dirty": """
        SELECT l_orderkey, l_linenumber,
               CASE WHEN l_orderkey % 11 = 0 THEN NULL
                    WHEN l_orderkey % 13 = 0 THEN l_partkey + 2000000000000
                    ELSE l_partkey END AS l_partkey,
               l_suppkey,
               CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE CAST(l_quantity AS SMALLINT) END AS qty,
               CAST(l_extendedprice AS DECIMAL(19,4)) AS price,
               CAST(l_discount AS DECIMAL(4,3)) AS discount
        FROM {lineitem}""",
    # Bronze lines delivered twice in part.
    "bronze_lines": """
        SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS SMALLINT) AS qty,
               CAST(l_extendedprice AS DECIMAL(19,4)) AS price,
               l_shipdate AS _ingestion_timestamp, 'batch1' AS _source_system
        FROM {lineitem}
        UNION ALL
        SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity + 1 AS SMALLINT),
               CAST(l_extendedprice AS DECIMAL(19,4)), l_shipdate + INTERVAL 1 DAY, 'batch2'
        FROM {lineitem} WHERE l_orderkey % 3 = 0""",
    # Untyped customers: padded names, NULLs, 'n/a' amounts, malformed addresses.
    "cust_raw": """
        SELECT c_custkey AS custid,
               CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE '  ' || c_name || ' ' END AS contactname,
               CASE WHEN c_custkey % 9 = 0 THEN 'n/a'
                    ELSE CAST(CAST(c_acctbal AS DECIMAL(19,4)) AS STRING) END AS acctbal,
               CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS segment,
               CONCAT('user', CAST(c_custkey AS STRING),
                      CASE WHEN c_custkey % 10 = 0 THEN '' ELSE '@example.com' END) AS email,
               c_nationkey
        FROM {customer}""",
    # The silver state before bronze_lines arrive: zeroed known lines and lines no
    # longer delivered.
    "silver_before": """
        SELECT l_orderkey, l_linenumber, MIN(l_partkey) AS l_partkey, CAST(0 AS SMALLINT) AS qty,
               CAST(0 AS DECIMAL(19,4)) AS price
        FROM {lineitem} WHERE l_orderkey % 2 = 0 GROUP BY l_orderkey, l_linenumber
        UNION ALL
        SELECT l_orderkey + 1000000000000, l_linenumber, MIN(l_partkey), CAST(1 AS SMALLINT),
               CAST(1 AS DECIMAL(19,4))
        FROM {lineitem} WHERE l_orderkey % 10 = 0 GROUP BY l_orderkey, l_linenumber""",
}

_NAMED = re.compile(r"\{(\w+)\}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or one derived from them."""
    if name in DERIVED:
        text = DERIVED[name]
        sources = {n: table(spark, sf_dir, n) for n in set(_NAMED.findall(text))}
        return spark.sql(text, **sources)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_derived(sql: str, *names: str, **more: str) -> str:
    """``sql`` with the named derived tables, and further CTEs, in front of it."""
    ctes = {n: _NAMED.sub(r"\1", DERIVED[n]) for n in names} | more
    if not ctes:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({text})" for n, text in ctes.items()) + "\n" + sql


def query(name: str, sql: str | None = None, *derived: str, **ctes: str) -> Callable[[Query], Query]:
    """Register a query, and the SQL that returns the same rows."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"registered twice: {name}")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = with_derived(sql, *derived, **ctes)
        return function

    return register
