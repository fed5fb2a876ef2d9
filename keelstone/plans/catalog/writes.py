"""Writes read back, load dispatch, audit, reconciliation and whole layered runs."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from keelstone.operators import audit as A
from keelstone.operators.dedupe import aggregate
from keelstone.operators.lookup import lookup, lookup_rejects
from keelstone.operators.scd import ScdSpec
from keelstone.plans import load as L
from keelstone.plans import medallion as M
from keelstone.plans.catalog.base import AS_OF, query, table
from keelstone.plans.catalog.dimensions import CLASSIFIED, SPEC, versions_sql
from keelstone.plans.catalog.facts import product_lookup
from keelstone.plans.catalog.merges import MERGED_LINES
from keelstone.session import scratch_path
from keelstone.sinks import compaction, layout, partitions, tables

LINE_COLUMNS = ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate")


def lines(spark, sf):
    return table(spark, sf, "lineitem").select(*LINE_COLUMNS)


@query("full_load", "SELECT productid, productname, unitprice FROM src_part", "src_part")
def full_load(spark, sf):
    path = scratch_path(spark, "full-load")
    # The first state has other rows and another schema; the second replaces both.
    tables.commit(table(spark, sf, "dim_part"), path)
    new = table(spark, sf, "src_part").select("productid", "productname", "unitprice")
    return tables.commit(new, path)


YEARS = ", CAST(YEAR(l_shipdate) AS INTEGER) AS year, CAST(MONTH(l_shipdate) AS INTEGER) AS month"


@query(
    "partition_replace",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, CAST(YEAR(l_shipdate) AS INTEGER) AS year,
              CASE WHEN YEAR(l_shipdate) = (SELECT MIN(YEAR(l_shipdate)) FROM lineitem)
                   THEN l_quantity + 1 ELSE l_quantity END AS l_quantity FROM lineitem""",
)
def partition_replace(spark, sf):
    path = scratch_path(spark, "by-year")
    rows = lines(spark, sf).withColumn("year", F.year("l_shipdate"))
    partitions.write_partitioned(rows, path, ["year"])
    stored = spark.read.parquet(path)
    first_year = rows.agg(F.min("year")).scalar()
    fixed = stored.filter(F.col("year") == first_year).withColumn("l_quantity", F.col("l_quantity") + 1)
    # Reads the partition it replaces; the other years are not touched.
    partitions.replace_partitions(fixed, path, ["year"])
    return spark.read.parquet(path)


@query(
    "merge_partitions",
    """SELECT l_orderkey, l_linenumber, l_partkey, qty, CAST(year AS INTEGER) AS year FROM (
           SELECT l_orderkey, l_linenumber, YEAR(l_shipdate) AS year, MIN(l_partkey) AS l_partkey,
                  CASE WHEN YEAR(l_shipdate) = (SELECT MAX(YEAR(l_shipdate)) FROM lineitem)
                       THEN MAX(l_quantity) ELSE MIN(l_quantity) END AS qty
           FROM lineitem GROUP BY 1, 2, 3) g""",
)
def merge_partitions(spark, sf):
    path = scratch_path(spark, "merge-by-year")
    keys = ["l_orderkey", "l_linenumber", "year"]
    grouped = lines(spark, sf).withColumn("year", F.year("l_shipdate"))
    grouped = grouped.groupBy(*keys).agg(
        F.min("l_partkey").alias("l_partkey"),
        F.min("l_quantity").alias("qty"),
        F.max("l_quantity").alias("new_qty"),
    )
    partitions.write_partitioned(grouped.drop("new_qty"), path, ["year"])
    last_year = lines(spark, sf).agg(F.max(F.year("l_shipdate"))).scalar()
    increment = grouped.filter(F.col("year") == last_year)
    increment = increment.select(*keys, "l_partkey", F.col("new_qty").alias("qty"))
    partitions.merge_partitions(increment, path, keys, ["year"])
    return spark.read.parquet(path)


@query("partitioned_write", f"SELECT {', '.join(LINE_COLUMNS)}{YEARS} FROM lineitem")
def partitioned_write(spark, sf):
    path = scratch_path(spark, "by-month")
    rows = partitions.add_date_parts(lines(spark, sf), "l_shipdate")
    partitions.write_partitioned(rows, path, ["year", "month"])
    return spark.read.parquet(path)


@query(
    "bronze_append_evolve",
    """SELECT productid, productname, supplierid, categoryid, unitprice, discontinued, NULL AS grade
       FROM src_part
       UNION ALL
       SELECT productid, productname, supplierid, NULL, unitprice, discontinued, 'A' FROM src_part""",
    "src_part",
)
def bronze_append_evolve(spark, sf):
    path = scratch_path(spark, "evolving")
    first = table(spark, sf, "src_part")
    partitions.append_fixed(first, path, first.schema)
    # The second delivery lacks one column and brings a new one.
    partitions.append_evolving(first.drop("categoryid").withColumn("grade", F.lit("A")), path)
    return partitions.read_evolving(spark, path)


DIM_SCHEMA = (
    "productkey bigint, productid bigint, productname string, supplierid string, categoryid string, "
    "unitprice decimal(19,4), discontinued boolean, flag boolean"
)
LINE_SCHEMA = "l_orderkey bigint, l_linenumber int, l_partkey bigint, qty smallint, price decimal(19,4), _ingestion_timestamp timestamp_ntz"
INCREMENT = """SELECT l_orderkey, l_linenumber, l_partkey, qty, price FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber
        ORDER BY _ingestion_timestamp DESC, l_partkey NULLS FIRST, qty NULLS FIRST, price NULLS FIRST) AS rn
    FROM bronze_lines) r WHERE rn = 1"""


@query(
    "load_dispatch",
    f"""SELECT 'FULL_OVERWRITE' AS strategy, productid AS id, -1 AS line, unitprice AS amount, TRUE AS flag
        FROM src_part
        UNION ALL
        SELECT 'INCREMENTAL', l_orderkey, l_linenumber, price, TRUE FROM ({INCREMENT}) i
        UNION ALL
        SELECT 'SCD_2', productid, -1, unitprice, flag FROM ({versions_sql(False)}) v""",
    "src_part",
    "dim_part",
    "bronze_lines",
    **CLASSIFIED,
    dim="SELECT * FROM dim_part",
)
def load_dispatch(spark, sf):
    source, bronze = table(spark, sf, "src_part"), table(spark, sf, "bronze_lines")

    full = L.load(
        source,
        scratch_path(spark, "dispatch-full"),
        source.schema,
        L.LoadOptions(L.FULL_OVERWRITE, ("productid",)),
    )

    # Two increments into one table: the second starts above the first one's mark.
    path = scratch_path(spark, "dispatch-increment")
    options = L.LoadOptions(
        L.INCREMENTAL,
        ("l_orderkey", "l_linenumber"),
        watermark="_ingestion_timestamp",
        ignore_duplicates=True,
    )
    early = F.col("_ingestion_timestamp") < F.lit("1998-01-01").cast("timestamp_ntz")
    L.load(bronze.filter(early), path, LINE_SCHEMA, options)
    merged = L.load(bronze, path, LINE_SCHEMA, options)

    path = scratch_path(spark, "dispatch-history")
    tables.commit(table(spark, sf, "dim_part"), path)
    history = L.load(source, path, DIM_SCHEMA, L.LoadOptions(L.SCD_2, ("productid",), scd=SPEC))

    none = F.lit(-1).alias("line")
    return (
        full.select(F.lit("FULL_OVERWRITE").alias("strategy"), F.col("productid").alias("id"), none, F.col("unitprice").alias("amount"), F.lit(True).alias("flag"))
        .unionByName(
            merged.select(F.lit("INCREMENTAL").alias("strategy"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("price").alias("amount"), F.lit(True).alias("flag"))
        )
        .unionByName(
            history.select(F.lit("SCD_2").alias("strategy"), F.col("productid").alias("id"), none, F.col("unitprice").alias("amount"), "flag")
        )
    )


NULL_KEYED = "SELECT productid, productname, CASE WHEN productid % 7 = 0 THEN NULL ELSE productid END AS code, productid % 3 AS part FROM src_part"


@query(
    "load_null_keys",
    """SELECT way, run, SUM(n) AS n_rows, SUM(a) AS n_aside FROM (
           SELECT unnest(['whole', 'whole', 'parts', 'parts']) AS way, unnest([1, 2, 1, 2]) AS run,
                  CASE WHEN code IS NULL THEN 0 ELSE 1 END AS n, CASE WHEN code IS NULL THEN 1 ELSE 0 END AS a
           FROM dirty) d GROUP BY way, run""",
    "src_part",
    dirty=NULL_KEYED,
)
def load_null_keys(spark, sf):
    """Loaded and quarantined rows are the source's, in both kinds of load, first and second."""
    source = spark.sql(NULL_KEYED.replace("src_part", "{src_part}"), src_part=table(spark, sf, "src_part"))
    schema = "productid bigint, productname string, code bigint, part bigint"
    counts = []
    for way in ("whole", "parts"):
        path = scratch_path(spark, "null-keys")
        for run in (1, 2):
            aside = scratch_path(spark, "null-keys-aside")
            if way == "whole":
                options = L.LoadOptions(L.INCREMENTAL, ("code",), quarantine=aside)
                loaded = L.load(source, path, schema, options)
            else:
                options = L.LoadOptions(L.INCREMENTAL, ("code", "part"), quarantine=aside)
                loaded = L.load_partitioned(source, path, schema, options, ["part"])
            both = loaded.select(F.lit(1).alias("n"), F.lit(0).alias("a")).unionByName(
                spark.read.parquet(aside).select(F.lit(0).alias("n"), F.lit(1).alias("a"))
            )
            # Counted now: the next run replaces the files.
            counts.append((way, run, *both.agg(F.sum("n"), F.sum("a")).first()))
    return spark.createDataFrame(counts, "way string, run int, n_rows bigint, n_aside bigint")


# Texts that are, or look like, something else as a folder name.
AWKWARD = """CASE productid % 8 WHEN 0 THEN '' WHEN 1 THEN '%' WHEN 2 THEN 'a/b' WHEN 3 THEN '01'
    WHEN 4 THEN '__HIVE_DEFAULT_PARTITION__' WHEN 5 THEN '~' WHEN 6 THEN ' =x ' ELSE 'plain' END"""
FOLDERED = f"SELECT productid AS id, {AWKWARD} AS part, unitprice, productid % 3 AS day FROM src_part"


@query(
    "partition_key_values",
    """SELECT 'incremental' AS way, id, part, CASE WHEN day > 0 THEN unitprice + 1 ELSE unitprice END AS amount, TRUE AS flag
       FROM foldered
       UNION ALL SELECT 'history', id, part, unitprice, day <> 1 FROM foldered
       UNION ALL SELECT 'history', id, part, unitprice + 1, TRUE FROM foldered WHERE day = 1
       UNION ALL SELECT 'layers', id, part, CASE WHEN day > 0 THEN unitprice + 1 ELSE unitprice END, TRUE FROM foldered""",
    "src_part",
    foldered=FOLDERED,
)
def partition_key_values(spark, sf):
    """Every text is a partition of its own, in two increments, a history and a layered run."""
    rows = spark.sql(FOLDERED.replace("src_part", "{src_part}"), src_part=table(spark, sf, "src_part"))
    amount = (F.col("unitprice") + F.col("run")).cast("decimal(19,4)").alias("unitprice")
    # The second delivery has other days, most of them again.
    first = rows.withColumn("run", F.lit(0)).filter("day < 2").select("id", "part", amount)
    second = rows.withColumn("run", F.lit(1)).filter("day > 0").select("id", "part", amount)
    schema, by = "id bigint, unitprice decimal(19,4), part string", ["part"]

    path = scratch_path(spark, "awkward")
    options = L.LoadOptions(L.INCREMENTAL, ("id", "part"))
    L.load_partitioned(first, path, schema, options, by)
    merged = L.load_partitioned(second, path, schema, options, by)

    path = scratch_path(spark, "awkward-history")
    spec = ScdSpec("sk", ("id", "part"), historical=("unitprice",))
    options = L.LoadOptions(L.SCD_2, spec.keys, scd=spec)
    held = "sk bigint, id bigint, unitprice decimal(19,4), flag boolean, part string"
    whole = rows.select("id", "part", "unitprice")
    L.load_partitioned(whole, path, held, options, by)
    history = L.load_partitioned(second.join(rows.filter("day = 1").select("id", "part"), ["id", "part"]), path, held, options, by)

    root = scratch_path(spark, "awkward-layers")
    for day, delivered in (("01", first), ("02", second)):
        sales = delivered.withColumn("qty", F.lit(1).cast("smallint"))
        fact = M.FactTable("sales", ("id", "part"), partition_by=("part",))
        gold = M.run_layers(spark, {"sales": sales}, [], [fact], root, "erp", f"2024-02-{day} 00:00:00")

    def shown(df, way, flag=F.lit(True)):
        return df.select(F.lit(way).alias("way"), "id", "part", F.col("unitprice").alias("amount"), flag.alias("flag"))

    return (
        shown(merged, "incremental")
        .unionByName(shown(history, "history", F.col("flag")))
        .unionByName(shown(gold["sales"], "layers"))
    )


MARKED = "SELECT productid AS id, CASE WHEN productid % 5 = 4 THEN NULL ELSE productid - 3 END AS mark FROM src_part"


@query(
    "first_load_all_rows",
    "SELECT id, mark, CASE WHEN mark IS NULL THEN 'aside' ELSE 'loaded' END AS place FROM marked",
    "src_part",
    marked=MARKED,
)
def first_load_all_rows(spark, sf):
    """An empty target takes marks of zero and below; rows without a mark are put aside."""
    source = spark.sql(MARKED.replace("src_part", "{src_part}"), src_part=table(spark, sf, "src_part"))
    aside = scratch_path(spark, "unmarked")
    options = L.LoadOptions(L.INCREMENTAL, ("id",), watermark="mark", quarantine=aside)
    loaded = L.load(source, scratch_path(spark, "first-load"), "id bigint, mark bigint", options)
    kept = spark.read.parquet(aside).drop(L.REASON)
    return loaded.withColumn("place", F.lit("loaded")).unionByName(kept.withColumn("place", F.lit("aside")))


@query(
    "load_dispatch_partitioned",
    f"""SELECT 'FULL_OVERWRITE' AS strategy, productid AS id, -1 AS line,
               CASE WHEN productid % 4 = 1 THEN unitprice + 1 ELSE unitprice END AS amount, TRUE AS flag
        FROM src_part
        UNION ALL
        SELECT 'INCREMENTAL', l_orderkey, l_linenumber, price, TRUE FROM ({INCREMENT}) i
        UNION ALL
        SELECT 'SCD_2', productid, -1, unitprice, flag FROM ({versions_sql(False)}) v""",
    "src_part",
    "dim_part",
    "bronze_lines",
    **CLASSIFIED,
    dim="SELECT * FROM dim_part",
)
def load_dispatch_partitioned(spark, sf):
    source, bronze = table(spark, sf, "src_part"), table(spark, sf, "bronze_lines")

    path = scratch_path(spark, "parts-full")
    rows = source.select("productid", "unitprice", (F.col("productid") % 4).alias("part"))
    schema = "productid bigint, unitprice decimal(19,4), part bigint"
    options = L.LoadOptions(L.FULL_OVERWRITE, ("productid",))
    L.load_partitioned(rows, path, schema, options, ["part"])
    # One partition is delivered again.
    again = rows.filter("part = 1").withColumn("unitprice", (F.col("unitprice") + 1).cast("decimal(19,4)"))
    full = L.load_partitioned(again, path, schema, options, ["part"])

    path = scratch_path(spark, "parts-increment")
    options = L.LoadOptions(
        L.INCREMENTAL, ("l_orderkey", "l_linenumber"), watermark="_ingestion_timestamp", ignore_duplicates=True
    )
    early = F.col("_ingestion_timestamp") < F.lit("1998-01-01").cast("timestamp_ntz")
    L.load_partitioned(bronze.filter(early), path, LINE_SCHEMA, options, ["l_linenumber"])
    merged = L.load_partitioned(bronze, path, LINE_SCHEMA, options, ["l_linenumber"])

    path = scratch_path(spark, "parts-history")
    bucket = (F.pmod("productid", F.lit(4))).alias("part")
    partitions.write_partitioned(table(spark, sf, "dim_part").select("*", bucket), path, ["part"])
    spec = replace(SPEC, keys=(*SPEC.keys, "part"))
    options = L.LoadOptions(L.SCD_2, spec.keys, scd=spec)
    history = L.load_partitioned(source.select("*", bucket), path, f"{DIM_SCHEMA}, part bigint", options, ["part"])

    none, true = F.lit(-1).alias("line"), F.lit(True).alias("flag")
    name = lambda text: F.lit(text).alias("strategy")
    return (
        full.select(name("FULL_OVERWRITE"), F.col("productid").alias("id"), none, F.col("unitprice").alias("amount"), true)
        .unionByName(
            merged.select(name("INCREMENTAL"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("price").alias("amount"), true)
        )
        .unionByName(history.select(name("SCD_2"), F.col("productid").alias("id"), none, F.col("unitprice").alias("amount"), "flag"))
    )


@query("load_table_by_name", "SELECT productid, unitprice + CASE WHEN productid % 2 = 0 THEN 1 ELSE 0 END AS unitprice FROM src_part", "src_part")
def load_table_by_name(spark, sf):
    """A catalog table as the target of a task, loaded twice, and read through a kept view."""
    name = f"keelstone_{uuid.uuid4().hex}"
    source = table(spark, sf, "src_part").select("productid", "unitprice")
    context = {"target": name, "schema": source.schema, "business_keys": ["productid"], "load_strategy": L.INCREMENTAL}
    tables.commit_table(source.limit(0), name, scratch_path(spark, "by-name"))
    for run in ("first", "second"):
        rows = source
        if run == "second":
            more = (F.col("unitprice") + 1).cast("decimal(19,4)")
            rows = source.filter("productid % 2 = 0").withColumn("unitprice", more)
        rows.createOrReplaceTempView(f"{name}_{run}")
        L.execute_task(spark, context | {"source": f"{name}_{run}"})
    return tables.publish_catalog_view(spark, f"{name}_view", f"SELECT productid, unitprice FROM {name}")


# Our choice: rows of a year from which its files are more than one.
FILE_ROWS = 3_000_000


@query(
    "compact_small_files",
    f"""SELECT {', '.join(LINE_COLUMNS)}, CAST(YEAR(l_shipdate) AS INTEGER) AS year, TRUE AS small_went, TRUE AS large_stayed
        FROM lineitem""",
)
def compact_small_files(spark, sf):
    """Many small appends and large files of every year: the small ones become few, the large ones stay."""
    path, year = scratch_path(spark, "appends"), F.year("l_shipdate").cast("int").alias("year")
    rows = lines(spark, sf).select("*", year)
    late = F.col("l_orderkey") % 10 > 5
    dealt, files = partitions.dealt_evenly(rows, ["year"], FILE_ROWS)

    def append(some):
        some.repartitionById(files, F.col(partitions.PIECE)).drop(partitions.PIECE).write.mode("append").partitionBy("year").parquet(path)

    append(dealt.filter(~late))
    large = compaction.stored_files(spark, path)
    for part in range(6, 10):
        append(dealt.filter(F.col("l_orderkey") % 10 == part))
    before = compaction.stored_files(spark, path)
    least = min(f.size for f in large)
    compaction.compact(spark, path, target_bytes=least, least_share=0.9)
    after = {f.path for f in compaction.stored_files(spark, path)}
    went = F.lit(len(after) < len(before)).alias("small_went")
    stayed = F.lit({f.path for f in large} <= after).alias("large_stayed")
    return partitions.read_known(spark, path, rows.schema, ["year"]).select("*", went, stayed)


@query("layout_preserves_rows", f"SELECT {', '.join(LINE_COLUMNS)} FROM lineitem")
def layout_preserves_rows(spark, sf):
    path = scratch_path(spark, "clustered")
    layout.compact_and_cluster(lines(spark, sf), ["l_orderkey", "l_partkey", "l_shipdate"], 8).write.parquet(path)
    return spark.read.parquet(path)


# ---------------------------------------------------------------- audit

HIT = "EXISTS (SELECT 1 FROM dim_part d WHERE d.flag AND d.productid = f.l_partkey)"


def _audit_sql(step: str, condition: str) -> str:
    return f"""SELECT 'fact_lines' AS job_name, '{step}' AS step, COUNT(*) AS n_rows,
                      TIMESTAMP '{AS_OF}' AS logged_at, 'SUCCEEDED' AS status
               FROM lines_dirty f WHERE {condition}"""


@query(
    "load_audit",
    " UNION ALL ".join(
        [_audit_sql("read", "TRUE"), _audit_sql("loaded", HIT), _audit_sql("rejected", f"NOT {HIT}")]
    ),
    "lines_dirty",
    "dim_part",
)
def load_audit(spark, sf):
    found = lookup(table(spark, sf, "lines_dirty"), product_lookup(spark, sf, "ignore"))
    missed = F.col("productkey").isNull()
    marked = found.withColumn("rejected", missed)
    counted, counter = A.observed(
        marked, f"load-{uuid.uuid4().hex}", {"read": None, "loaded": ~missed, "rejected": missed}
    )
    counted.write.partitionBy("rejected").parquet(scratch_path(spark, "audited"))
    log = scratch_path(spark, "audit-log")
    A.append_audit(A.audit_rows(spark, "fact_lines", counter, AS_OF), log)
    return spark.read.parquet(log)


def _layer_sql(layer: str, condition: str) -> str:
    return f"""SELECT '{layer}' AS layer, COUNT(*) AS n_rows, COUNT(*) AS expected_rows, TRUE AS balanced
               FROM lines_dirty f WHERE {condition}"""


@query(
    "layer_reconcile",
    " UNION ALL ".join(
        [
            _layer_sql("source", "TRUE"),
            _layer_sql("bronze", "TRUE"),
            _layer_sql("gold", HIT),
            _layer_sql("rejected", f"NOT {HIT}"),
        ]
    ),
    "lines_dirty",
    "dim_part",
)
def layer_reconcile(spark, sf):
    bronze, spec = table(spark, sf, "lines_dirty"), product_lookup(spark, sf, "drop")
    return A.reconcile(
        {
            "source": table(spark, sf, "lineitem"),
            "bronze": bronze,
            "gold": lookup(bronze, spec),
            "rejected": lookup_rejects(bronze, spec),
        },
        {"source": ["bronze"], "bronze": ["gold", "rejected"]},
    )


# ---------------------------------------------------------------- layered runs


@query("silver_load", MERGED_LINES, "bronze_lines", "silver_before")
def silver_load(spark, sf):
    return M.silver_load(
        table(spark, sf, "bronze_lines"),
        table(spark, sf, "silver_before"),
        ["l_orderkey", "l_linenumber"],
        "l_orderkey bigint, l_linenumber int, l_partkey bigint, qty smallint, price decimal(19,4)",
    )


@query(
    "medallion_end_to_end",
    """SELECT COALESCE(p.categoryid, 'Unknown') AS categoryid, COUNT(*) AS n_lines,
              CAST(SUM(f.amount) AS DECIMAL(38,4)) AS revenue
       FROM latest f LEFT JOIN src_part p ON p.productid = f.l_partkey
       GROUP BY 1""",
    "src_part",
    "lines_dirty",
    latest="""SELECT l_partkey, CAST(CAST(qty AS DECIMAL(10,0)) * price AS DECIMAL(19,4)) AS amount
              FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber
                        ORDER BY l_partkey NULLS FIRST, l_suppkey NULLS FIRST, qty NULLS FIRST,
                                 price NULLS FIRST, discount NULLS FIRST) AS rn
                    FROM lines_dirty) r WHERE rn = 1""",
)
def medallion_end_to_end(spark, sf):
    gold = M.run_layers(
        spark,
        {"product": table(spark, sf, "src_part"), "sales": table(spark, sf, "lines_dirty")},
        [M.DimensionTable("product", ("productid",), "productkey")],
        [
            M.FactTable(
                "sales",
                ("l_orderkey", "l_linenumber"),
                {"l_partkey": ("product", "productid")},
                price="price",
                partition_by=("l_linenumber",),
            )
        ],
        scratch_path(spark, "layers"),
        "erp",
        AS_OF,
    )
    # Lines shrink to one row per product before they meet the dimension.
    per_product = aggregate(
        gold["sales"],
        ["productkey"],
        {"n": F.count(F.lit(1)), "amount": F.sum("total_amount")},
    )
    names = gold["product"].select("productkey", "categoryid")
    return aggregate(
        per_product.join(names, "productkey"),
        ["categoryid"],
        {"n_lines": F.sum("n"), "revenue": F.sum("amount").cast("decimal(38,4)")},
    )
