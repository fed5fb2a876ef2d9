"""Table, query, CSV and sample scans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelstone.types import as_schema

CORRUPT_COLUMN = "_corrupt_record"


def scan_table(spark: SparkSession, name_or_path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A catalog table by name, or parquet files by path; ``columns`` prunes the read."""
    is_path = "/" in name_or_path
    df = spark.read.parquet(name_or_path) if is_path else spark.read.table(name_or_path)
    return df.select(*columns) if columns else df


def scan_query(
    spark: SparkSession,
    query: str,
    frames: Mapping[str, DataFrame] | None = None,
    args: Mapping[str, object] | None = None,
) -> DataFrame:
    """Run a SELECT. ``{name}`` stands for a frame, ``:name`` for a bound value.

    Values are bound by Spark and never spliced into the text.
    """
    return spark.sql(query, args=dict(args) if args else None, **(frames or {}))


def scan_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    header: bool = True,
    strict: bool = True,
    **options: str,
) -> DataFrame:
    """CSV with a declared schema; nothing is inferred.

    ``strict`` fails on a malformed line. Otherwise the line is kept whole in
    ``_corrupt_record`` beside NULLs, so that it can be quarantined.
    """
    schema = as_schema(schema)
    reader = spark.read.options(header=str(header).lower(), **options)
    if strict:
        return reader.schema(schema).option("mode", "FAILFAST").csv(path)
    with_corrupt = T.StructType([*schema.fields, T.StructField(CORRUPT_COLUMN, T.StringType())])
    return (
        reader.schema(with_corrupt)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT_COLUMN)
        .csv(path)
    )


def sample_rows(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows by the given order: per-task top-n, no full sort."""
    return df.orderBy(*order_by).limit(n)


def dataset_inventory(frames: Mapping[str, DataFrame]) -> DataFrame:
    """(name, kind, n_rows) per dataset; one job counts all of them, without reading columns."""
    counts = [
        df.agg(F.count(F.lit(1)).cast("bigint").alias("n_rows")).select(
            F.lit(name).alias("name"), F.lit("TABLE").alias("kind"), "n_rows"
        )
        for name, df in frames.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def catalog_inventory(spark: SparkSession, database: str | None = None) -> DataFrame:
    """The inventory of a catalog database."""
    names = [t.name for t in spark.catalog.listTables(database) if not t.isTemporary]
    prefix = f"{database}." if database else ""
    return dataset_inventory({name: spark.read.table(prefix + name) for name in names})
