"""Partitioned, appending and partition-replacing writes.

Text values name their folders as :mod:`keelstone.sinks.folders` says; read such a table with
:func:`read_partitioned` or :func:`read_known`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelstone.operators.columns import enforce_schema
from keelstone.operators.merge import merge
from keelstone.sinks.folders import from_folders, to_folders
from keelstone.types import as_schema

PIECE = "_piece"


def add_date_parts(df: DataFrame, column: str, year: str = "year", month: str = "month") -> DataFrame:
    """Year and month columns to partition by."""
    return df.withColumns({year: F.year(column), month: F.month(column)})


def write_partitioned(
    df: DataFrame, path: str, partition_by: Sequence[str], mode: str = "errorifexists"
) -> None:
    """Write by partition value.

    The rebalance hint brings a value's rows together, so that small values make one
    file, and splits a value that is larger than the advisory partition size over
    several tasks.
    """
    rows = to_folders(df, partition_by).hint("rebalance", *partition_by)
    rows.write.mode(mode).partitionBy(*partition_by).parquet(path)


def dealt_evenly(df: DataFrame, partition_by: Sequence[str], max_rows: int) -> tuple[DataFrame, int]:
    """``df`` with the piece of its partition value that a row is dealt to, and how many there are.

    A value has as few pieces as keep them near ``max_rows`` rows, all about equal; pieces are
    numbered through. Rows are dealt by chance: copies and hot keys spread like others. The
    driver gets a line per partition value, as it does from a listing of the folders.
    """
    found = df.groupBy(*partition_by).agg(F.count(F.lit(1)).alias("_n")).collect()
    places, pieces = [], 0
    for row in found:
        places.append((*row[:-1], pieces, own := -(-row[-1] // max_rows)))
        pieces += own
    fields = [T.StructField(f"_p_{c}", df.schema[c].dataType) for c in partition_by]
    fields += [T.StructField(c, T.IntegerType()) for c in ("_first", "_pieces")]
    at = F.broadcast(df.sparkSession.createDataFrame(places, T.StructType(fields)))
    same: Column = F.lit(True)
    for c in partition_by:
        same = same & F.col(c).eqNullSafe(F.col(f"_p_{c}"))
    piece = F.col("_first") + F.floor(F.rand(0) * F.col("_pieces")).cast("int")
    return df.join(at, same, "left").withColumn(PIECE, piece).select(*df.columns, PIECE), max(pieces, 1)


def replace_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replace the partitions ``df`` has rows for; all others stay.

    Files are staged and moved in when the job commits, so ``df`` may read ``path``.
    """
    (
        to_folders(df, partition_by)
        .hint("rebalance", *partition_by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def _partition_text(partition_by: Sequence[str]) -> Column:
    """One text per partition, NULLs being values like any other."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for c in partition_by]
    return F.concat_ws("\x1f", *parts)


def touched_partitions(source: DataFrame, partition_by: Sequence[str]) -> Column:
    """Predicate for the partitions ``source`` has rows in.

    No job runs here: the values are a scalar subquery, which Spark evaluates before the scan
    it filters. As a filter on partition columns alone it chooses the folders to open then,
    where the listing has one entry for each of them.
    """
    texts = source.select(_partition_text(partition_by).alias("p")).agg(F.collect_set("p").alias("ps"))
    return F.array_contains(texts.scalar(), _partition_text(partition_by))


def read_partitioned(path: str, like: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """A partitioned folder with the partition columns typed as in ``like``.

    Spark would read a text value such as 01 as a number and write it back as 1. A folder
    without files has the columns of ``like``.
    """
    spark = like.sparkSession
    types = {f.name: f.dataType for f in like.schema.fields}
    try:
        stored = spark.read.parquet(path).schema.fields
    except AnalysisException as error:
        if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        kept = [f for f in like.schema.fields if f.name not in partition_by]
        stored = [*kept, *[like.schema[c] for c in partition_by]]
    fields = [
        T.StructField(f.name, types[f.name] if f.name in partition_by else f.dataType) for f in stored
    ]
    return read_known(spark, path, T.StructType(fields), partition_by)


def read_known(
    spark: SparkSession, path: str, schema: T.StructType | str, partition_by: Sequence[str]
) -> DataFrame:
    """A partitioned folder whose columns are known, without a look at its files."""
    return from_folders(spark.read.schema(as_schema(schema)).parquet(path), partition_by)


def merge_partitions(
    source: DataFrame, path: str, keys: Sequence[str], partition_by: Sequence[str], **merge_options
) -> None:
    """Upsert a small increment into a large partitioned table.

    Only the partitions the increment touches are read, merged and replaced. A key keeps
    its partition: put the partition columns into ``keys``.
    """
    missing = [c for c in partition_by if c not in keys]
    if missing:
        raise ValueError(f"partition columns must be part of the merge key: {missing}")
    slice_ = read_partitioned(path, source, partition_by).filter(touched_partitions(source, partition_by))
    replace_partitions(merge(slice_, source, keys, **merge_options), path, partition_by)


def append_evolving(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Append; columns may be missing or new compared with earlier appends."""
    to_folders(df, partition_by).write.mode("append").partitionBy(*partition_by).parquet(path)


def read_evolving(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """All appends under one schema, absent columns being NULL.

    Naming the schema saves reading every file footer; naming the columns of the folders
    brings back empty texts, which Spark would take for NULL.
    """
    if schema is not None:
        return read_known(spark, path, schema, partition_by)
    return from_folders(spark.read.option("mergeSchema", "true").parquet(path), partition_by)


def append_fixed(df: DataFrame, path: str, schema: T.StructType | str) -> None:
    """Append rows cast to a fixed schema; a bad value fails the write."""
    enforce_schema(df, schema).write.mode("append").parquet(path)
