"""Versioned table commits on plain parquet.

A table is a folder of version folders ``v=1, v=2, ...``. A version counts from the
moment Spark's commit protocol writes its ``_SUCCESS`` marker, so a failed or running
write is never read, a new state can be computed from the current one, and the last
versions stay for rollback and change feeds.
"""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelstone.operators.changes import CHANGE_TYPE
from keelstone.operators.merge import FEED, PART, STATE
from keelstone.session import scratch_path
from keelstone.sinks.folders import from_folders, to_folders
from keelstone.types import as_schema

KEEP_VERSIONS = 2
# Our choice: hours for which an older version may still be read.
RETENTION_HOURS = 168
FEED_VERSION = "_version"
_VERSION = "v="


def _hadoop_path(spark: SparkSession, path: str):
    """A path and its file system: local, HDFS or object store alike."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _found(spark: SparkSession, pattern: str) -> list:
    at, fs = _hadoop_path(spark, pattern)
    return [status.getPath() for status in fs.globStatus(at) or []]


def _number(folder) -> int:
    return int(folder.getName().removeprefix(_VERSION))


def _delete_version(spark: SparkSession, path: str, version: int) -> None:
    at, fs = _hadoop_path(spark, version_path(path, version))
    fs.delete(at, True)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Committed versions, oldest first."""
    markers = _found(spark, f"{path}/{_VERSION}*/_SUCCESS")
    return sorted(_number(marker.getParent()) for marker in markers)


def has_rows_written(spark: SparkSession, path: str) -> bool:
    """Whether a write to the folder itself (not to a version of it) has finished.

    Partitions that were moved in one by one have no marker but their folders.
    """
    return bool(_found(spark, f"{path}/_SUCCESS") or _found(spark, f"{path}/*=*"))


def version_path(path: str, version: int) -> str:
    """Folder of one version."""
    return f"{path}/{_VERSION}{version}"


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether anything has been committed."""
    return bool(versions(spark, path))


def read_current(spark: SparkSession, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """The latest committed version; ``partition_by`` as it was committed."""
    committed = versions(spark, path)
    if not committed:
        raise FileNotFoundError(f"no committed version under {path}")
    return from_folders(read_version(spark, path, committed[-1]), partition_by)


def read_version(spark: SparkSession, path: str, version: int) -> DataFrame:
    """One kept version, for rollback or a change feed."""
    if _has_feed(spark, path, version):
        return spark.read.parquet(f"{version_path(path, version)}/{PART}={STATE}").drop(CHANGE_TYPE)
    return spark.read.parquet(version_path(path, version))


def _has_feed(spark: SparkSession, path: str, version: int) -> bool:
    return bool(_found(spark, f"{version_path(path, version)}/{PART}=*"))


def read_feed(spark: SparkSession, path: str, after: int) -> DataFrame | None:
    """What changed in the versions after one, in any order, beside their numbers.

    None where one of them was not committed with its feed, or is not kept any more.
    """
    committed = versions(spark, path)
    wanted = [v for v in committed if v > after]
    if not committed or not all(_has_feed(spark, path, v) for v in wanted):
        return None
    # Numbers of failed writes are left out; a version that is gone is older than the first.
    if committed[0] > after:
        return None
    state = read_version(spark, path, committed[-1])
    schema = T.StructType([*state.schema.fields, T.StructField(CHANGE_TYPE, T.StringType())])
    feeds = empty_frame(spark, schema).withColumn(FEED_VERSION, F.lit(0))
    for v in wanted:
        feed = spark.read.schema(schema).parquet(*_feed_paths(spark, path, v)) if _feed_paths(spark, path, v) else None
        if feed is not None:
            feeds = feeds.unionByName(feed.withColumn(FEED_VERSION, F.lit(v)))
    return feeds


def _feed_paths(spark: SparkSession, path: str, version: int) -> list[str]:
    """The folder of a version's changes; none if nothing changed."""
    return [str(p) for p in _found(spark, f"{version_path(path, version)}/{PART}={FEED}")]


def empty_frame(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    """No rows under a schema, in a form the optimizer sees through: joins with it fold away."""
    nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in as_schema(schema).fields]
    return spark.range(0, 1, 1, 1).select(*nulls).filter(F.lit(False))


def load_or_empty(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The current version, or an empty frame: first load and later loads are one plan."""
    if table_exists(spark, path):
        return read_current(spark, path)
    return empty_frame(spark, schema)


def commit(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    keep: int = KEEP_VERSIONS,
    retention_hours: float = RETENTION_HOURS,
    gather: bool = True,
) -> DataFrame:
    """Write ``df`` as the next version, drop versions out of use, return the new state.

    A version goes when it is not among the last ``keep`` and was replaced more than
    ``retention_hours`` ago: frames that still read it have had that long.

    Rows of a partition are gathered by one more shuffle, so that small ones make one file.
    Without ``gather`` every task writes a file for each partition that it has rows of.

    ``df`` may read the current version. One writer at a time: a state computed from an
    older version than the current one would undo what came between.
    """
    spark = df.sparkSession
    # Folders of failed writes keep their number: the next one is above all of them.
    claimed = [_number(folder) for folder in _found(spark, f"{path}/{_VERSION}*")]
    version = max(claimed, default=0) + 1
    rows = to_folders(df, partition_by)
    if partition_by and gather:
        rows = rows.hint("rebalance", *partition_by)
    rows.write.mode("errorifexists").partitionBy(*partition_by).parquet(version_path(path, version))
    markers = {_number(m.getParent()): m for m in _found(spark, f"{path}/{_VERSION}*/_SUCCESS")}
    known = sorted(markers)
    for old, replaced_by in list(zip(known, known[1:]))[: -max(keep - 1, 0) or None]:
        _, fs = _hadoop_path(spark, path)
        age = time.time() - fs.getFileStatus(markers[replaced_by]).getModificationTime() / 1000
        if age >= retention_hours * 3600:
            _delete_version(spark, path, old)
    # The schema is known: a state without rows has no file to take it from.
    fields = [f for f in df.schema.fields if f.name not in partition_by] + [df.schema[c] for c in partition_by]
    return from_folders(spark.read.schema(T.StructType(fields)).parquet(version_path(path, version)), partition_by)


def commit_tagged(tagged: DataFrame, path: str) -> DataFrame:
    """Commit the state of a tagged merge and its change feed as one version, by one write.

    Both are visible with the version's marker or not at all. ``read_feed`` returns what
    changed; all else treats such a version as any other. An empty state keeps its schema.
    The tasks of the merge write both parts: two folders need no shuffle to gather them.
    """
    spark = tagged.sparkSession
    columns = T.StructType([f for f in tagged.schema.fields if f.name not in (PART, CHANGE_TYPE)])
    commit(tagged, path, [PART], gather=False)
    version = versions(spark, path)[-1]
    state = f"{version_path(path, version)}/{PART}={STATE}"
    return spark.read.schema(columns).parquet(state) if _found(spark, state) else empty_frame(spark, columns)


def roll_back(spark: SparkSession, path: str) -> DataFrame:
    """Drop the latest version and return the one before it."""
    committed = versions(spark, path)
    if len(committed) < 2:
        raise ValueError(f"no earlier version under {path}")
    _delete_version(spark, path, committed[-1])
    return read_current(spark, path)


def publish_view(df: DataFrame, name: str) -> DataFrame:
    """A session view over the frame, as a gold layer is read."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def publish_catalog_view(spark: SparkSession, name: str, query: str) -> DataFrame:
    """A view kept by the catalog: its text, evaluated when it is read."""
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS {query}")
    return spark.table(name)


def is_table_name(target: str) -> bool:
    """Whether a target names a catalog table; anything with a slash is a folder."""
    return "/" not in target


def commit_table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Replace a catalog table, or create it (at ``path`` if one is given).

    ``df`` may read the table: its rows are staged in the shared folder first. For the
    moment of the replacement the table is incomplete, as it is without a table format;
    running the load again repairs one that was cut short.
    """
    spark = df.sparkSession
    staged = stage(df, scratch_path(spark, "staged"))
    if spark.catalog.tableExists(name):
        # By position, into the table's own columns and place.
        staged.select(*spark.table(name).columns).write.insertInto(name, overwrite=True)
    else:
        writer = staged.write.format("parquet")
        (writer.option("path", path) if path else writer).saveAsTable(name)
    return spark.table(name)


def stage(df: DataFrame, path: str) -> DataFrame:
    """Replace a staging folder and read it back.

    Only worth a write when several consumers share an expensive input; a single
    consumer is pipelined by Spark.
    """
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
