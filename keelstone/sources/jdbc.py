"""JDBC reads and writes spread over several connections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def jdbc_read_options(
    url: str,
    query: str,
    partition_column: str | None = None,
    lower: int | None = None,
    upper: int | None = None,
    num_partitions: int = 32,
    fetch_size: int = 10_000,
    **extra: str,
) -> dict[str, str]:
    """Options for a pushed-down query, read by ranges of ``partition_column``.

    The bounds only place the ranges: rows outside them fall into the first and
    last range, none is dropped.
    """
    options = {"url": url, "dbtable": f"({query}) AS src", "fetchsize": str(fetch_size)}
    if partition_column is not None:
        if lower is None or upper is None:
            raise ValueError("a partitioned read needs lower and upper")
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": str(lower),
            "upperBound": str(upper),
            "numPartitions": str(num_partitions),
        }
    return options | extra


def read_jdbc(spark: SparkSession, **options) -> DataFrame:
    """See :func:`jdbc_read_options`. Filters and columns are pushed by Spark."""
    return spark.read.format("jdbc").options(**jdbc_read_options(**options)).load()


def jdbc_write_options(
    url: str, table: str, num_partitions: int = 16, batch_size: int = 10_000, **extra: str
) -> dict[str, str]:
    """``num_partitions`` bounds the connections, ``batch_size`` the rows per round trip."""
    return {
        "url": url,
        "dbtable": table,
        "numPartitions": str(num_partitions),
        "batchsize": str(batch_size),
    } | extra


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options) -> None:
    """Write to a warehouse table over JDBC."""
    df.write.format("jdbc").options(**jdbc_write_options(url, table, **options)).mode(mode).save()
