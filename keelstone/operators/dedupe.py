"""Deduplication, set operations and grouped aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelstone.operators.columns import INGEST_COLUMNS


def latest_per_key(
    df: DataFrame,
    keys: Sequence[str],
    newest_by: str | Sequence[str],
) -> DataFrame:
    """The newest row of each key; ties are settled by all other columns ascending.

    ``row_number() = 1`` lets Spark keep one row per key and task before the shuffle,
    so a hot key never travels whole.
    """
    newest_by = [newest_by] if isinstance(newest_by, str) else list(newest_by)
    ties = [c for c in df.columns if c not in keys and c not in newest_by]
    order = [F.col(c).desc_nulls_last() for c in newest_by] + [F.col(c).asc_nulls_first() for c in ties]
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") == 1).drop("_rn")


def first_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key where no order is given: the smallest by the other columns."""
    ties = [F.col(c).asc_nulls_first() for c in df.columns if c not in keys]
    window = Window.partitionBy(*keys).orderBy(*(ties or [F.lit(0)]))
    return df.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") == 1).drop("_rn")


def distinct_rows(df: DataFrame, ignore: Sequence[str] = INGEST_COLUMNS) -> DataFrame:
    """Distinct rows of the business columns; ingest metadata would keep copies apart."""
    return df.drop(*ignore).distinct()


def union_all(*frames: DataFrame, pad_missing: bool = False) -> DataFrame:
    """UNION ALL by name; ``pad_missing`` fills columns one side lacks with NULL."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=pad_missing)
    return result


def aggregate(
    df: DataFrame, keys: Sequence[str], measures: Mapping[str, Column | str]
) -> DataFrame:
    """Grouped aggregate; measures are name -> SQL text or ``Column``."""
    exprs = [
        (F.expr(m) if isinstance(m, str) else m).alias(name) for name, m in measures.items()
    ]
    return df.groupBy(*keys).agg(*exprs)
