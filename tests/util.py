from __future__ import annotations

from pyspark.sql import DataFrame


def rows(df: DataFrame) -> list[str]:
    """Rows as sorted text, for comparing frames as multisets."""
    return sorted(repr(tuple(r)) for r in df.collect())


def plan(df: DataFrame) -> str:
    """The physical plan as text."""
    return df._jdf.queryExecution().executedPlan().toString()
