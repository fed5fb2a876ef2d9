"""Load audit rows and reconciliation of counts between layers."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from keelstone.functions.legacy import load_time

AUDIT_COLUMNS = ("job_name", "step", "n_rows", "logged_at", "status")


def observed(
    df: DataFrame, name: str, steps: Mapping[str, Column | None]
) -> tuple[DataFrame, Observation]:
    """``df`` with row counters that fill while it is written; no second scan.

    ``steps`` is step -> predicate of the rows to count, None for all rows. Observe the
    frame that is written: below a shuffle, a stage that runs again would count again.
    """
    counter = Observation(name)
    counts = []
    for step, predicate in steps.items():
        counted = F.lit(1) if predicate is None else F.when(predicate, F.lit(1))
        counts.append(F.count(counted).alias(step))
    return df.observe(counter, *counts), counter


def audit_rows(
    spark: SparkSession, job_name: str, counter: Observation, as_of: str | None = None
) -> DataFrame:
    """One audit row per counted step of a finished load."""
    rows = [(job_name, step, n) for step, n in counter.get.items()]
    counted = spark.createDataFrame(rows, "job_name string, step string, n_rows bigint")
    return counted.withColumns({"logged_at": load_time(as_of), "status": F.lit("SUCCEEDED")})


def append_audit(rows: DataFrame, path: str) -> None:
    """Append audit rows to the log."""
    rows.select(*AUDIT_COLUMNS).write.mode("append").parquet(path)


def reconcile(
    layers: Mapping[str, DataFrame], balance: Mapping[str, list[str]]
) -> DataFrame:
    """(layer, n_rows, expected_rows, balanced) per layer.

    ``balance`` names, for a layer, the layers whose counts must add up to its own:
    ``{"staged": ["loaded", "rejected"]}``. Layers without an entry only report. Each
    layer is counted once.
    """
    counts = reduce(
        DataFrame.unionByName,
        [
            df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("layer"), "n_rows")
            for name, df in layers.items()
        ],
    )
    # One row with a column per layer, then one row per layer again.
    wide = counts.agg(*[F.sum(F.when(F.col("layer") == n, F.col("n_rows"))).alias(n) for n in layers])
    rows = []
    for name in layers:
        parts = [F.col(p) for p in balance.get(name, [])]
        expected = reduce(lambda a, b: a + b, parts) if parts else F.col(name)
        rows.append(
            F.struct(
                F.lit(name).alias("layer"),
                F.col(name).alias("n_rows"),
                expected.alias("expected_rows"),
                (expected == F.col(name)).alias("balanced"),
            )
        )
    return wide.select(F.inline(F.array(*rows)))
