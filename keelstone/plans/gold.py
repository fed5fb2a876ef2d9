"""Gold aggregates beside the committed table they are taken from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelstone.operators.aggregates import AggregateSpec, aggregate_rows, maintain_aggregate, shown
from keelstone.sinks.tables import commit, read_current, read_feed, table_exists, versions

_SOURCE = "_source_version"


def refresh_aggregate(spark: SparkSession, fact_path: str, path: str, spec: AggregateSpec) -> DataFrame:
    """Bring the aggregate at ``path`` up to the committed fact; returns its groups and measures.

    The aggregate keeps the version of the fact it is of. Where all later versions were
    committed with their change feed and are kept, only their changes are added; a refresh
    that was cut short is repeated from the version it began with, so nothing counts twice.
    Else, and where the aggregate is new or empty, it is taken from all rows.
    """
    now = versions(spark, fact_path)[-1]
    stored = read_current(spark, path) if table_exists(spark, path) else None
    done = stored.agg(F.max(_SOURCE).alias("v")).first().v if stored is not None else None
    if done == now:
        return shown(stored.drop(_SOURCE), spec)
    fact = read_current(spark, fact_path)
    feed = read_feed(spark, fact_path, done) if done is not None else None
    if feed is None:
        fresh = aggregate_rows(fact, spec)
    else:
        fresh = maintain_aggregate(stored.drop(_SOURCE), feed, fact, spec)
    return shown(commit(fresh.withColumn(_SOURCE, F.lit(now)), path).drop(_SOURCE), spec)
