"""Bronze, silver and gold layers, and a run over several tables."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelstone.functions.legacy import load_time
from keelstone.operators.columns import (
    INGEST_COLUMNS,
    INGESTED_AT,
    UNKNOWN_KEY,
    ColumnMapping,
    add_ingest_columns,
    enforce_schema,
    mask_by_mapping,
)
from keelstone.operators.dedupe import latest_per_key
from keelstone.operators.keys import add_unknown_member, assign_surrogate_keys
from keelstone.operators.lookup import Lookup, lookup
from keelstone.operators.merge import merge, null_key_rows, placeable
from keelstone.plans.facts import with_total
from keelstone.session import cut_lineage
from keelstone.sinks.partitions import (
    merge_partitions,
    read_evolving,
    read_partitioned,
    replace_partitions,
    touched_partitions,
    write_partitioned,
)
from keelstone.sinks.tables import commit, empty_frame, has_rows_written, load_or_empty

INGEST_DATE = "_ingestion_date"
BATCH = "_batch_id"


def bronze_ingest(source: DataFrame, path: str, source_system: str, as_of: str | None = None) -> DataFrame:
    """Add the source with load time and origin, in a folder per load date and run.

    A run repeated with the same ``as_of`` replaces its own rows, no others.
    Returns bronze under the columns of this delivery; earlier ones may have had others,
    which :func:`keelstone.sinks.partitions.read_evolving` brings together.
    """
    stamped = add_ingest_columns(source, source_system, as_of)
    batch = re.sub(r"\W", "-", as_of) if as_of else uuid.uuid4().hex
    stamped = stamped.withColumns({INGEST_DATE: F.to_date(INGESTED_AT), BATCH: F.lit(f"run-{batch}")})
    replace_partitions(stamped, path, [INGEST_DATE, BATCH])
    return read_evolving(source.sparkSession, path, stamped.schema)


def added_since(bronze: DataFrame, as_of: str) -> DataFrame:
    """Bronze rows loaded at or after ``as_of``; folders of earlier dates are not opened."""
    since = load_time(as_of)
    added = bronze.filter((F.col(INGEST_DATE) >= F.to_date(since)) & (F.col(INGESTED_AT) >= since))
    return added.drop(INGEST_DATE, BATCH)


def silver_rows(
    bronze: DataFrame,
    keys: Sequence[str],
    schema: T.StructType | str | None = None,
    mappings: Iterable[ColumnMapping] = (),
    newest_by: str = INGESTED_AT,
    mode: str = "strict",
    on_null_key: str = "fail",
) -> DataFrame:
    """Bronze -> latest row per key, cast to the silver schema, personal data masked.

    A NULL in the key fails the job; ``on_null_key="reject"`` is for callers that have put
    such rows aside.
    """
    latest = latest_per_key(placeable(bronze, keys, on_null_key), keys, newest_by)
    if schema is None:
        typed = latest.drop(*INGEST_COLUMNS)
    else:
        typed = enforce_schema(latest, schema, mode)
    return mask_by_mapping(typed, mappings)


def silver_load(
    bronze: DataFrame,
    target: DataFrame | None,
    keys: Sequence[str],
    schema: T.StructType | str | None = None,
    mappings: Iterable[ColumnMapping] = (),
    newest_by: str = INGESTED_AT,
    mode: str = "strict",
) -> DataFrame:
    """The silver table after merging the bronze rows into ``target`` (None: first load).

    The dedupe window and the merge join partition by the same keys: one shuffle of the
    bronze rows serves both.
    """
    rows = silver_rows(bronze, keys, schema, mappings, newest_by, mode)
    return rows if target is None else merge(target, rows, keys, source_is_unique=True)


def gold_dimension(
    silver: DataFrame, target: DataFrame | None, keys: Sequence[str], sk: str
) -> DataFrame:
    """Silver rows, unique by key, with stable surrogate keys and the unknown member."""
    if target is None:
        schema = T.StructType([*silver.schema.fields, T.StructField(sk, T.LongType())])
        target = empty_frame(silver.sparkSession, schema)
    keyed = assign_surrogate_keys(silver, target, keys, sk)
    return add_unknown_member(keyed, sk, keys)


def gold_fact(silver: DataFrame, lookups: Sequence[Lookup], quantity: str, price: str) -> DataFrame:
    """Silver facts with dimension keys and the total amount."""
    for spec in lookups:
        silver = lookup(silver, spec)
    return with_total(silver, quantity, price)


@dataclass(frozen=True)
class DimensionTable:
    """A dimension of a run: business key and surrogate key."""

    name: str
    keys: tuple[str, ...]
    sk: str
    schema: str | None = None
    mappings: tuple[ColumnMapping, ...] = ()


@dataclass(frozen=True)
class FactTable:
    """A fact of a run; ``references`` is fact column -> (dimension, its key column).

    With ``partition_by``, columns of the key, silver and gold are partitioned folders of
    which a run reads and replaces those its rows touch, and those with a fact whose
    dimension member has arrived since. Without it both are rewritten, and all lookups
    repeated. The result is the same.
    """

    name: str
    keys: tuple[str, ...]
    references: Mapping[str, tuple[str, str]] = field(default_factory=dict)
    quantity: str = "qty"
    price: str = "unitprice"
    schema: str | None = None
    mappings: tuple[ColumnMapping, ...] = ()
    partition_by: tuple[str, ...] = ()


def _late_members(gold: DataFrame, lookups: Sequence[Lookup], by: Sequence[str]) -> DataFrame:
    """Partitions with facts of the unknown member whose own member is there now."""
    found = gold.select(*by).limit(0)
    for spec in lookups:
        ((fk, key),), ((taken, sk),) = spec.on.items(), spec.take.items()
        members = spec.dim.filter(F.col(taken) != UNKNOWN_KEY).select(F.col(key).alias(fk))
        waiting = gold.filter(F.col(sk) == UNKNOWN_KEY).select(fk, *[c for c in by if c != fk])
        found = found.unionByName(waiting.join(members, fk, "left_semi").select(*by))
    return found.distinct()


def _load_fact_partitions(
    rows: DataFrame, fact: FactTable, lookups: Sequence[Lookup], silver_path: str, gold_path: str
) -> DataFrame:
    """Merge new silver rows and recompute the gold partitions they touch."""
    spark, by = rows.sparkSession, fact.partition_by
    rows = cut_lineage(rows)
    if has_rows_written(spark, silver_path):
        merge_partitions(rows, silver_path, fact.keys, by, source_is_unique=True, small_source=True)
    else:
        write_partitioned(rows, silver_path, by)
    changed = rows.select(*by)
    if has_rows_written(spark, gold_path):
        changed = changed.unionByName(_late_members(read_partitioned(gold_path, rows, by), lookups, by))
    silver = read_partitioned(silver_path, rows, by).filter(touched_partitions(changed, by))
    replace_partitions(gold_fact(silver, lookups, fact.quantity, fact.price), gold_path, by)
    return read_partitioned(gold_path, rows, by)


def run_layers(
    spark: SparkSession,
    sources: Mapping[str, DataFrame],
    dimensions: Sequence[DimensionTable],
    facts: Sequence[FactTable],
    root: str,
    source_system: str,
    as_of: str | None = None,
) -> dict[str, DataFrame]:
    """Load every table through bronze, silver and gold: dimensions first, then facts.

    Returns the gold tables. Running it again on the same sources changes none of them.
    Rows with a NULL in their key go to ``quarantine/<table>`` under the root.
    Silver reads what this run added to bronze, not the history.
    """
    as_of = as_of or datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")
    gold: dict[str, DataFrame] = {}

    def new_rows(table: DimensionTable | FactTable) -> DataFrame:
        bronze = bronze_ingest(sources[table.name], f"{root}/bronze/{table.name}", source_system, as_of)
        added = added_since(bronze, as_of)
        aside = null_key_rows(added, table.keys).withColumn(INGEST_DATE, F.to_date(INGESTED_AT))
        replace_partitions(aside, f"{root}/quarantine/{table.name}", [INGEST_DATE])
        return silver_rows(added, table.keys, table.schema, table.mappings, on_null_key="reject")

    def to_silver(table: DimensionTable | FactTable) -> DataFrame:
        path = f"{root}/silver/{table.name}"
        rows = new_rows(table)
        target = load_or_empty(spark, path, rows.schema)
        return commit(merge(target, rows, table.keys, source_is_unique=True), path)

    for dim in dimensions:
        silver = to_silver(dim)
        path = f"{root}/gold/{dim.name}"
        schema = T.StructType([*silver.schema.fields, T.StructField(dim.sk, T.LongType())])
        # Reordered once here: assigned rows carry the surrogate key last.
        target = load_or_empty(spark, path, schema).select(*schema.names)
        gold[dim.name] = commit(gold_dimension(silver, target, dim.keys, dim.sk), path)

    sk_of = {d.name: d.sk for d in dimensions}
    for fact in facts:
        specs = [
            Lookup(gold[dim], {fk: key}, {sk_of[dim]: sk_of[dim]}, miss="default")
            for fk, (dim, key) in fact.references.items()
        ]
        path = f"{root}/gold/{fact.name}"
        if fact.partition_by:
            silver_path = f"{root}/silver/{fact.name}"
            gold[fact.name] = _load_fact_partitions(new_rows(fact), fact, specs, silver_path, path)
        else:
            rows = gold_fact(to_silver(fact), specs, fact.quantity, fact.price)
            gold[fact.name] = commit(rows, path)
    return gold
