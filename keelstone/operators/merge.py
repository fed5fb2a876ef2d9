"""MERGE, keyed update and insert as pure functions: (target, source) -> new target.

Spark's own MERGE INTO needs a table format; these need none. The new state is
published with :mod:`keelstone.sinks.tables`.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelstone.operators.changes import AFTER, BEFORE, CHANGE_TYPE, INSERT
from keelstone.operators.columns import any_null
from keelstone.operators.joins import fits_broadcast, keyed_join, unique_or_fail

NULL_KEY_POLICIES = ("reject", "fail")
# What a row of a tagged merge belongs to: the new state, or the feed of what changed.
PART, STATE, FEED = "_part", "state", "feed"


def null_key_rows(source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows a merge cannot place because part of the key is NULL: quarantine these."""
    return source.filter(any_null(keys))


def placeable(source: DataFrame, keys: Sequence[str], policy: str) -> DataFrame:
    """Rows with a whole key; others are left out (``reject``) or fail the job (``fail``)."""
    if policy not in NULL_KEY_POLICIES:
        raise ValueError(f"on_null_key is one of {NULL_KEY_POLICIES}")
    if policy == "reject":
        return source.filter(~any_null(keys))
    # In the key's own value: a later filter on the key has to evaluate it, where the
    # optimizer could put such a filter before another one, or prove that one needless.
    error = F.raise_error(F.lit(f"NULL in merge key {', '.join(keys)}"))
    types = {f.name: f.dataType for f in source.schema.fields}
    return source.withColumns({k: F.coalesce(F.col(k), error.cast(types[k])) for k in keys})


def merge(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    update_columns: Sequence[str] | None = None,
    insert_columns: Sequence[str] | None = None,
    on_null_key: str = "reject",
    source_is_unique: bool = False,
    small_source: bool = False,
) -> DataFrame:
    """Upsert: matched target rows take the update columns, other source rows are added.

    ``update_columns`` default to every non-key column of the target the source has; an
    empty list updates nothing. ``insert_columns`` default likewise; target columns
    outside them are NULL in new rows. The target is unique by ``keys``. Source rows
    with a NULL key never match in a MERGE and would be added again by every run, so
    they are left to :func:`null_key_rows`, or fail the job. Duplicate source keys fail
    the job unless the caller vouches for ``source_is_unique`` (then the shuffle of a
    preceding dedupe on the same keys is reused by the join).

    By default both sides meet in one full outer join. With ``small_source`` (a stored
    increment, cheap to read twice) its size is measured, and if it fits a broadcast
    the target is rewritten without being shuffled at all.
    """
    joined, result, _, _ = _met(
        target, source, keys, update_columns, insert_columns, on_null_key, source_is_unique, small_source
    )
    # Target rows with a NULL key match nothing: pass them by the join, so that they
    # do not all meet in one task.
    return joined.select(*result).unionByName(target.filter(any_null(list(keys))))


def merge_tagged(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    update_columns: Sequence[str] | None = None,
    insert_columns: Sequence[str] | None = None,
    on_null_key: str = "reject",
    source_is_unique: bool = False,
    small_source: bool = False,
) -> DataFrame:
    """The upsert of :func:`merge` and its change feed, as rows of one join.

    Rows whose ``_part`` is ``state`` are the new target. Those of the ``feed`` have a change
    type: an inserted row, or the old and the new row of an update that changed anything.
    :func:`keelstone.sinks.tables.commit_tagged` writes both at once.
    """
    joined, result, in_source, in_target = _met(
        target, source, keys, update_columns, insert_columns, on_null_key, source_is_unique, small_source
    )
    rest = [c for c in target.columns if c not in keys]
    old = F.struct(*[F.col(c) for c in target.columns])
    new = F.struct(*result)
    met = joined.select(old.alias("_old"), new.alias("_new"), in_source.alias("_s"), in_target.alias("_t"))
    same = reduce(Column.__and__, [F.col("_old")[c].eqNullSafe(F.col("_new")[c]) for c in rest], F.lit(True))

    def row(part: str, kind: str | None, values: str) -> Column:
        return F.struct(
            F.lit(part).alias(PART), F.lit(kind).cast("string").alias(CHANGE_TYPE), F.col(values).alias("_row")
        )

    state = row(STATE, None, "_new")
    rows = (
        F.when(~F.col("_t"), F.array(state, row(FEED, INSERT, "_new")))
        .when(F.col("_s") & ~same, F.array(state, row(FEED, BEFORE, "_old"), row(FEED, AFTER, "_new")))
        .otherwise(F.array(state))
    )
    tagged = met.select(F.explode(rows).alias("_r"))
    tagged = tagged.select(
        *[F.col("_r")["_row"][c].alias(c) for c in target.columns], F.col("_r")[CHANGE_TYPE].alias(CHANGE_TYPE), F.col("_r")[PART].alias(PART)
    )
    unkeyed = target.filter(any_null(list(keys)))
    return tagged.unionByName(unkeyed.withColumns({CHANGE_TYPE: F.lit(None).cast("string"), PART: F.lit(STATE)}))


def _met(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    update_columns: Sequence[str] | None,
    insert_columns: Sequence[str] | None,
    on_null_key: str,
    source_is_unique: bool,
    small_source: bool,
) -> tuple[DataFrame, list[Column], Column, Column]:
    """Target and source side by side, the merged columns, and which side has a row."""
    keys = list(keys)
    shared = [c for c in target.columns if c in source.columns and c not in keys]
    updates = set(shared if update_columns is None else update_columns)
    inserts = set(shared if insert_columns is None else insert_columns)
    unknown = (updates | inserts) - set(shared)
    if unknown:
        raise ValueError(f"not in both target and source: {sorted(unknown)}")

    incoming = placeable(source.select(*keys, *shared), keys, on_null_key)
    if not source_is_unique:
        incoming = unique_or_fail(incoming, keys, "merge source rows")
    incoming = incoming.select(
        *keys, *[F.col(c).alias(f"_s_{c}") for c in shared], F.lit(True).alias("_in_source")
    )
    keyed = target.filter(~any_null(keys)).withColumn("_in_target", F.lit(True))
    if small_source and fits_broadcast(incoming):
        joined = _unshuffled_outer_join(keyed, incoming, keys)
    else:
        joined = keyed.join(incoming, keys, "full_outer")

    types = {f.name: f.dataType for f in target.schema.fields}
    in_source, in_target = F.col("_in_source").isNotNull(), F.col("_in_target").isNotNull()
    result = []
    for name in target.columns:
        if name in keys:
            result.append(F.col(name).cast(types[name]).alias(name))
            continue
        value = F.col(name)
        if name in updates or name in inserts:
            new = F.col(f"_s_{name}").cast(types[name])
            if name in updates:
                value = F.when(in_source & in_target, new).otherwise(value)
            if name in inserts:
                value = F.when(~in_target, new).otherwise(value)
        result.append(value.alias(name))
    return joined, result, in_source, in_target


def _unshuffled_outer_join(keyed: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join in two halves that leave the target where it is.

    The caller has measured ``incoming``. The keys of it the target holds are at most
    as many, so only small frames are shuffled.
    """
    small = F.broadcast(incoming)
    present = keyed.select(*keys).join(F.broadcast(incoming.select(*keys)), keys, "left_semi")
    fresh = incoming.join(present.distinct(), keys, "left_anti")
    return keyed.join(small, keys, "left").unionByName(fresh, allowMissingColumns=True)


def insert_missing(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Insert-only merge: existing rows stay as they are."""
    incoming = unique_or_fail(
        placeable(source.select(*target.columns), keys, "reject"), keys, "merge source rows"
    )
    fresh = keyed_join(incoming, target.select(*keys), keys, "left_anti")
    return target.unionByName(fresh)


def insert_missing_rows(target: DataFrame, source: DataFrame) -> DataFrame:
    """Insert-only merge where all columns together are the key, NULLs being equal."""
    columns = target.columns
    existing = target.select(*[F.col(c).alias(f"_t_{c}") for c in columns])
    incoming = source.select(*columns).distinct()
    same: Column = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_t_{c}"))
    return target.unionByName(incoming.join(existing, same, "left_anti"))


def update_matched(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str] | None = None,
    only_where: Column | str | None = None,
) -> DataFrame:
    """UPDATE target SET columns FROM source WHERE keys equal [AND predicate on target].

    Set-based and without inserts; the target may hold several rows per key.
    """
    keys = list(keys)
    columns = [c for c in target.columns if c in source.columns and c not in keys] if columns is None else list(columns)
    # A NULL key matches nothing, so it is no duplicate either.
    usable = source.select(*keys, *columns).filter(~any_null(keys))
    incoming = unique_or_fail(usable, keys, "update source rows").select(
        *keys, *[F.col(c).alias(f"_s_{c}") for c in columns], F.lit(True).alias("_hit")
    )
    joined = keyed_join(target, incoming, keys, "left")
    hit: Column = F.col("_hit").isNotNull()
    if only_where is not None:
        predicate = F.expr(only_where) if isinstance(only_where, str) else only_where
        hit = hit & F.coalesce(predicate, F.lit(False))
    types = {f.name: f.dataType for f in target.schema.fields}
    return joined.select(
        *[
            F.when(hit, F.col(f"_s_{c}").cast(types[c])).otherwise(F.col(c)).alias(c)
            if c in columns
            else F.col(c)
            for c in target.columns
        ]
    )
