"""Joins of a large side against a keyed side, safe for hot keys.

By default Spark joins as the sizes it sees at run time suggest: adaptive execution
broadcasts a side that turns out small and splits partitions that turn out large, hot and
NULL keys among them. Nothing is measured while the plan is built. Where adaptive
execution is off, ``rows_per_task`` spreads every key with more rows than that over as
many salts as it needs. No way changes the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 32 * 1024 * 1024
NULL_SALTS = 1024

_SALT = "_salt"
_SALTS = "_salts"


def measured_bytes(df: DataFrame) -> int | None:
    """Size of the rows, by one aggregate; None where a column has no simple width."""
    width: Column = F.lit(0).cast("bigint")
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            width = width + F.lit(16) + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            return None
        else:
            width = width + F.lit(16)
    return df.agg(F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()["bytes"]


def fits_broadcast(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether the measured size of ``df`` is within the bound."""
    size = measured_bytes(df)
    return size is not None and size <= max_bytes


def hot_keys(df: DataFrame, keys: Sequence[str], rows_per_task: int) -> DataFrame:
    """Keys with more than ``rows_per_task`` rows and the number of salts each needs.

    Counts are exact, so evaluating this twice gives the same salts. The result has
    at most ``rows / rows_per_task`` rows, which is what makes it safe to broadcast.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows_per_task)
    return counts.select(*keys, F.ceil(F.col("_n") / rows_per_task).cast("int").alias(_SALTS))


def unique_or_fail(df: DataFrame, keys: Sequence[str], what: str = "rows") -> DataFrame:
    """``df`` unchanged if ``keys`` is unique in it, else the job fails.

    Duplicates collapse in the map-side half of the aggregate, so a key repeated a
    billion times costs its reducer a handful of rows.
    """
    # A value per column, not one struct: narrow numeric payloads then aggregate by
    # hashing. Mixing rows is no risk, because more than one row fails.
    rest = [F.any_value(c).alias(c) for c in df.columns if c not in keys]
    grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *rest)
    error = F.raise_error(F.lit(f"{what} are not unique by {', '.join(keys)}"))
    checked = grouped.filter(F.when(F.col("_n") > 1, error.cast("boolean")).otherwise(F.lit(True)))
    return checked.select(*df.columns)


def keyed_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    rows_per_task: int | None = None,
    broadcast: bool = False,
) -> DataFrame:
    """``left.join(right, keys, how)`` for how in inner, left, left_semi, left_anti.

    ``right`` is unique by ``keys`` for inner and left. Both sides use the same names
    for the keys and share no other column. ``broadcast`` is the caller's word that the
    right side has a bounded size (see :func:`fits_broadcast`). ``rows_per_task`` salts
    hot keys, for one more pass over the left side's keys.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join: {how}")
    keys = list(keys)
    if how in ("left_semi", "left_anti"):
        right = right.select(*keys).distinct()
    if broadcast:
        return left.join(F.broadcast(right), keys, how)
    if rows_per_task is not None:
        return _salted_join(left, right, keys, how, rows_per_task)
    return left.join(right, keys, how)


def _salted_join(
    left: DataFrame, right: DataFrame, keys: list[str], how: str, rows_per_task: int
) -> DataFrame:
    hot = F.broadcast(hot_keys(left, keys, rows_per_task))
    # Row content plus input partition: stable when a task is retried, and it parts
    # identical copies that arrive in different partitions. NULL keys match nothing
    # and are spread over a fixed number of salts.
    mixed = F.xxhash64(*[F.col(c) for c in left.columns], F.spark_partition_id())
    null_key = F.lit(False)
    for key in keys:
        null_key = null_key | F.col(key).isNull()
    spread = F.when(null_key, F.lit(NULL_SALTS)).otherwise(F.coalesce(F.col(_SALTS), F.lit(1)))
    salted = left.join(hot, keys, "left").select(
        *left.columns, F.pmod(mixed, spread.cast("bigint")).cast("int").alias(_SALT)
    )
    copies = F.sequence(F.lit(0), F.coalesce(F.col(_SALTS), F.lit(1)) - 1)
    replicated = right.join(hot, keys, "left").select(
        *right.columns, F.explode(copies).alias(_SALT)
    )
    joined = salted.join(replicated, [*keys, _SALT], how)
    extra = [c for c in right.columns if c not in keys] if how in ("inner", "left") else []
    return joined.select(*left.columns, *extra)
