"""Surrogate keys: parallel sequential numbering, stable assignment, unknown members."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelstone.operators.columns import UNKNOWN_KEY, any_null
from keelstone.operators.joins import keyed_join, unique_or_fail
from keelstone.session import scratch_table

UNKNOWN_TEXT = "Unknown"

# Our choice: rows of new members that one task numbers; their count is measured.
ONE_TASK_ROWS = 200_000
_AT, _RANGE = "_at", "_range"


def max_key(frame: DataFrame, column: str) -> Column:
    """Largest key in use as a scalar subquery; 0 when there is none but reserved ones."""
    largest = F.greatest(F.coalesce(F.max(column), F.lit(0)), F.lit(0)).cast("bigint")
    return frame.agg(largest.alias("max_key")).scalar()


def number_rows(df: DataFrame, order_by: Sequence[str], name: str, after: Column | int = 0) -> DataFrame:
    """Add ``name`` = after + 1, after + 2, ... in the order of ``order_by``.

    Same numbers as ``row_number()`` over an unpartitioned window, without its single task.
    The rows are shuffled into key ranges, sorted, and written once with their places; what
    precedes is not evaluated again. The ranges are counted on the places alone, a narrow
    column of the written files, and a place is shifted by the ranges before its own. The
    plan does not grow with the number of ranges. ``order_by`` should be unique; equal rows
    get neighbouring numbers in no particular order.
    """
    order = list(order_by)
    after = F.lit(after).cast("bigint") if isinstance(after, int) else after
    ranged = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    # A place is the number of its range and, in the lower 33 bits, the row inside it.
    frozen = scratch_table(ranged.withColumn(_AT, F.monotonically_increasing_id()), "numbered")
    range_of = F.shiftright(_AT, 33)
    sizes = frozen.groupBy(range_of.alias(_RANGE)).agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    # As many rows as there are ranges, which are shuffle partitions.
    offsets = sizes.select(_RANGE, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    numbered = frozen.join(F.broadcast(offsets), range_of == F.col(_RANGE))
    inside = F.col(_AT).bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return numbered.select(*df.columns, (after + F.col("_offset") + inside).cast("bigint").alias(name))


def assign_surrogate_keys(
    source: DataFrame,
    target: DataFrame,
    keys: Sequence[str],
    sk: str,
) -> DataFrame:
    """Source rows with their surrogate key: the target's where the business key is known,
    else the next free numbers in business-key order.

    Source and target meet in one join, whose result is written once. Only the distinct
    business keys that it missed are numbered and joined again, so the work after it grows
    with the news, and a second run over its own result numbers nothing. Rows with a NULL in
    the business key get no surrogate key.
    """
    keys = list(keys)
    types = {f.name: f.dataType for f in source.schema.fields}
    known = unique_or_fail(
        target.filter(~any_null(keys)).select(
            *[F.col(k).cast(types[k]).alias(k) for k in keys], F.col(sk).cast("bigint").alias(sk)
        ),
        keys,
        "target surrogate keys",
    )
    missed = F.col(sk).isNull() & ~any_null(keys)
    counted = Observation()
    joined = keyed_join(source, known, keys, "left").observe(counted, F.count_if(missed).alias("misses"))
    met = scratch_table(joined, "met")
    return number_missing(met, missed, keys, sk, max_key(target, sk), counted.get["misses"])


def number_missing(
    rows: DataFrame, missed: Column, order_by: Sequence[str], sk: str, after: Column, most: int
) -> DataFrame:
    """Written rows, those that are ``missed`` with the next numbers, equal keys with one.

    ``most`` is how many are missed, as counted when the rows were written. An attempt that
    was lost may have counted twice: too many, never too few. Few are numbered by one task.
    """
    order = list(order_by)
    news = rows.filter(missed).drop(sk)
    if most <= ONE_TASK_ROWS:
        news = news.withColumn(sk, (after + F.dense_rank().over(Window.orderBy(*order))).cast("bigint"))
    else:
        news = keyed_join(news, number_rows(news.select(*order).distinct(), order, sk, after), order, "left")
    return rows.filter(~missed).unionByName(news.select(*rows.columns))


def unknown_row(dim: DataFrame, sk: str, keys: Sequence[str], overrides: Mapping[str, object] | None = None) -> DataFrame:
    """One row typed like ``dim``: keys -1 (text keys '-1', as facts have it), text 'Unknown',
    numbers 0, the rest NULL."""
    overrides = dict(overrides or {})
    values = []
    for field in dim.schema.fields:
        if field.name in overrides:
            value = overrides[field.name]
        elif field.name == sk or field.name in keys:
            value = UNKNOWN_KEY
        elif isinstance(field.dataType, T.StringType):
            value = UNKNOWN_TEXT
        elif isinstance(field.dataType, T.NumericType):
            value = 0
        else:
            value = None
        values.append(F.lit(value).cast(field.dataType).alias(field.name))
    return dim.sparkSession.range(0, 1, 1, 1).select(*values)


def add_unknown_member(
    dim: DataFrame, sk: str, keys: Sequence[str], overrides: Mapping[str, object] | None = None
) -> DataFrame:
    """Add the unknown member unless the dimension has it."""
    present = dim.filter(F.col(sk) == UNKNOWN_KEY).exists()
    return dim.unionByName(unknown_row(dim, sk, keys, overrides).filter(~present))
