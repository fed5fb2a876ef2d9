"""High-water marks and incremental extracts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelstone.operators.dedupe import latest_per_key
from keelstone.operators.merge import merge

# What the mark of an empty target is reported as.
FIRST_MARKS = {
    T.DateType: "0001-01-01",
    T.TimestampType: "0001-01-01 00:00:00",
    T.TimestampNTZType: "0001-01-01 00:00:00",
    T.StringType: "",
}
# Least and largest value of the whole-number types, by simple name.
WHOLE_NUMBERS = {"tinyint": 7, "smallint": 15, "int": 31, "bigint": 63}


def high_water_mark(target: DataFrame, column: str, default: object | None = None) -> DataFrame:
    """One row, one column ``mark``: the largest value, or the default when empty."""
    dtype = target.schema[column].dataType
    if default is None:
        default = FIRST_MARKS.get(type(dtype), 0)
    return target.agg(F.coalesce(F.max(column), F.lit(default).cast(dtype)).alias("mark"))


def _least_new(dtype: T.DataType, largest: Column) -> Column | None:
    """The smallest value above the largest one in use, the type's smallest if there is none."""
    kind = dtype.simpleString()
    if kind in WHOLE_NUMBERS:
        bits = WHOLE_NUMBERS[kind]
        # Where the largest value is the type's own largest, its rows are read once more.
        following = F.when(largest < F.lit((1 << bits) - 1), largest.cast("bigint") + 1).otherwise(largest)
        return F.coalesce(following, F.lit(-(1 << bits))).cast(dtype)
    if isinstance(dtype, T.StringType):
        return F.coalesce(F.concat(largest, F.lit("\x00")), F.lit(""))
    return None


def incremental_extract(
    source: DataFrame,
    target: DataFrame,
    column: str,
    target_column: str | None = None,
    default: object | None = None,
) -> DataFrame:
    """Source rows strictly above the target's mark; all rows with a mark if it is empty.

    ``default`` is the mark of an empty target, for those who want one. Rows without a
    value to compare are not part of the extract: see :func:`unmarked_rows`.

    The bound is a scalar subquery: Spark computes it first and pushes the resulting
    literal into the source scan, where row groups below it are skipped. Whole numbers and
    text are compared with the next value, so that an empty target needs no second test.
    """
    used = target_column or column
    dtype = target.schema[used].dataType
    if default is not None:
        return source.filter(F.col(column) > high_water_mark(target, used, default).scalar())
    least = _least_new(dtype, F.max(used))
    if least is not None:
        return source.filter(F.col(column) >= target.agg(least.alias("least")).scalar())
    mark = target.agg(F.max(used).alias("mark")).scalar()
    return source.filter(F.col(column).isNotNull() & (mark.isNull() | (F.col(column) > mark)))


def unmarked_rows(source: DataFrame, column: str) -> DataFrame:
    """Rows an extract cannot place because their mark is NULL: quarantine these."""
    return source.filter(F.col(column).isNull())


def incremental_merge(
    target: DataFrame, source: DataFrame, keys: Sequence[str], watermark: str
) -> DataFrame:
    """Rows newer than the target, reduced to the latest per key, merged by key."""
    fresh = latest_per_key(incremental_extract(source, target, watermark), keys, watermark)
    return merge(target, fresh, keys, source_is_unique=True)
