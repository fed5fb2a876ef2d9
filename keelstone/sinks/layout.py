"""Data layout: compaction and clustering on several columns (z-order)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Our choice: bits of a column's range number, by the number of files; the borders are
# literals of the plan, which bounds them.
LEAST_BITS, MOST_BITS = 4, 9
SAMPLE_PER_RANGE = 16
_Z = "_z"


def range_bits(target_files: int, columns: int) -> int:
    """Bits per column that give some cells for every file."""
    wanted = -(-((target_files - 1).bit_length() + 3) // columns)
    return max(LEAST_BITS, min(MOST_BITS, wanted))


def _borders(df: DataFrame, columns: Sequence[str], ranges: int, border_sample: float) -> list[list[Column]]:
    """Values that cut each column into near equal ranges, from one bounded sample of rows."""
    rows = df.select(*columns)
    if border_sample < 1.0:
        rows = rows.sample(border_sample, seed=0)
    size = SAMPLE_PER_RANGE * ranges
    rows = rows.orderBy(F.xxhash64(*columns, F.monotonically_increasing_id())).limit(size).collect()
    out = []
    for name in columns:
        dtype = df.schema[name].dataType
        if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            raise ValueError(f"cannot cluster on {name}: {dtype.simpleString()}")
        values = [r[name] for r in rows if r[name] is not None]
        values.sort(key=lambda v: v.encode() if isinstance(v, str) else v)
        cuts = [values[i * len(values) // ranges] for i in range(1, ranges)] if values else []
        distinct = [c for i, c in enumerate(cuts) if not i or c != cuts[i - 1]]
        out.append([F.lit(c).cast(dtype) for c in distinct])
    return out


def _range_number(rank: Column, borders: Sequence[Column], first: int = 0) -> Column:
    """How many borders lie at or below the value, by halving: a few comparisons a row."""
    if not borders:
        return F.lit(first)
    middle = len(borders) // 2
    below = _range_number(rank, borders[:middle], first)
    above = _range_number(rank, borders[middle + 1 :], first + middle + 1)
    return F.when(rank < borders[middle], below).otherwise(above)


def with_z_value(
    df: DataFrame, columns: Sequence[str], bits: int = LEAST_BITS, border_sample: float = 1.0
) -> DataFrame:
    """``df`` with ``_z``, the interleaved range numbers of the columns; NULL ranks first.

    Borders are values of the columns themselves, whole texts included, from a bounded
    sample. They only decide the order, so a small sample loses nothing.
    """
    borders = _borders(df, columns, 1 << bits, border_sample)
    # A projection per step: each number is computed once and used by every bit.
    numbers = [f"_number_{c}" for c in columns]
    numbered = df.withColumns(
        {
            n: F.when(F.col(c).isNull(), F.lit(0)).otherwise(_range_number(F.col(c), cuts))
            for n, c, cuts in zip(numbers, columns, borders)
        }
    )
    parts = []
    for position, number in enumerate(numbers):
        for bit in range(bits):
            picked = F.shiftright(number, bit).bitwiseAND(F.lit(1)).cast("bigint")
            parts.append(F.shiftleft(picked, bit * len(columns) + position))
    interleaved = reduce(Column.bitwiseOR, parts)
    return numbered.withColumn(_Z, interleaved).drop(*numbers)


def compact_and_cluster(
    df: DataFrame, columns: Sequence[str], target_files: int, border_sample: float = 1.0
) -> DataFrame:
    """The same rows in ``target_files`` partitions clustered on ``columns``.

    Written out, each file covers a narrow range of every column, so filters on any of
    them skip files. The row hash and input partition after the z-value let a crowded
    cell, even one of identical rows, spread over several files.
    """
    if len(columns) * LEAST_BITS > 62:
        raise ValueError("too many clustering columns")
    spread = F.xxhash64(*df.columns, F.spark_partition_id())
    if len(columns) == 1:
        # Range partitioning on the column itself is as fine as the files.
        placed = df.withColumn("_spread", spread).repartitionByRange(target_files, *columns, "_spread")
        return placed.sortWithinPartitions(*columns).drop("_spread")
    bits = min(range_bits(target_files, len(columns)), 62 // len(columns))
    return (
        with_z_value(df, columns, bits, border_sample)
        .withColumn("_spread", spread)
        .repartitionByRange(target_files, _Z, "_spread")
        .sortWithinPartitions(_Z)
        .drop(_Z, "_spread")
    )
