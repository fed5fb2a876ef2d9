"""Change feed between two states of a table, and state comparison."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelstone.operators.columns import any_null
from keelstone.operators.joins import unique_or_fail

CHANGE_TYPE = "_change_type"

# Names of the change types.
INSERT, DELETE, BEFORE, AFTER = "insert", "delete", "update_preimage", "update_postimage"

# Our choice: buckets in which two states are compared by sums of hashes, below these primes.
BUCKETS = 4096
PRIMES = (2147483647, 2147483629)


def change_feed(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Changed rows with their change type; an update yields its old and its new row.

    Both states are unique by ``keys``, else the job fails. One full outer join; rows
    without a difference are dropped before anything else happens to them. Rows with a
    NULL in the key cannot be matched: they are compared as whole rows, copies counted,
    and appear as inserts and deletes where their numbers differ.
    """
    keys = list(keys)
    unkeyed = _unkeyed_changes(before.filter(any_null(keys)), after.filter(any_null(keys)))
    before = unique_or_fail(before.filter(~any_null(keys)), keys, "rows before")
    after = unique_or_fail(after.filter(~any_null(keys)), keys, "rows after")
    rest = [c for c in before.columns if c not in keys]
    old = before.select(
        *keys, *[F.col(c).alias(f"_b_{c}") for c in rest], F.lit(True).alias("_in_before")
    )
    new = after.select(
        *keys, *[F.col(c).alias(f"_a_{c}") for c in rest], F.lit(True).alias("_in_after")
    )
    joined = old.join(new, keys, "full_outer")
    was, now = F.col("_in_before").isNotNull(), F.col("_in_after").isNotNull()
    same = reduce(
        Column.__and__, [F.col(f"_b_{c}").eqNullSafe(F.col(f"_a_{c}")) for c in rest], F.lit(True)
    )
    changed = joined.filter(~(was & now & same))

    def row(kind: str, prefix: str) -> Column:
        return F.struct(F.lit(kind).alias(CHANGE_TYPE), *[F.col(prefix + c).alias(c) for c in rest])

    rows = (
        F.when(was & now, F.array(row(BEFORE, "_b_"), row(AFTER, "_a_")))
        .when(now, F.array(row(INSERT, "_a_")))
        .otherwise(F.array(row(DELETE, "_b_")))
    )
    exploded = changed.select(*keys, F.explode(rows).alias("_r"))
    columns = [F.col(c) if c in keys else F.col("_r")[c].alias(c) for c in before.columns]
    return exploded.select(*columns, F.col("_r")[CHANGE_TYPE].alias(CHANGE_TYPE)).unionByName(unkeyed)


def _unkeyed_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Inserts and deletes of whole rows; copies collapse before the shuffle."""
    columns = before.columns
    signed = after.select(*columns, F.lit(1).alias("_w")).unionByName(before.select(*columns, F.lit(-1).alias("_w")))
    net = signed.groupBy(*columns).agg(F.sum("_w").alias("_net")).filter("_net <> 0")
    kind = F.when(F.col("_net") > 0, INSERT).otherwise(DELETE)
    each = F.explode(F.sequence(F.lit(1), F.abs("_net").cast("int")))
    return net.select(*columns, kind.alias(CHANGE_TYPE), each.alias("_each")).drop("_each")


def _row_prints(types: T.StructType) -> tuple[Column, Column]:
    """Two independent hashes of a whole row, each below a prime."""
    parts = []
    for f in types.fields:
        plain = not isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType, T.VariantType))
        # A hash passes over NULLs, inside nested values too: what is NULL is said beside it.
        parts += [F.col(f.name) if plain else F.to_json(F.struct(f.name)), F.col(f.name).isNull()]
    return tuple(F.pmod(F.xxhash64(F.lit(k), *parts), F.lit(prime)) for k, prime in enumerate(PRIMES))


def difference_count(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row ``differing_rows``: the size of the symmetric difference, copies counted.

    Fingerprints first: rows are dealt into ``BUCKETS`` by hash, and a bucket's rows make a
    count and two sums of row hashes, which no order of the rows changes. Only rows of
    buckets that differ are grouped and counted, by signed counts per distinct row, without a
    join of the states. Equal states shuffle no rows, only a line per bucket and task. Two
    states that differ in a bucket go unnoticed with a probability of 2 ** -62.
    """
    columns = left.columns
    signed = left.select(*columns, F.lit(1).alias("_w")).unionByName(
        right.select(*columns, F.lit(-1).alias("_w"))
    )
    one, other = _row_prints(T.StructType([f for f in signed.schema.fields if f.name != "_w"]))
    bucket = F.pmod(one, F.lit(BUCKETS))
    printed = signed.select(bucket.alias("_b"), "_w", (F.col("_w") * one).alias("_one"), (F.col("_w") * other).alias("_other"))
    sums = printed.groupBy("_b").agg(*[F.sum(c).alias(c) for c in ("_w", "_one", "_other")])
    # BUCKETS rows at most; none leaves nothing to read.
    unequal = sums.filter((F.col("_w") != 0) | (F.col("_one") != 0) | (F.col("_other") != 0)).select("_b")
    rows = signed.withColumn("_b", bucket).join(F.broadcast(unequal), "_b", "left_semi")
    net = rows.groupBy(*columns).agg(F.sum("_w").alias("_net"))
    return net.agg(F.coalesce(F.sum(F.abs("_net")), F.lit(0)).cast("bigint").alias("differing_rows"))
