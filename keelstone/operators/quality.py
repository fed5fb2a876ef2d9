"""Data-quality suites in one scan, quarantine, key and referential integrity."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelstone.operators.columns import VIOLATIONS, ColumnMapping, any_null
from keelstone.operators.joins import keyed_join

# Type expectations and the Spark types that meet them.
TYPE_FAMILIES = {
    "Integer": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "Float": (T.FloatType, T.DoubleType),
    "Boolean": (T.BooleanType,),
    "String": (T.StringType,),
}
# What a text value is tried as for each expectation.
TRIED_AS = {"Integer": "bigint", "Float": "double", "Boolean": "boolean"}
# Words in a declared type name that select an expectation, first hit wins.
TYPE_WORDS = (
    ("Integer", ("int", "long")),
    ("Float", ("float", "double")),
    ("Boolean", ("bool",)),
    ("String", ("char", "string", "text")),
)
# Fixed value: share of malformed personal data a contract tolerates, in percent.
PII_INVALID_PERCENT = 5.0


@dataclass(frozen=True)
class Check:
    """One rule about one column.

    kind     ``not_null``, ``missing_count``, ``type``, ``invalid_percent``, ``max_length``
             or ``rule``
    arg      type name, regular expression, length or SQL predicate that must hold
    percent  share of failing rows that is still a pass
    """

    kind: str
    column: str
    arg: object | None = None
    percent: float = 0.0

    def failing(self, schema: T.StructType) -> Column:
        """True for a row that breaks the rule; never NULL."""
        value = F.col(self.column)
        match self.kind:
            case "not_null" | "missing_count":
                return value.isNull()
            case "type":
                held = schema[self.column].dataType
                if isinstance(held, TYPE_FAMILIES[str(self.arg)]):
                    return F.lit(False)
                if isinstance(held, T.StringType):
                    return value.isNotNull() & value.try_cast(TRIED_AS[str(self.arg)]).isNull()
                return F.lit(True)
            case "invalid_percent":
                return value.isNotNull() & ~value.rlike(str(self.arg))
            case "max_length":
                return F.coalesce(F.length(value) > F.lit(int(str(self.arg))), F.lit(False))
            case "rule":
                return ~F.coalesce(F.expr(str(self.arg)), F.lit(False))
        raise ValueError(f"unknown check: {self.kind}")


def expected_family(type_name: str) -> str | None:
    """Type expectation for a declared type name, or None."""
    lowered = type_name.lower()
    return next((f for f, words in TYPE_WORDS if any(w in lowered for w in words)), None)


def suite_from_mappings(
    mappings: Iterable[ColumnMapping], pii_pattern: str = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
) -> list[Check] | None:
    """The checks a set of column mappings implies; None where they imply none."""
    checks = []
    for m in mappings:
        if not m.is_nullable or m.is_pii:
            checks.append(Check("not_null", m.source_column))
        if not m.is_nullable:
            checks.append(Check("missing_count", m.source_column))
        family = expected_family(m.source_datatype or "")
        if family:
            checks.append(Check("type", m.source_column, family))
        if m.is_pii:
            checks.append(
                Check("invalid_percent", m.source_column, pii_pattern, PII_INVALID_PERCENT)
            )
    return checks or None


def run_suite(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """(check_name, column_name, failed, total, passed), one row per check.

    All checks are one aggregate over one scan that reads only the checked columns.
    """
    if not checks:
        raise ValueError("an empty suite has no result")
    fails = [
        F.coalesce(F.sum(c.failing(df.schema).cast("bigint")), F.lit(0)).alias(f"f{i}")
        for i, c in enumerate(checks)
    ]
    counted = df.agg(F.count(F.lit(1)).alias("total"), *fails)
    rows = F.array(
        *[
            F.struct(
                F.lit(c.kind).alias("check_name"),
                F.lit(c.column).alias("column_name"),
                F.col(f"f{i}").alias("failed"),
                F.col("total"),
                _passes(c, F.col(f"f{i}"), F.col("total")).alias("passed"),
            )
            for i, c in enumerate(checks)
        ]
    )
    return counted.select(F.inline(rows))


def _passes(check: Check, failed: Column, total: Column) -> Column:
    if check.kind == "invalid_percent":
        # Strictly below the percentage; no rows means nothing invalid.
        return (total == 0) | (failed * 100.0 < total * F.lit(check.percent))
    return failed == 0


def key_integrity(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per property of a declared key: ``null_key`` and ``duplicate_key`` rows.

    A key group with n rows has n - 1 surplus rows. Counts per key combine map-side.
    """
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    null, label = any_null(keys), ",".join(keys)
    counted = groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(null, F.col("_n"))), F.lit(0)).alias("nulls"),
        F.coalesce(F.sum(F.when(~null, F.col("_n") - 1)), F.lit(0)).alias("surplus"),
    )
    rows = [
        F.struct(
            F.lit(name).alias("check_name"),
            F.lit(label).alias("column_name"),
            F.col(c).alias("failed"),
            F.col("total"),
            (F.col(c) == 0).alias("passed"),
        )
        for name, c in (("null_key", "nulls"), ("duplicate_key", "surplus"))
    ]
    return counted.select(F.inline(F.array(*rows)))


def referential_integrity(
    fact: DataFrame, references: Mapping[str, tuple[DataFrame, str]]
) -> DataFrame:
    """One row per foreign key: rows whose non-NULL value the dimension lacks.

    The fact shrinks to (value, count) before it meets the dimension, so a hot value is
    one row in the join.
    """
    results = []
    for fk, (dim, key) in references.items():
        values = fact.groupBy(fk).agg(F.count(F.lit(1)).alias("_n"))
        known = dim.select(F.col(key).cast(fact.schema[fk].dataType).alias(fk))
        known = known.distinct().withColumn("_known", F.lit(True))
        joined = keyed_join(values, known, [fk], "left")
        orphan = F.col(fk).isNotNull() & F.col("_known").isNull()
        results.append(
            joined.agg(
                F.coalesce(F.sum(F.when(orphan, F.col("_n"))), F.lit(0)).alias("failed"),
                F.coalesce(F.sum("_n"), F.lit(0)).alias("total"),
            ).select(
                F.lit("referential").alias("check_name"),
                F.lit(fk).alias("column_name"),
                "failed",
                "total",
                (F.col("failed") == 0).alias("passed"),
            )
        )
    return reduce(DataFrame.unionByName, results)


def mark_violations(df: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """Add ``_violations``: sorted names of the rules (SQL predicates) a row breaks.

    A rule that evaluates to NULL is broken.
    """
    broken = [
        F.when(~F.coalesce(F.expr(sql), F.lit(False)), F.lit(name)) for name, sql in rules.items()
    ]
    return df.withColumn(VIOLATIONS, F.array_sort(F.array_compact(F.array(*broken))))


def quarantine_split(df: DataFrame, rules: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with ``_violations``); together every row of ``df``."""
    marked = mark_violations(df, rules)
    empty = F.size(VIOLATIONS) == 0
    return marked.filter(empty).drop(VIOLATIONS), marked.filter(~empty)
