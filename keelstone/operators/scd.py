"""Slowly changing dimensions: classification, in place, by flag and by validity dates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelstone.operators.columns import any_null
from keelstone.operators.dedupe import latest_per_key
from keelstone.operators.joins import keyed_join, unique_or_fail
from keelstone.operators.keys import max_key, number_rows
from keelstone.operators.merge import merge, placeable
from keelstone.session import cut_lineage

NEW, UNCHANGED, CHANGING, HISTORICAL, FIXED, INFERRED = (
    "New",
    "Unchanged",
    "Changing",
    "Historical",
    "Fixed",
    "Inferred",
)
CLASSES = "scd_classes"
_HELD = "_held_"
_NEXT = "_next_"


@dataclass(frozen=True)
class ScdSpec:
    """Roles of a dimension's columns.

    changing     differences overwrite the current version
    historical   differences expire it and start a new version
    fixed        differences are reported and otherwise ignored
    valid_from, valid_to   optional half-open validity interval beside the flag
    confirmed    optional array of further times at which a version was delivered, for
                 histories that are spliced (:mod:`keelstone.operators.history`)
    """

    sk: str
    keys: tuple[str, ...]
    changing: tuple[str, ...] = ()
    historical: tuple[str, ...] = ()
    fixed: tuple[str, ...] = ()
    flag: str = "flag"
    valid_from: str | None = None
    valid_to: str | None = None
    confirmed: str | None = None

    @property
    def attributes(self) -> tuple[str, ...]:
        return self.changing + self.historical + self.fixed


def _current(dim: DataFrame, spec: ScdSpec) -> DataFrame:
    return dim.filter(F.coalesce(F.col(spec.flag), F.lit(False)))


def _differs(columns: Sequence[str], left: str, right: str) -> Column:
    """Any column differs, two NULLs being equal."""
    tests = [~F.col(left + c).eqNullSafe(F.col(right + c)) for c in columns]
    return reduce(Column.__or__, tests, F.lit(False))


def _all_null(columns: Sequence[str], prefix: str = "") -> Column:
    return reduce(Column.__and__, [F.col(prefix + c).isNull() for c in columns], F.lit(True))


def _class_array(spec: ScdSpec, matched: Column, held: str, incoming: str) -> Column:
    """Classes of a source row; a row may be both Changing and Historical."""
    found = F.array_compact(
        F.array(
            F.when(_differs(spec.changing, held, incoming), F.lit(CHANGING)),
            F.when(_differs(spec.historical, held, incoming), F.lit(HISTORICAL)),
            F.when(_differs(spec.fixed, held, incoming), F.lit(FIXED)),
        )
    )
    return (
        F.when(~matched, F.array(F.lit(NEW)))
        .when(_all_null(spec.attributes, held), F.array(F.lit(INFERRED)))
        .when(F.size(found) == 0, F.array(F.lit(UNCHANGED)))
        .otherwise(found)
    )


def scd_classify(source: DataFrame, dim: DataFrame, spec: ScdSpec) -> DataFrame:
    """Source rows plus ``scd_classes`` against the dimension's current versions.

    Rows with a NULL business key are not classified and not returned.
    """
    keys = list(spec.keys)
    held = unique_or_fail(
        _current(dim, spec).select(*keys, *[F.col(c).alias(_HELD + c) for c in spec.attributes]),
        keys,
        "current dimension rows",
    ).withColumn("_matched", F.lit(True))
    keyed = source.filter(~any_null(keys))
    joined = keyed_join(keyed, held, keys, "left")
    matched = F.col("_matched").isNotNull()
    return joined.select(*source.columns, _class_array(spec, matched, _HELD, "").alias(CLASSES))


def _has(name: str) -> Column:
    return F.array_contains(F.col(CLASSES), name)


def scd_load(
    source: DataFrame,
    dim: DataFrame,
    spec: ScdSpec,
    as_of: str | None = None,
    on_null_key: str = "fail",
    numbered_in: DataFrame | None = None,
) -> DataFrame:
    """The dimension after loading a source snapshot or increment.

    New         a current version with the next surrogate key
    Historical  the current version expires as it is, a new one takes all source values
    Changing    the current version is overwritten, earlier versions are not
    Inferred    all versions of the key take the source's attributes
    Fixed       nothing changes
    Rows known to the dimension only stay. The source is unique by business key. A NULL in
    it fails the job; ``on_null_key="reject"`` is for callers that have put such rows aside.
    New numbers follow the largest of ``numbered_in``, where ``dim`` is only a part of it.
    """
    keys = list(spec.keys)
    if (spec.valid_from is None) != (spec.valid_to is None):
        raise ValueError("valid_from and valid_to go together")
    if spec.valid_from and as_of is None:
        raise ValueError("validity intervals need as_of")
    types = {f.name: f.dataType for f in dim.schema.fields}
    checked = unique_or_fail(
        placeable(source.select(*keys, *spec.attributes), keys, on_null_key), keys, "dimension source rows"
    )
    # Read by two joins: the check and whatever precedes it run once.
    incoming = cut_lineage(
        checked.select(*[F.col(c).cast(types[c]).alias(c) for c in [*keys, *spec.attributes]])
    )
    kept = _updated_versions(incoming, dim, spec, as_of, types)
    numbers = max_key(dim if numbered_in is None else numbered_in, spec.sk)
    return kept.unionByName(_new_versions(incoming, dim, spec, as_of, types, numbers))


def _updated_versions(incoming, dim, spec, as_of, types) -> DataFrame:
    """All versions the dimension has, after overwrite or expiry: one row in, one row out.

    A key with very many versions is a hot key, which the join splits.
    """
    keys = list(spec.keys)
    blank = _current(dim, spec).filter(_all_null(spec.attributes)).select(*keys, F.lit(True).alias("_blank"))
    offered = incoming.join(blank, keys, "left").select(
        *keys,
        *[F.col(c).alias(_NEXT + c) for c in spec.attributes],
        F.lit(True).alias("_matched"),
        F.col("_blank").isNotNull().alias("_inferred"),
    )
    joined = keyed_join(dim, offered, keys, "left")
    held_current = F.coalesce(F.col(spec.flag), F.lit(False))
    inferred = F.coalesce(F.col("_inferred"), F.lit(False))
    hit = F.col("_matched").isNotNull() & held_current
    expired = hit & ~inferred & _differs(spec.historical, "", _NEXT)
    out = []
    for name in dim.columns:
        value = F.col(name)
        if name in spec.attributes:
            takes = inferred | (hit & ~expired) if name in spec.changing else inferred
            value = F.when(takes, F.col(_NEXT + name)).otherwise(value)
        elif name == spec.flag:
            value = F.when(expired, F.lit(False)).otherwise(value)
        elif name == spec.valid_to:
            value = F.when(expired, F.lit(as_of).cast(types[name])).otherwise(value)
        out.append(value.alias(name))
    return joined.select(*out)


def _new_versions(incoming, dim, spec, as_of, types, after) -> DataFrame:
    """First versions of new keys and next versions of historical ones, numbered by key."""
    classified = scd_classify(incoming, dim, spec)
    versions = classified.filter(_has(NEW) | _has(HISTORICAL)).drop(CLASSES)
    numbered = number_rows(versions, spec.keys, spec.sk, after)
    out = []
    for name in dim.columns:
        if name == spec.flag:
            value = F.lit(True)
        elif name == spec.valid_from:
            value = F.lit(as_of)
        elif name in numbered.columns:
            value = F.col(name)
        else:
            value = F.lit(None)
        out.append(value.cast(types[name]).alias(name))
    return numbered.select(*out)


def scd1_upsert(
    target: DataFrame, source: DataFrame, keys: Sequence[str], newest_by: str | None = None
) -> DataFrame:
    """Overwrite in place; with ``newest_by`` the latest source row per key wins."""
    if newest_by is None:
        return merge(target, source, keys)
    return merge(target, latest_per_key(source, keys, newest_by), keys, source_is_unique=True)


def add_inferred_members(
    dim: DataFrame,
    fact: DataFrame,
    fact_key: str,
    spec: ScdSpec,
    as_of: str | None = None,
) -> DataFrame:
    """Add a current row without attributes for every fact key the dimension lacks.

    Facts may arrive before their dimension row; the next :func:`scd_load` that brings
    it fills the attributes in. NULL fact keys belong to the unknown member.
    """
    (key,) = spec.keys
    types = {f.name: f.dataType for f in dim.schema.fields}
    wanted = fact.filter(F.col(fact_key).isNotNull()).select(
        F.col(fact_key).cast(types[key]).alias(key)
    )
    orphans = keyed_join(
        wanted.distinct(), dim.select(key), [key], "left_anti"
    )
    numbered = number_rows(orphans, [key], spec.sk, max_key(dim, spec.sk))
    values = {
        spec.sk: F.col(spec.sk),
        key: F.col(key),
        spec.flag: F.lit(True),
        spec.valid_from: F.lit(as_of),
    }
    return dim.unionByName(
        numbered.select(*[values.get(c, F.lit(None)).cast(types[c]).alias(c) for c in dim.columns])
    )
