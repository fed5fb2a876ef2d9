"""Aggregates kept by increments: what changed is added, nothing else is read again."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from keelstone.operators.changes import AFTER, CHANGE_TYPE, INSERT
from keelstone.session import scratch_table

ROWS = "n_rows"
_LOST, _TIED = "_lost", "_tied"


@dataclass(frozen=True)
class AggregateSpec:
    """Groups and their measures, as name -> column of the fact.

    Beside ``n_rows`` and the measures a stored aggregate has, for every sum, the number of
    values in it: a sum without values is NULL, not zero.
    """

    group_by: tuple[str, ...]
    sums: Mapping[str, str] = field(default_factory=dict)
    least: Mapping[str, str] = field(default_factory=dict)
    greatest: Mapping[str, str] = field(default_factory=dict)

    def values(self, name: str) -> str:
        """The column that counts a sum's values."""
        return f"n_{name}"

    @property
    def columns(self) -> list[str]:
        counts = [self.values(s) for s in self.sums]
        return [*self.group_by, ROWS, *self.sums, *counts, *self.least, *self.greatest]


def aggregate_rows(fact: DataFrame, spec: AggregateSpec) -> DataFrame:
    """The aggregate of all rows."""
    return fact.groupBy(*spec.group_by).agg(
        F.count(F.lit(1)).alias(ROWS),
        *[F.sum(c).alias(s) for s, c in spec.sums.items()],
        *[F.count(c).alias(spec.values(s)) for s, c in spec.sums.items()],
        *[F.min(c).alias(s) for s, c in spec.least.items()],
        *[F.max(c).alias(s) for s, c in spec.greatest.items()],
    )


def _signed(feed: DataFrame, spec: AggregateSpec, types: Mapping, *more: str) -> DataFrame:
    """What every changed row adds to its group, or takes from it; ``more`` columns beside that."""
    extremes = {**spec.least, **spec.greatest}
    added = F.col(CHANGE_TYPE).isin(INSERT, AFTER)

    def signed(name: str, kind) -> Column:
        value = F.col(name).cast(kind)
        return F.when(added, value).otherwise(-value)

    one = F.when(added, 1).otherwise(-1).cast("bigint")
    return feed.select(
        *spec.group_by,
        *more,
        one.alias(ROWS),
        *[signed(c, types[s]).alias(s) for s, c in spec.sums.items()],
        *[F.when(F.col(c).isNotNull(), one).otherwise(0).alias(spec.values(s)) for s, c in spec.sums.items()],
        *[F.lit(None).cast(types[s]).alias(s) for s in extremes],
        *[F.when(added, F.col(c)).cast(types[s]).alias(f"_in_{s}") for s, c in extremes.items()],
        *[F.when(~added, F.col(c)).cast(types[s]).alias(f"_out_{s}") for s, c in extremes.items()],
    )


def _netted(feed: DataFrame, spec: AggregateSpec, types: Mapping) -> DataFrame:
    """The same of rows that were netted first: those of one group with the same extreme columns.

    An update that leaves these alone neither adds to an extreme nor takes from it.
    """
    extremes = {**spec.least, **spec.greatest}
    values = {f"_value_{k}": c for k, c in enumerate(dict.fromkeys(extremes.values()))}
    named = {c: v for v, c in values.items()}
    rows = _signed(feed.withColumns({v: F.col(c) for v, c in values.items()}), spec, types, *values)
    net = rows.groupBy(*spec.group_by, *values).agg(
        F.sum(ROWS).alias(ROWS),
        *[F.sum(s).cast(types[s]).alias(s) for s in spec.sums],
        *[F.sum(spec.values(s)).alias(spec.values(s)) for s in spec.sums],
    )
    return net.select(
        *spec.group_by,
        ROWS,
        *spec.sums,
        *[spec.values(s) for s in spec.sums],
        *[F.lit(None).cast(types[s]).alias(s) for s in extremes],
        *[F.when(F.col(ROWS) > 0, F.col(named[c])).cast(types[s]).alias(f"_in_{s}") for s, c in extremes.items()],
        *[F.when(F.col(ROWS) < 0, F.col(named[c])).cast(types[s]).alias(f"_out_{s}") for s, c in extremes.items()],
    )


def _pick(spec: AggregateSpec, name: str) -> tuple:
    return (F.min, F.least, lambda a, b: a <= b) if name in spec.least else (F.max, F.greatest, lambda a, b: a >= b)


def _added(stored: DataFrame, changes: DataFrame, spec: AggregateSpec, types: Mapping) -> DataFrame:
    """Stored groups and changes in one grouping, without the groups that have no row left.

    Says of each group whether it lost an extreme: what went reaches the stored one and all
    that came. Where the same value came, it may have stayed all along: it is tied.
    """
    extremes = {**spec.least, **spec.greatest}
    nothing = [F.lit(None).cast(types[s]).alias(f"_{way}_{s}") for way in ("in", "out") for s in extremes]
    # NULL groups meet in a grouping, and nothing is joined.
    both = stored.select(*spec.columns, *nothing).unionByName(changes)
    summed = both.groupBy(*spec.group_by).agg(
        F.sum(ROWS).alias(ROWS),
        *[F.sum(s).cast(types[s]).alias(s) for s in spec.sums],
        *[F.sum(spec.values(s)).alias(spec.values(s)) for s in spec.sums],
        *[_pick(spec, s)[0](c).alias(c) for s in extremes for c in (s, f"_in_{s}", f"_out_{s}")],
    )
    lost = tied = F.lit(False)
    made = {}
    for s in extremes:
        _, both_of, reaches = _pick(spec, s)
        # A row that came and went again may reach beyond the stored extreme.
        gone = F.coalesce(reaches(F.col(f"_out_{s}"), both_of(s, f"_in_{s}")), F.lit(False))
        same = F.coalesce(F.col(f"_out_{s}") == F.col(f"_in_{s}"), F.lit(False))
        lost, tied = lost | (gone & ~same), tied | (gone & same)
        made[s] = both_of(s, f"_in_{s}")
    for s in spec.sums:
        made[s] = F.when(F.col(spec.values(s)) > 0, F.col(s))
    flags = {_LOST: lost | tied, _TIED: tied & ~lost}
    return summed.filter(F.col(ROWS) > 0).withColumns(flags).withColumns(made).select(*spec.columns, _LOST, _TIED)


def _of_groups(rows: DataFrame, groups: DataFrame, spec: AggregateSpec, how: str = "left_semi") -> DataFrame:
    """``rows`` joined with groups, whose columns are named ``_g_``; NULL is a group."""
    same: Column = F.lit(True)
    for c in spec.group_by:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return rows.join(groups, same, how)


def maintain_aggregate(stored: DataFrame, feed: DataFrame, after: DataFrame, spec: AggregateSpec) -> DataFrame:
    """The aggregate of ``after``, from the one stored before and the changes in between.

    Changed rows add their values to the stored sums and counts, or take them away; a group
    without a row left goes. An extreme takes in what is added. Only a group that lost its
    extreme, and got none at least as far out, has its extremes taken from ``after`` again:
    where there is none, the rows of ``after`` are not read, whatever its size.

    Changes are added up by group where they are read, and shuffled once, as sums. Only of
    groups whose farthest value both came and went, as far out as the stored one, are the
    changes netted, which takes their single values through a shuffle.

    ``feed`` has every change since ``stored`` once: the versions' order does not matter, as
    a row that was changed twice adds and takes its middle state. Groups may be NULL. Sums
    should be exact (whole numbers, decimals).
    """
    types = {f.name: f.dataType for f in stored.schema.fields}
    extremes = {**spec.least, **spec.greatest}
    names = {c: f"_g_{c}" for c in spec.group_by}

    def kept_once(rows: DataFrame) -> tuple[DataFrame, dict]:
        counted = Observation()
        counts = [F.count_if(_LOST).alias("lost"), F.count_if(_TIED).alias("tied")]
        return scratch_table(rows.observe(counted, *counts), "aggregate"), counted.get

    kept, found = kept_once(_added(stored, _signed(feed, spec, types), spec, types))
    lost = found["lost"] - found["tied"]
    if found["tied"]:
        groups = kept.filter(_TIED).select(*spec.group_by).withColumnsRenamed(names)
        own, changes = (_of_groups(rows, groups, spec) for rows in (stored, feed))
        settled, found = kept_once(_added(own, _netted(changes, spec, types), spec, types))
        kept, lost = kept.filter(~F.col(_TIED)).unionByName(settled), lost + found["lost"]
    kept = kept.drop(_TIED)
    if not lost:
        return kept.drop(_LOST)
    groups = kept.filter(_LOST).select(*spec.group_by).withColumnsRenamed(names)
    narrow = after.select(*spec.group_by, *{c: None for c in extremes.values() if c not in spec.group_by})
    again = _of_groups(narrow, groups, spec).groupBy(*spec.group_by).agg(
        *[_pick(spec, s)[0](c).cast(types[s]).alias(f"_new_{s}") for s, c in extremes.items()]
    )
    renewed = _of_groups(kept.filter(_LOST), again.withColumnsRenamed(names), spec, "left").withColumns({s: F.col(f"_new_{s}") for s in extremes})
    return kept.filter(~F.col(_LOST)).select(*spec.columns).unionByName(renewed.select(*spec.columns))


def shown(aggregate: DataFrame, spec: AggregateSpec) -> DataFrame:
    """The groups with their measures, without the counts that only maintain them."""
    counts: Sequence[str] = [spec.values(s) for s in spec.sums]
    return aggregate.drop(*counts)
