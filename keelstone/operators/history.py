"""Validity histories from deliveries in any order: intervals are spliced, not appended."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from keelstone.operators.joins import keyed_join
from keelstone.operators.keys import max_key, number_missing
from keelstone.operators.merge import placeable
from keelstone.operators.scd import ScdSpec
from keelstone.session import scratch_table

_AT, _OLD, _BLANK, _GROUP, _START, _TOUCHED = "_at", "_old", "_blank", "_group", "_start", "_touched"


def splice_history(
    source: DataFrame,
    dim: DataFrame,
    spec: ScdSpec,
    effective: str,
    on_null_key: str = "fail",
    numbered_in: DataFrame | None = None,
) -> DataFrame:
    """The dimension after a delivery that may hold several versions of a key, late ones too.

    A delivery is a set of events: a key had these attributes from ``effective`` on. The
    borders of the dimension's own versions are events as well. All events of a touched key
    are one timeline; an event whose historical attributes are those before it only confirms
    them, any other starts a version, which is valid until the next. So a late event cuts the
    interval it falls into, and a version can begin earlier than was known.

    ``changing`` columns have no history: all versions of a key take the values of its latest
    event. ``fixed`` columns keep those of its earliest. Of several events of one key and time
    the one with the greatest attributes counts, the historical ones first, NULLs being least.
    An event without any attribute, as an inferred member is one, takes the attributes before
    it, else those after it, and counts as delivered with these from then on. A stored version
    may be valid since ever, with a NULL start; a NULL time in ``source`` is not placeable, as
    a NULL key is.

    The result does not depend on the order of deliveries if ``spec.confirmed`` names an
    array column of the dimension, where a version keeps the later times it was confirmed at:
    what is cut off by a late event can then begin again at the next of them. Without it a
    version counts as delivered once. Versions keep their surrogate keys; new ones get the
    next numbers by key and time, after the largest of ``numbered_in``.

    Keys that the delivery does not name pass by. Events of one key and time are reduced
    before they are shuffled; a key's timeline is then sorted by one task, which spills.
    """
    if spec.valid_from is None or spec.valid_to is None:
        raise ValueError("a history needs valid_from and valid_to")
    keys, attributes = list(spec.keys), list(spec.attributes)
    types = {f.name: f.dataType for f in dim.schema.fields}
    usable = placeable(source.select(*keys, *attributes, effective), [*keys, effective], on_null_key)
    news = usable.select(
        *[F.col(c).cast(types[c]).alias(c) for c in [*keys, *attributes]],
        F.col(effective).cast(types[spec.valid_from]).alias(_AT),
        _blank(spec).alias(_BLANK),
        F.lit(None).cast("bigint").alias(_OLD),
    )
    named = news.select(*keys).distinct().withColumn(_TOUCHED, F.lit(True))
    marked = keyed_join(dim, named, keys, "left")
    touched = F.col(_TOUCHED).isNotNull()
    counted = Observation()
    fresh = F.col(spec.sk).isNull()
    versions = _versions(news.unionByName(_events(marked.filter(touched), spec)), dim, spec)
    versions = scratch_table(versions.observe(counted, F.count_if(fresh).alias("fresh")), "versions")
    # A NULL start, since ever, sorts first.
    order = [*keys, spec.valid_from]
    after = max_key(dim if numbered_in is None else numbered_in, spec.sk)
    numbered = number_missing(versions, fresh, order, spec.sk, after, counted.get["fresh"])
    return marked.filter(~touched).select(*dim.columns).unionByName(numbered.select(*dim.columns))


def _blank(spec: ScdSpec) -> Column:
    """A row without any attribute, as inferred members have it."""
    return reduce(Column.__and__, [F.col(c).isNull() for c in spec.attributes], F.lit(True))


def _events(held: DataFrame, spec: ScdSpec) -> DataFrame:
    """An event for the start of every version, with its surrogate key, and for each later
    time it was confirmed at."""
    start = F.struct(F.col(spec.valid_from).alias(_AT), F.col(spec.sk).cast("bigint").alias(_OLD))
    events = F.array(start)
    if spec.confirmed:
        again = F.transform(
            F.coalesce(spec.confirmed, F.array().cast(held.schema[spec.confirmed].dataType)),
            lambda t: F.struct(t.alias(_AT), F.lit(None).cast("bigint").alias(_OLD)),
        )
        events = F.concat(events, again)
    exploded = held.select(*spec.keys, *spec.attributes, _blank(spec).alias(_BLANK), F.explode(events).alias("_e"))
    return exploded.select(*spec.keys, *spec.attributes, F.col("_e")[_AT].alias(_AT), _BLANK, F.col("_e")[_OLD].alias(_OLD))


def _versions(events: DataFrame, dim: DataFrame, spec: ScdSpec) -> DataFrame:
    """Events of whole keys as versions; those that start anew have no surrogate key yet."""
    keys, types = list(spec.keys), {f.name: f.dataType for f in dim.schema.fields}
    # An inferred member's event is less than any real one of its time.
    value = F.struct((~F.col(_BLANK)).alias("_real"), *[F.col(c) for c in spec.historical + spec.changing + spec.fixed])
    once = events.groupBy(*keys, _AT).agg(F.max(value).alias("_v"), F.min(_OLD).alias(_OLD))
    by_time = Window.partitionBy(*keys).orderBy(F.col(_AT).asc_nulls_first())
    until, onward, all_ = (
        by_time.rowsBetween(*span)
        for span in (
            (Window.unboundedPreceding, Window.currentRow),
            (Window.currentRow, Window.unboundedFollowing),
            (Window.unboundedPreceding, Window.unboundedFollowing),
        )
    )
    real = F.when(F.col("_v")["_real"], F.col("_v"))
    # What an inferred member was given: the attributes before it, else those after it.
    filled = once.withColumn(
        "_v", F.coalesce(F.last(real, ignorenulls=True).over(until), F.first(real, ignorenulls=True).over(onward), F.col("_v"))
    )
    history = F.struct(F.lit(0), *[F.col("_v")[c].alias(c) for c in spec.historical])
    before = F.lag(history).over(by_time)
    starts = F.row_number().over(by_time) == 1
    starts = starts | ~history.eqNullSafe(before)
    placed = filled.withColumns(
        {
            _START: starts,
            **{c: F.last(F.col("_v")[c]).over(all_) for c in spec.changing},
            **{c: F.first(F.col("_v")[c]).over(all_) for c in spec.fixed},
            **{c: F.col("_v")[c] for c in spec.historical},
        }
    )
    grouped = placed.withColumn(_GROUP, F.sum(F.col(_START).cast("int")).over(until))
    versions = grouped.groupBy(*keys, _GROUP).agg(
        F.min(F.struct(_AT)).alias("_from"),
        F.sort_array(F.collect_list(F.when(~F.col(_START), F.col(_AT)))).alias("_again"),
        F.min(_OLD).alias(spec.sk),
        *[F.first(c).alias(c) for c in spec.attributes],
    )
    follows = F.lead(F.col("_from")[_AT]).over(Window.partitionBy(*keys).orderBy(_GROUP))
    made = {
        spec.valid_from: F.col("_from")[_AT],
        spec.valid_to: follows,
        spec.flag: F.lead(F.lit(True)).over(Window.partitionBy(*keys).orderBy(_GROUP)).isNull(),
        spec.confirmed: F.col("_again"),
    }
    given = {c: F.col(c) for c in [*keys, *spec.attributes, spec.sk]}
    return versions.select(*[(given | made).get(c, F.lit(None)).cast(types[c]).alias(c) for c in dim.columns])
