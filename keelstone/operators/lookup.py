"""Dimension lookups with an explicit policy for misses."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelstone.operators.columns import UNKNOWN_KEY
from keelstone.operators.joins import keyed_join, unique_or_fail

MISS_POLICIES = ("ignore", "default", "drop")


@dataclass(frozen=True)
class Lookup:
    """Find ``take`` columns of a dimension by key.

    on        fact column -> dimension column
    take      dimension column -> name in the result
    miss      ``ignore`` leaves NULL, ``default`` fills ``defaults`` (-1 for columns not
              named there), ``drop`` keeps matched rows only
    current   boolean column marking the current version, or None
    """

    dim: DataFrame
    on: Mapping[str, str]
    take: Mapping[str, str] = field(default_factory=dict)
    miss: str = "default"
    defaults: Mapping[str, object] = field(default_factory=dict)
    current: str | None = None


def _keyed_dim(fact: DataFrame, spec: Lookup) -> DataFrame:
    """Current rows, keys in the fact's names and types, checked to be unique."""
    clash = set(spec.take.values()) & set(fact.columns)
    if clash:
        raise ValueError(f"lookup would overwrite {sorted(clash)}")
    types = {f.name: f.dataType for f in fact.schema.fields}
    dim = spec.dim.filter(F.col(spec.current)) if spec.current else spec.dim
    # A dimension key the fact's type cannot hold matches no fact: NULL, not an error.
    keys = [F.col(d).try_cast(types[f]).alias(f) for f, d in spec.on.items()]
    narrow = dim.select(*keys, *[F.col(d).alias(out) for d, out in spec.take.items()])
    for key in spec.on:
        narrow = narrow.filter(F.col(key).isNotNull())
    return unique_or_fail(narrow, list(spec.on), "current dimension rows")


def lookup(fact: DataFrame, spec: Lookup, rows_per_task: int | None = None) -> DataFrame:
    """Fact rows plus the looked-up columns; never more rows than the fact has."""
    if spec.miss not in MISS_POLICIES:
        raise ValueError(f"miss is one of {MISS_POLICIES}")
    dim, keys = _keyed_dim(fact, spec), list(spec.on)
    if spec.miss == "drop":
        how = "inner" if spec.take else "left_semi"
        return keyed_join(fact, dim, keys, how, rows_per_task)
    found = keyed_join(fact, dim, keys, "left", rows_per_task)
    return found if spec.miss == "ignore" else _filled(found, spec)


def _filled(found: DataFrame, spec: Lookup) -> DataFrame:
    """Defaults where nothing was found."""
    if not spec.take:
        return found
    types = {f.name: f.dataType for f in found.schema.fields}
    return found.withColumns(
        {
            out: F.coalesce(F.col(out), F.lit(spec.defaults.get(out, UNKNOWN_KEY)).cast(types[out]))
            for out in spec.take.values()
        }
    )


def lookup_many(
    fact: DataFrame, specs: Mapping[str, Lookup], missed: str | None = None, rows_per_task: int | None = None
) -> DataFrame:
    """All lookups of a fact in one pass over it.

    ``specs`` names the lookups. With ``missed`` the result keeps every fact row and has
    an array column of that name with the lookups that found nothing: matches and misses
    are two filters on one result. Without it, misses of ``drop`` lookups go.
    """
    out, marks = fact, []
    for i, (name, spec) in enumerate(specs.items()):
        if spec.miss not in MISS_POLICIES:
            raise ValueError(f"miss is one of {MISS_POLICIES}")
        mark = f"_hit_{i}"
        dim = _keyed_dim(out, spec).withColumn(mark, F.lit(True))
        out = keyed_join(out, dim, list(spec.on), "left", rows_per_task)
        if spec.miss == "default":
            out = _filled(out, spec)
        if spec.miss == "drop" and missed is None:
            out = out.filter(F.col(mark))
        marks.append((mark, name))
    if missed is not None:
        absent = [F.when(F.col(mark).isNull(), F.lit(name)) for mark, name in marks]
        out = out.withColumn(missed, F.array_compact(F.array(*absent)))
    return out.drop(*[mark for mark, _ in marks])


def lookup_rejects(fact: DataFrame, spec: Lookup, rows_per_task: int | None = None) -> DataFrame:
    """Fact rows the lookup misses, NULL keys among them: the complement of ``drop``."""
    return keyed_join(fact, _keyed_dim(fact, spec), list(spec.on), "left_anti", rows_per_task)
