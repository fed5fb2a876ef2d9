"""Profiling: keys, table type, personal data, volume, partition key, mapping suggestions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations
from math import prod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelstone.operators.columns import any_null

# Endings of a column name that suggest a key.
KEY_ENDINGS = ("id", "key", "code", "num")
# Words in a column name that suggest personal data.
PII_WORDS = ("email", "phone", "ssn", "address", "name", "password")
# Shapes of personal data.
PII_PATTERNS = {
    "email": r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$",
    "phone": r"^\+?[0-9][0-9 ()\-]{6,}[0-9]$",
    "ssn": r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$",
}
# Our choice: share of values of one shape that marks a column as personal data.
PII_HIT_SHARE = 0.5
# Our choice: rows from which a table counts as MED and as HIGH.
VOLUME_CUTOFFS = (10_000, 1_000_000)
# Suggested target type for a declared or Spark type name.
SUGGESTED_TYPES = {
    "INT": "BIGINT",
    "VARCHAR": "STRING",
    "DATETIME": "TIMESTAMP",
    "TIMESTAMP_NTZ": "TIMESTAMP",
}


# Our choice: size of a distinct sketch (0.8 % standard error), the share of the rows below
# which its estimate rules a candidate out (six errors), and how many sketches one scan makes.
SKETCH_BITS, SKETCH_SHARE, SKETCHES = 14, 0.95, 128


def key_like(columns: Sequence[str]) -> list[str]:
    """Columns whose name ends like a key."""
    return [c for c in columns if c.lower().endswith(KEY_ENDINGS)]


def _measured(df: DataFrame, candidate: Sequence[str]) -> DataFrame:
    """(candidate, n_rows, distinct_rows, null_rows, is_key) of one candidate: a narrow grouping."""
    groups = df.groupBy(*candidate).agg(F.count(F.lit(1)).alias("_n"))
    total = F.coalesce(F.sum("_n"), F.lit(0))
    nulls = F.coalesce(F.sum(F.when(any_null(candidate), F.col("_n"))), F.lit(0))
    counted = groups.agg(total.alias("n_rows"), F.count(F.lit(1)).alias("distinct_rows"), nulls.alias("null_rows"))
    is_key = (F.col("distinct_rows") == F.col("n_rows")) & (F.col("null_rows") == 0)
    return counted.select(F.lit(",".join(candidate)).alias("candidate"), "*", is_key.alias("is_key"))


def profile_keys(df: DataFrame, candidates: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """(candidate, n_rows, distinct_rows, null_rows, is_key) per candidate, measured.

    Each candidate is one grouping of its own columns, combined map-side. Without
    ``candidates`` the key-like columns and their combinations are searched by
    :func:`find_keys`.
    """
    if candidates is None:
        return find_keys(df)
    return reduce(DataFrame.unionByName, [_measured(df, list(c)) for c in candidates])


def _nearly_unique(df: DataFrame, candidates: Sequence[Sequence[str]], n_rows: int) -> list[Sequence[str]]:
    """The candidates whose sketched distinct count does not rule them out."""
    out = []
    for at in range(0, len(candidates), SKETCHES):
        block = candidates[at : at + SKETCHES]
        sketches = [F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64(*c), F.lit(SKETCH_BITS))) for c in block]
        found = df.agg(*[s.alias(f"s{k}") for k, s in enumerate(sketches)]).first()
        out += [c for k, c in enumerate(block) if found[k] >= SKETCH_SHARE * n_rows]
    return out


def find_keys(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """All measured candidates of a search for minimal keys of any width.

    Width by width. The columns themselves are all measured. A wider candidate is looked at
    only if no part of it is a key already and the product of its columns' distinct counts
    reaches the number of rows: fewer combinations than rows cannot be unique. All of a width
    are sketched in one scan (in blocks of ``SKETCHES``); only those whose estimated distinct
    count is near the number of rows are measured, each by a grouping of its own, so the
    scans grow with what may be a key, not with the combinations. A key is missed if its
    estimate is six standard errors off. A column with NULLs is in no key. A few numbers per
    candidate come to the driver.
    """
    names = key_like(df.columns) if columns is None else list(columns)
    if not names:
        raise ValueError("no column looks like a key: name the candidates")
    found, keys, counts = [], [], {}
    usable = names
    for width in range(1, len(names) + 1):
        level = [
            c
            for c in combinations(usable, width)
            if not any(set(k) <= set(c) for k in keys)
            and (width == 1 or prod(counts[name] for name in c) >= n_rows)
        ]
        if width > 1:
            level = _nearly_unique(df, level, n_rows)
        if not level:
            continue
        rows = reduce(DataFrame.unionByName, [_measured(df, c) for c in level]).collect()
        found += rows
        by_name = {r.candidate: r for r in rows}
        keys += [c for c in level if by_name[",".join(c)].is_key]
        if width == 1:
            n_rows = rows[0].n_rows
            counts = {c: by_name[c].distinct_rows for c in names}
            usable = [c for c in names if not by_name[c].null_rows and (c,) not in keys]
    schema = "candidate string, n_rows bigint, distinct_rows bigint, null_rows bigint, is_key boolean"
    return df.sparkSession.createDataFrame(found, schema)


def profile_table_type(name: str, df: DataFrame) -> DataFrame:
    """(table_name, n_foreign_keys, n_measures, n_dates, table_type): FACT or DIMENSION.

    A name containing fact or dim decides. Otherwise a FACT has a key-like column that
    is not unique (a foreign key), a numeric column that is no key (a measure) and a
    date column; everything else is a DIMENSION. Uniqueness is measured.
    """
    keys = key_like(df.columns)
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    measures = [c for c in numeric if c not in keys]
    dates = _date_columns(df)
    # A narrow distinct per key, not one aggregate over all: that would expand every row.
    counted = df.agg(F.count(F.lit(1)).alias("n_rows"))
    for i, k in enumerate(keys):
        counted = counted.withColumn(f"d{i}", df.select(k).distinct().agg(F.count(k)).scalar())
    foreign = reduce(
        lambda total, i: total + (F.col(f"d{i}") < F.col("n_rows")).cast("bigint"),
        range(len(keys)),
        F.lit(0).cast("bigint"),
    )
    lowered = name.lower()
    if "fact" in lowered:
        kind = F.lit("FACT")
    elif "dim" in lowered:
        kind = F.lit("DIMENSION")
    else:
        is_fact = (F.col("n_foreign_keys") > 0) & (F.col("n_measures") > 0) & (F.col("n_dates") > 0)
        kind = F.when(is_fact, F.lit("FACT")).otherwise(F.lit("DIMENSION"))
    return counted.select(
        F.lit(name).alias("table_name"),
        foreign.alias("n_foreign_keys"),
        F.lit(len(measures)).cast("bigint").alias("n_measures"),
        F.lit(len(dates)).cast("bigint").alias("n_dates"),
    ).withColumn("table_type", kind)


def _date_columns(df: DataFrame) -> list[str]:
    kinds = (T.DateType, T.TimestampType, T.TimestampNTZType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def profile_pii(df: DataFrame, patterns: Mapping[str, str] | None = None) -> DataFrame:
    """Per string column: name hit, values present, values of each known shape, verdict.

    Whole values are matched, all columns and shapes in one scan.
    """
    patterns = dict(PII_PATTERNS if patterns is None else patterns)
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not strings:
        raise ValueError("no string column to profile")
    aggs = []
    for i, c in enumerate(strings):
        aggs.append(F.count(c).alias(f"v{i}"))
        for j, pattern in enumerate(patterns.values()):
            hit = F.coalesce(F.col(c).rlike(pattern), F.lit(False)).cast("bigint")
            aggs.append(F.coalesce(F.sum(hit), F.lit(0)).alias(f"h{i}_{j}"))
    rows = []
    for i, c in enumerate(strings):
        name_hit = any(w in c.lower() for w in PII_WORDS)
        hits = [F.col(f"h{i}_{j}") for j in range(len(patterns))]
        most = F.greatest(F.lit(0).cast("bigint"), *hits)
        by_value = (F.col(f"v{i}") > 0) & (most >= F.col(f"v{i}") * PII_HIT_SHARE)
        rows.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit(name_hit).alias("name_hit"),
                F.col(f"v{i}").alias("values_present"),
                *[h.alias(f"{p}_hits") for p, h in zip(patterns, hits)],
                (F.lit(name_hit) | by_value).alias("is_pii"),
            )
        )
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def profile_volume(
    frames: Mapping[str, DataFrame], cutoffs: tuple[int, int] = VOLUME_CUTOFFS
) -> DataFrame:
    """(table_name, n_rows, volume) with volume LOW, MED or HIGH."""
    medium, high = cutoffs
    n = F.col("n_rows")
    kind = F.when(n >= high, "HIGH").when(n >= medium, "MED").otherwise("LOW")
    counts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows", kind.alias("volume")
        )
        for name, df in frames.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def profile_partition_key(df: DataFrame) -> DataFrame:
    """Per date column: distinct days and the largest day; most days is the suggestion.

    Every date column in one scan; counts per day combine map-side.
    """
    dates = _date_columns(df)
    if not dates:
        raise ValueError("no date column")
    per_column = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("column_name"), F.to_date(c).alias("day"))
                for c in dates
            ]
        )
    )
    days = df.select(per_column.alias("d")).groupBy("d.column_name", "d.day").agg(
        F.count(F.lit(1)).alias("_n")
    )
    found = days.groupBy("column_name").agg(
        F.count("day").alias("n_days"),
        F.max("_n").alias("max_rows_per_day"),
        F.sum("_n").alias("n_rows"),
    )
    best = found.agg(F.max("n_days")).scalar()
    return found.withColumn("suggested", F.col("n_days") == best)


def suggested_type(type_name: str) -> str:
    """Suggested target type; decimals stay decimals, a double would lose money."""
    return SUGGESTED_TYPES.get(type_name.upper(), type_name.upper())


def suggest_mapping(df: DataFrame) -> DataFrame:
    """One mapping row per column: target name and type, rule, personal-data verdict.

    Name and declared type give the suggestion; the values of string columns are
    profiled for personal data the name does not give away.
    """
    fields = df.schema.fields
    strings = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    rows = []
    for f in fields:
        declared = f.dataType.simpleString().upper()
        target = suggested_type(declared)
        rows.append(
            F.struct(
                F.lit(f.name).alias("source_column"),
                F.lit(declared).alias("source_datatype"),
                F.lit(f.name.lower()).alias("target_column"),
                F.lit(target).alias("target_datatype"),
                F.lit("CAST" if target != declared else None).cast("string").alias("transformation_rule"),
                F.lit(any(w in f.name.lower() for w in PII_WORDS)).alias("_by_name"),
            )
        )
    listed = df.sparkSession.range(0, 1, 1, 1).select(F.inline(F.array(*rows)))
    if not strings:
        return listed.withColumnRenamed("_by_name", "is_pii")
    # One row per column on both sides.
    verdicts = profile_pii(df).select(F.col("column_name").alias("source_column"), "is_pii")
    joined = listed.join(F.broadcast(verdicts), "source_column", "left")
    return joined.withColumn("is_pii", F.coalesce("is_pii", "_by_name")).drop("_by_name")
