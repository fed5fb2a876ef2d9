"""Column mapping, derivation, masking, schema enforcement and row predicates."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelstone.functions import legacy
from keelstone.types import as_schema, spark_type

UNKNOWN_KEY = -1
VIOLATIONS = "_violations"
INGESTED_AT = "_ingestion_timestamp"
SOURCE_SYSTEM = "_source_system"
INGEST_COLUMNS = (INGESTED_AT, SOURCE_SYSTEM)

MASKS = {"sha256": legacy.sha256, "redact": legacy.redacted}


@dataclass(frozen=True)
class ColumnMapping:
    """One source column and what becomes of it in the target.

    ``rules`` are applied in order out of TRIM, UPPER, LOWER, CAST, COALESCE and
    CUSTOM; CUSTOM evaluates ``logic``, a SQL expression over the source row.
    ``target_datatype`` and ``default_value`` apply with or without their rule.
    """

    source_column: str
    target_column: str | None = None
    source_datatype: str | None = None
    target_datatype: str | None = None
    rules: tuple[str, ...] = ()
    is_pii: bool = False
    is_nullable: bool = True
    default_value: object | None = None
    logic: str | None = None
    mask: str = "sha256"

    @property
    def target(self) -> str:
        return self.target_column or self.source_column


def _cast(column: Column, dtype: T.DataType | str, strict: bool) -> Column:
    return column.cast(dtype) if strict else column.try_cast(dtype)


def mapped_column(mapping: ColumnMapping, strict: bool = True) -> Column:
    """The expression one mapping stands for."""
    value = F.col(mapping.source_column)
    dtype = spark_type(mapping.target_datatype) if mapping.target_datatype else None
    for rule in mapping.rules:
        match rule.upper():
            case "TRIM":
                value = F.trim(value)
            case "UPPER":
                value = F.upper(value)
            case "LOWER":
                value = F.lower(value)
            case "CUSTOM":
                if not mapping.logic:
                    raise ValueError(f"{mapping.source_column}: CUSTOM needs logic")
                value = F.expr(mapping.logic)
            case "CAST" | "COALESCE":
                needed = dtype if rule.upper() == "CAST" else mapping.default_value
                if needed is None:
                    raise ValueError(f"{mapping.source_column}: {rule} has nothing to apply")
            case other:
                raise ValueError(f"{mapping.source_column}: unknown rule {other}")
    if dtype is not None:
        value = _cast(value, dtype, strict)
    if mapping.default_value is not None:
        default = F.lit(mapping.default_value)
        value = F.coalesce(value, default.cast(dtype) if dtype is not None else default)
    return value.alias(mapping.target)


def apply_mapping(df: DataFrame, mappings: Iterable[ColumnMapping], strict: bool = True) -> DataFrame:
    """All mappings as one projection: rename, transform, cast, default."""
    return df.select(*[mapped_column(m, strict) for m in mappings])


def derive(
    df: DataFrame,
    columns: Mapping[str, Column | str],
    types: Mapping[str, T.DataType | str] | None = None,
) -> DataFrame:
    """Add or replace columns from SQL text or ``Column`` expressions, in one projection.

    Every expression sees the incoming row, never another derived column.
    """
    types = types or {}
    exprs = {}
    for name, expression in columns.items():
        column = F.expr(expression) if isinstance(expression, str) else expression
        exprs[name] = column.cast(types[name]) if name in types else column
    return df.withColumns(exprs)


def add_ingest_columns(df: DataFrame, source_system: str, as_of: str | None = None) -> DataFrame:
    """Stamp rows with load time and source system."""
    return df.withColumns(
        {INGESTED_AT: legacy.load_time(as_of), SOURCE_SYSTEM: F.lit(source_system)}
    )


def mask_columns(df: DataFrame, methods: Mapping[str, str]) -> DataFrame:
    """Mask columns in place; ``methods`` is column -> ``sha256`` or ``redact``."""
    return df.withColumns({name: MASKS[method](F.col(name)) for name, method in methods.items()})


def mask_by_mapping(
    df: DataFrame, mappings: Iterable[ColumnMapping], method: str | None = None
) -> DataFrame:
    """Mask every target column whose mapping says personal data."""
    return mask_columns(
        df, {m.target: method or m.mask for m in mappings if m.is_pii and m.target in df.columns}
    )


def _length_broken(name: str, limit: int) -> Column:
    return F.length(F.col(name)) > limit


def enforce_schema(
    df: DataFrame,
    schema: T.StructType | str,
    mode: str = "strict",
    lengths: Mapping[str, int] | None = None,
    report: bool = False,
) -> DataFrame:
    """Cast every target field and project in target order, dropping other columns.

    ``strict``: a bad value or an over-long string fails the job.
    ``permissive``: a bad value becomes NULL; with ``report`` a ``_violations`` array
    names what broke, and an over-long string is named there but kept whole.
    """
    if mode not in ("strict", "permissive"):
        raise ValueError(f"mode is strict or permissive, not {mode!r}")
    schema, lengths = as_schema(schema), dict(lengths or {})
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"columns missing from the input: {missing}")
    strict = mode == "strict"
    exprs, broken = [], []
    for field in schema.fields:
        source = F.col(field.name)
        value = _cast(source, field.dataType, strict)
        if field.name in lengths:
            too_long = _length_broken(field.name, lengths[field.name])
            if strict:
                error = F.concat(F.lit(f"value too long for {field.name}: "), source)
                value = F.when(too_long, F.raise_error(error)).otherwise(value)
            broken.append(F.when(too_long, F.lit(f"{field.name}:length")))
        if not strict:
            broken.append(
                F.when(source.isNotNull() & value.isNull(), F.lit(f"{field.name}:cast"))
            )
        exprs.append(value.alias(field.name))
    if report and not strict:
        found = F.array_sort(F.array_compact(F.array(*broken)))
        exprs.append(found.cast("array<string>").alias(VIOLATIONS))
    return df.select(*exprs)


def length_violations(df: DataFrame, lengths: Mapping[str, int], keys: Sequence[str]) -> DataFrame:
    """One row per over-long value: keys, column, length, max_length, value. One pass."""
    found = [
        F.when(
            _length_broken(name, limit),
            F.struct(
                F.lit(name).alias("column_name"),
                F.length(name).alias("length"),
                F.lit(limit).alias("max_length"),
                F.col(name).cast("string").alias("value"),
            ),
        )
        for name, limit in lengths.items()
    ]
    exploded = df.select(*keys, F.explode(F.array_compact(F.array(*found))).alias("v"))
    return exploded.select(*keys, "v.*")


def keep_not_null(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which every named column has a value."""
    return df.filter(reduce(Column.__and__, [F.col(c).isNotNull() for c in columns]))


def delete_where(df: DataFrame, predicate: Column | str) -> DataFrame:
    """Everything but the rows for which the predicate is true; unknown keeps the row."""
    predicate = F.expr(predicate) if isinstance(predicate, str) else predicate
    return df.filter(~F.coalesce(predicate, F.lit(False)))


def null_keys_to_unknown(df: DataFrame, *columns: str, unknown: object = UNKNOWN_KEY) -> DataFrame:
    """Replace NULL foreign keys by the key of the unknown member."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns(
        {c: F.coalesce(F.col(c), F.lit(unknown).cast(types[c])) for c in columns}
    )


def any_null(columns: Sequence[str]) -> Column:
    """True when one of the columns is NULL."""
    return reduce(Column.__or__, [F.col(c).isNull() for c in columns])
