"""One entry for a table load: strategy, duplicates and type strictness as options."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelstone.operators.columns import any_null, enforce_schema
from keelstone.operators.dedupe import first_per_key, latest_per_key
from keelstone.operators.history import splice_history
from keelstone.operators.incremental import incremental_extract
from keelstone.operators.joins import fits_broadcast, unique_or_fail
from keelstone.operators.merge import merge, merge_tagged
from keelstone.operators.scd import ScdSpec, scd_load
from keelstone.session import cut_lineage
from keelstone.sinks.partitions import (
    merge_partitions,
    read_known,
    replace_partitions,
    touched_partitions,
    write_partitioned,
)
from keelstone.sinks.tables import (
    commit,
    commit_table,
    commit_tagged,
    empty_frame,
    has_rows_written,
    is_table_name,
    load_or_empty,
    table_exists,
)
from keelstone.types import as_schema

FULL_OVERWRITE, INCREMENTAL, SCD_2 = "FULL_OVERWRITE", "INCREMENTAL", "SCD_2"


REASON = "_reason"


@dataclass(frozen=True)
class LoadOptions:
    """How a table is loaded.

    strategy            FULL_OVERWRITE replaces it, INCREMENTAL merges rows above the
                        target's ``watermark`` (all rows without one: the source is the
                        increment), SCD_2 keeps history as ``scd`` says
    effective           of SCD_2, the source's column of the time from which a row holds: a
                        key may then have several rows, and late ones cut the intervals
                        they fall into. Without it a row holds from ``as_of`` on
    ignore_duplicates   keep one source row per key, the newest by ``newest_by`` or
                        ``watermark`` if named; otherwise a duplicate key fails the load
    strict_types        a value that does not fit the target type, or is longer than
                        ``lengths`` allows, fails the load; otherwise it becomes NULL
                        (an over-long text stays)
    change_feed         an INCREMENTAL load into a committed folder keeps what it changed,
                        for :func:`keelstone.sinks.tables.read_feed`
    quarantine          folder for rows that cannot be placed: a NULL in the business key,
                        or in the watermark of an INCREMENTAL load. Without a folder such a
                        row fails the load. First and later loads treat them alike
    """

    strategy: str
    business_keys: tuple[str, ...]
    watermark: str | None = None
    newest_by: str | None = None
    scd: ScdSpec | None = None
    effective: str | None = None
    ignore_duplicates: bool = False
    strict_types: bool = True
    as_of: str | None = None
    lengths: Mapping[str, int] | None = None
    change_feed: bool = False
    quarantine: str | None = None


def _typed(source: DataFrame, schema: T.StructType, options: LoadOptions, whole: bool) -> DataFrame:
    """Source rows under the target's types; ``whole`` wants every column of it."""
    if not whole:
        schema = T.StructType([f for f in schema.fields if f.name in source.columns])
    if options.effective and options.effective not in schema.names:
        (at,) = [f for f in schema.fields if f.name == options.scd.valid_from] or [source.schema[options.effective]]
        schema = T.StructType([*schema.fields, T.StructField(options.effective, at.dataType)])
    lengths = {c: n for c, n in (options.lengths or {}).items() if c in schema.names}
    return enforce_schema(source, schema, "strict" if options.strict_types else "permissive", lengths)


def placed_rows(rows: DataFrame, options: LoadOptions) -> DataFrame:
    """Rows with a key and, where one is compared, a watermark; the others are put aside.

    Rows put aside are appended to the quarantine folder with their reason.
    """
    reason = F.when(any_null(options.business_keys), "NULL key")
    if options.strategy == INCREMENTAL and options.watermark:
        reason = reason.when(F.col(options.watermark).isNull(), "NULL watermark")
    if options.effective:
        reason = reason.when(F.col(options.effective).isNull(), "NULL effective time")
    if options.quarantine is None:
        # In the values themselves, so that the source is read once: a filter on the mark
        # has to look at every row, and every row that is written has its key.
        error = F.raise_error(F.concat(reason, F.lit(" in a source row, and no quarantine folder")))
        types = {f.name: f.dataType for f in rows.schema.fields}
        checked = [*options.business_keys]
        marks = {INCREMENTAL: options.watermark, SCD_2: options.effective}
        if marks.get(options.strategy):
            checked = list(dict.fromkeys([*checked, marks[options.strategy]]))
        return rows.withColumns(
            {c: F.when(reason.isNotNull(), error.cast(types[c])).otherwise(F.col(c)) for c in checked}
        )
    aside = rows.withColumn(REASON, reason).filter(F.col(REASON).isNotNull())
    aside.write.mode("append").parquet(options.quarantine)
    return rows.filter(reason.isNull())


def _one_per_key(rows: DataFrame, options: LoadOptions) -> DataFrame:
    keys = list(options.business_keys)
    if not options.ignore_duplicates:
        return unique_or_fail(rows, keys, "source rows")
    newest_by = options.newest_by or options.watermark
    if newest_by:
        return latest_per_key(rows, keys, newest_by)
    return first_per_key(rows, keys)


def _increment(fresh: DataFrame, options: LoadOptions, first_load: bool) -> tuple[DataFrame, bool]:
    """The rows to merge, one per key, and whether they may fit a broadcast.

    Kept once, so that measuring and merging do not repeat the extract. Rows that have to be
    unique are kept as they come: where they are too large for a broadcast, the shuffle that
    checks them is the one that the join needs.
    """
    if first_load:
        return _one_per_key(fresh, options), False
    if options.ignore_duplicates:
        return cut_lineage(_one_per_key(fresh, options)), True
    kept = cut_lineage(fresh)
    if fits_broadcast(kept):
        return cut_lineage(_one_per_key(kept, options)), True
    return _one_per_key(kept, options), False


def next_state(
    source: DataFrame, target: DataFrame, options: LoadOptions, first_load: bool = False
) -> DataFrame:
    """The table after the load; the table itself is not written.

    With a change feed the rows are those of a tagged merge.
    """
    if options.strategy == FULL_OVERWRITE:
        return _one_per_key(source, options)
    if options.strategy == INCREMENTAL:
        fresh = source
        if options.watermark:
            fresh = incremental_extract(source, target, options.watermark)
        rows, small = _increment(fresh, options, first_load)
        return (merge_tagged if options.change_feed else merge)(
            target,
            rows,
            options.business_keys,
            source_is_unique=True,
            small_source=small,
        )
    if options.strategy == SCD_2:
        if options.scd is None:
            raise ValueError("SCD_2 needs column roles")
        if options.effective:
            return splice_history(source, target, options.scd, options.effective)
        return scd_load(_one_per_key(source, options), target, options.scd, options.as_of)
    raise ValueError(f"unknown strategy: {options.strategy}")


def load(
    source: DataFrame, target: str, schema: T.StructType | str, options: LoadOptions
) -> DataFrame:
    """Load ``source`` into the committed table at a path, or into a catalog table by name,
    and return its new state.

    ``schema`` is the target's. A missing target counts as empty. FULL_OVERWRITE wants all
    of its columns.
    """
    schema, spark = as_schema(schema), source.sparkSession
    rows = placed_rows(_typed(source, schema, options, options.strategy == FULL_OVERWRITE), options)
    if is_table_name(target):
        if options.change_feed:
            raise ValueError("a change feed needs a committed folder")
        present = spark.catalog.tableExists(target)
        current = spark.read.table(target) if present else empty_frame(spark, schema)
        return commit_table(next_state(rows, current, options, not present), target)
    if options.change_feed and options.strategy != INCREMENTAL:
        raise ValueError("a change feed needs an INCREMENTAL load")
    current = load_or_empty(spark, target, schema)
    new = next_state(rows, current, options, not table_exists(spark, target))
    return commit_tagged(new, target) if options.change_feed else commit(new, target)


def load_partitioned(
    source: DataFrame,
    path: str,
    schema: T.StructType | str,
    options: LoadOptions,
    partition_by: Sequence[str],
) -> DataFrame:
    """Load a table partitioned on disk: the way for tables too large to rewrite.

    INCREMENTAL and SCD_2 read and replace the partitions that the source touches; the
    partition columns belong to the business key. FULL_OVERWRITE replaces the partitions
    that the source has rows for. What is read twice is kept once in the shared folder.
    """
    schema, spark = as_schema(schema), source.sparkSession
    whole = options.strategy != SCD_2
    rows = placed_rows(_typed(source, schema, options, whole), options)
    written = has_rows_written(spark, path)
    if options.strategy == FULL_OVERWRITE:
        replace_partitions(_one_per_key(rows, options), path, partition_by)
    elif options.strategy == INCREMENTAL:
        if options.watermark and written:
            stored = read_known(spark, path, schema, partition_by)
            rows = incremental_extract(rows, stored, options.watermark)
        rows = _one_per_key(rows, options)
        if written:
            merge_partitions(
                cut_lineage(rows), path, options.business_keys, partition_by, source_is_unique=True, small_source=True
            )
        else:
            write_partitioned(rows, path, partition_by)
    elif options.strategy == SCD_2:
        if options.scd is None:
            raise ValueError("SCD_2 needs column roles")
        if not set(partition_by) <= set(options.scd.keys):
            raise ValueError("partition columns must be part of the business key")
        rows = cut_lineage(rows if options.effective else _one_per_key(rows, options))
        whole_dim = read_known(spark, path, schema, partition_by) if written else empty_frame(spark, schema)
        part = whole_dim
        if written:
            part = whole_dim.filter(touched_partitions(rows, partition_by)).select(*schema.names)
        if options.effective:
            new = splice_history(rows, part, options.scd, options.effective, numbered_in=whole_dim)
        else:
            new = scd_load(rows, part, options.scd, options.as_of, numbered_in=whole_dim)
        replace_partitions(new, path, partition_by)
    else:
        raise ValueError(f"unknown strategy: {options.strategy}")
    return read_known(spark, path, schema, partition_by)


def execute_task(spark: SparkSession, context: dict) -> DataFrame:
    """Run one load from a context dictionary.

    source        SQL text or table name, with ``variables`` bound as parameters
    target        path or catalog name of the target table; ``schema`` its columns
    partition_by  columns of its folders, for a table loaded by partition
    business_keys, load_strategy and the other :class:`LoadOptions` by name
    """
    text = context["source"]
    variables = context.get("variables") or None
    is_query = text.lstrip().lower().startswith(("select", "with"))
    source = spark.sql(text, args=variables) if is_query else spark.read.table(text)
    names = set(LoadOptions.__dataclass_fields__) - {"strategy", "business_keys"}
    options = LoadOptions(
        strategy=context["load_strategy"],
        business_keys=tuple(context["business_keys"]),
        **{k: v for k, v in context.items() if k in names},
    )
    if context.get("partition_by"):
        return load_partitioned(source, context["target"], context["schema"], options, context["partition_by"])
    return load(source, context["target"], context["schema"], options)


def check_idempotent(source: DataFrame, target: DataFrame, options: LoadOptions) -> tuple[DataFrame, DataFrame]:
    """(state after one load, state after loading the same source again)."""
    once = next_state(source, target, options)
    return once, next_state(source, once, options)
