"""Partition values as folder names: every text its own folder, and back.

Spark names the folder of a NULL and that of an empty text alike, and reads a text that looks
like this name as NULL. Such texts get a mark in front of them; a text that begins with the
mark gets another one. All other texts, and values of other types, name their folders as ever.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "~"
# Fixed value: the folder name of a NULL.
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"


def _texts(df: DataFrame, columns: Sequence[str]) -> list[str]:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return [c for c in columns if isinstance(kinds[c], T.StringType)]


def _named(value: Column) -> Column:
    marked = (value == "") | (value == NULL_FOLDER) | value.startswith(MARK)
    return F.when(marked, F.concat(F.lit(MARK), value)).otherwise(value)


def _value(name: Column) -> Column:
    return F.when(name.startswith(MARK), F.substr(name, F.lit(len(MARK) + 1))).otherwise(name)


def to_folders(df: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """``df`` with the text columns it is partitioned by as folder names."""
    return df.withColumns({c: _named(F.col(c)) for c in _texts(df, partition_by)})


def from_folders(df: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """``df`` as it was before :func:`to_folders`.

    The value is an expression of the partition column alone, so that filters on it still
    choose folders before the scan.
    """
    return df.withColumns({c: _value(F.col(c)) for c in _texts(df, partition_by)})
