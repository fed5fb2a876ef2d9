"""Legacy type names to Spark types."""

from __future__ import annotations

import re

from pyspark.sql import types as T

# Source type name -> Spark type.
LEGACY_TYPES: dict[str, T.DataType] = {
    "DT_I2": T.ShortType(),
    "DT_I4": T.IntegerType(),
    "DT_I8": T.LongType(),
    "DT_WSTR": T.StringType(),
    "DT_STR": T.StringType(),
    "DT_CY": T.DecimalType(19, 4),
    "DT_BOOL": T.BooleanType(),
    "DT_DATE": T.TimestampNTZType(),
    "DT_DBDATE": T.DateType(),
    "SMALLINT": T.ShortType(),
    "INT": T.IntegerType(),
    "INTEGER": T.IntegerType(),
    "BIGINT": T.LongType(),
    "LONG": T.LongType(),
    "CHAR": T.StringType(),
    "NCHAR": T.StringType(),
    "VARCHAR": T.StringType(),
    "NVARCHAR": T.StringType(),
    "TEXT": T.StringType(),
    "STRING": T.StringType(),
    "MONEY": T.DecimalType(19, 4),
    "BIT": T.BooleanType(),
    "BOOLEAN": T.BooleanType(),
    "DATETIME": T.TimestampNTZType(),
    "TIMESTAMP": T.TimestampNTZType(),
    "DATE": T.DateType(),
    "FLOAT": T.DoubleType(),
    "DOUBLE": T.DoubleType(),
}

# Names whose arguments are precision and scale.
DECIMAL_NAMES = ("DT_NUMERIC", "NUMERIC", "DECIMAL")

_TYPE_TEXT = re.compile(r"^\s*(\w+)\s*(?:\(\s*(\d+|max)\s*(?:,\s*(\d+)\s*)?\))?\s*$", re.I)


def spark_type(name: str) -> T.DataType:
    """``'DT_NUMERIC(4,3)'`` -> ``DecimalType(4, 3)``; an unknown name is an error.

    Timestamps have no zone. Lengths of character types are not part of the Spark
    type; :func:`declared_length` returns them for a length rule.
    """
    match = _TYPE_TEXT.match(name)
    if not match:
        raise ValueError(f"not a type name: {name!r}")
    base = match.group(1).upper()
    if base in DECIMAL_NAMES:
        return T.DecimalType(int(match.group(2) or 18), int(match.group(3) or 0))
    if base not in LEGACY_TYPES:
        raise ValueError(f"unknown type: {name!r}")
    return LEGACY_TYPES[base]


def declared_length(name: str) -> int | None:
    """``'nvarchar(40)'`` -> 40; None where the type sets no length."""
    match = _TYPE_TEXT.match(name)
    if match and match.group(2) and match.group(2).isdigit():
        if isinstance(spark_type(name), T.StringType):
            return int(match.group(2))
    return None


def schema_from_legacy(columns: dict[str, str]) -> T.StructType:
    """Column name -> legacy type name, as a Spark schema in the given order."""
    return T.StructType([T.StructField(name, spark_type(kind)) for name, kind in columns.items()])


def as_schema(schema: T.StructType | str) -> T.StructType:
    """Accept a ``StructType`` or a DDL string."""
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
