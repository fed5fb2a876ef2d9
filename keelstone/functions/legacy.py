"""Scalar functions with the semantics a legacy warehouse expression expects.

Every helper returns a ``Column`` built from Spark's own functions, so nested
expressions compose and stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _col(value: ColumnOrName) -> Column:
    return F.col(value) if isinstance(value, str) else value


def is_null(value: ColumnOrName, fallback: Column, dtype: str | None = None) -> Column:
    """Two-argument ISNULL / NVL: the result takes the first argument's type.

    Name that type in ``dtype`` where the fallback's type is wider.
    """
    fallback = fallback.cast(dtype) if dtype else fallback
    return F.coalesce(_col(value), fallback)


def load_time(as_of: str | None = None) -> Column:
    """GETDATE(); a given ``as_of`` literal makes a run reproducible. No zone."""
    if as_of is None:
        return F.localtimestamp()
    return F.lit(as_of).cast("timestamp_ntz")


def date_add_days(value: ColumnOrName, days: int | Column) -> Column:
    """DATEADD(day, n, d) on a DATE."""
    return F.date_add(_col(value), days)


def timestamp_add_days(value: ColumnOrName, days: int | Column) -> Column:
    """DATEADD(day, n, t) on a timestamp: the time of day stays."""
    return _col(value) + F.make_dt_interval(days=F.lit(days) if isinstance(days, int) else days)


def date_diff_days(later: ColumnOrName, earlier: ColumnOrName) -> Column:
    """DATEDIFF(day, earlier, later): number of day boundaries crossed."""
    return F.datediff(F.to_date(_col(later)), F.to_date(_col(earlier)))


def substring(value: ColumnOrName, pos: int, length: int) -> Column:
    """SUBSTRING(s, pos, len), first character is 1."""
    return F.substring(_col(value), pos, length)


def if_then_else(condition: Column, then: Column, otherwise: Column) -> Column:
    """CASE WHEN c THEN a ELSE b END; a NULL condition takes the else branch."""
    return F.when(condition, then).otherwise(otherwise)


def plus_concat(*parts: ColumnOrName) -> Column:
    """``a + b`` on strings: NULL if any part is NULL."""
    return F.concat(*[_col(p) for p in parts])


def joined_concat(separator: str, *parts: ColumnOrName) -> Column:
    """Join with a separator and skip NULL parts (differs from :func:`plus_concat`)."""
    return F.concat_ws(separator, *[_col(p) for p in parts])


def sha256(value: ColumnOrName) -> Column:
    """Lower-case hex SHA-256 of the text form; NULL stays NULL."""
    return F.sha2(_col(value).cast("string"), 256)


def redacted(value: ColumnOrName, marker: str = "REDACTED") -> Column:
    """A fixed marker in place of any value; NULL stays NULL."""
    return F.when(_col(value).isNotNull(), F.lit(marker))


# Canonical function name -> helper.
CANONICAL = {
    "COALESCE": F.coalesce,
    "CURRENT_TIMESTAMP": load_time,
    "DATE_ADD": date_add_days,
    "SUBSTRING": substring,
    "TO_UPPER": F.upper,
    "IF_THEN_ELSE": if_then_else,
}
