"""Compare every registered query with its SQL on one data folder.

    python tests/check.py /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM read_parquet('{table}')")
    return con


def plain(value):
    if isinstance(value, Decimal):
        return format(value.normalize(), "f")
    if isinstance(value, float):
        return round(value, 9)
    return value


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(row[i]) for i in order)) for row in rows)


def compare(spark, con, name, function, sql, sf_dir):
    """None if equal, else what differs."""
    df = function(spark, sf_dir)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got else "no rows"
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    want = normal(columns, cursor.fetchall())
    if got == want:
        return None if got else "no rows on either side"
    only_got = [r for r in got if r not in set(want)][:3]
    only_want = [r for r in want if r not in set(got)][:3]
    return f"{len(got)} rows != {len(want)} rows; only here {only_got}; only there {only_want}"


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from tests.conftest import local_session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark, con, sqls = local_session(), duck(sf_dir), oracle_sql()
    failed = 0
    for name, function in queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            problem = compare(spark, con, name, function, sqls.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001  (report and go on to the next query)
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
