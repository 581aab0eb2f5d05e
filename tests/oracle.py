"""Compare registered queries with their SQL on one directory of test tables.

Usage: python tests/oracle.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark, con, sf_dir, name, run, sql) -> str:
    """Empty text when Spark and SQL agree, else what differs."""
    df = run(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    theirs = rows_of(columns, cursor.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(columns)}"
    if mine != theirs:
        only_mine, only_theirs = mine - theirs, theirs - mine
        return (
            f"rows {sum(mine.values())} / {sum(theirs.values())}; "
            f"only Spark {list(only_mine)[:2]}; only SQL {list(only_theirs)[:2]}"
        )
    if not mine:
        return "EMPTY"
    return ""


def main() -> None:
    import __spark_entry__ as entry
    from folioflux.session import local_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark = local_session(8)
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        start = time.time()
        try:
            if name in oracles:
                text = compare(spark, con, sf_dir, name, run, oracles[name])
            else:
                n = run(spark, sf_dir).count()
                text = "" if n else "EMPTY"
                name += f" (rows only: {n})"
        except Exception as exc:  # noqa: BLE001 - report and go on
            text = f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += bool(text)
        print(f"{'BAD' if text else 'ok '} {time.time() - start:5.1f}s {name} {text}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
