"""Run queries next to their SQL oracles and compare row by row.

    python -m checks.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

from checks.oracles import ORACLES
from forgeline.plans.catalog import QUERIES
from forgeline.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return value


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir: str, name: str) -> tuple[bool, str]:
    start = time.time()
    df = QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if name not in ORACLES:
        return True, f"{len(got)} rows, {took:.1f}s, no oracle"
    start = time.time()
    cursor = con.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    want = rows_of(columns, cursor.fetchall())
    note = f"{len(got)} rows, spark {took:.1f}s, duckdb {time.time() - start:.1f}s"
    if sorted(df.columns) != sorted(columns):
        return False, f"columns {sorted(df.columns)} != {sorted(columns)}"
    kinds = [[type(v).__name__ for v in r] for r in (got[:1] or [()])[0:1]], [
        [type(v).__name__ for v in r] for r in (want[:1] or [()])[0:1]
    ]
    if got == want and kinds[0] == kinds[1]:
        return bool(got), note + ("" if got else ", EMPTY")
    a, b = set(got) - set(want), set(want) - set(got)
    return False, (
        f"{note}; {len(got)} vs {len(want)} rows, only spark {len(a)}, only duckdb {len(b)}\n"
        f"    columns {sorted(columns)}\n    spark  {sorted(a, key=repr)[:2]}\n    duckdb {sorted(b, key=repr)[:2]}"
    )


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    names = args or list(QUERIES)
    spark = local_session()
    con = duck(sf_dir)
    bad = 0
    for name in names:
        try:
            ok, note = compare(spark, con, sf_dir, name)
        except Exception as e:  # report and go on with the next query
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(main())
