"""Compare queries with their oracle SQL:  python -m checks.run [sf] [name ...]"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from checks import QUERIES, SQL, load_all
from faultline.session import local_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    return value


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def main() -> None:
    load_all()
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0][0].isdigit() else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    names = [n for n in QUERIES if not args or any(a in n for a in args)]
    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            got = rows_of(df.columns, [tuple(r) for r in df.collect()])
        except Exception as error:  # noqa: BLE001
            print(f"ERROR {name}: {str(error)[:1500]}")
            bad += 1
            continue
        took = time.time() - start
        if name not in SQL:
            print(f"rows  {name}: {len(got[1])} rows, {took:.1f}s")
            continue
        start = time.time()
        try:
            cur = con.execute(SQL[name])
            want = rows_of([d[0] for d in cur.description], cur.fetchall())
        except Exception as error:  # noqa: BLE001
            print(f"SQLERR {name}: {str(error)[:1500]}")
            bad += 1
            continue
        sql_took = time.time() - start
        if got == want:
            print(f"ok    {name}: {len(got[1])} rows, {took:.1f}s (sql {sql_took:.1f}s)", flush=True)
            continue
        bad += 1
        print(f"DIFF  {name}: {len(got[1])} rows vs {len(want[1])}; columns {got[0]} vs {want[0]}")
        a, b = set(map(repr, got[1])), set(map(repr, want[1]))
        for label, only in (("spark", a - b), ("sql", b - a)):
            for row in sorted(only)[:4]:
                print(f"      only {label} ({len(only)}): {row[:400]}")
    print(f"{len(names) - bad} of {len(names)} fine")


if __name__ == "__main__":
    main()
