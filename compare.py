"""Run registered queries next to their SQL and report differences: python compare.py [sf_dir] [from:to] [name ...]"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

from pricebook.session import build_session
from workload import ORACLE, QUERIES
from workload.base import TABLES


def cell(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    if isinstance(v, bool) or v is None or isinstance(v, (int, str)):
        return repr(v) if not isinstance(v, int) or isinstance(v, bool) else repr(round(float(v), 9))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def main(argv: list[str]) -> int:
    sf = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("OFF")
    duck = duckdb.connect()
    duck.execute("SET TimeZone='UTC'")
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    bad = 0
    span = slice(*map(int, wanted.pop(0).split(":"))) if wanted and ":" in wanted[0] else slice(None)
    for name, fn in list(QUERIES.items())[span]:
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, sf)
            rows = df.collect()
            took = time.time() - start
            cols = sorted(df.columns)
            mine = sorted(tuple(cell(r[c]) for c in cols) for r in rows)
            if name not in ORACLE:
                print(f"rows {name} {len(mine)} {took:.1f}s")
                continue
            cur = duck.execute(ORACLE[name])
            names = [d[0] for d in cur.description]
            theirs_rows = cur.fetchall()
            if sorted(names) != cols:
                bad += 1
                print(f"BAD  {name}: columns {cols} against {sorted(names)}")
                continue
            at = [names.index(c) for c in cols]
            theirs = sorted(tuple(cell(r[i]) for i in at) for r in theirs_rows)
            if mine == theirs:
                print(f"ok   {name} {len(mine)} {took:.1f}s", flush=True)
            else:
                bad += 1
                a, b = set(mine) - set(theirs), set(theirs) - set(mine)
                print(f"BAD  {name}: {len(mine)} rows against {len(theirs)}; only spark {len(a)}, only sql {len(b)}\n  {cols}\n  spark {sorted(a)[:3]}\n  sql   {sorted(b)[:3]}")
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: {type(e).__name__} {str(e)[:700]}")
    print(f"{bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
