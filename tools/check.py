"""Run registered queries next to their checking SQL and compare rows.

    python tools/check.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from vitalgrid.plans import catalog  # noqa: E402
from vitalgrid.session import local_session  # noqa: E402
from vitalgrid.sources.tables import BASE_TABLES  # noqa: E402


def normal(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, bool):
        return str(v)
    return repr(v)


def connect(folder):
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows)


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    spark = local_session()
    con = connect(folder)
    bad = 0
    for name, fn in catalog.QUERIES.items():
        if args.names and not any(n in name for n in args.names):
            continue
        t0 = time.time()
        try:
            df = fn(spark, folder)
            got = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001 - report and go on
            print(f"FAIL {name}: spark {str(e)[:1500]}")
            bad += 1
            continue
        t1 = time.time()
        if name not in catalog.ORACLES:
            print(f"rows {name}: {len(got)} {t1 - t0:.1f}s")
            continue
        try:
            cur = con.execute(catalog.ORACLES[name])
            cols = [d[0] for d in cur.description]
            types = {d[0]: str(d[1]) for d in cur.description}
            want = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: oracle {str(e)[:1500]}")
            bad += 1
            con = connect(folder)
            continue
        a, b = rows_of(df.columns, got), rows_of(cols, want)
        if sorted(df.columns) == sorted(cols) and a == b and a:
            print(f"ok   {name}: {len(a)} rows {t1 - t0:.1f}s duck {time.time() - t1:.1f}s")
        else:
            bad += 1
            print(f"DIFF {name}: spark {len(a)} duck {len(b)} {sorted(df.columns)} {sorted(cols)}")
            print("   ", dict(df.dtypes), types)
            sa, sb = set(a), set(b)
            for r in sorted(sa - sb)[:4]:
                print("    spark only", r)
            for r in sorted(sb - sa)[:4]:
                print("    duck only ", r)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
