"""Runs queries and their SQL side by side; ``python tests/compare.py SF [NAME ...]``."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return dt.datetime(v.year, v.month, v.day).isoformat()
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if isinstance(v, list | tuple):
        return tuple(norm(x) for x in v)
    return v


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def both(spark, con, sf_dir: str, f, sql: str):
    df = f(spark, sf_dir)
    cols = sorted(df.columns)
    mine = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    order = [names.index(c) for c in cols] if sorted(names) == cols else None
    assert order is not None, f"columns {cols} and {sorted(names)}"
    theirs = [tuple(norm(r[i]) for i in order) for r in cur.fetchall()]
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    return cols, sorted(mine, key=key), sorted(theirs, key=key)


if __name__ == "__main__":
    import __spark_entry__ as entry
    from finloom.plans.runtime import session

    sf = f"/root/testdata/{sys.argv[1]}"
    spark, con = session(cores="8"), connect(sf)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = []
    for name in sys.argv[2:] or [n for n in queries if n in sql]:
        t = time.time()
        try:
            cols, a, b = both(spark, con, sf, queries[name], sql[name])
            ok = a == b
            print(("ok  " if ok else "BAD ") + name, len(a), len(b), round(time.time() - t, 1), flush=True)
            if not ok:
                bad.append(name)
                print("   ", cols)
                sa, sb = set(a), set(b)
                print("    spark only", [str(x)[:300] for x in a if x not in sb][:2])
                print("    sql only  ", [str(x)[:300] for x in b if x not in sa][:2], flush=True)
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print("ERR ", name, str(e)[:500].replace("\n", " | "), flush=True)
    print("bad:", bad)
