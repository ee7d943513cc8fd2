"""Run registered queries against their SQL: python tools/check.py [sf_dir] [name-prefix ...]"""

from __future__ import annotations

import os
import sys
import time
import traceback
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from chartloom.plans import load  # noqa: E402
from chartloom.session import get_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def normal(v):
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return str([normal(x) for x in v])
    return str(v)


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def compare(df, con, sql):
    """None when both sides agree, else a short description."""
    cols = sorted(df.columns)
    rows = df.select(*cols).collect()
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    other = rel.fetchall()
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}", len(rows)
    order = [names.index(c) for c in cols]
    left = Counter(tuple(normal(v) for v in r) for r in rows)
    right = Counter(tuple(normal(r[i]) for i in order) for r in other)
    if left == right:
        return None, len(rows)
    return (f"rows {len(rows)} vs {len(other)}; only spark {list((left - right).items())[:2]}; "
            f"only sql {list((right - left).items())[:2]}; cols {cols}"), len(rows)


def main():
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    queries, oracles = load()
    names = [n for n in queries if not args or any(n.startswith(a) for a in args)]
    spark, con, bad = get_session(8), connect(sf), []
    for name in names:
        t = time.time()
        try:
            df = queries[name](spark, sf)
            t1 = time.time()
            if name in oracles:
                why, n = compare(df, con, oracles[name])
            else:
                why, n = None, df.count()
        except Exception as e:  # noqa: BLE001
            why, n, t1 = "".join(traceback.format_exception_only(e))[:600], -1, time.time()
        mark = "ok  " if why is None else "FAIL"
        kind = "sql" if name in oracles else "rows"
        print(f"{mark} {name} [{kind}] rows={n} {time.time() - t:.1f}s (plan {t1 - t:.1f})", why or "", flush=True)
        if why:
            bad.append(name)
    print(f"{len(names) - len(bad)}/{len(names)} ok; failed: {bad}")


if __name__ == "__main__":
    main()
