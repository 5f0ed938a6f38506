"""Run registered queries against their SQL in DuckDB on the same Parquet files."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, float) and v == 0:
        return 0.0
    if isinstance(v, dict):
        return tuple(sorted((str(k), _plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, bytearray):
        return bytes(v)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def difference(spark, con, sf_dir: str, name: str):
    """None when equal, else a short description."""
    from aeroband.plans import catalog
    from aeroband.plans.registry import ENTRIES, run, with_views

    df = run(name, spark, sf_dir)
    got = df.collect()
    sql = ENTRIES[name].sql
    if sql is None:
        return None if len(got) > 0 else "no rows (unchecked values)"
    cur = con.execute(with_views(sql))
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns spark={sorted(df.columns)} sql={sorted(names)}"
    if len(got) != len(want):
        return f"rows spark={len(got)} sql={len(want)}"
    if not want:
        return "empty result"
    a, b = _rows(df.columns, [tuple(r) for r in got]), _rows(names, want)
    for x, y in zip(a, b):
        if x != y:
            return f"cols {sorted(names)}\n   spark {str(x)[:600]}\n   sql   {str(y)[:600]}"
        for v, w in zip(x, y):
            if type(v) is not type(w):
                return f"types {type(v)} {type(w)} in {x} {y}"
    return None


def main(argv):
    from aeroband.plans import catalog
    from aeroband.plans.registry import ENTRIES
    from aeroband.session import local_session

    sf_dir = "/root/testdata/sf0.01"
    if argv and argv[0].startswith("/"):
        sf_dir, argv = argv[0], argv[1:]
    catalog.load()
    names = [n for n in ENTRIES if not argv or any(n == p or (p.endswith("*") and n.startswith(p[:-1])) for p in argv)]
    spark, con, bad = local_session(cpus=8), connect(sf_dir), 0
    for n in names:
        t = time.time()
        try:
            d = difference(spark, con, sf_dir, n)
        except Exception as ex:  # report and go on with the next query
            d = f"{type(ex).__name__}: {str(ex)[:700]}"
        took = time.time() - t
        if d:
            bad += 1
            print(f"BAD  {n} {took:.1f}s {d}", flush=True)
        elif took > 8:
            print(f"slow {n} {took:.1f}s", flush=True)
    print(f"{len(names) - bad}/{len(names)} equal", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
