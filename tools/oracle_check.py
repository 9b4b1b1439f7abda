"""Run registered queries on Spark and their oracle SQL on DuckDB; compare.

usage: python tools/oracle_check.py [--sf DIR] [name ...]

Comparison: same column names (order-insensitive), same row count, same
multiset of rows after rounding doubles to 6 places; types are reported.
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from laborlens.session import get_session  # noqa: E402
from laborlens.plans.registry import all_queries  # noqa: E402
from laborlens.sources.tables import TABLES  # noqa: E402

EXACT = bool(os.environ.get("ORACLE_EXACT"))

_SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                  "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "date": "DATE",
                  "smallint": "SMALLINT", "tinyint": "TINYINT", "float": "FLOAT"}


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return (round(v, 6) if not EXACT else v) + 0.0
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(records):
    out = [tuple(_norm(x) for x in r) for r in records]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0)
                                           for x in t))


def duck_con(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def check(spark, con, q, sf):
    t0 = time.time()
    sdf = q.fn(spark, sf)
    cols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    ts = time.time() - t0
    if q.oracle is None:
        return "rows-only", f"{len(srows)} rows ({ts:.1f}s)"
    rel = con.sql(q.oracle)
    dcols = rel.columns
    drows = rel.fetchall()
    stypes = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
    dtypes = dict(zip(dcols, [str(t) for t in rel.types]))
    if sorted(cols) != sorted(dcols):
        return "FAIL", f"columns differ: spark={sorted(cols)} duck={sorted(dcols)}"
    order = sorted(cols)
    si = [cols.index(c) for c in order]
    di = [dcols.index(c) for c in order]
    a = _rows([tuple(r[i] for i in si) for r in srows])
    b = _rows([tuple(r[i] for i in di) for r in drows])
    tmis = [c for c in order if _SPARK_TO_DUCK.get(stypes[c], stypes[c]) != dtypes[c]]
    note = f" types differ: {[(c, stypes[c], dtypes[c]) for c in tmis]}" if tmis else ""
    if len(a) != len(b):
        return "FAIL", f"rows spark={len(a)} duck={len(b)}{note}"
    if a != b:
        for x, y in zip(a, b):
            if x != y:
                return "FAIL", f"first diff:\n  spark={x}\n  duck ={y}{note}"
    return "ok", f"{len(a)} rows ({ts:.1f}s){note}"


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    spark = get_session()
    con = duck_con(a.sf)
    qs = all_queries()
    names = a.names or list(qs)
    bad = 0
    for n in names:
        try:
            status, msg = check(spark, con, qs[n], a.sf)
        except Exception as e:  # report and continue
            status, msg = "ERROR", f"{type(e).__name__}: {str(e)[:600]}"
        if status in ("FAIL", "ERROR"):
            bad += 1
        print(f"{status:9s} {n:32s} {msg}", flush=True)
    print(f"{len(names) - bad}/{len(names)} passed")


if __name__ == "__main__":
    main()
