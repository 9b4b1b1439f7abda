"""Summarise the physical plans of registered queries (explain 'formatted').

usage: python tools/plan_report.py [--sf DIR] [names...]  > docs/PLANS.md
Counts exchanges / join strategies / windows and lists every parquet scan's
ReadSchema and PushedFilters, so plan regressions are visible in review.
"""

from __future__ import annotations

import argparse
import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from laborlens.plans.registry import all_queries  # noqa: E402
from laborlens.session import get_session  # noqa: E402

OPS = ["Exchange", "BroadcastExchange", "BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin",
       "BroadcastNestedLoopJoin", "CartesianProduct", "Window", "HashAggregate", "SortAggregate",
       "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas"]


def summarize(df) -> dict:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    tree = text.split("\n\n")[0]
    counts = {op: len(re.findall(rf"\b{op} \(", tree)) for op in OPS}
    scans = []
    for block in text.split("\n\n"):
        if re.match(r"\(\d+\) Scan (parquet|csv|text|json)", block.strip()):
            loc = re.search(r"Location: \S+ \[(.*?)\]", block)
            rs = re.search(r"ReadSchema: (.*)", block)
            pf = re.search(r"PushedFilters: (.*)", block)
            scans.append((os.path.basename((loc.group(1) if loc else "?").split(",")[0]),
                          rs.group(1) if rs else "", pf.group(1) if pf else ""))
    return {"counts": {k: v for k, v in counts.items() if v}, "scans": scans}


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.1")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    spark = get_session()
    qs = all_queries()
    names = a.names or list(qs)
    print(f"# Physical plans ({a.sf}, explain before AQE re-planning)\n")
    for n in names:
        s = summarize(qs[n].fn(spark, a.sf))
        ops = ", ".join(f"{k}×{v}" for k, v in s["counts"].items())
        print(f"## {n}  [{' '.join(qs[n].ids)}]\n\n{ops}\n")
        for loc, rs, pf in s["scans"]:
            print(f"- `{loc}` ReadSchema `{rs}`" + (f" PushedFilters `{pf}`" if pf and pf != "[]" else ""))
        print()


if __name__ == "__main__":
    main()
