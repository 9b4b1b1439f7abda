"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value", "unit", "queries": {name: sec}, "sf", ...}.
Each query is executed in full (noop sink) after one warm-up run of the
flagship query; file fixtures are written before timing starts.
"""

from __future__ import annotations

import json
import os
import platform
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "it_share_by_year", "yearly_comparative", "general_comparative", "weighted_quantiles",
    "weighted_describe", "uf_latest_year", "age_band_distribution", "income_by_schooling_smoothed",
    "education_by_sex", "age_box_by_period", "registry_groups", "registry_rollup", "enriched_survey",
    "moves_by_band", "dataset_summary", "strat_sample", "clf_metrics", "auc_exact", "threshold_sweep",
    "subgroup_metrics", "fixed_width_roundtrip",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from laborlens.session import get_session
    from laborlens.plans.registry import all_queries
    from laborlens.plans import files as FP

    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    qs = all_queries()
    FP.fwf_dir(spark, sf_dir)                      # fixture write, not timed

    def run(name: str) -> float:
        t0 = time.perf_counter()
        qs[name].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    run(HEADLINE[0])                                # warm-up
    times = {n: round(run(n), 3) for n in HEADLINE}
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_headline_sec", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(m.group(1)) if m else sf_dir,
        "fixed_width_rows_per_sec": round(rows / times["fixed_width_roundtrip"], 1),
        "cpus": int(cpus), "machine": platform.machine(), "python": platform.python_version(),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
