"""Registered queries against their DuckDB oracle (small scale) + properties."""

import pytest

from tools.oracle_check import check, duck_con
from tests.conftest import SF_SMALL

SAMPLE = ["it_share_by_year", "yearly_comparative", "weighted_quantiles", "uf_latest_year",
          "age_band_distribution", "income_by_schooling_smoothed", "registry_groups", "moves_by_band",
          "quotas", "strat_sample", "auc_exact", "top_codes", "ingest_pending", "consolidate",
          "fraction_sample", "prop_sample", "smote", "bootstrap_auc", "class_report", "curve_points", "subgroup_metrics",
          "age_trend", "ttest_pvalues", "registry_profile", "targets_wage", "csv_headers", "charset_roundtrip",
          "stream_ingest", "stream_feed_windows", "cv_folds", "layout_columns", "file_caps"]


@pytest.fixture(scope="module")
def qs():
    from laborlens.plans.registry import all_queries
    return all_queries()


@pytest.mark.parametrize("name", SAMPLE)
def test_oracle(spark, qs, name):
    status, msg = check(spark, duck_con(SF_SMALL), qs[name], SF_SMALL)
    assert status == "ok", msg


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 80


def test_shares_sum_to_100(spark, qs):
    rows = qs["age_band_distribution"].fn(spark, SF_SMALL).collect()
    assert abs(sum(r["perc_ti"] for r in rows) - 100) < 1e-3


def test_quotas_sum(spark, qs):
    from laborlens.plans.sampling_plans import SAMPLE_FRACTION
    rows = qs["quotas"].fn(spark, SF_SMALL).collect()
    assert sum(r["quota"] for r in rows) == int(sum(r["n"] for r in rows) * SAMPLE_FRACTION)


def test_split_fraction(spark, qs):
    rows = qs["split_sizes"].fn(spark, SF_SMALL).collect()
    by = {}
    for r in rows:
        by.setdefault(r["y_true"], {})[r["split"]] = r["n"]
    for y, d in by.items():
        n = d.get("teste", 0) + d.get("treino", 0)
        assert abs(d.get("teste", 0) - round(n * 0.25)) <= 1
