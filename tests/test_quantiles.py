"""Distributed weighted / exact quantiles against brute-force numpy."""

import numpy as np

from laborlens.operators import quantiles as Q


def _ref_interp(v, w, p):
    o = np.lexsort((w, v))
    v, w = v[o], w[o]
    c = np.cumsum(w) / w.sum()
    i = np.searchsorted(c, p)
    if i == 0:
        return v[0]
    if i >= len(v):
        return v[-1]
    return v[i - 1] + (v[i] - v[i - 1]) * (p - c[i - 1]) / (c[i] - c[i - 1])


def _ref_step(v, w, p):
    o = np.lexsort((w, v))
    v, w = v[o], w[o]
    c = np.cumsum(w) / w.sum()
    i = np.searchsorted(c, p, side="right")
    return v[0] if i == 0 else v[i - 1]


def test_weighted_percentiles_match_numpy(spark):
    rng = np.random.default_rng(7)
    rows = []
    for g in range(3):
        n = 400
        v = np.round(rng.lognormal(8, 1, n), 0) * (1 if g else -1)   # ties and negatives
        w = rng.integers(1, 30, n).astype(float)
        rows += [(g, float(a), float(b)) for a, b in zip(v, w)]
    df = spark.createDataFrame(rows, "g int, v double, w double")
    ps = [0.1, 0.25, 0.5, 0.9]
    got = {r["g"]: r for r in Q.weighted_percentiles(df, ["g"], "v", "w", ps).collect()}
    step = {r["g"]: r for r in Q.weighted_percentiles(df, ["g"], "v", "w", ps, interpolate=False).collect()}
    for g in range(3):
        v = np.array([r[1] for r in rows if r[0] == g])
        w = np.array([r[2] for r in rows if r[0] == g])
        for p in ps:
            assert abs(got[g][Q._pname(p)] - _ref_interp(v, w, p)) < 1e-6
            assert abs(step[g][Q._pname(p)] - _ref_step(v, w, p)) < 1e-9


def test_exact_percentiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(0, 90, 1000).astype(float)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    ps = [0.0, 0.25, 0.5, 0.75, 1.0]
    r = Q.exact_percentiles(df, [], "v", ps).first()
    for p in ps:
        assert abs(r[Q._pname(p)] - np.percentile(v, p * 100)) < 1e-9


def test_targeted_matches_full_order(spark):
    """The bucket-targeted selection equals the full running-weight path."""
    rng = np.random.default_rng(11)
    rows = [(int(g), float(v), float(w)) for g, v, w in
            zip(rng.integers(0, 4, 3000), np.round(rng.normal(0, 500, 3000), 1), rng.uniform(0.1, 9, 3000))]
    df = spark.createDataFrame(rows, "g int, v double, w double")
    vt = Q.value_weights(df, ["g"], "v", "w")
    ps = [0.0, 0.01, 0.33, 0.5, 0.999, 1.0]
    for interp in (True, False):
        a = {r["g"]: r for r in Q.percentiles_from_values(vt, ["g"], "v", ps, interp).collect()}
        b = {r["g"]: r for r in Q.percentiles_reference(vt, ["g"], "v", ps, interp).collect()}
        c = {r["g"]: r for r in Q.percentiles_full_order(vt, ["g"], "v", ps, interp).collect()}
        for g in a:
            for p in ps:
                assert abs(a[g][Q._pname(p)] - b[g][Q._pname(p)]) < 1e-9, (g, p, interp)
                assert abs(c[g][Q._pname(p)] - b[g][Q._pname(p)]) < 1e-9, (g, p, interp)
