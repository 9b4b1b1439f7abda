"""Statistical tests and trends from aggregates.

The statistics are computed from count / mean / variance aggregates; the
p-value of a t statistic is a small per-row helper (regularised incomplete
beta, vectorised with numpy in a pandas UDF) applied to the tiny result table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def two_sample_t(df: DataFrame, by: list[str], value: str, flag: str) -> DataFrame:
    """Equal-variance two-sample t per group (flag true vs false);
    fewer than 2 rows on a side -> t = 0 (p = 1)."""
    a, b = F.col(flag), ~F.col(flag)
    g = df.groupBy(*by).agg(
        F.count(F.when(a, 1)).alias("n1"), F.count(F.when(b, 1)).alias("n2"),
        F.avg(F.when(a, F.col(value))).alias("m1"), F.avg(F.when(b, F.col(value))).alias("m2"),
        F.var_samp(F.when(a, F.col(value))).alias("v1"), F.var_samp(F.when(b, F.col(value))).alias("v2"))
    dof = F.col("n1") + F.col("n2") - 2
    sp2 = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / dof
    t = (F.col("m1") - F.col("m2")) / F.sqrt(sp2 * (1.0 / F.col("n1") + 1.0 / F.col("n2")))
    ok = (F.col("n1") >= 2) & (F.col("n2") >= 2) & (sp2 > 0)
    return g.withColumn("gl", dof.cast("long")).withColumn("t", F.when(ok, t).otherwise(F.lit(0.0)))


def _betacf(a, b, x, iters=200, eps=3e-16):
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c = np.ones_like(x)
    d = 1.0 - qab * x / qap
    d = np.where(np.abs(d) < 1e-300, 1e-300, d)
    d = 1.0 / d
    h = d.copy()
    for m in range(1, iters + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = np.where(np.abs(d) < 1e-300, 1e-300, d)
        c = 1.0 + aa / c
        c = np.where(np.abs(c) < 1e-300, 1e-300, c)
        d = 1.0 / d
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = np.where(np.abs(d) < 1e-300, 1e-300, d)
        c = 1.0 + aa / c
        c = np.where(np.abs(c) < 1e-300, 1e-300, c)
        d = 1.0 / d
        de = d * c
        h *= de
        if np.all(np.abs(de - 1.0) < eps):
            break
    return h


def _betainc(a, b, x):
    from math import lgamma
    x = np.clip(x, 0.0, 1.0)
    lbeta = np.array([lgamma(ai + bi) - lgamma(ai) - lgamma(bi) for ai, bi in zip(a, b)])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(lbeta + a * np.log(np.where(x > 0, x, 1e-300))
                       + b * np.log(np.where(x < 1, 1 - x, 1e-300)))
    use_direct = x < (a + 1.0) / (a + b + 2.0)
    direct = front * _betacf(a, b, x) / a
    swapped = 1.0 - front * _betacf(b, a, 1.0 - x) / b
    out = np.where(use_direct, direct, swapped)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


@F.pandas_udf(DoubleType())
def t_pvalue(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Two-sided p-value of Student's t with `dof` degrees of freedom."""
    tt = t.astype(float).to_numpy()
    v = dof.astype(float).to_numpy()
    known = (v > 0) & np.isfinite(tt)                 # else there is nothing to test: p = 1
    p = np.ones(len(tt))
    a = v[known] / 2.0
    p[known] = _betainc(a, np.full_like(a, 0.5), v[known] / (v[known] + tt[known] ** 2))
    return pd.Series(np.clip(p, 0.0, 1.0))


@F.pandas_udf(DoubleType())
def student_quantile(p: pd.Series, dof: pd.Series) -> pd.Series:
    """The value that Student's t stays below with probability p (from 0.5 on); null without degrees of freedom."""
    v = dof.astype(float).to_numpy()
    tail = 2 * (1 - p.astype(float).to_numpy())
    out = np.full(len(v), np.nan)
    for i in np.flatnonzero(v > 0):                       # rows of a small table
        low, high = 0.0, 1.0
        a = np.asarray([v[i] / 2.0])

        def beyond(t: float) -> float:
            return float(_betainc(a, np.asarray([0.5]), np.asarray([v[i] / (v[i] + t * t)]))[0])

        while beyond(high) > tail[i] and high < 1e6:
            high *= 2
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (mid, high) if beyond(mid) > tail[i] else (low, mid)
        out[i] = (low + high) / 2
    return pd.Series(out).where(v > 0, None)


def linear_trend(df: DataFrame, by: list[str], y: str, x: str) -> DataFrame:
    """R2: slope, intercept, R^2 per group, direction of the slope, and the two-sided
    p-value of the slope (null below three points)."""
    g = df.groupBy(*by).agg(F.regr_slope(y, x).alias("inclinacao"),
                            F.regr_intercept(y, x).alias("intercepto"),
                            F.regr_r2(y, x).alias("r2"), F.count(F.lit(1)).alias("n"),
                            F.max(x).alias("x_max"))
    dof = (F.col("n") - 2).cast("double")
    r2 = F.least(F.col("r2"), F.lit(1.0))
    g = g.withColumn("_t", F.when(r2 < 1, F.sqrt(r2 * dof / (1 - r2))))
    p = F.when(F.col("n") > 2, F.when(F.col("r2") >= 1, F.lit(0.0)).otherwise(t_pvalue(F.coalesce("_t", F.lit(0.0)), dof)))
    g = g.withColumn("p_valor", p).drop("_t")
    return g.withColumn("direcao", F.when(F.col("inclinacao") > 0, "crescente")
                        .when(F.col("inclinacao") < 0, "decrescente").otherwise("estavel"))


def project(trend: DataFrame, by: list[str], steps: int = 3) -> DataFrame:
    """Extend each fitted line `steps` periods past its last x."""
    t = trend.withColumn("x", F.explode(F.sequence(F.col("x_max") + 1, F.col("x_max") + steps)))
    return t.select(*by, "x", (F.col("intercepto") + F.col("inclinacao") * F.col("x")).alias("previsto"))
