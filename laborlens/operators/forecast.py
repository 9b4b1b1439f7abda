"""Forecast by piecewise trend and season (R4), a least-squares fit for each key.

The regressors of period t (0, 1, ... since the key's first) are 1, t, a bend max(0, t - knot) at each of
``bends`` evenly spaced knots, and sine and cosine of the season's harmonics.  Spark sums the
normal equations of every key (a handful of numbers, whatever the rows); each key's small system is
solved in a task.  The interval of a forecast is that of a new observation under normal errors.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laborlens.operators.stats import student_quantile


def regressors(t: Column, last: Column, period: int, harmonics: int, bends: int) -> list[Column]:
    """x_0 ... of period ``t`` for a key whose last period is ``last``."""
    t = t.cast("double")
    out = [F.lit(1.0), t]
    out += [F.greatest(F.lit(0.0), t - last.cast("double") * F.lit((i + 1) / (bends + 1))) for i in range(bends)]
    for h in range(1, harmonics + 1):
        angle = F.lit(2 * math.pi * h / period) * t
        out.append(F.cos(angle))
        if 2 * h != period:                       # the sine of half the period is always 0
            out.append(F.sin(angle))
    return out


def normal_equations(series: DataFrame, by: list[str], t: str, y: str, period: int, harmonics: int,
                     bends: int) -> DataFrame:
    """(by, primeiro, ultimo, n, yy, xx, xy): sums over each key's rows; xx is the upper triangle, row by row.

    ``t``: the number of the period, any start."""
    ends = series.where(F.col(t).isNotNull() & F.col(y).isNotNull()).groupBy(*by).agg(
        F.min(t).alias("primeiro"), F.max(t).alias("ultimo"))
    rows = series.where(F.col(t).isNotNull() & F.col(y).isNotNull()).join(ends, by)
    x = regressors(F.col(t) - F.col("primeiro"), F.col("ultimo") - F.col("primeiro"), period, harmonics, bends)
    p = len(x)
    rows = rows.select(*by, "primeiro", "ultimo", F.col(y).cast("double").alias("_y"),
                       *[c.alias(f"_x{i}") for i, c in enumerate(x)])
    xx = [F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")) for i in range(p) for j in range(i, p)]
    return rows.groupBy(*by, "primeiro", "ultimo").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("_y") * F.col("_y")).alias("yy"), F.array(*xx).alias("xx"),
        F.array(*[F.sum(F.col(f"_x{i}") * F.col("_y")) for i in range(p)]).alias("xy"))


def solved(xx: np.ndarray, xy: np.ndarray, yy: float, n: int) -> tuple:
    """(coefficients, inverse of the matrix, residual variance, degrees of freedom); regressors that
    a key's periods can't tell apart share their weight (the least-norm solution)."""
    p = len(xy)
    a = np.zeros((p, p))
    a[np.triu_indices(p)] = xx
    a = a + np.triu(a, 1).T
    scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
    inverse = np.linalg.pinv(a / np.outer(scale, scale), rcond=1e-10, hermitian=True) / np.outer(scale, scale)
    rank = np.linalg.matrix_rank(a / np.outer(scale, scale), tol=1e-10, hermitian=True)
    beta = inverse @ xy
    dof = n - int(rank)
    rss = max(0.0, yy - float(beta @ xy))
    return beta, inverse, rss / dof if dof > 0 else math.nan, dof


def fit(sums: DataFrame, by: list[str]) -> DataFrame:
    """(by, primeiro, ultimo, n, gl, desvio, coef, inversa) of every key."""
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in sums.schema if f.name in by],
                        "primeiro long, ultimo long, n long, gl int, desvio double, coef array<double>, inversa array<double>"])

    def work(frames):
        for frame in frames:
            out = []
            for r in frame.to_dict("records"):
                beta, inverse, variance, dof = solved(np.asarray(r["xx"]), np.asarray(r["xy"]), r["yy"], r["n"])
                out.append([*[r[b] for b in by], r["primeiro"], r["ultimo"], r["n"], dof,
                            math.sqrt(variance) if dof > 0 else None, beta.tolist(), inverse.ravel().tolist()])
            yield pd.DataFrame(out, columns=[*by, "primeiro", "ultimo", "n", "gl", "desvio", "coef", "inversa"])

    return sums.select(*by, F.col("primeiro").cast("long"), F.col("ultimo").cast("long"), "n", "yy", "xx", "xy") \
               .mapInPandas(work, schema)


def project(model: DataFrame, by: list[str], steps: int, period: int, harmonics: int, bends: int,
            level: float = 0.95) -> DataFrame:
    """(by, t, previsto, inferior, superior) of the ``steps`` periods after each key's last."""
    ahead = model.withColumn("t", F.explode(F.sequence(F.col("ultimo") + 1, F.col("ultimo") + steps)))
    x = F.array(*regressors(F.col("t") - F.col("primeiro"), F.col("ultimo") - F.col("primeiro"), period, harmonics, bends))
    ahead = ahead.withColumn("_x", x)
    total = F.aggregate(F.zip_with("coef", "_x", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    p = F.size("_x")
    row = F.transform("_x", lambda xi, i: xi * F.aggregate(
        F.zip_with(F.slice("inversa", i * p + 1, p), "_x", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b))
    spread = F.aggregate(row, F.lit(0.0), lambda a, b: a + b)
    half = student_quantile(F.lit((1 + level) / 2), F.col("gl").cast("double")) * F.col("desvio") * F.sqrt(1 + spread)
    return ahead.withColumns({"previsto": total, "_half": half}).select(
        *by, "t", "previsto", (F.col("previsto") - F.col("_half")).alias("inferior"),
        (F.col("previsto") + F.col("_half")).alias("superior"))
