"""Summaries that are kept and merged: weighted quantile sketches (A4, A5), partial aggregates
of files (A25, Q3), and the forecast with trend and season (R4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from laborlens.operators import forecast as FC
from laborlens.operators import partials as PT
from laborlens.operators import sketches as SK
from laborlens.plans import survey as SV
from laborlens.plans.registry import register
from laborlens.plans.sqlbits import survey_sql
from laborlens.plans.views import micro, with_views
from laborlens.session import materialise, scratch_path

WGT = "peso_populacional"
PS = [0.1, 0.25, 0.5, 0.75, 0.9]


@register("age_quantile_sketch", "A4 A5", survey_sql("""
SELECT ano, eh_ti, ROUND(MAX(total), 4) AS peso, """ + ", ".join(
    f"MIN(CASE WHEN cum >= {p}e0 * total - 1e-9 * total THEN v END) AS q_{i}" for i, p in enumerate(PS)) + """
FROM (SELECT *, SUM(w) OVER (PARTITION BY ano, eh_ti ORDER BY v ROWS UNBOUNDED PRECEDING) AS cum,
             SUM(w) OVER (PARTITION BY ano, eh_ti) AS total FROM (
  SELECT ano, eh_ti, CAST(idade AS DOUBLE) AS v, SUM(peso_populacional) AS w FROM occ
  WHERE peso_populacional > 0 AND idade IS NOT NULL GROUP BY 1, 2, 3)) GROUP BY 1, 2"""))
def age_quantile_sketch(spark, d):
    """Weighted age quantiles of every year and segment in one pass; ages are few, so the sketch is exact."""
    rows = SV.occ(spark, d).select("ano", "eh_ti", "idade", WGT)
    q = SK.quantiles(SK.sketch(rows, ["ano", "eh_ti"], "idade", WGT), ["ano", "eh_ti"], PS)
    return q.select("ano", "eh_ti", F.round("total", 4).alias("peso"), *[f"q_{i}" for i in range(len(PS))])


@register("income_quantile_sketch", "A4 A5")
def income_quantile_sketch(spark, d):
    """Weighted income quantiles from the sketch, and how far their rank is from the asked one
    (at most 1 / POINTS, plus the weight of the value itself)."""
    rows = materialise(SV.occ(spark, d).select("eh_ti", F.col("rendimento_trabalho_principal").alias("renda"), WGT),
                       "renda")
    q = SK.quantiles(SK.sketch(rows, ["eh_ti"], "renda", WGT), ["eh_ti"], PS)
    picks = q.select("eh_ti", F.inline(F.array(*[F.struct(F.lit(p).alias("p"), F.col(f"q_{i}").alias("valor"))
                                                 for i, p in enumerate(PS)])))
    ranks = rows.where((F.col(WGT) > 0) & F.col("renda").isNotNull()).join(F.broadcast(picks), "eh_ti")   # ten rows
    return ranks.groupBy("eh_ti", "p", "valor").agg(
        (F.sum(F.when(F.col("renda") <= F.col("valor"), F.col(WGT)).otherwise(0.0)) / F.sum(WGT)).alias("posto"))


PROFILED = ["idade", "uf", "cbo_ocupacao", "anos_estudo"]


def _profile_sql(c: str) -> str:
    number = c if c != "cbo_ocupacao" else "TRY_CAST(cbo_ocupacao AS DOUBLE)"
    return f"""SELECT rodada, '{c}' AS coluna, COUNT(*) AS linhas, COUNT({c}) AS presentes, COUNT(*) - COUNT({c}) AS ausentes,
  ROUND(SUM(CAST({number} AS DOUBLE)) / COUNT({c}), 6) AS media, MIN(CAST({number} AS DOUBLE)) AS minimo,
  MAX(CAST({number} AS DOUBLE)) AS maximo, COUNT(DISTINCT {c}) AS distintos FROM parte GROUP BY rodada"""


@register("partials_profile", "A25 Q3", with_views("micro", extra="""
parte AS (SELECT rodada, m.* FROM micro m, (VALUES (1), (2), (3)) r(rodada) WHERE rodada >= 2 OR trimestre <= 2)""")
          + " UNION ALL ".join(_profile_sql(c) for c in PROFILED))
def partials_profile(spark, d):
    """Column profiles from the states of files over three runs: half of the year, the rest, nothing new."""
    m = micro(spark, d).select("trimestre", *PROFILED)
    landing, store = scratch_path(spark, "perfil"), scratch_path(spark, "estados")
    runs = None
    for run, part in ((1, m.filter("trimestre <= 2")), (2, m.filter("trimestre > 2")), (3, None)):
        if part is not None:
            part.write.parquet(f"{landing}/lote{run}")
        PT.update(spark, landing, store, PROFILED)
        now = materialise(PT.merged(PT.current(spark, store), [], PROFILED), "perfil")
        now = now.select(F.lit(run).alias("rodada"), "coluna", "linhas", "presentes", "ausentes",
                         F.round("media", 6).alias("media"), "minimo", "maximo", "distintos")
        runs = now if runs is None else runs.unionByName(now)
    return runs


PERIOD, HARMONICS, BENDS = 4, 2, 2


def _quarters(spark, d):
    """Employed people by quarter and segment; t counts quarters."""
    t = (F.col("ano") * 4 + F.col("trimestre") - 1).cast("long")
    return SV.occ(spark, d).groupBy("eh_ti", t.alias("t")).agg(F.count(F.lit(1)).cast("double").alias("n"))


def _equations_sql() -> str:
    u, last = "CAST(t - primeiro AS DOUBLE)", "CAST(ultimo - primeiro AS DOUBLE)"
    x = ["1.0::DOUBLE", u] + [f"greatest(0.0::DOUBLE, {u} - {last} * {(i + 1) / (BENDS + 1)!r}::DOUBLE)" for i in range(BENDS)]
    for h in range(1, HARMONICS + 1):
        x.append(f"cos({2 * h}::DOUBLE * pi() / {PERIOD} * {u})")
        if 2 * h != PERIOD:
            x.append(f"sin({2 * h}::DOUBLE * pi() / {PERIOD} * {u})")
    p = len(x)
    cols = ", ".join(f"{c} AS x{i}" for i, c in enumerate(x))
    cells = [f"ROUND(SUM(x{i} * x{j}), 4)" for i in range(p) for j in range(i, p)]
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    parts = [f"SELECT eh_ti, {i} AS i, {j} AS j, {c} + 0.0 AS soma, COUNT(*) AS n FROM r GROUP BY eh_ti" for (i, j), c in zip(pairs, cells)]
    parts += [f"SELECT eh_ti, {i} AS i, -1 AS j, ROUND(SUM(x{i} * y), 4) + 0.0 AS soma, COUNT(*) AS n FROM r GROUP BY eh_ti" for i in range(p)]
    return survey_sql(" UNION ALL ".join(parts), extra=f"""
s AS (SELECT eh_ti, CAST(ano * 4 + trimestre - 1 AS BIGINT) AS t, CAST(COUNT(*) AS DOUBLE) AS y FROM occ GROUP BY 1, 2),
e AS (SELECT *, MIN(t) OVER (PARTITION BY eh_ti) AS primeiro, MAX(t) OVER (PARTITION BY eh_ti) AS ultimo FROM s),
r AS (SELECT eh_ti, y, {cols} FROM e)""")


@register("seasonal_equations", "R4", _equations_sql())
def seasonal_equations(spark, d):
    """The normal equations of every segment's trend and season, sum by sum (j = -1: with the series)."""
    sums = FC.normal_equations(_quarters(spark, d), ["eh_ti"], "t", "n", PERIOD, HARMONICS, BENDS)
    p = len(FC.regressors(F.lit(0), F.lit(1), PERIOD, HARMONICS, BENDS))
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    cells = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.element_at("xx", k + 1).alias("v"))
             for k, (i, j) in enumerate(pairs)]
    cells += [F.struct(F.lit(i).alias("i"), F.lit(-1).alias("j"), F.element_at("xy", i + 1).alias("v")) for i in range(p)]
    return sums.select("eh_ti", F.col("n").alias("n"), F.inline(F.array(*cells))).select(
        "eh_ti", "i", "j", (F.round("v", 4) + F.lit(0.0)).alias("soma"), "n")


@register("seasonal_projection", "R4")
def seasonal_projection(spark, d):
    """Employed people of the next three years by quarter, with 95 % intervals."""
    sums = FC.normal_equations(_quarters(spark, d), ["eh_ti"], "t", "n", PERIOD, HARMONICS, BENDS)
    out = FC.project(FC.fit(sums, ["eh_ti"]), ["eh_ti"], 12, PERIOD, HARMONICS, BENDS)
    return out.select("eh_ti", F.floor(F.col("t") / 4).cast("int").alias("ano"), (F.col("t") % 4 + 1).cast("int").alias("trimestre"),
                      *[F.round(c, 4).alias(c) for c in ("previsto", "inferior", "superior")])
