"""Age-structure (ageism study) tables: yearly age moments, band shares,
period / generation comparisons, five-number summaries, histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laborlens import params as P
from laborlens.functions import scalars as X
from laborlens.operators import aggregates as A
from laborlens.operators import filters as FL
from laborlens.operators import quantiles as Q
from laborlens.plans import sqlbits as S
from laborlens.plans.registry import register
from laborlens.plans.views import micro, with_views
from laborlens.session import materialise

# Test parameters: the study's year window is 2012-2025; the synthetic years are 1995-2001.
YEAR_LO, YEAR_HI = 1990, 2025
AGE_LO, AGE_HI = 14, 120


def base(spark, d) -> DataFrame:
    """F2 plausible age + F5 year window over the microdata."""
    return FL.year_between(FL.age_between(micro(spark, d), "idade", AGE_LO, AGE_HI), YEAR_LO, YEAR_HI)


def _sql(body: str, extra: str = "") -> str:
    cte = (f"base AS (SELECT * FROM micro WHERE idade BETWEEN {AGE_LO} AND {AGE_HI} "
           f"AND ano BETWEEN {YEAR_LO} AND {YEAR_HI})")
    return with_views("micro", extra=cte + ("," + extra if extra else "")) + body


def _r(c, places=4):
    return F.round(c.cast("double"), places)


_AGEISM_SQL = "CASE " + " ".join(
    (f"WHEN idade BETWEEN {lo} AND {hi} THEN '{lb}'" if hi is not None else
     f"WHEN idade >= {lo} THEN '{lb}'") for lb, lo, hi in P.AGE_BANDS_AGEISM) + \
    f" ELSE '{P.AGE_BAND_UNDEFINED}' END"


@register("age_by_year", "F2 F5 A21", _sql("""
SELECT ano, eh_ti, COUNT(*) AS n, ROUND(AVG(idade), 4) AS idade_media,
       ROUND(STDDEV_SAMP(idade), 4) AS idade_desvio
FROM base GROUP BY ano, eh_ti"""))
def age_by_year(spark, d):
    return base(spark, d).groupBy("ano", "eh_ti").agg(
        F.count(F.lit(1)).alias("n"), _r(F.avg("idade")).alias("idade_media"),
        _r(F.stddev_samp("idade")).alias("idade_desvio"))


@register("band_share_by_year", "X19 A21 W2", _sql(f"""
SELECT ano, eh_ti, faixa, n, ROUND(100.0 * n / SUM(n) OVER (PARTITION BY ano, eh_ti), 4) AS pct
FROM (SELECT ano, eh_ti, {_AGEISM_SQL} AS faixa, COUNT(*) AS n FROM base GROUP BY 1, 2, 3)"""))
def band_share_by_year(spark, d):
    df = base(spark, d).withColumn("faixa", X.age_band("idade", P.AGE_BANDS_AGEISM,
                                                        P.AGE_BAND_UNDEFINED))
    g = df.groupBy("ano", "eh_ti", "faixa").agg(F.count(F.lit(1)).alias("n"))
    return g.select("ano", "eh_ti", "faixa", "n",
                    _r(100.0 * A.share_of_total("n", "ano", "eh_ti")).alias("pct"))


_PERIOD_SQL = ("CASE WHEN ano < 2020 THEN 'Pre-Pandemia' WHEN ano <= 2021 THEN 'Pandemia' "
               "ELSE 'Pos-Pandemia' END")


@register("period_compare", "X20 A22", _sql(f"""
SELECT periodo, decada, COUNT(CASE WHEN eh_ti THEN 1 END) AS n_ti,
       COUNT(CASE WHEN NOT eh_ti THEN 1 END) AS n_outros,
       ROUND(AVG(CASE WHEN eh_ti THEN idade END), 4) AS idade_media_ti,
       ROUND(AVG(CASE WHEN NOT eh_ti THEN idade END), 4) AS idade_media_outros,
       ROUND(AVG(CASE WHEN eh_ti THEN idade END) - AVG(CASE WHEN NOT eh_ti THEN idade END), 4) AS diferenca
FROM (SELECT *, {_PERIOD_SQL} AS periodo, CAST(floor(ano / 10) * 10 AS INT) AS decada FROM base)
GROUP BY periodo, decada"""))
def period_compare(spark, d):
    df = base(spark, d).withColumns({"periodo": X.covid_period("ano"), "decada": X.decade("ano")})
    it, nit = F.col("eh_ti"), ~F.col("eh_ti")
    mt, mo = F.avg(F.when(it, F.col("idade"))), F.avg(F.when(nit, F.col("idade")))
    return df.groupBy("periodo", "decada").agg(
        A.count_if(it).alias("n_ti"), A.count_if(nit).alias("n_outros"),
        _r(mt).alias("idade_media_ti"), _r(mo).alias("idade_media_outros"),
        _r(mt - mo).alias("diferenca"))


_GEN_SQL = ("CASE WHEN idade + (2020 - COALESCE(ano, 2020)) IS NULL THEN NULL "
            "WHEN idade + (2020 - COALESCE(ano, 2020)) <= 25 THEN 'Gen Z' "
            "WHEN idade + (2020 - COALESCE(ano, 2020)) <= 40 THEN 'Millennial' "
            "WHEN idade + (2020 - COALESCE(ano, 2020)) <= 55 THEN 'Gen X' ELSE 'Boomer' END")


@register("generation_share", "X20 A23 W2", _sql(f"""
SELECT ano, eh_ti, geracao, n, ROUND(100.0 * n / SUM(n) OVER (PARTITION BY ano, eh_ti), 4) AS pct
FROM (SELECT ano, eh_ti, {_GEN_SQL} AS geracao, COUNT(*) AS n FROM base GROUP BY 1, 2, 3)"""))
def generation_share(spark, d):
    df = base(spark, d).withColumn("geracao", X.generation("idade", "ano"))
    g = df.groupBy("ano", "eh_ti", "geracao").agg(F.count(F.lit(1)).alias("n"))
    return g.select("ano", "eh_ti", "geracao", "n",
                    _r(100.0 * A.share_of_total("n", "ano", "eh_ti")).alias("pct"))


_BOX = [0.0, 0.25, 0.5, 0.75, 1.0]


@register("age_box_by_period", "X20 A23", _sql(f"""
SELECT decada, eh_ti, {', '.join(f'ROUND(quantile_cont(idade, {p}), 4) AS {S.pname(p)}' for p in _BOX)}
FROM (SELECT *, CAST(floor(ano / 10) * 10 AS INT) AS decada FROM base) GROUP BY decada, eh_ti"""))
def age_box_by_period(spark, d):
    # ages are few: every level of the percentile search reads one written table of counts
    n = base(spark, d).groupBy(X.decade("ano").alias("decada"), "eh_ti", "idade").agg(F.count(F.lit(1)).alias("_n"))
    q = Q.exact_percentiles(materialise(n, "idades"), ["decada", "eh_ti"], "idade", _BOX, count_col="_n")
    return q.select("decada", "eh_ti", *[_r(F.col(Q._pname(p))).alias(Q._pname(p)) for p in _BOX])


@register("age_hist", "A32", _sql("""
SELECT eh_ti, LEAST(CAST(floor((idade - mn) * 20.0 / (mx - mn)) AS INT) + 1, 20) AS bin, COUNT(*) AS n
FROM base, (SELECT MIN(idade) AS mn, MAX(idade) AS mx FROM base) r GROUP BY 1, 2"""))
def age_hist(spark, d):
    df = base(spark, d)
    rng = df.agg(F.min("idade").alias("mn"), F.max("idade").alias("mx"))   # one row
    j = df.join(F.broadcast(rng), how="inner")
    b = F.least(F.floor((F.col("idade") - F.col("mn")) * 20.0 / (F.col("mx") - F.col("mn")))
                .cast("int") + 1, F.lit(20))
    return j.groupBy("eh_ti", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@register("it_headcount", "A34", _sql("SELECT ano, COUNT(*) AS n_ti FROM base WHERE eh_ti GROUP BY ano"))
def it_headcount(spark, d):
    return FL.segment(base(spark, d), True).groupBy("ano").agg(F.count(F.lit(1)).alias("n_ti"))


_NUMS = ("idade", "anos_estudo", "horas_trabalhadas_semana", "rendimento_trabalho_principal")
_DQ = [0.25, 0.5, 0.75]


@register("describe_numeric", "A30", with_views("micro") + " UNION ALL ".join(f"""
SELECT '{c}' AS variavel, COUNT({c}) AS n, ROUND(AVG({c}), 4) AS media,
       ROUND(STDDEV_SAMP({c}), 4) AS desvio, ROUND(CAST(MIN({c}) AS DOUBLE), 4) AS minimo,
       {', '.join(f'ROUND(quantile_cont({c}, {p}), 4) AS {S.pname(p)}' for p in _DQ)},
       ROUND(CAST(MAX({c}) AS DOUBLE), 4) AS maximo FROM micro""" for c in _NUMS))
def describe_numeric(spark, d):
    m = micro(spark, d).select(*[F.col(c).cast("double").alias(c) for c in _NUMS])
    long = m.unpivot([], list(_NUMS), "variavel", "valor")
    mom = long.groupBy("variavel").agg(
        F.count("valor").alias("n"), _r(F.avg("valor")).alias("media"),
        _r(F.stddev_samp("valor")).alias("desvio"), _r(F.min("valor")).alias("minimo"),
        _r(F.max("valor")).alias("maximo"))
    qs = Q.exact_percentiles(long, ["variavel"], "valor", _DQ)
    qs = qs.select("variavel", *[_r(F.col(Q._pname(p))).alias(Q._pname(p)) for p in _DQ])
    return mom.join(qs, "variavel")
