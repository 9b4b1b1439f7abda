"""Hire/dismissal feed reports over the `mov` view, and cross-dataset summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlens import params as P
from laborlens.functions import scalars as X
from laborlens.operators import aggregates as A
from laborlens.operators import filters as FL
from laborlens.plans.registry import register
from laborlens.plans.views import mov, with_views, TEST_IT_CODES
from laborlens.plans import registry_plans as RG
from laborlens.plans import survey as SV

_IT_REG = ", ".join(f"'{c}'" for c in P.IT_CODES_REGISTRY)


def feed(spark, d) -> DataFrame:
    """Processed feed: year from period (X17), family + IT flag (X2, X8 with the
    registry list), decimal-comma salary (X15), hire / exit flags (X25), F1."""
    m = mov(spark, d)
    m = m.withColumns({
        "ano": X.period_year("competencia"),
        "mes": X.period_month("competencia"),
        "cbo_familia": X.cbo_family("cbo_ocupacao"),
        "salario_num": X.decimal_comma("salario"),
        "eh_admissao": X.is_hire("tipomovimentacao"),
        "eh_demissao": X.is_exit("tipomovimentacao"),
    })
    m = m.withColumn("eh_ti", X.is_it("cbo_familia", P.IT_CODES_REGISTRY))
    return FL.age_between(m, "idade", P.AGE_MIN_DEFAULT, P.AGE_MAX_DEFAULT)


FEED_SQL = f"""
feed AS (
  SELECT *, COALESCE(cbo_familia IN ({_IT_REG}), false) AS eh_ti FROM (
    SELECT *, TRY_CAST(substr(competencia, 1, 4) AS INT) AS ano,
           TRY_CAST(substr(competencia, 5, 2) AS INT) AS mes,
           NULLIF(lpad(NULLIF(regexp_replace(regexp_replace(trim(cbo_ocupacao), '\\.0+$', ''),
                  '[^0-9]', '', 'g'), ''), 4, '0'), '0000') AS cbo_familia,
           TRY_CAST(replace(trim(salario), ',', '.') AS DOUBLE) AS salario_num,
           COALESCE(tipomovimentacao IN (10), false) AS eh_admissao,
           COALESCE(tipomovimentacao IN (20, 31, 32, 40), false) AS eh_demissao
    FROM mov) WHERE idade BETWEEN 14 AND 80)"""


def _sql(body: str, extra: str = "") -> str:
    return with_views("mov", extra=FEED_SQL + ("," + extra if extra else "")) + body


_BAND_SQL = "CASE " + " ".join(f"WHEN idade BETWEEN {lo} AND {hi} THEN '{lb}'"
                               for lb, lo, hi in P.AGE_BANDS_REGISTRY) + " ELSE 'Outros' END"


@register("moves_by_band", "X15 X17 X18 X25 A23", _sql(f"""
SELECT eh_ti, {_BAND_SQL} AS faixa_etaria,
       COUNT(CASE WHEN eh_admissao THEN 1 END) AS admissoes,
       COUNT(CASE WHEN eh_demissao THEN 1 END) AS demissoes,
       CAST(SUM(saldo_movimentacao) AS BIGINT) AS saldo,
       ROUND(AVG(CASE WHEN eh_admissao THEN salario_num END), 4) AS salario_medio_admissao
FROM feed GROUP BY 1, 2"""))
def moves_by_band(spark, d):
    f = feed(spark, d).withColumn("faixa_etaria", X.age_band("idade", P.AGE_BANDS_REGISTRY))
    return f.groupBy("eh_ti", "faixa_etaria").agg(
        A.count_if(F.col("eh_admissao")).alias("admissoes"),
        A.count_if(F.col("eh_demissao")).alias("demissoes"),
        F.sum("saldo_movimentacao").cast("long").alias("saldo"),
        F.round(F.avg(F.when(F.col("eh_admissao"), F.col("salario_num"))), 4)
        .alias("salario_medio_admissao"))


@register("moves_by_year", "A26", _sql("""
SELECT ano, COUNT(CASE WHEN eh_ti THEN 1 END) AS ti, COUNT(CASE WHEN NOT eh_ti THEN 1 END) AS nao_ti,
       COUNT(*) AS total FROM feed GROUP BY ano"""))
def moves_by_year(spark, d):
    p = feed(spark, d).groupBy("ano").pivot("eh_ti", [True, False]).count()
    p = p.withColumnsRenamed({"true": "ti", "false": "nao_ti"}).fillna(0, ["ti", "nao_ti"])
    return p.select("ano", F.col("ti").cast("long").alias("ti"),
                    F.col("nao_ti").cast("long").alias("nao_ti"),
                    (F.col("ti") + F.col("nao_ti")).cast("long").alias("total"))


@register("moves_by_month", "X17 X25", _sql("""
SELECT ano, mes, COUNT(CASE WHEN eh_admissao THEN 1 END) AS admissoes,
       COUNT(CASE WHEN eh_demissao THEN 1 END) AS demissoes, CAST(SUM(saldo_movimentacao) AS BIGINT) AS saldo
FROM feed WHERE eh_ti GROUP BY ano, mes"""))
def moves_by_month(spark, d):
    f = FL.segment(feed(spark, d), True)
    return f.groupBy("ano", "mes").agg(
        A.count_if(F.col("eh_admissao")).alias("admissoes"),
        A.count_if(F.col("eh_demissao")).alias("demissoes"),
        F.sum("saldo_movimentacao").cast("long").alias("saldo"))


# Quality rules (test parameters; the feed config declares 0-100 for salary in its own unit).
SALARY_RANGE = (0.0, 1000.0)


@register("quality_filter", "F10 X15", _sql(f"""
SELECT ano, COUNT(*) AS n_antes,
       COUNT(CASE WHEN salario_num BETWEEN {SALARY_RANGE[0]} AND {SALARY_RANGE[1]}
                   AND cbo_familia IS NOT NULL AND COALESCE(indicador_aprendiz <> '1', true)
                   AND tipomovimentacao IN (10, 20, 31, 32, 40) AND idade BETWEEN 18 AND 100
                  THEN 1 END) AS n_depois
FROM feed GROUP BY ano"""))
def quality_filter(spark, d):
    f = feed(spark, d)
    keep = FL.all_of(FL.quality_predicates("salario_num", SALARY_RANGE, "cbo_familia",
                                           "indicador_aprendiz", "tipomovimentacao", "idade",
                                           (18, 100)))
    return f.groupBy("ano").agg(F.count(F.lit(1)).alias("n_antes"),
                                A.count_if(keep).alias("n_depois"))


@register("it_distribution", "A26", _sql("""
SELECT eh_ti, COUNT(*) AS n, ROUND(100.0 * COUNT(*) / SUM(COUNT(*)) OVER (), 4) AS pct
FROM feed GROUP BY eh_ti"""))
def it_distribution(spark, d):
    g = feed(spark, d).groupBy("eh_ti").agg(F.count(F.lit(1)).alias("n"))
    return g.select("eh_ti", "n", F.round(100.0 * A.share_of_total("n"), 4).alias("pct"))


# ---------------------------------------------------------------------------
# cross-dataset summary (tagged union, partial + final aggregation)
# ---------------------------------------------------------------------------

def _tagged(spark, d) -> DataFrame:
    cols = ["base", "ano", "idade", "eh_ti"]
    s = SV.survey(spark, d).select(F.lit("pnad").alias("base"), "ano",
                                   F.col("idade").cast("double").alias("idade"), "eh_ti")
    r = RG.registry(spark, d).select(F.lit("rais").alias("base"), "ano", "idade", "eh_ti")
    c = feed(spark, d).select(F.lit("caged").alias("base"), "ano",
                              F.col("idade").cast("double").alias("idade"), "eh_ti")
    return s.select(*cols).unionByName(r.select(*cols)).unionByName(c.select(*cols),
                                                                       allowMissingColumns=True)


@register("dataset_summary", "A25 U1", with_views("micro", "vinculos", "mov", extra=FEED_SQL + "," + RG.REGISTRY_SQL) + """
SELECT base, COUNT(*) AS n, COUNT(CASE WHEN eh_ti THEN 1 END) AS n_ti,
       COUNT(CASE WHEN NOT eh_ti THEN 1 END) AS n_outros, ROUND(AVG(idade), 4) AS idade_media,
       COUNT(DISTINCT ano) AS n_anos, MIN(ano) AS ano_min, MAX(ano) AS ano_max,
       string_agg(DISTINCT CAST(ano AS STRING), ',' ORDER BY CAST(ano AS STRING)) AS anos
FROM (SELECT 'pnad' AS base, ano, CAST(idade AS DOUBLE) AS idade, eh_ti FROM micro WHERE idade BETWEEN 14 AND 80
      UNION ALL SELECT 'rais', ano, idade, eh_ti FROM registry
      UNION ALL SELECT 'caged', ano, CAST(idade AS DOUBLE), eh_ti FROM feed)
GROUP BY base""")
def dataset_summary(spark, d):
    t = _tagged(spark, d)
    return t.groupBy("base").agg(
        F.count(F.lit(1)).alias("n"), A.count_if(F.col("eh_ti")).alias("n_ti"),
        A.count_if(~F.col("eh_ti")).alias("n_outros"), F.round(F.avg("idade"), 4).alias("idade_media"),
        F.countDistinct("ano").alias("n_anos"), F.min("ano").alias("ano_min"),
        F.max("ano").alias("ano_max"),
        F.concat_ws(",", F.array_sort(F.collect_set(F.col("ano").cast("string")))).alias("anos"))


__all__ = ["feed", "FEED_SQL", "TEST_IT_CODES"]
