"""Household-survey reports over the `micro` view (weighted shares, means,
quantiles, comparative tables by year, state, age, schooling and sex)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from laborlens import params as P
from laborlens.functions import scalars as X
from laborlens.operators import aggregates as A
from laborlens.operators import filters as FL
from laborlens.operators import quantiles as Q
from laborlens.operators import windows as W
from laborlens.operators.joins import dimension, int_range
from laborlens.plans import sqlbits as S
from laborlens.plans.registry import register
from laborlens.plans.views import micro

WGT = "peso_populacional"
# Multi-branch reports materialise their narrow pre-aggregate once (checkpoint
# to the shared folder) so the fact-table join is computed exactly once.
CHECKPOINT_PRE = True
INC = "rendimento_trabalho_principal"


def _it():
    return F.col("eh_ti")


def _nit():
    return ~F.col("eh_ti")

r4 = X.r


def survey(spark: SparkSession, d: str) -> DataFrame:
    """Processed survey = microdata after the age filter (F1, 14-80)."""
    return FL.age_between(micro(spark, d), "idade", P.AGE_MIN_DEFAULT, P.AGE_MAX_DEFAULT)


def occ(spark: SparkSession, d: str) -> DataFrame:
    """Employed (F3) records of the processed survey."""
    return FL.employed_or_income(survey(spark, d))


def _r(c, places=4):
    return F.round(c.cast("double"), places)


# ---------------------------------------------------------------------------
# flagship: yearly weighted IT share
# ---------------------------------------------------------------------------

@register("it_share_by_year", "X2 X8 F1 F3 A2 A17", S.survey_sql(f"""
SELECT ano, COUNT(*) AS n_obs, COUNT(CASE WHEN eh_ti THEN 1 END) AS n_ti,
       {S.r(S.wsum())} AS peso_total, {S.r(S.wsum(cond='eh_ti'))} AS peso_ti,
       {S.r('100.0 * ' + S.wshare('eh_ti'))} AS pct_ti_ponderado,
       {S.r('100.0 * AVG(CAST(eh_ti AS INT))')} AS pct_ti_simples
FROM occ GROUP BY ano"""))
def it_share_by_year(spark, d):
    return occ(spark, d).groupBy("ano").agg(
        F.count(F.lit(1)).alias("n_obs"),
        A.count_if(_it()).alias("n_ti"),
        _r(A.wsum(WGT)).alias("peso_total"),
        _r(A.wsum(WGT, _it())).alias("peso_ti"),
        _r(100.0 * A.wshare("eh_ti", WGT)).alias("pct_ti_ponderado"),
        _r(100.0 * A.share("eh_ti")).alias("pct_ti_simples"),
    )


@register("it_mean_age_by_year", "F6 F9 A1 A3 A18", S.survey_sql(f"""
SELECT ano, {S.r(S.wmean('idade', cond='eh_ti'))} AS idade_media_ti,
       {S.r(S.wmean('idade', cond='NOT eh_ti'))} AS idade_media_nao_ti,
       COUNT(CASE WHEN eh_ti THEN 1 END) AS n_ti
FROM occ WHERE idade IS NOT NULL AND peso_populacional IS NOT NULL GROUP BY ano"""))
def it_mean_age_by_year(spark, d):
    df = FL.required(occ(spark, d), "idade", WGT)
    return df.groupBy("ano").agg(
        _r(A.wmean("idade", WGT, _it())).alias("idade_media_ti"),
        _r(A.wmean("idade", WGT, _nit())).alias("idade_media_nao_ti"),
        A.count_if(_it()).alias("n_ti"),
    )


@register("it_quarter_series", "F4 A13 A19 T2", S.survey_sql(f"""
SELECT ano, trimestre, COUNT(*) AS n_registros,
       COUNT(CASE WHEN ocupado = 1 THEN 1 END) AS n_ocupados,
       COUNT(CASE WHEN ocupado = 1 AND eh_ti THEN 1 END) AS ti_count_ocupados,
       {S.r('AVG(CASE WHEN ocupado = 1 THEN CAST(eh_ti AS INT) END)', 6)} AS ti_prop_ocupados_simple,
       {S.r(S.wshare('eh_ti', cond='ocupado = 1'), 6)} AS ti_prop_ocupados_weighted
FROM survey GROUP BY ano, trimestre ORDER BY ano, trimestre"""))
def it_quarter_series(spark, d):
    df = survey(spark, d)
    o = F.col("ocupado") == 1
    return (df.groupBy("ano", "trimestre").agg(
        F.count(F.lit(1)).alias("n_registros"),
        A.count_if(o).alias("n_ocupados"),
        A.count_if(o & _it()).alias("ti_count_ocupados"),
        _r(A.share("eh_ti", o), 6).alias("ti_prop_ocupados_simple"),
        _r(A.wshare("eh_ti", WGT, o), 6).alias("ti_prop_ocupados_weighted"),
    ).orderBy("ano", "trimestre"))


@register("employed_summary", "F4 A13", S.survey_sql(f"""
SELECT COUNT(*) AS ocupados_total, COUNT(CASE WHEN eh_ti THEN 1 END) AS ocupados_ti,
       {S.r('AVG(CAST(eh_ti AS INT))', 6)} AS prop_ti_ocup_simples,
       {S.r(S.wshare('eh_ti'), 6)} AS prop_ti_ocup_ponderada
FROM survey WHERE ocupado = 1"""))
def employed_summary(spark, d):
    s = A.employed_summary(survey(spark, d), WGT)
    return s.select("ocupados_total", "ocupados_ti",
                    _r(F.col("prop_ti_ocup_simples"), 6).alias("prop_ti_ocup_simples"),
                    _r(F.col("prop_ti_ocup_ponderada"), 6).alias("prop_ti_ocup_ponderada"))


# ---------------------------------------------------------------------------
# comparative tables
# ---------------------------------------------------------------------------

def _segment_label() -> "F.Column":
    return F.when(_it(), "ti").otherwise("nao_ti")


_GEN_SQL_STATS = {
    "pop_ponderada": S.wsum(),
    "pop_masculino": S.wsum(cond="sexo = 1"),
    "pop_feminino": S.wsum(cond="sexo = 2"),
    "media_idade": S.wmean("idade"),
    "media_anos_estudo": S.wmean("anos_estudo"),
    "media_rendimento": S.wmean(INC),
}


def _gen_sql() -> str:
    sel = ", ".join(f"CAST({e} AS DOUBLE) AS {k}" for k, e in _GEN_SQL_STATS.items())
    unp = ", ".join(_GEN_SQL_STATS)
    return S.survey_sql(f"""
SELECT estatistica,
       {S.r("MAX(CASE WHEN seg = 'ti' THEN valor END)")} AS ti,
       {S.r("MAX(CASE WHEN seg = 'nao_ti' THEN valor END)")} AS nao_ti,
       {S.r("MAX(CASE WHEN seg = 'total' THEN valor END)")} AS total,
       {S.r(S.ratio("MAX(CASE WHEN seg = 'ti' THEN valor END)", "MAX(CASE WHEN seg = 'nao_ti' THEN valor END)"), 6)} AS razao_ti_nao_ti,
       {S.r("MAX(CASE WHEN seg = 'ti' THEN valor END) - MAX(CASE WHEN seg = 'nao_ti' THEN valor END)")} AS diferenca
FROM (
  SELECT seg, estatistica, valor FROM (
    SELECT CASE WHEN eh_ti THEN 'ti' ELSE 'nao_ti' END AS seg, {sel} FROM occ GROUP BY 1
    UNION ALL SELECT 'total' AS seg, {sel} FROM occ
  ) UNPIVOT (valor FOR estatistica IN ({unp}))
  UNION ALL
  SELECT CASE WHEN eh_ti THEN 'ti' ELSE 'nao_ti' END, 'mediana_rendimento', p0_5 FROM (
    SELECT {S.interp_percentiles(['eh_ti'], [0.5])} FROM rt GROUP BY eh_ti)
  UNION ALL
  SELECT 'total', 'mediana_rendimento', p0_5 FROM (
    SELECT {S.interp_percentiles([], [0.5])} FROM rt2)
) GROUP BY estatistica""", extra=S.running_table("occ", ["eh_ti"], INC) + ","
        + S.running_table("occ", [], INC).replace("vt AS", "vt2 AS").replace("rt AS", "rt2 AS")
        .replace("FROM vt)", "FROM vt2)"))


def _gen_stats(df: DataFrame) -> list:
    return [
        A.wsum(WGT).alias("pop_ponderada"),
        A.wsum(WGT, F.col("sexo") == 1).alias("pop_masculino"),
        A.wsum(WGT, F.col("sexo") == 2).alias("pop_feminino"),
        A.wmean("idade", WGT).alias("media_idade"),
        A.wmean("anos_estudo", WGT).alias("media_anos_estudo"),
        A.wmean(INC, WGT).alias("media_rendimento"),
    ]


@register("general_comparative", "F3 A4 A7", _gen_sql())
def general_comparative(spark, d):
    """One scan: rows are pre-aggregated per (segment, income value) carrying
    every partial sum; segment/total statistics and the weighted medians are
    all derived from that table (its exchange is reused by each branch)."""
    df = occ(spark, d)
    w, ok = F.col(WGT), A.w_ok(WGT)
    pre = df.groupBy("eh_ti", INC).agg(
        F.sum(w).alias("pop_ponderada"),
        F.sum(F.when(F.col("sexo") == 1, w)).alias("pop_masculino"),
        F.sum(F.when(F.col("sexo") == 2, w)).alias("pop_feminino"),
        F.sum(F.when(ok & F.col("idade").isNotNull(), F.col("idade") * w)).alias("_ia"),
        F.sum(F.when(ok & F.col("idade").isNotNull(), w)).alias("_iw"),
        F.sum(F.when(ok & F.col("anos_estudo").isNotNull(), F.col("anos_estudo") * w)).alias("_ea"),
        F.sum(F.when(ok & F.col("anos_estudo").isNotNull(), w)).alias("_ew"),
        F.sum(F.when(ok, w)).alias("sw"), F.min(F.when(ok, w)).alias("mw"))
    if CHECKPOINT_PRE:
        pre = pre.checkpoint()          # narrow table read by every branch below
    inc_known = F.col(INC).isNotNull()
    stats = ["pop_ponderada", "pop_masculino", "pop_feminino", "media_idade",
             "media_anos_estudo", "media_rendimento"]
    by_seg = (pre.rollup("eh_ti").agg(
                F.coalesce(F.sum("pop_ponderada"), F.lit(0.0)).alias("pop_ponderada"),
                F.coalesce(F.sum("pop_masculino"), F.lit(0.0)).alias("pop_masculino"),
                F.coalesce(F.sum("pop_feminino"), F.lit(0.0)).alias("pop_feminino"),
                F.try_divide(F.sum("_ia"), F.sum("_iw")).alias("media_idade"),
                F.try_divide(F.sum("_ea"), F.sum("_ew")).alias("media_anos_estudo"),
                F.try_divide(F.sum(F.when(inc_known, F.col(INC) * F.col("sw"))),
                             F.sum(F.when(inc_known, F.col("sw")))).alias("media_rendimento"),
                F.grouping("eh_ti").alias("_g"))
              .withColumn("seg", F.when(F.col("_g") == 1, "total").when(_it(), "ti").otherwise("nao_ti"))
              .select("seg", *[F.col(c).cast("double").alias(c) for c in stats]))
    long = by_seg.unpivot(["seg"], stats, "estatistica", "valor")
    vt = pre.filter(inc_known & F.col("sw").isNotNull()).select("eh_ti", INC, "sw", "mw")
    # per-segment and total medians in one pass: the total is a third segment
    seg_vt = vt.select(_segment_label().alias("seg"), INC, "sw", "mw")
    tot_vt = Q.regroup_values(vt, [], INC).select(F.lit("total").alias("seg"), INC, "sw", "mw")
    med = (Q.percentiles_from_values(seg_vt.unionByName(tot_vt), ["seg"], INC, [0.5])
           .select("seg", F.lit("mediana_rendimento").alias("estatistica"), F.col("p0_5").alias("valor")))
    allv = long.unionByName(med)
    ti = F.max(F.when(F.col("seg") == "ti", F.col("valor")))
    nti = F.max(F.when(F.col("seg") == "nao_ti", F.col("valor")))
    tot = F.max(F.when(F.col("seg") == "total", F.col("valor")))
    return allv.groupBy("estatistica").agg(
        _r(ti).alias("ti"), _r(nti).alias("nao_ti"), _r(tot).alias("total"),
        _r(A.ratio(ti, nti), 6).alias("razao_ti_nao_ti"), _r(ti - nti).alias("diferenca"))


@register("yearly_comparative", "F3 A8", S.survey_sql(f"""
SELECT ano, {S.r(S.wsum(cond='eh_ti'))} AS total_ti, {S.r(S.wsum(cond='NOT eh_ti'))} AS total_nao_ti,
       {S.r(S.pct(S.wsum(cond='eh_ti'), S.wsum()))} AS pct_ti,
       {S.r(S.wmean('idade', cond='eh_ti'))} AS idade_ti, {S.r(S.wmean('idade', cond='NOT eh_ti'))} AS idade_nao_ti,
       {S.r(S.wmean('anos_estudo', cond='eh_ti'))} AS estudo_ti,
       {S.r(S.wmean('anos_estudo', cond='NOT eh_ti'))} AS estudo_nao_ti,
       {S.r(S.wmean(INC, cond='eh_ti'))} AS renda_ti, {S.r(S.wmean(INC, cond='NOT eh_ti'))} AS renda_nao_ti,
       {S.r(S.ratio(S.wmean(INC, cond='eh_ti'), S.wmean(INC, cond='NOT eh_ti')), 6)} AS razao_renda
FROM occ GROUP BY ano"""))
def yearly_comparative(spark, d):
    df = occ(spark, d)
    t = df.groupBy("ano").agg(
        A.wsum(WGT, _it()).alias("total_ti"), A.wsum(WGT, _nit()).alias("total_nao_ti"),
        A.wmean("idade", WGT, _it()).alias("idade_ti"), A.wmean("idade", WGT, _nit()).alias("idade_nao_ti"),
        A.wmean("anos_estudo", WGT, _it()).alias("estudo_ti"),
        A.wmean("anos_estudo", WGT, _nit()).alias("estudo_nao_ti"),
        A.wmean(INC, WGT, _it()).alias("renda_ti"), A.wmean(INC, WGT, _nit()).alias("renda_nao_ti"))
    return t.select(
        "ano", _r(F.col("total_ti")).alias("total_ti"), _r(F.col("total_nao_ti")).alias("total_nao_ti"),
        _r(A.pct("total_ti", F.col("total_ti") + F.col("total_nao_ti"))).alias("pct_ti"),
        *[_r(F.col(c)).alias(c) for c in ("idade_ti", "idade_nao_ti", "estudo_ti", "estudo_nao_ti",
                                          "renda_ti", "renda_nao_ti")],
        _r(A.ratio("renda_ti", "renda_nao_ti"), 6).alias("razao_renda"))


@register("weighted_summary", "A12", S.survey_sql(f"""
SELECT {S.r(S.wshare('eh_ti'), 6)} AS proporcao_ti_ponderada,
       {S.r(S.wmean('idade', cond='eh_ti'))} AS idade_media_ti_ponderada,
       {S.r(S.wmean('idade', cond='NOT eh_ti'))} AS idade_media_outros_ponderada
FROM survey"""))
def weighted_summary(spark, d):
    s = A.weighted_summary(survey(spark, d), WGT)
    return s.select(_r(F.col("proporcao_ti_ponderada"), 6).alias("proporcao_ti_ponderada"),
                    _r(F.col("idade_media_ti_ponderada")).alias("idade_media_ti_ponderada"),
                    _r(F.col("idade_media_outros_ponderada")).alias("idade_media_outros_ponderada"))


_BAND_SQL = ("CASE " + " ".join(f"WHEN idade BETWEEN {lo} AND {hi} THEN '{lb}'"
                                for lb, lo, hi in P.AGE_BANDS_SURVEY) + " ELSE 'Outros' END")


@register("basic_comparative", "X18 A24 W2", S.survey_sql(f"""
SELECT eh_ti, faixa_etaria, n, {S.r('100.0 * n / SUM(n) OVER (PARTITION BY eh_ti)')} AS pct_segmento,
       {S.r('SUM(s) OVER (PARTITION BY eh_ti) / SUM(n) OVER (PARTITION BY eh_ti)')} AS idade_media_segmento
FROM (SELECT eh_ti, {_BAND_SQL} AS faixa_etaria, COUNT(*) AS n, SUM(idade) AS s
      FROM survey GROUP BY 1, 2)"""))
def basic_comparative(spark, d):
    df = survey(spark, d).withColumn("faixa_etaria", X.age_band("idade", P.AGE_BANDS_SURVEY))
    g = df.groupBy("eh_ti", "faixa_etaria").agg(F.count(F.lit(1)).alias("n"),
                                                 F.sum("idade").alias("s"))
    seg = Window.partitionBy("eh_ti")  # small table: segments x bands
    return g.select("eh_ti", "faixa_etaria", "n",
                    _r(100.0 * A.share_of_total("n", "eh_ti")).alias("pct_segmento"),
                    _r(F.sum("s").over(seg) / F.sum("n").over(seg)).alias("idade_media_segmento"))


# ---------------------------------------------------------------------------
# weighted quantiles / describe
# ---------------------------------------------------------------------------

_QPS = [0.25, 0.5, 0.75, 0.9]
_DPS = [0.25, 0.5, 0.75, 0.9, 0.95]


@register("weighted_quantiles", "A4 W1", S.survey_sql(f"""
SELECT eh_ti, {', '.join(f'ROUND({S.pname(p)}, 4) AS {S.pname(p)}' for p in _QPS)}
FROM (SELECT {S.interp_percentiles(['eh_ti'], _QPS)} FROM rt GROUP BY eh_ti)""",
      extra=S.running_table("occ", ["eh_ti"], INC)))
def weighted_quantiles(spark, d):
    q = Q.weighted_percentiles(occ(spark, d), ["eh_ti"], INC, WGT, _QPS)
    return q.select("eh_ti", *[_r(F.col(Q._pname(p))).alias(Q._pname(p)) for p in _QPS])


@register("income_quantiles_by_year", "A4 W1", S.survey_sql(f"""
SELECT ano, eh_ti, {', '.join(f'ROUND({S.pname(p)}, 4) AS {S.pname(p)}' for p in [0.1, 0.5, 0.9])}
FROM (SELECT {S.interp_percentiles(['ano', 'eh_ti'], [0.1, 0.5, 0.9])} FROM rt GROUP BY ano, eh_ti)""",
      extra=S.running_table("occ", ["ano", "eh_ti"], INC)))
def income_quantiles_by_year(spark, d):
    ps = [0.1, 0.5, 0.9]
    q = Q.weighted_percentiles(occ(spark, d), ["ano", "eh_ti"], INC, WGT, ps)
    return q.select("ano", "eh_ti", *[_r(F.col(Q._pname(p))).alias(Q._pname(p)) for p in ps])


_DESC_VARS = ("idade", "anos_estudo", INC)


def _desc_long(df: DataFrame) -> DataFrame:
    """One row per (eh_ti, variavel, valor, peso) under the strict mask."""
    long = df.select("eh_ti", WGT, *[F.col(c).cast("double").alias(c) for c in _DESC_VARS]) \
             .unpivot(["eh_ti", WGT], list(_DESC_VARS), "variavel", "valor")
    return long.filter(F.col("valor").isNotNull() & A.w_ok(WGT))


def weighted_describe_df(df: DataFrame) -> DataFrame:
    """A5: n, Σw, mean, population std, min, max and step quantiles per
    (variavel, eh_ti).  One scan: the masked long rows are pre-aggregated per
    distinct value; moments, the centred variance and the quantiles all come
    from that table (means are joined back to it, not to the rows)."""
    keys = ["variavel", "eh_ti"]
    vt = _desc_long(df).groupBy(*keys, "valor").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(WGT).alias("sw"), F.min(WGT).alias("mw"))
    if CHECKPOINT_PRE:
        vt = vt.checkpoint()            # narrow table read by every branch below
    base = vt.groupBy(*keys).agg(
        F.sum("_n").alias("n"), F.sum("sw").alias("n_ponderado"),
        (F.sum(F.col("valor") * F.col("sw")) / F.sum("sw")).alias("media"),
        F.min("valor").alias("minimo"), F.max("valor").alias("maximo"))
    var = A.join_null_safe(vt, base.select(*keys, "media"), keys).groupBy(*keys).agg(
        (F.sum(F.col("sw") * (F.col("valor") - F.col("media")) ** 2) / F.sum("sw")).alias("_var"))
    qs = Q.percentiles_from_values(vt.drop("_n"), keys, "valor", _DPS, interpolate=False)
    out = A.join_null_safe(A.join_null_safe(base, var, keys), qs, keys)
    return out.withColumn("desvio", F.sqrt("_var")).drop("_var")


_DESC_COLS = ["n_ponderado", "media", "desvio", "minimo", "maximo"] + [S.pname(p) for p in _DPS]


def _desc_sql_inner() -> str:
    unions = " UNION ALL ".join(
        f"SELECT eh_ti, peso_populacional, '{v}' AS variavel, CAST({v} AS DOUBLE) AS valor FROM occ"
        for v in _DESC_VARS)
    return f"""
lng AS (SELECT * FROM ({unions}) WHERE valor IS NOT NULL AND peso_populacional > 0),
mn AS (SELECT variavel, eh_ti, COUNT(*) AS n, SUM(peso_populacional) AS n_ponderado,
              SUM(valor * peso_populacional) / SUM(peso_populacional) AS media,
              MIN(valor) AS minimo, MAX(valor) AS maximo FROM lng GROUP BY 1, 2),
vr AS (SELECT l.variavel, l.eh_ti,
              SUM(l.peso_populacional * (l.valor - m.media) ^ 2) / SUM(l.peso_populacional) AS var
       FROM lng l JOIN mn m ON l.variavel = m.variavel AND l.eh_ti = m.eh_ti GROUP BY 1, 2),
{S.running_table('lng', ['variavel', 'eh_ti'], 'valor').lstrip()},
qs AS (SELECT {S.step_percentiles(['variavel', 'eh_ti'], _DPS)} FROM rt GROUP BY variavel, eh_ti),
dsc AS (SELECT mn.*, sqrt(vr.var) AS desvio, {', '.join('qs.' + S.pname(p) for p in _DPS)}
        FROM mn JOIN vr USING (variavel, eh_ti) JOIN qs USING (variavel, eh_ti))"""


@register("weighted_describe", "A5 W1", S.survey_sql(
    "SELECT variavel, eh_ti, n, " + ", ".join(f"ROUND({c}, 4) AS {c}" for c in _DESC_COLS)
    + " FROM dsc", extra=_desc_sql_inner()))
def weighted_describe(spark, d):
    t = weighted_describe_df(occ(spark, d))
    return t.select("variavel", "eh_ti", "n", *[_r(F.col(c)).alias(c) for c in _DESC_COLS])


@register("weighted_describe_table", "A5 A6", S.survey_sql(f"""
SELECT variavel, estatistica, ROUND(MAX(CASE WHEN eh_ti THEN valor END), 4) AS ti,
       ROUND(MAX(CASE WHEN NOT eh_ti THEN valor END), 4) AS nao_ti,
       ROUND(MAX(CASE WHEN eh_ti THEN valor END) - MAX(CASE WHEN NOT eh_ti THEN valor END), 4) AS diferenca
FROM (SELECT variavel, eh_ti, CAST(n AS DOUBLE) AS n, {', '.join(_DESC_COLS)} FROM dsc)
     UNPIVOT (valor FOR estatistica IN (n, {', '.join(_DESC_COLS)}))
GROUP BY variavel, estatistica""", extra=_desc_sql_inner()))
def weighted_describe_table(spark, d):
    t = weighted_describe_df(occ(spark, d)).withColumn("n", F.col("n").cast("double"))
    long = t.unpivot(["variavel", "eh_ti"], ["n"] + _DESC_COLS, "estatistica", "valor")
    ti = F.max(F.when(_it(), F.col("valor")))
    nti = F.max(F.when(_nit(), F.col("valor")))
    return long.groupBy("variavel", "estatistica").agg(
        _r(ti).alias("ti"), _r(nti).alias("nao_ti"), _r(ti - nti).alias("diferenca"))


# ---------------------------------------------------------------------------
# states (latest year, state x year)
# ---------------------------------------------------------------------------

_UF_VALUES = ", ".join(f"({k}, '{v}')" for k, v in P.UF_CODE_TO_SIGLA.items())


@register("uf_latest_year", "F8 A9 L1 L9 T2", S.survey_sql(f"""
SELECT dim.uf, dim.sigla, {S.r('COALESCE(a.total_ti, 0.0)')} AS total_ti,
       {S.r('COALESCE(a.total_nao_ti, 0.0)')} AS total_nao_ti,
       {S.r(S.pct('COALESCE(a.total_ti, 0.0)', 'COALESCE(a.total_ti, 0.0) + COALESCE(a.total_nao_ti, 0.0)'))} AS pct_ti,
       {S.r('a.renda_ti')} AS renda_ti, {S.r('a.renda_nao_ti')} AS renda_nao_ti
FROM (VALUES {_UF_VALUES}) dim(uf, sigla)
LEFT JOIN (SELECT uf, {S.wsum(cond='eh_ti')} AS total_ti, {S.wsum(cond='NOT eh_ti')} AS total_nao_ti,
                  {S.wmean(INC, cond='eh_ti')} AS renda_ti, {S.wmean(INC, cond='NOT eh_ti')} AS renda_nao_ti
           FROM occ WHERE ano = (SELECT MAX(ano) FROM occ) GROUP BY uf) a ON dim.uf = a.uf
ORDER BY pct_ti DESC, dim.uf"""))
def uf_latest_year(spark, d):
    agg = occ(spark, d).groupBy("ano", "uf").agg(
        A.wsum(WGT, _it()).alias("total_ti"), A.wsum(WGT, _nit()).alias("total_nao_ti"),
        A.wmean(INC, WGT, _it()).alias("renda_ti"), A.wmean(INC, WGT, _nit()).alias("renda_nao_ti"))
    agg = FL.keep_latest(agg, "ano").drop("ano")
    states = dimension(spark, P.UF_CODE_TO_SIGLA, "uf", "sigla")
    j = F.broadcast(states).join(agg, "uf", "left").fillna(0.0, ["total_ti", "total_nao_ti"])
    return j.select(
        "uf", "sigla", _r(F.col("total_ti")).alias("total_ti"),
        _r(F.col("total_nao_ti")).alias("total_nao_ti"),
        _r(A.pct("total_ti", F.col("total_ti") + F.col("total_nao_ti"))).alias("pct_ti"),
        _r(F.col("renda_ti")).alias("renda_ti"), _r(F.col("renda_nao_ti")).alias("renda_nao_ti"),
    ).orderBy(F.desc("pct_ti"), "uf")


@register("uf_year_share", "A16 L1", S.survey_sql(f"""
SELECT ano, uf, s.sigla, {S.r('ti_total')} AS ti_total, {S.r('ocupados_total')} AS ocupados_total,
       {S.r('100.0 * ' + S.ratio('ti_total', 'ocupados_total'))} AS pct_ti
FROM (SELECT ano, uf, {S.wsum(cond='eh_ti')} AS ti_total,
             {S.wsum(cond='ocupado = 1 OR rendimento_trabalho_principal > 0')} AS ocupados_total
      FROM survey GROUP BY ano, uf) t
LEFT JOIN (VALUES {_UF_VALUES}) s(uf_code, sigla) ON t.uf = s.uf_code"""))
def uf_year_share(spark, d):
    df = survey(spark, d)
    employed = (F.col("ocupado") == 1) | F.coalesce(F.col(INC) > 0, F.lit(False))
    g = df.groupBy("ano", "uf").agg(A.wsum(WGT, _it()).alias("ti_total"),
                                    A.wsum(WGT, employed).alias("ocupados_total"))
    g = g.withColumn("sigla", X.map_literal(P.UF_CODE_TO_SIGLA)[F.col("uf")])
    return g.select("ano", "uf", "sigla", _r(F.col("ti_total")).alias("ti_total"),
                    _r(F.col("ocupados_total")).alias("ocupados_total"),
                    _r(100.0 * A.ratio("ti_total", "ocupados_total")).alias("pct_ti"))   # null, not 0, when no employed weight


# ---------------------------------------------------------------------------
# age and education distributions (latest year)
# ---------------------------------------------------------------------------

_EDGES, _LABELS = P.AGE_CUTS_DISTRIBUTION
_CUT_SQL = "CASE " + " ".join(
    f"WHEN idade > {lo} AND idade <= {hi} THEN '{lb}'"
    for lo, hi, lb in zip(_EDGES[:-1], _EDGES[1:], _LABELS)) + " END"
_LABEL_VALUES = ", ".join(f"('{lb}', {i})" for i, lb in enumerate(_LABELS))


def _dist_measures():
    return [A.wsum(WGT, _it()).alias("pop_ti"), A.wsum(WGT, _nit()).alias("pop_nao_ti"),
            A.wmean(INC, WGT, _it()).alias("renda_ti"), A.wmean(INC, WGT, _nit()).alias("renda_nao_ti")]


def _dist_select(g: DataFrame, keys: list[str]) -> DataFrame:
    every = Window.partitionBy(F.lit(0))  # bounded: one row per category
    return g.select(
        *keys, _r(F.col("pop_ti")).alias("pop_ti"), _r(F.col("pop_nao_ti")).alias("pop_nao_ti"),
        _r(A.pct("pop_ti", F.sum("pop_ti").over(every))).alias("perc_ti"),
        _r(A.pct("pop_nao_ti", F.sum("pop_nao_ti").over(every))).alias("perc_nao_ti"),
        _r(F.col("renda_ti")).alias("renda_ti"), _r(F.col("renda_nao_ti")).alias("renda_nao_ti"),
        _r(A.ratio("renda_ti", "renda_nao_ti"), 6).alias("razao_renda"))


_DIST_SQL_SELECT = f"""
       {S.r('pop_ti')} AS pop_ti, {S.r('pop_nao_ti')} AS pop_nao_ti,
       {S.r(S.pct('pop_ti', 'SUM(pop_ti) OVER ()'))} AS perc_ti,
       {S.r(S.pct('pop_nao_ti', 'SUM(pop_nao_ti) OVER ()'))} AS perc_nao_ti,
       {S.r('renda_ti')} AS renda_ti, {S.r('renda_nao_ti')} AS renda_nao_ti,
       {S.r(S.ratio('renda_ti', 'renda_nao_ti'), 6)} AS razao_renda"""
_DIST_SQL_MEASURES = (f"{S.wsum(cond='eh_ti')} AS pop_ti, {S.wsum(cond='NOT eh_ti')} AS pop_nao_ti, "
                      f"{S.wmean(INC, cond='eh_ti')} AS renda_ti, "
                      f"{S.wmean(INC, cond='NOT eh_ti')} AS renda_nao_ti")


@register("age_band_distribution", "F8 X19 A10 L8 W2", S.survey_sql(f"""
SELECT faixa_idade, ordem, {_DIST_SQL_SELECT}
FROM (SELECT b.faixa_idade, b.ordem, COALESCE(a.pop_ti, 0.0) AS pop_ti,
             COALESCE(a.pop_nao_ti, 0.0) AS pop_nao_ti, a.renda_ti, a.renda_nao_ti
      FROM (VALUES {_LABEL_VALUES}) b(faixa_idade, ordem)
      LEFT JOIN (SELECT {_CUT_SQL} AS faixa_idade, {_DIST_SQL_MEASURES}
                 FROM occ WHERE ano = (SELECT MAX(ano) FROM occ) GROUP BY 1) a
        ON a.faixa_idade = b.faixa_idade)"""))
def age_band_distribution(spark, d):
    banded = occ(spark, d).withColumn("faixa_idade", X.age_cut("idade", _EDGES, _LABELS))
    g = banded.filter(F.col("faixa_idade").isNotNull()).groupBy("ano", "faixa_idade").agg(*_dist_measures())
    g = FL.keep_latest(g, "ano").drop("ano")
    bands = spark.createDataFrame([(lb, i) for i, lb in enumerate(_LABELS)], "faixa_idade string, ordem int")
    full = F.broadcast(bands).join(g, "faixa_idade", "left").fillna(0.0, ["pop_ti", "pop_nao_ti"])
    return _dist_select(full, ["faixa_idade", "ordem"])


def _education_dim(spark):
    rows = [("ate2015", k, v) for k, v in P.EDUCATION_UP_TO_2015.items()] + \
           [("pos2015", k, v) for k, v in P.EDUCATION_AFTER_2015.items()]
    return spark.createDataFrame(rows, "era string, codigo int, nivel string")


def _edu_values_sql():
    rows = [f"('ate2015', {k}, '{v}')" for k, v in P.EDUCATION_UP_TO_2015.items()] + \
           [f"('pos2015', {k}, '{v}')" for k, v in P.EDUCATION_AFTER_2015.items()]
    return ", ".join(rows)


@register("education_distribution", "F8 L1 L8 A11 W2", S.survey_sql(f"""
SELECT era, codigo, nivel,
       {S.r('pop_ti')} AS pop_ti, {S.r('pop_nao_ti')} AS pop_nao_ti,
       {S.r(S.pct('pop_ti', 'tot_ti'))} AS perc_ti, {S.r(S.pct('pop_nao_ti', 'tot_nao_ti'))} AS perc_nao_ti,
       {S.r('renda_ti')} AS renda_ti, {S.r('renda_nao_ti')} AS renda_nao_ti,
       {S.r(S.ratio('renda_ti', 'renda_nao_ti'), 6)} AS razao_renda
FROM (SELECT d.era, d.codigo, d.nivel, COALESCE(a.pop_ti, 0.0) AS pop_ti,
             COALESCE(a.pop_nao_ti, 0.0) AS pop_nao_ti, a.renda_ti, a.renda_nao_ti,
             t.tot_ti, t.tot_nao_ti
      FROM (VALUES {_edu_values_sql()}) d(era, codigo, nivel)
      JOIN (SELECT CASE WHEN MAX(ano) <= 2015 THEN 'ate2015' ELSE 'pos2015' END AS era,
                   {S.wsum(cond='eh_ti')} AS tot_ti, {S.wsum(cond='NOT eh_ti')} AS tot_nao_ti
            FROM lat) t ON d.era = t.era
      LEFT JOIN (SELECT CASE WHEN ano <= 2015 THEN curso_mais_elevado_antes_2015 ELSE curso_mais_elevado END
                          AS codigo, {_DIST_SQL_MEASURES} FROM lat GROUP BY 1) a ON a.codigo = d.codigo)""",
    extra="lat AS (SELECT * FROM occ WHERE ano = (SELECT MAX(ano) FROM occ))"))
def education_distribution(spark, d):
    era = F.when(F.col("ano") <= P.EDUCATION_ERA_SPLIT_YEAR, "ate2015").otherwise("pos2015")
    code = F.when(F.col("ano") <= P.EDUCATION_ERA_SPLIT_YEAR,
                  F.col("curso_mais_elevado_antes_2015")).otherwise(F.col("curso_mais_elevado"))
    lat = occ(spark, d).withColumn("era", era).withColumn("codigo", code)
    g = lat.groupBy("ano", "era", "codigo").agg(*_dist_measures())
    per_year = Window.partitionBy("ano")                 # small: codes of one year
    g = g.withColumns({"tot_ti": F.sum("pop_ti").over(per_year),
                       "tot_nao_ti": F.sum("pop_nao_ti").over(per_year)})
    g = FL.keep_latest(g, "ano")
    totals = g.select("era", "tot_ti", "tot_nao_ti").distinct()
    g = g.drop("ano", "era", "tot_ti", "tot_nao_ti")
    grid = F.broadcast(_education_dim(spark)).join(totals, "era")   # codes of the latest era
    full = grid.join(g, "codigo", "left").fillna(0.0, ["pop_ti", "pop_nao_ti"])
    return full.select(
        "era", "codigo", "nivel", _r(F.col("pop_ti")).alias("pop_ti"),
        _r(F.col("pop_nao_ti")).alias("pop_nao_ti"),
        _r(A.pct("pop_ti", "tot_ti")).alias("perc_ti"),
        _r(A.pct("pop_nao_ti", "tot_nao_ti")).alias("perc_nao_ti"),
        _r(F.col("renda_ti")).alias("renda_ti"), _r(F.col("renda_nao_ti")).alias("renda_nao_ti"),
        _r(A.ratio("renda_ti", "renda_nao_ti"), 6).alias("razao_renda"))


# ---------------------------------------------------------------------------
# income by schooling / age (per year and segment), smoothing, long form
# ---------------------------------------------------------------------------

@register("income_by_schooling", "F7 A14", S.survey_sql(f"""
SELECT ano, eh_ti, anos_estudo, {S.r(S.wsum())} AS populacao, {S.r(S.wmean(INC))} AS renda_media
FROM occ WHERE anos_estudo >= 1 GROUP BY ano, eh_ti, anos_estudo"""))
def income_by_schooling(spark, d):
    df = FL.min_schooling(occ(spark, d))
    return df.groupBy("ano", "eh_ti", "anos_estudo").agg(
        _r(A.wsum(WGT)).alias("populacao"), _r(A.wmean(INC, WGT)).alias("renda_media"))


_BANDS_SQL = ", ".join(f"('{lb}')" for lb in _LABELS)


@register("income_by_age", "X19 A15 L8", S.survey_sql(f"""
SELECT k.ano, k.eh_ti, b.faixa_idade, {S.r('COALESCE(a.populacao, 0.0)')} AS populacao,
       {S.r('a.renda_media')} AS renda_media
FROM (SELECT DISTINCT ano, eh_ti FROM occ) k
CROSS JOIN (VALUES {_BANDS_SQL}) b(faixa_idade)
LEFT JOIN (SELECT ano, eh_ti, {_CUT_SQL} AS faixa_idade, {S.wsum()} AS populacao,
                  {S.wmean(INC)} AS renda_media FROM occ GROUP BY 1, 2, 3) a
  ON a.ano = k.ano AND a.eh_ti = k.eh_ti AND a.faixa_idade = b.faixa_idade"""))
def income_by_age(spark, d):
    df = occ(spark, d).withColumn("faixa_idade", X.age_cut("idade", _EDGES, _LABELS))
    g = df.groupBy("ano", "eh_ti", "faixa_idade").agg(A.wsum(WGT).alias("populacao"),
                                                      A.wmean(INC, WGT).alias("renda_media"))
    keys = g.select("ano", "eh_ti").distinct()
    grid = keys.select("ano", "eh_ti", F.explode(F.array(*[F.lit(x) for x in _LABELS]))
                       .alias("faixa_idade"))      # every band for every (year, segment)
    full = grid.join(g, ["ano", "eh_ti", "faixa_idade"], "left").fillna(0.0, ["populacao"])
    return full.select("ano", "eh_ti", "faixa_idade", _r(F.col("populacao")).alias("populacao"),
                       _r(F.col("renda_media")).alias("renda_media"))


def _smoothed(df: DataFrame) -> DataFrame:
    g = FL.min_schooling(df).groupBy("ano", "anos_estudo").agg(
        A.wmean(INC, WGT, _it()).alias("renda_ti"), A.wmean(INC, WGT, _nit()).alias("renda_nao_ti"))
    dense = int_range(g, ["ano"], "anos_estudo").join(g, ["ano", "anos_estudo"], "left")
    for c in ("renda_ti", "renda_nao_ti"):
        dense = W.interpolate_linear(dense, ["ano"], "anos_estudo", c, f"{c}_interp")
        dense = dense.withColumn(f"{c}_suave", W.centred_mean(f"{c}_interp", ["ano"], "anos_estudo"))
    ti, nao_ti = W.scale_by_max(["renda_ti_suave", "renda_nao_ti_suave"], ["ano"])
    return dense.select(
        "ano", "anos_estudo",
        *[_r(F.col(c)).alias(c) for c in ("renda_ti", "renda_nao_ti", "renda_ti_interp",
                                         "renda_nao_ti_interp", "renda_ti_suave", "renda_nao_ti_suave")],
        _r(ti, 6).alias("escala_ti"), _r(nao_ti, 6).alias("escala_nao_ti"))


def _interp_sql(c: str) -> str:
    o = "PARTITION BY ano ORDER BY anos_estudo"
    return f"""
   CASE WHEN {c} IS NOT NULL THEN {c}
        WHEN last_value({c} IGNORE NULLS) OVER ({o} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) IS NULL
          THEN first_value({c} IGNORE NULLS) OVER ({o} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
        WHEN first_value({c} IGNORE NULLS) OVER ({o} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) IS NULL
          THEN last_value({c} IGNORE NULLS) OVER ({o} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
        ELSE last_value({c} IGNORE NULLS) OVER ({o} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
           + (first_value({c} IGNORE NULLS) OVER ({o} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
              - last_value({c} IGNORE NULLS) OVER ({o} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
           * (pos - last_value(CASE WHEN {c} IS NOT NULL THEN pos END IGNORE NULLS)
                      OVER ({o} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
           / (first_value(CASE WHEN {c} IS NOT NULL THEN pos END IGNORE NULLS)
                      OVER ({o} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
              - last_value(CASE WHEN {c} IS NOT NULL THEN pos END IGNORE NULLS)
                      OVER ({o} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) END AS {c}_interp"""


@register("income_by_schooling_smoothed", "L7 L8 W3 W4 W5", S.survey_sql(f"""
SELECT ano, anos_estudo, ROUND(renda_ti, 4) AS renda_ti, ROUND(renda_nao_ti, 4) AS renda_nao_ti,
       ROUND(renda_ti_interp, 4) AS renda_ti_interp, ROUND(renda_nao_ti_interp, 4) AS renda_nao_ti_interp,
       ROUND(renda_ti_suave, 4) AS renda_ti_suave, ROUND(renda_nao_ti_suave, 4) AS renda_nao_ti_suave,
       ROUND(renda_ti_suave / CASE WHEN top > 0 THEN top ELSE 1.0 END, 6) AS escala_ti,
       ROUND(renda_nao_ti_suave / CASE WHEN top > 0 THEN top ELSE 1.0 END, 6) AS escala_nao_ti
FROM (SELECT *, greatest(MAX(renda_ti_suave) OVER (PARTITION BY ano),
                         MAX(renda_nao_ti_suave) OVER (PARTITION BY ano)) AS top
      FROM (SELECT *, AVG(renda_ti_interp) OVER (PARTITION BY ano ORDER BY anos_estudo
                        ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS renda_ti_suave,
                      AVG(renda_nao_ti_interp) OVER (PARTITION BY ano ORDER BY anos_estudo
                        ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS renda_nao_ti_suave
            FROM (SELECT *, {_interp_sql('renda_ti')}, {_interp_sql('renda_nao_ti')}
                  FROM (SELECT k.ano, k.anos_estudo, g.renda_ti, g.renda_nao_ti,
                               ROW_NUMBER() OVER (PARTITION BY k.ano ORDER BY k.anos_estudo) AS pos
                        FROM (SELECT ano, CAST(UNNEST(range(MIN(anos_estudo), MAX(anos_estudo) + 1)) AS INT) AS anos_estudo
                              FROM g GROUP BY ano) k
                        LEFT JOIN g ON g.ano = k.ano AND g.anos_estudo = k.anos_estudo) dn) itp) sm) sc""",
    extra=f"""g AS (SELECT ano, anos_estudo, {S.wmean(INC, cond='eh_ti')} AS renda_ti,
                   {S.wmean(INC, cond='NOT eh_ti')} AS renda_nao_ti
            FROM occ WHERE anos_estudo >= 1 GROUP BY ano, anos_estudo)"""))
def income_by_schooling_smoothed(spark, d):
    return _smoothed(occ(spark, d))


@register("income_long", "A8 P12", S.survey_sql(f"""
SELECT ano, categoria, ROUND(valor, 4) AS valor FROM (
  SELECT ano, {S.wmean(INC, cond='eh_ti')} AS renda_ti, {S.wmean(INC, cond='NOT eh_ti')} AS renda_nao_ti,
         {S.pct(S.wsum(cond='eh_ti'), S.wsum())} AS pct_ti
  FROM occ GROUP BY ano) UNPIVOT (valor FOR categoria IN (renda_ti, renda_nao_ti, pct_ti))"""))
def income_long(spark, d):
    t = occ(spark, d).groupBy("ano").agg(
        A.wmean(INC, WGT, _it()).alias("renda_ti"), A.wmean(INC, WGT, _nit()).alias("renda_nao_ti"),
        A.wsum(WGT, _it()).alias("_ti"), A.wsum(WGT).alias("_all"))
    t = t.withColumn("pct_ti", A.pct("_ti", "_all")).drop("_ti", "_all")
    long = t.unpivot(["ano"], ["renda_ti", "renda_nao_ti", "pct_ti"], "categoria", "valor")
    return long.filter(F.col("valor").isNotNull()).select("ano", "categoria", _r(F.col("valor")).alias("valor"))


# ---------------------------------------------------------------------------
# education x sex
# ---------------------------------------------------------------------------

_SEXES = list(P.SEX_LABELS.values())
_SEX_SQL = "CASE sexo " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in P.SEX_LABELS.items()) + " END"


@register("education_by_sex", "A20 L1 L8 X10", S.survey_sql(f"""
SELECT k.ano, k.eh_ti, d.codigo, d.nivel AS nivel_escolaridade, x.sexo_desc,
       {S.r('COALESCE(a.populacao_estimada, 0.0)')} AS populacao_estimada
FROM (SELECT DISTINCT ano, eh_ti, CASE WHEN ano <= 2015 THEN 'ate2015' ELSE 'pos2015' END AS era FROM survey) k
JOIN (VALUES {_edu_values_sql()}) d(era, codigo, nivel) ON d.era = k.era
CROSS JOIN (VALUES ('Homens'), ('Mulheres')) x(sexo_desc)
LEFT JOIN (SELECT ano, eh_ti, CASE WHEN ano <= 2015 THEN curso_mais_elevado_antes_2015 ELSE curso_mais_elevado END AS codigo,
                  {_SEX_SQL} AS sexo_desc, SUM(peso_populacional) AS populacao_estimada
           FROM survey WHERE peso_populacional IS NOT NULL GROUP BY 1, 2, 3, 4) a
  ON a.ano = k.ano AND a.eh_ti = k.eh_ti AND a.codigo = d.codigo AND a.sexo_desc = x.sexo_desc"""))
def education_by_sex(spark, d):
    """Weighted population by education level (era-dependent course code
    and label table) x sex, per year and segment; every level of the era and
    both sexes present (zero-filled)."""
    era = F.when(F.col("ano") <= P.EDUCATION_ERA_SPLIT_YEAR, "ate2015").otherwise("pos2015")
    code = F.when(F.col("ano") <= P.EDUCATION_ERA_SPLIT_YEAR,
                  F.col("curso_mais_elevado_antes_2015")).otherwise(F.col("curso_mais_elevado"))
    df = survey(spark, d).withColumns({"era": era, "codigo": code, "sexo_desc": X.sex_label("sexo")})
    df = FL.required(df, "codigo", "sexo_desc", WGT)
    g = df.groupBy("ano", "eh_ti", "era", "codigo", "sexo_desc").agg(F.sum(WGT).alias("populacao_estimada"))
    keys = g.select("ano", "eh_ti", "era").distinct()
    grid = keys.join(F.broadcast(_education_dim(spark)), "era")           # fixed label table
    grid = grid.withColumn("sexo_desc", F.explode(F.array(*[F.lit(x) for x in _SEXES])))
    full = grid.join(g, ["ano", "eh_ti", "era", "codigo", "sexo_desc"], "left") \
               .fillna(0.0, ["populacao_estimada"])
    return full.select("ano", "eh_ti", "codigo", F.col("nivel").alias("nivel_escolaridade"), "sexo_desc",
                       _r(F.col("populacao_estimada")).alias("populacao_estimada"))


@register("education_by_sex_int", "A20", S.survey_sql(f"""
SELECT ano, codigo,
       CAST(COALESCE(SUM(CASE WHEN sexo = 1 THEN w END), 0) AS BIGINT) AS homens,
       CAST(COALESCE(SUM(CASE WHEN sexo = 2 THEN w END), 0) AS BIGINT) AS mulheres
FROM (SELECT ano, sexo, CASE WHEN ano < 2015 THEN curso_mais_elevado_antes_2015 ELSE curso_mais_elevado END AS codigo,
             CAST(trunc(peso_populacional) AS BIGINT) AS w
      FROM survey WHERE eh_ti AND peso_populacional IS NOT NULL AND sexo IN (1, 2))
WHERE codigo IS NOT NULL GROUP BY ano, codigo"""))
def education_by_sex_int(spark, d):
    """A20 variant: IT only, weights truncated to integers, course code by era
    (switch at < 2015 in this variant), pivoted by sex."""
    code = F.when(F.col("ano") < 2015, F.col("curso_mais_elevado_antes_2015")).otherwise(F.col("curso_mais_elevado"))
    df = FL.segment(survey(spark, d), True).withColumns({"codigo": code, "sexo_desc": X.sex_label("sexo")})
    df = FL.required(df, "codigo", "sexo_desc", WGT)
    p = (df.groupBy("ano", "codigo").pivot("sexo_desc", _SEXES)
           .agg(F.sum(F.col(WGT).cast("long"))).fillna(0, _SEXES))
    return p.select("ano", "codigo", F.col("Homens").cast("long").alias("homens"),
                    F.col("Mulheres").cast("long").alias("mulheres"))
