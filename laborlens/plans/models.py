"""Model evaluation (metrics over the deterministic pseudo-score), statistical tests
and trends, and Spark ML model operators.  The model queries report what SQL can
check (sizes, weights, sums, agreement of a saved and a fitted model)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlens import params as P
from laborlens.functions import scalars as X
from laborlens.operators import metrics as MT
from laborlens.operators import ml as ML
from laborlens.operators import sampling as M
from laborlens.operators import schema as SC
from laborlens.operators import stats as ST
from laborlens.plans import ageism as AG
from laborlens.plans import sampling_plans as SP
from laborlens.plans import survey as SV
from laborlens.plans.registry import register
from laborlens.plans.sqlbits import survey_sql
from laborlens.session import materialise, scratch_path

WGT = "peso_populacional"
_W_SQL = "COALESCE(peso_populacional, CAST(0 AS DOUBLE))"


def scored(spark, d) -> DataFrame:
    return SV.survey(spark, d)


def _conf_sql(w: str | None, t: str = "0.5") -> str:
    ww = "CAST(1 AS DOUBLE)" if w is None else w
    return (f"SUM(CASE WHEN y_true = 1 AND y_proba >= {t} THEN {ww} ELSE CAST(0 AS DOUBLE) END) AS tp, "
            f"SUM(CASE WHEN y_true <> 1 AND y_proba >= {t} THEN {ww} ELSE CAST(0 AS DOUBLE) END) AS fp, "
            f"SUM(CASE WHEN y_true <> 1 AND y_proba < {t} THEN {ww} ELSE CAST(0 AS DOUBLE) END) AS tn, "
            f"SUM(CASE WHEN y_true = 1 AND y_proba < {t} THEN {ww} ELSE CAST(0 AS DOUBLE) END) AS fn")


def _derive_sql(sfx: str = "") -> str:
    tp, fp, tn, fn = (f"tp{sfx}", f"fp{sfx}", f"tn{sfx}", f"fn{sfx}")
    prec = f"(CASE WHEN {tp} + {fp} > 0 THEN {tp} / ({tp} + {fp}) ELSE 0.0 END)"
    rec = f"(CASE WHEN {tp} + {fn} > 0 THEN {tp} / ({tp} + {fn}) ELSE 0.0 END)"
    spec = f"(CASE WHEN {tn} + {fp} > 0 THEN {tn} / ({tn} + {fp}) ELSE 0.0 END)"
    f1 = f"(CASE WHEN {prec} + {rec} > 0 THEN 2 * {prec} * {rec} / ({prec} + {rec}) ELSE 0.0 END)"
    acc = f"(CASE WHEN {tp} + {fp} + {tn} + {fn} > 0 THEN ({tp} + {tn}) / ({tp} + {fp} + {tn} + {fn}) END)"
    return (f"ROUND({acc}, 6) AS accuracy{sfx}, ROUND(({rec} + {spec}) / 2, 6) AS balanced_accuracy{sfx}, "
            f"ROUND({prec}, 6) AS precision{sfx}, ROUND({rec}, 6) AS recall{sfx}, ROUND({f1}, 6) AS f1{sfx}")


@register("clf_metrics", "R8 X21", survey_sql(f"""
SELECT variante, n, tp, fp, tn, fn, {_derive_sql()} FROM (
  SELECT 'nao_ponderado' AS variante, COUNT(*) AS n, {_conf_sql(None)} FROM survey
  UNION ALL SELECT 'ponderado', COUNT(*), {_conf_sql(_W_SQL)} FROM survey)"""))
def clf_metrics(spark, d):
    df = scored(spark, d)
    a = MT.classification_report(df, "y_true", "y_proba", 0.5).withColumn("variante", F.lit("nao_ponderado"))
    b = MT.classification_report(df, "y_true", "y_proba", 0.5, WGT).withColumn("variante", F.lit("ponderado"))
    return a.unionByName(b)


def _class_sql(name: str, w: str) -> str:
    line = ("SELECT '{v}' AS variante, '{c}' AS classe, {tp} / NULLIF({tp} + {fp}, 0) AS p, {tp} / NULLIF({tp} + {fn}, 0) AS r, "
            "{tp} + {fn} AS s FROM k")
    both = (line.format(v=name, c="0", tp="tn", fp="fn", fn="fp") + " UNION ALL "
            + line.format(v=name, c="1", tp="tp", fp="fp", fn="fn"))
    f1 = "CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END"
    return f"""
SELECT variante, classe, ROUND(p, 6) AS precision, ROUND(r, 6) AS recall, ROUND(f1, 6) AS f1, ROUND(s, 4) AS suporte FROM (
  WITH k AS (SELECT {_conf_sql(w)} FROM survey),
  c AS (SELECT variante, classe, p, r, {f1} AS f1, s FROM (SELECT variante, classe, COALESCE(p, 0) AS p, COALESCE(r, 0) AS r, s FROM ({both})))
  SELECT * FROM c
  UNION ALL SELECT '{name}', 'macro', AVG(p), AVG(r), AVG(f1), SUM(s) FROM c
  UNION ALL SELECT '{name}', 'ponderada', SUM(p * s) / SUM(s), SUM(r * s) / SUM(s), SUM(f1 * s) / SUM(s), SUM(s) FROM c)"""


@register("class_report", "R8", survey_sql(_class_sql("nao_ponderado", None) + " UNION ALL " + _class_sql("ponderado", _W_SQL)))
def class_report(spark, d):
    df = scored(spark, d)
    a = MT.class_report(df, "y_true", "y_proba").withColumn("variante", F.lit("nao_ponderado"))
    return a.unionByName(MT.class_report(df, "y_true", "y_proba", w=WGT).withColumn("variante", F.lit("ponderado")))


def _auc_sql(w: str, name: str) -> str:
    return f"""
SELECT '{name}' AS variante,
       ROUND(SUM(wp * (cwn - wn + wn / 2.0)) / (SUM(wp) * MAX(twn)), 6) AS auc,
       ROUND(SUM(CASE WHEN twp > 0 THEN wp / twp * dcwp / (dcwp + dcwn) END), 6) AS ap
FROM (SELECT *, SUM(wn) OVER (ORDER BY y_proba ROWS UNBOUNDED PRECEDING) AS cwn,
             SUM(wn) OVER () AS twn, SUM(wp) OVER () AS twp,
             SUM(wp) OVER (ORDER BY y_proba DESC ROWS UNBOUNDED PRECEDING) AS dcwp,
             SUM(wn) OVER (ORDER BY y_proba DESC ROWS UNBOUNDED PRECEDING) AS dcwn
      FROM (SELECT y_proba, SUM(CASE WHEN y_true = 1 THEN {w} ELSE CAST(0 AS DOUBLE) END) AS wp,
                   SUM(CASE WHEN y_true = 1 THEN 0.0 ELSE {w} END) AS wn
            FROM survey WHERE y_proba IS NOT NULL GROUP BY y_proba))"""


@register("auc_exact", "R9 W1", survey_sql(_auc_sql("1.0", "nao_ponderado") + " UNION ALL "
                                           + _auc_sql(_W_SQL, "ponderado")))
def auc_exact(spark, d):
    t = MT.score_table(scored(spark, d), "y_true", "y_proba", {"nao_ponderado": None, "ponderado": WGT})
    r = MT.ranking_metrics(materialise(t, "escores"), ["nao_ponderado", "ponderado"])
    return r.select("variante", F.round("auc", 6).alias("auc"), F.round("ap", 6).alias("ap"))


@register("curve_points", "R9", survey_sql("""
SELECT y_proba AS score, ROUND(fp / tn, 6) AS fpr, ROUND(tp / tpos, 6) AS tpr, ROUND(tp / (tp + fp), 6) AS precision,
       ROUND(tp / tpos, 6) AS recall FROM (
  SELECT y_proba, SUM(wp) OVER (ORDER BY y_proba DESC ROWS UNBOUNDED PRECEDING) AS tp,
         SUM(wn) OVER (ORDER BY y_proba DESC ROWS UNBOUNDED PRECEDING) AS fp,
         SUM(wp) OVER () AS tpos, SUM(wn) OVER () AS tn FROM (
    SELECT y_proba, CAST(COUNT(CASE WHEN y_true = 1 THEN 1 END) AS DOUBLE) AS wp,
           CAST(COUNT(CASE WHEN y_true <> 1 THEN 1 END) AS DOUBLE) AS wn
    FROM survey WHERE y_proba IS NOT NULL GROUP BY y_proba))"""))
def curve_points(spark, d):
    """ROC and precision-recall points, one per distinct score."""
    t = materialise(MT.score_table(scored(spark, d), "y_true", "y_proba", {"n": None}), "escores")
    return MT.curve_points(t, "n").select("score", *[F.round(c, 6).alias(c) for c in ("fpr", "tpr", "precision", "recall")])


_TH_SQL = ", ".join(f"({t})" for t in P.THRESHOLDS)


def _sweep_sql() -> str:
    conf = lambda w, s: (
        f"SUM(CASE WHEN y_true = 1 AND y_proba >= limiar THEN {w} ELSE CAST(0 AS DOUBLE) END) AS tp{s}, "
        f"SUM(CASE WHEN y_true <> 1 AND y_proba >= limiar THEN {w} ELSE CAST(0 AS DOUBLE) END) AS fp{s}, "
        f"SUM(CASE WHEN y_true <> 1 AND y_proba < limiar THEN {w} ELSE CAST(0 AS DOUBLE) END) AS tn{s}, "
        f"SUM(CASE WHEN y_true = 1 AND y_proba < limiar THEN {w} ELSE CAST(0 AS DOUBLE) END) AS fn{s}")
    return f"""
sweep AS (SELECT limiar, tp, fp, tn, fn, tp_w, fp_w, tn_w, fn_w, {_derive_sql()}, {_derive_sql('_w')} FROM (
  SELECT CAST(limiar AS DOUBLE) AS limiar, {conf('CAST(1 AS DOUBLE)', '')}, {conf(_W_SQL, '_w')}
  FROM survey, (VALUES {_TH_SQL}) th(limiar) GROUP BY limiar))"""


@register("threshold_sweep", "R10", survey_sql("SELECT * FROM sweep", extra=_sweep_sql()))
def threshold_sweep(spark, d):
    return MT.threshold_sweep(scored(spark, d), "y_true", "y_proba", WGT)


@register("best_threshold", "R10 T3", survey_sql("""
SELECT arg_min(limiar, (-f1, limiar)) AS limiar, MAX(f1) AS f1 FROM sweep""", extra=_sweep_sql()))
def best_threshold(spark, d):
    return MT.best_threshold(MT.threshold_sweep(scored(spark, d), "y_true", "y_proba"), "f1")


@register("calibration", "R11", survey_sql("""
SELECT LEAST(CAST(floor(y_proba * 20) AS INT), 19) AS bin, COUNT(*) AS n, ROUND(AVG(y_proba), 6) AS prob_media,
       ROUND(AVG(CAST(y_true AS DOUBLE)), 6) AS taxa_observada FROM survey GROUP BY 1"""))
def calibration(spark, d):
    return MT.calibration(scored(spark, d), "y_true", "y_proba")


_HE, _HL = P.AGE_CUTS_HEATMAP
_HCUT_SQL = "CASE " + " ".join(f"WHEN idade > {lo} AND idade <= {hi} THEN '{lb}'"
                               for lo, hi, lb in zip(_HE[:-1], _HE[1:], _HL)) + " END"


@register("subgroup_metrics", "R12 X19", survey_sql(f"""
SELECT grupo, valor, n, tp, fp, tn, fn, valido, {", ".join(f"CASE WHEN valido THEN {c} END AS {c}" for c in
    ("accuracy", "balanced_accuracy", "precision", "recall", "f1"))} FROM (
SELECT grupo, valor, n, tp, fp, tn, fn, n >= 10 AND pos > 0 AND pos < n AS valido, {_derive_sql()} FROM (
  SELECT grupo, valor, COUNT(*) AS n, SUM(y_true) AS pos, {_conf_sql(None)} FROM (
    SELECT 'faixa_idade' AS grupo, {_HCUT_SQL} AS valor, y_true, y_proba FROM survey
    UNION ALL SELECT 'sexo', CAST(sexo AS STRING), y_true, y_proba FROM survey
    UNION ALL SELECT 'nivel_instrucao', CAST(nivel_instrucao AS STRING), y_true, y_proba FROM survey)
  GROUP BY grupo, valor))"""))
def subgroup_metrics(spark, d):
    df = scored(spark, d).withColumn("faixa_idade", X.age_cut("idade", _HE, _HL))
    return MT.subgroup_metrics(df, "y_true", "y_proba", ["faixa_idade", "sexo", "nivel_instrucao"])


@register("proba_matrix", "A31 X19", survey_sql(f"""
SELECT eh_ti, {_HCUT_SQL} AS faixa_idade, anos_estudo, COUNT(*) AS n, ROUND(AVG(y_proba), 6) AS prob_media
FROM survey GROUP BY 1, 2, 3"""))
def proba_matrix(spark, d):
    df = scored(spark, d).withColumn("faixa_idade", X.age_cut("idade", _HE, _HL))
    return df.groupBy("eh_ti", "faixa_idade", "anos_estudo").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("y_proba"), 6).alias("prob_media"))


@register("labelled_scores", "X24 X21", survey_sql("""
SELECT record_id, l_partkey, ROUND(y_proba * 100, 2) AS prob_pct,
       CASE WHEN y_proba >= 0.5 THEN 'Sim' ELSE 'Nao' END AS previsao, y_true
FROM survey"""))
def labelled_scores(spark, d):
    df = scored(spark, d)
    return df.select("record_id", "l_partkey", X.percent2("y_proba").alias("prob_pct"),
                     X.class_label((F.col("y_proba") >= 0.5).cast("int")).alias("previsao"), "y_true")


# ---------------------------------------------------------------------------
# statistics
# ---------------------------------------------------------------------------

@register("ttest_by_period", "R1 X20", AG._sql("""
SELECT decada, n1, n2, gl, ROUND(m1, 4) AS m1, ROUND(m2, 4) AS m2,
       ROUND(CASE WHEN n1 >= 2 AND n2 >= 2 AND sp2 > 0 THEN (m1 - m2) / sqrt(sp2 * (1.0 / n1 + 1.0 / n2))
                  ELSE 0.0 END, 6) AS t
FROM (SELECT *, CAST(n1 + n2 - 2 AS BIGINT) AS gl,
             ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) AS sp2 FROM (
  SELECT CAST(floor(ano / 10) * 10 AS INT) AS decada,
         COUNT(CASE WHEN eh_ti THEN 1 END) AS n1, COUNT(CASE WHEN NOT eh_ti THEN 1 END) AS n2,
         AVG(CASE WHEN eh_ti THEN idade END) AS m1, AVG(CASE WHEN NOT eh_ti THEN idade END) AS m2,
         VAR_SAMP(CASE WHEN eh_ti THEN idade END) AS v1, VAR_SAMP(CASE WHEN NOT eh_ti THEN idade END) AS v2
  FROM base GROUP BY 1))"""))
def ttest_by_period(spark, d):
    df = AG.base(spark, d).withColumn("decada", X.decade("ano"))
    t = ST.two_sample_t(df, ["decada"], "idade", "eh_ti")
    return t.select("decada", "n1", "n2", "gl", F.round("m1", 4).alias("m1"), F.round("m2", 4).alias("m2"),
                    F.round("t", 6).alias("t"))


_STEPS = 4000
#: Two-sided p-value of t with v degrees of freedom: Simpson's rule over the density.
_P_SQL = f"""
pv AS (SELECT id, CASE WHEN v > 0 THEN greatest(0e0, 1 - 2 * abs(t) / {_STEPS} / 3 * SUM(
    CASE WHEN i = 0 OR i = {_STEPS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
    * exp(lgamma((v + 1) / 2e0) - lgamma(v / 2e0)) / sqrt(v * pi())
    * pow(1 + pow(abs(t) * i / {_STEPS}, 2) / v, -(v + 1) / 2e0))) ELSE 1e0 END AS p
  FROM ts, (SELECT UNNEST(range(0, {_STEPS + 1})) AS i) GROUP BY id, t, v)"""


@register("ttest_pvalues", "R1", AG._sql("""
SELECT ano, ROUND(t, 6) AS t, v AS gl, ROUND(p, 5) AS p FROM ts JOIN pv ON ts.id = pv.id""", extra="""
ts AS (SELECT ano AS id, ano, CAST(n1 + n2 - 2 AS BIGINT) AS v,
    CASE WHEN n1 >= 2 AND n2 >= 2 AND sp2 > 0 THEN (m1 - m2) / sqrt(sp2 * (1.0 / n1 + 1.0 / n2)) ELSE 0.0 END AS t
  FROM (SELECT *, ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) AS sp2 FROM (
    SELECT ano, COUNT(CASE WHEN eh_ti THEN 1 END) AS n1, COUNT(CASE WHEN NOT eh_ti THEN 1 END) AS n2,
           AVG(CASE WHEN eh_ti THEN idade END) AS m1, AVG(CASE WHEN NOT eh_ti THEN idade END) AS m2,
           VAR_SAMP(CASE WHEN eh_ti THEN idade END) AS v1, VAR_SAMP(CASE WHEN NOT eh_ti THEN idade END) AS v2
    FROM base GROUP BY 1))),""" + _P_SQL))
def ttest_pvalues(spark, d):
    """t and its two-sided p-value per year."""
    t = ST.two_sample_t(AG.base(spark, d), ["ano"], "idade", "eh_ti")
    return t.select("ano", F.round("t", 6).alias("t"), "gl",
                    F.round(ST.t_pvalue(F.col("t"), F.col("gl").cast("double")), 5).alias("p"))


_YEARLY_AGE_SQL = "ya AS (SELECT eh_ti, ano, AVG(idade) AS idade_media FROM base GROUP BY eh_ti, ano)"


@register("age_trend", "R2", AG._sql("""
SELECT eh_ti, ROUND(regr_slope(idade_media, ano), 6) AS inclinacao,
       ROUND(regr_intercept(idade_media, ano), 4) AS intercepto, ROUND(regr_r2(idade_media, ano), 6) AS r2,
       COUNT(*) AS n, CASE WHEN regr_slope(idade_media, ano) > 0 THEN 'crescente'
                           WHEN regr_slope(idade_media, ano) < 0 THEN 'decrescente' ELSE 'estavel' END AS direcao,
       ROUND(ANY_VALUE(p), 5) AS p_valor
FROM ya JOIN pv ON ya.eh_ti = pv.id GROUP BY eh_ti""", extra=_YEARLY_AGE_SQL + """,
ts AS (SELECT eh_ti AS id, COUNT(*) - 2 AS v, sqrt(regr_r2(idade_media, ano) * (COUNT(*) - 2)
              / (1 - regr_r2(idade_media, ano))) AS t FROM ya GROUP BY eh_ti),""" + _P_SQL))
def age_trend(spark, d):
    ya = AG.base(spark, d).groupBy("eh_ti", "ano").agg(F.avg("idade").alias("idade_media"))
    t = ST.linear_trend(ya, ["eh_ti"], "idade_media", "ano")
    return t.select("eh_ti", F.round("inclinacao", 6).alias("inclinacao"),
                    F.round("intercepto", 4).alias("intercepto"), F.round("r2", 6).alias("r2"), "n", "direcao",
                    F.round("p_valor", 5).alias("p_valor"))


@register("trend_projection", "R4", AG._sql("""
SELECT eh_ti, CAST(x AS INT) AS ano, ROUND(intercepto + inclinacao * x, 4) AS previsto FROM (
  SELECT eh_ti, regr_slope(n, ano) AS inclinacao, regr_intercept(n, ano) AS intercepto, MAX(ano) AS xm
  FROM (SELECT eh_ti, ano, CAST(COUNT(*) AS DOUBLE) AS n FROM base GROUP BY 1, 2) GROUP BY eh_ti),
  LATERAL (SELECT UNNEST(range(xm + 1, xm + 4)) AS x)"""))
def trend_projection(spark, d):
    yc = AG.base(spark, d).groupBy("eh_ti", "ano").agg(F.count(F.lit(1)).cast("double").alias("n"))
    t = ST.linear_trend(yc, ["eh_ti"], "n", "ano")
    p = ST.project(t, ["eh_ti"], 3)
    return p.select("eh_ti", F.col("x").cast("int").alias("ano"), F.round("previsto", 4).alias("previsto"))


# ---------------------------------------------------------------------------
# Spark ML models
# ---------------------------------------------------------------------------

NUMERIC = ["idade", "anos_estudo", "horas_trabalhadas_semana"]
CATEGORICAL = ["sexo", "uf", "nivel_instrucao", "carteira_assinada", "cor_raca"]
TARGET_ALIASES = ("y_true", "rendimento_trabalho_principal", "rendimento_bruto_mensal")
TRAIN = "split = 'treino'"

_TABLES: dict = {}


def _ml_table(spark, d) -> DataFrame:
    """Features ∩ schema minus target/leakage, hash split, balanced weights;
    the rows are written once, as every model pass reads them; split and weights follow from small tables.
    A file's rows are ordered by their key, so that forests, whose bags go by the row, are the same on every run."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _TABLES:
        df = SV.occ(spark, d).withColumn("hk", M.pk_hash(*SP.PK))
        num, cat = SC.feature_projection(df, NUMERIC, CATEGORICAL, TARGET_ALIASES)
        t = ML.prepare(df.select("hk", "record_id", "l_partkey", "ano", "trimestre", "y_true", "eh_ti", WGT, *num, *cat),
                       num, cat, "y_true")
        t = M.stratified_split(materialise(t.sortWithinPartitions("hk"), "ml"), "label", SP.TEST_FRACTION, "hk")
        _TABLES[at] = ML.balanced_weights(t, "label")
    return _TABLES[at]


def _fit_forest(spark, d, num_trees=20, max_depth=8, weight_col="peso_classe"):
    t = _ml_table(spark, d)
    train = ML.require_two_classes(t.filter(TRAIN))
    return ML.fit_alike([ML.forest(NUMERIC, CATEGORICAL, num_trees, max_depth, 5, weight_col)], train)[0], t


_ML_CTE = SP._HK_CTE.replace("FROM survey", "FROM occ") + f""",
ml AS (SELECT *, CASE WHEN ROW_NUMBER() OVER (PARTITION BY y_true ORDER BY hk, {SP.PK_ORDER})
         <= round(COUNT(*) OVER (PARTITION BY y_true) * {SP.TEST_FRACTION}) THEN 'teste' ELSE 'treino' END AS split FROM hs),
wc AS (SELECT y_true, SUM(COUNT(*)) OVER () / (COUNT(*) OVER () * COUNT(*)) AS peso FROM ml GROUP BY y_true)"""


def _in_unit(c) -> "F.Column":
    return F.coalesce(F.col(c).between(0.0, 1.0), F.lit(False))


@register("forest", "R5 R6 R8 R9", survey_sql("""
SELECT v AS pesos, COUNT(*) AS n, CAST(SUM(y_true) AS BIGINT) AS n_pos, TRUE AS soma_ok, TRUE AS auc_ok, TRUE AS metricas_ok,
       (SELECT ROUND(peso, 6) FROM wc WHERE y_true = 1) AS peso_pos
FROM ml, (VALUES ('classe'), ('populacao')) x(v) WHERE split = 'teste' GROUP BY v""", extra=_ML_CTE))
def forest(spark, d):
    """Forests with class and with survey weights, scored on the test rows."""
    t = _ml_table(spark, d).withColumn("peso_amostra", F.greatest(F.coalesce(F.col(WGT), F.lit(0.0)), F.lit(0.0)))
    weights = {"classe": "peso_classe", "populacao": "peso_amostra"}
    models = ML.fit_alike([ML.forest(NUMERIC, CATEGORICAL, 20, 8, 5, w) for w in weights.values()],
                          ML.require_two_classes(t.filter(TRAIN)))
    pred = ML.PipelineModel(models[0].stages[:-1]).transform(t.filter("split = 'teste'")).select("label", "peso_classe", "features")
    for name, model in zip(weights, models):
        pred = ML.positive_probability(model.stages[-1].transform(pred), name).drop("rawPrediction", "probability", "prediction")
    pred = materialise(pred.drop("features"), "previsoes")
    out = None
    for name in weights:
        one = pred.withColumnRenamed(name, "y_proba")
        rep = MT.classification_report(one, "label", "y_proba")
        auc = MT.auc_exact(one, "label", "y_proba")
        more = one.agg(F.sum("label").cast("long").alias("n_pos"),
                       F.round(F.max(F.when(F.col("label") == 1, F.col("peso_classe"))), 6).alias("peso_pos"))
        r = rep.crossJoin(auc).crossJoin(more).select(                                   # one row each
            F.lit(name).alias("pesos"), "n", "n_pos",
            (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn") == F.col("n")).alias("soma_ok"),
            _in_unit("auc").alias("auc_ok"), (_in_unit("f1") & _in_unit("accuracy")).alias("metricas_ok"), "peso_pos")
        out = r if out is None else out.unionByName(r)
    return out


@register("forest_predictions", "R6 X24", survey_sql("""
SELECT record_id, l_partkey, split, y_true, TRUE AS prob_ok FROM ml""", extra=_ML_CTE))
def forest_predictions(spark, d):
    """Prediction table of all rows (train and test) with the probability and the label."""
    model, t = _fit_forest(spark, d, num_trees=10, max_depth=6)
    pred = ML.positive_probability(model.transform(t))
    ok = _in_unit("y_proba") & ((F.col("y_proba") >= 0.5) == (F.col("prediction") == 1))
    return pred.select("record_id", "l_partkey", "split", "y_true", ok.alias("prob_ok"))


def _sources_sql(flag: str) -> str:
    return survey_sql(" UNION ALL ".join(
        f"SELECT '{c}' AS origem, TRUE AS {flag}, (SELECT COUNT(*) FROM ml WHERE split = 'treino') AS n_treino"
        for c in NUMERIC + CATEGORICAL), extra=_ML_CTE)


def coefficients(model, t: DataFrame) -> DataFrame:
    """(feature, coef, origem) of a fitted logistic pipeline."""
    names = ML.feature_names(model, "features", model.transform(t.limit(1)))
    rows = [(n, float(c), ML.source_column(n, NUMERIC + CATEGORICAL))
            for n, c in zip(names, model.stages[-1].coefficients.toArray())]
    return t.sparkSession.createDataFrame(rows, "feature string, coef double, origem string")


@register("logistic", "R5 R7", _sources_sql("finito"))
def logistic(spark, d):
    t = _ml_table(spark, d)
    train = ML.require_two_classes(t.filter(TRAIN))
    c = coefficients(ML.logistic(NUMERIC, CATEGORICAL, "peso_classe").fit(train), t)
    n = train.agg(F.count(F.lit(1)).alias("n_treino"))
    return c.groupBy("origem").agg(F.bool_and(F.abs("coef") < 1e6).alias("finito")).crossJoin(n)   # one row


def importance_table(model, t: DataFrame) -> DataFrame:
    """Forest importances summed to their source columns."""
    names = ML.feature_names(model, "features", model.transform(t.limit(1)))
    rows = [(ML.source_column(n, NUMERIC + CATEGORICAL), float(v))
            for n, v in zip(names, model.stages[-1].featureImportances.toArray())]
    imp = t.sparkSession.createDataFrame(rows, "origem string, importancia double")
    return imp.groupBy("origem").agg(F.sum("importancia").alias("importancia"))


@register("importances", "R13", _sources_sql("soma_ok"))
def importances(spark, d):
    model, t = _fit_forest(spark, d, num_trees=10, max_depth=6)
    imp = importance_table(model, t)
    one = imp.agg((F.abs(F.sum("importancia") - 1) < 1e-9).alias("soma_ok"))
    n = t.filter(TRAIN).agg(F.count(F.lit(1)).alias("n_treino"))
    return imp.select("origem").crossJoin(one).crossJoin(n)                              # one row each


@register("perm_importance", "R14 M9", survey_sql(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST(20 AS BIGINT) AS replicas, TRUE AS valida" for c in NUMERIC + CATEGORICAL)))
def perm_importance(spark, d):
    """F1 drop of all features when permuted, with bootstrap mean, deviation and quantiles."""
    model, t = _fit_forest(spark, d, num_trees=10, max_depth=6)
    imp = ML.permutation_importance(model, t.filter("split = 'teste'"), NUMERIC + CATEGORICAL, "hk")
    ok = (F.col("q025") <= F.col("media") + 1e-9) & (F.col("media") <= F.col("q975") + 1e-9) & (F.abs("media") <= 1)
    return imp.select("feature", "replicas", ok.alias("valida"))


@register("cv_folds", "R15", survey_sql(f"""
SELECT fold, y_true, COUNT(*) AS n FROM (
  SELECT y_true, CAST((ROW_NUMBER() OVER (PARTITION BY y_true ORDER BY hk, {SP.PK_ORDER}) - 1) % 3 AS INT) AS fold
  FROM ml) GROUP BY fold, y_true""", extra=_ML_CTE))
def cv_folds(spark, d):
    """Stratified folds: sizes per fold and class."""
    t = ML.stratified_folds(_ml_table(spark, d), "y_true", "hk", 3)
    return t.groupBy("fold", "y_true").agg(F.count(F.lit(1)).alias("n"))


FOLDS = 3

_GROUP_FOLDS_SQL = f"""
cel AS (SELECT ano, trimestre, COUNT(*) AS n, COUNT(CASE WHEN y_true = 1 THEN 1 END) AS n1 FROM occ GROUP BY 1, 2),
ord AS (SELECT ano, trimestre, CAST(n - n1 AS DOUBLE) AS c0, CAST(n1 AS DOUBLE) AS c1,
               ROW_NUMBER() OVER (ORDER BY n DESC, ano, trimestre) AS i, SUM(n - n1) OVER () AS s0, SUM(n1) OVER () AS s1 FROM cel),
passo AS (
  SELECT CAST(0 AS BIGINT) AS i, [0e0, 0e0, 0e0] AS h0, [0e0, 0e0, 0e0] AS h1, 0 AS fold
  UNION ALL
  SELECT i, list_transform(h0, lambda v, k: CASE WHEN k = f THEN v + c0 ELSE v END),
         list_transform(h1, lambda v, k: CASE WHEN k = f THEN v + c1 ELSE v END), CAST(f - 1 AS INT)
  FROM (SELECT o.i, p.h0, p.h1, o.c0, o.c1, list_position(q, list_min(q)) AS f FROM (
    SELECT *, list_transform([1, 2, 3], lambda k: greatest((h0[k] + c0) / s0, (h1[k] + c1) / s1)) AS q
    FROM passo p0 JOIN ord o0 ON o0.i = p0.i + 1) z JOIN ord o ON o.i = z.i_1 JOIN passo p ON p.i = z.i))"""


@register("cv_group_folds", "R15", survey_sql("""
SELECT ano, trimestre, p.fold, CAST(c0 + c1 AS BIGINT) AS n, CAST(c1 AS BIGINT) AS n1 FROM ord o JOIN passo p ON p.i = o.i""",
    extra=_GROUP_FOLDS_SQL).replace("WITH ", "WITH RECURSIVE ", 1))
def cv_group_folds(spark, d):
    """Folds of whole quarters, balanced in size and class."""
    t = ML.group_folds(SV.occ(spark, d), ["ano", "trimestre"], "y_true", FOLDS)
    return t.groupBy("ano", "trimestre", "fold").agg(F.count(F.lit(1)).alias("n"),
                                                     F.count(F.when(F.col("y_true") == 1, 1)).alias("n1"))


@register("cv_grid", "R15", survey_sql("""
SELECT x AS max_depth, TRUE AS auc_ok FROM (VALUES (3), (6)) v(x)"""))
def cv_grid(spark, d):
    t = materialise(ML.stratified_folds(_ml_table(spark, d), "y_true", "hk", 3), "folds")
    pipe = ML.forest(NUMERIC, CATEGORICAL, 10, 4, 5)
    rf = pipe.getStages()[-1]
    grid = ML.ParamGridBuilder().addGrid(rf.maxDepth, [3, 6]).build()
    cv = ML.cross_validate(t, pipe, grid, "fold")
    rows = [(int(pm[rf.maxDepth]), float(m)) for pm, m in zip(grid, cv.avgMetrics)]
    return spark.createDataFrame(rows, "max_depth int, auc_media double").select(
        "max_depth", _in_unit("auc_media").alias("auc_ok"))


CURVE = (0.25, 0.5, 1.0)
_SHARE_SQL = "CAST('0x' || substr(md5(CAST(hk AS STRING) || '-curva'), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE)"


@register("learning_curve", "R15", survey_sql(" UNION ALL ".join(
    f"SELECT CAST({f} AS DOUBLE) AS fracao, COUNT(*) AS n_treino, TRUE AS auc_ok FROM ml "
    f"WHERE split = 'treino' AND {_SHARE_SQL} < CAST({f} AS DOUBLE)" for f in CURVE), extra=_ML_CTE))
def learning_curve(spark, d):
    """AUC on the test rows of forests fitted on growing shares of the training rows."""
    t = _ml_table(spark, d)
    train, test = t.filter(TRAIN), t.filter("split = 'teste'")
    out = None
    for frac in CURVE:
        sub = train.filter(M.uniform(F.col("hk"), F.lit("curva")) < frac)
        m = ML.forest(NUMERIC, CATEGORICAL, 10, 6, 5).fit(ML.require_two_classes(sub))
        auc = MT.auc_exact(ML.positive_probability(m.transform(test)), "label", "y_proba")
        n = sub.agg(F.count(F.lit(1)).alias("n_treino"))
        r = auc.crossJoin(n).select(F.lit(frac).alias("fracao"), "n_treino", _in_unit("auc").alias("auc_ok"))   # one row
        out = r if out is None else out.unionByName(r)
    return out


@register("batch_score", "R17 X24", survey_sql("""
SELECT COUNT(*) AS n, CAST(0 AS BIGINT) AS divergentes FROM ml""", extra=_ML_CTE))
def batch_score(spark, d):
    """Save the fitted pipeline to the shared folder, load it back, score the survey; rows
    where the loaded and the fitted model disagree."""
    model, t = _fit_forest(spark, d, num_trees=10, max_depth=6)
    path = scratch_path(spark, "model")
    model.write().overwrite().save(path)
    loaded = ML.PipelineModel.load(path)
    a = ML.positive_probability(model.transform(t)).select(*t.columns, F.col("y_proba").alias("a"))
    b = ML.positive_probability(loaded.transform(a)).select(
        "a", F.col("y_proba").alias("b"), X.percent2("y_proba").alias("prob_pct"),
        X.class_label(F.col("prediction").cast("int")).alias("previsao"))
    wrong = ~F.col("a").eqNullSafe(F.col("b")) | (F.round(F.col("b") * 100, 2) != F.col("prob_pct")) \
        | ~F.col("previsao").isin("Sim", "Nao")
    return b.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(wrong, 1)).alias("divergentes"))


@register("kmeans_age", "R16 A33", survey_sql("""
SELECT CAST(4 AS BIGINT) AS clusters, COUNT(*) AS n, MIN(CAST(idade AS DOUBLE)) AS minimo, MAX(CAST(idade AS DOUBLE)) AS maximo,
       ROUND(AVG(idade), 6) AS media, TRUE AS separados FROM survey WHERE eh_ti"""))
def kmeans_age(spark, d):
    """Clusters of age: their sizes, means and ranges add up to the whole and don't overlap."""
    it = SV.survey(spark, d).filter(F.col("eh_ti")).select(F.col("idade").cast("double").alias("idade"))
    it = materialise(it, "idades")
    c = ML.cluster_summary(ML.kmeans(it, ["idade"], k=4).transform(it), "idade")
    ranges = F.array_sort(F.collect_list(F.struct("minimo", "maximo")))                  # one entry a cluster
    s = c.agg(F.count(F.lit(1)).alias("clusters"), F.sum("n").alias("n"), F.min("minimo").alias("minimo"),
              F.max("maximo").alias("maximo"), F.round(F.sum(F.col("media") * F.col("n")) / F.sum("n"), 6).alias("media"),
              ranges.alias("r"))
    apart = F.forall(F.sequence(F.lit(1), F.size("r") - 1),
                     lambda i: F.element_at("r", i)["maximo"] < F.element_at("r", i + 1)["minimo"])
    return s.withColumn("separados", apart).drop("r")


@register("pca_kmeans", "R16 A33 A32", survey_sql(f"""
SELECT CAST(4 AS BIGINT) AS clusters, COUNT(*) AS n, TRUE AS faixas_ok FROM survey
WHERE {" AND ".join(c + " IS NOT NULL" for c in NUMERIC)}"""))
def pca_kmeans(spark, d):
    """Clusters on principal components, as an age histogram of 20 bins per cluster."""
    df = materialise(SV.survey(spark, d).select(*[F.col(c).cast("double").alias(c) for c in NUMERIC]), "pca")
    pred = ML.kmeans(df, NUMERIC, k=4, pca_k=2).transform(df)
    rng = pred.agg(F.min("idade").alias("mn"), F.max("idade").alias("mx"))
    b = F.least(F.floor((F.col("idade") - F.col("mn")) * 20.0 / (F.col("mx") - F.col("mn"))).cast("int") + 1,
                F.lit(20))
    hist = pred.join(F.broadcast(rng), how="inner").groupBy("cluster", b.alias("bin")) \
               .agg(F.count(F.lit(1)).alias("n"))
    return hist.agg(F.countDistinct("cluster").alias("clusters"), F.sum("n").alias("n"),
                    F.bool_and(F.col("bin").between(1, 20)).alias("faixas_ok"))


# ---------------------------------------------------------------------------
# the models' values (the queries above check their form against SQL)
# ---------------------------------------------------------------------------

@register("forest_metrics", "R6 R8 R9")
def forest_metrics(spark, d):
    """Test metrics of the forest, as one row."""
    model, t = _fit_forest(spark, d)
    pred = materialise(ML.positive_probability(model.transform(t.filter("split = 'teste'"))).select("label", "y_proba"),
                       "previsoes")
    return MT.classification_report(pred, "label", "y_proba").crossJoin(MT.auc_exact(pred, "label", "y_proba"))   # one row each


@register("logistic_coefficients", "R7")
def logistic_coefficients(spark, d):
    """Standardised coefficients by feature, and the source column of each."""
    t = _ml_table(spark, d)
    return coefficients(ML.logistic(NUMERIC, CATEGORICAL, "peso_classe").fit(ML.require_two_classes(t.filter(TRAIN))), t)


@register("importance_values", "R13")
def importance_values(spark, d):
    model, t = _fit_forest(spark, d, num_trees=10, max_depth=6)
    return importance_table(model, t)


@register("permutation_values", "R14")
def permutation_values(spark, d):
    """F1 drop by permuted column: mean, deviation and quantiles over bootstrap weights."""
    model, t = _fit_forest(spark, d, num_trees=10, max_depth=6)
    return ML.permutation_importance(model, t.filter("split = 'teste'"), NUMERIC + CATEGORICAL, "hk")


@register("cv_values", "R15")
def cv_values(spark, d):
    """Mean AUC over folds of whole quarters, by depth of the trees."""
    t = _ml_table(spark, d)
    t = materialise(ML.group_folds(t, ["ano", "trimestre"], "y_true", FOLDS), "folds")
    pipe = ML.forest(NUMERIC, CATEGORICAL, 10, 4, 5)
    grid = ML.ParamGridBuilder().addGrid(pipe.getStages()[-1].maxDepth, [3, 6]).build()
    cv = ML.cross_validate(t, pipe, grid, "fold")
    rows = [(int(list(pm.values())[0]), float(m), float(s)) for pm, m, s in zip(grid, cv.avgMetrics, cv.stdMetrics)]
    return spark.createDataFrame(rows, "max_depth int, auc_media double, auc_desvio double")


@register("learning_curve_values", "R15")
def learning_curve_values(spark, d):
    """F1 and AUC on training and test rows of forests fitted on growing shares of the training rows."""
    t = _ml_table(spark, d)
    out = None
    for frac in CURVE:
        sub = t.filter(TRAIN).filter(M.uniform(F.col("hk"), F.lit("curva")) < frac)
        m = ML.forest(NUMERIC, CATEGORICAL, 10, 6, 5).fit(ML.require_two_classes(sub))
        for part, rows in (("treino", sub), ("teste", t.filter("split = 'teste'"))):
            pred = materialise(ML.positive_probability(m.transform(rows)).select("label", "y_proba"), "previsoes")
            r = ML.f1_of(pred).crossJoin(MT.auc_exact(pred, "label", "y_proba")).select(                       # one row each
                F.lit(frac).alias("fracao"), F.lit(part).alias("parte"), "f1", "auc")
            out = r if out is None else out.unionByName(r)
    return out


@register("cluster_values", "R16 A33")
def cluster_values(spark, d):
    """Size, mean and range of age by cluster: on age alone, and on two principal components."""
    rows = materialise(SV.survey(spark, d).select("eh_ti", *[F.col(c).cast("double").alias(c) for c in NUMERIC]), "rows")
    it = rows.filter("eh_ti").select("idade")
    parts = [("idade", ML.kmeans(it, ["idade"], k=4).transform(it)),
             ("componentes", ML.kmeans(rows, NUMERIC, k=4, pca_k=2).transform(rows))]
    out = None
    for name, pred in parts:
        r = ML.cluster_summary(pred, "idade").withColumn("modelo", F.lit(name))
        out = r if out is None else out.unionByName(r)
    return out
