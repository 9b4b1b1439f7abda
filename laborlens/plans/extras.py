"""Record repair, text / flag normalisation, targets, weight normalisation,
ML table dummies, file-name rules and the report sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from laborlens import params as P
from laborlens.functions import scalars as X
from laborlens.operators import filters as FL
from laborlens.operators import quantiles as Q
from laborlens.operators import schema as SC
from laborlens.plans import feed as FD
from laborlens.plans import survey as SV
from laborlens.plans.files import _fixture
from laborlens.plans.registry import register
from laborlens.plans.sqlbits import survey_sql
from laborlens.plans.views import micro, mov, with_views, test_wage, TEST_N_WAGES
from laborlens.session import materialise, scratch_path
from laborlens.sources import files as FS
from laborlens.sources import sinks as K
from laborlens.operators.aggregates import count_if, weighted_summary


@register("repair", "P13 P9 X3 X9 X15 X16", with_views("micro") + """
SELECT ano, COUNT(right(lpad(regexp_replace(p, '[^0-9]', '', 'g'),
                 CAST(greatest(4, length(regexp_replace(p, '[^0-9]', '', 'g'))) AS INT), '0'), 4)) AS n_cbo_norm,
       CAST(SUM(carteira_assinada) AS BIGINT) AS soma_carteira,
       COUNT(CASE WHEN forca_trabalho = 1 OR ocupado = 1 THEN 1 END) AS n_empregado,
       ROUND(SUM(peso_populacional), 4) AS soma_peso, COUNT(DISTINCT CAST(curso_mais_elevado AS STRING)) AS n_cursos,
       ROUND(AVG(rendimento_trabalho_principal), 4) AS renda_media
FROM (SELECT *, cbo_ocupacao AS p FROM micro) GROUP BY ano""")
def repair(spark, d):
    df = SC.coerce_income_columns(SC.repair_projection(micro(spark, d)))
    return df.groupBy("ano").agg(
        F.count("cbo_norm").alias("n_cbo_norm"), F.sum("carteira_assinada_norm").cast("long").alias("soma_carteira"),
        count_if(F.col("employed_derived")).alias("n_empregado"),
        F.round(F.sum("peso_parsed"), 4).alias("soma_peso"), F.countDistinct("v3009_merged").alias("n_cursos"),
        F.round(F.avg("rendimento_trabalho_principal"), 4).alias("renda_media"))


_UF_CASE = "CASE uf " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in P.UF_CODE_TO_SIGLA.items()) + " END"


@register("norm_text", "X7 X12", with_views("micro") + f"""
SELECT trim(regexp_replace(regexp_replace(upper(strip_accents(trim(uf_nome))), '[^A-Z0-9\\s.]', ' ', 'g'),
            '\\s+', ' ', 'g')) AS nome_norm, {_UF_CASE} AS sigla, COUNT(*) AS n
FROM micro GROUP BY 1, 2""")
def norm_text(spark, d):
    m = micro(spark, d)
    return m.groupBy(X.normalize_text("uf_nome").alias("nome_norm"), X.uf_sigla("uf").alias("sigla")) \
            .agg(F.count(F.lit(1)).alias("n"))


@register("targets", "X21 F12", survey_sql(f"""
SELECT ano, COUNT(*) AS n,
       CAST(SUM(CASE WHEN rendimento_trabalho_principal IS NOT NULL AND rendimento_trabalho_principal
                      >= {TEST_N_WAGES}.0 * (10000.0 + 500.0 * (ano - 1995)) THEN 1 ELSE 0 END) AS BIGINT) AS alvo_renda,
       COUNT(rendimento_trabalho_principal) AS alvo_renda_definido,
       COUNT(CASE WHEN ocupado = 1 THEN 1 END) AS alvo_ocupado,
       COUNT(CASE WHEN carteira_assinada = 1 THEN 1 END) AS alvo_carteira,
       COUNT(CASE WHEN horas_trabalhadas_semana >= 44 THEN 1 END) AS alvo_horas
FROM survey WHERE eh_ti GROUP BY ano"""))
def targets(spark, d):
    df = SV.survey(spark, d)
    # IT scope unless the IT scope holds a single class (then the whole population)
    it = df.filter(F.col("eh_ti"))
    scope = it if it.select("y_true").distinct().limit(2).count() > 1 else df
    wage = test_wage("ano")
    return scope.groupBy("ano").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(X.income_target("rendimento_trabalho_principal", wage, TEST_N_WAGES, "zero")).cast("long")
        .alias("alvo_renda"),
        F.count(X.income_target("rendimento_trabalho_principal", wage, TEST_N_WAGES, "drop"))
        .alias("alvo_renda_definido"),
        count_if(F.col("ocupado") == 1).alias("alvo_ocupado"),
        count_if(F.col("carteira_assinada") == 1).alias("alvo_carteira"),
        count_if(F.col("horas_trabalhadas_semana") >= 44).alias("alvo_horas"))


@register("sample_weights", "X26", survey_sql("""
SELECT ano, COUNT(*) AS n, ROUND(SUM(w2 / m), 6) AS soma_peso_norm FROM (
  SELECT ano, w2, AVG(w2) OVER () AS m FROM (
    SELECT ano, CASE WHEN COALESCE(peso_populacional, 0) > 0 THEN peso_populacional
                     ELSE (SELECT quantile_cont(peso_populacional, 0.5) FROM survey WHERE peso_populacional > 0)
                END AS w2 FROM survey)) GROUP BY ano"""))
def sample_weights(spark, d):
    w = F.when(F.isnan("peso_populacional") | F.col("peso_populacional").isNull(), F.lit(0.0)) \
         .otherwise(F.col("peso_populacional"))
    # median, mean and sums all come from one (year, weight, rows) table
    t = materialise(SV.survey(spark, d).groupBy("ano", w.alias("_w")).agg(F.count(F.lit(1)).alias("_n")), "pesos")
    med = Q.exact_percentiles(t.filter(F.col("_w") > 0), [], "_w", [0.5], count_col="_n") \
           .withColumnRenamed("p0_5", "_med")
    j = t.join(F.broadcast(med), how="inner")                          # one-row scalar
    j = j.withColumn("_w2", F.when(F.col("_w") > 0, F.col("_w")).otherwise(F.col("_med")))
    mean = j.agg((F.sum(F.col("_w2") * F.col("_n")) / F.sum("_n")).alias("_mean"))
    j = j.join(F.broadcast(mean), how="inner")                         # one-row scalar
    return j.groupBy("ano").agg(F.sum("_n").alias("n"),
                                F.round(F.sum(F.col("_w2") * F.col("_n") / F.col("_mean")), 6).alias("soma_peso_norm"))


_WAGE_SQL = "CASE ano + 20 " + " ".join(f"WHEN {k} THEN {float(v)}e0" for k, v in P.MINIMUM_WAGE.items()) + " END"


@register("targets_wage", "X21", survey_sql(f"""
SELECT ano, COUNT(*) AS n, COUNT(CASE WHEN eh_ti THEN 1 END) AS alvo_ti,
       COUNT(CASE WHEN rendimento_trabalho_principal IS NOT NULL AND {_WAGE_SQL} IS NOT NULL THEN 1 END) AS definido,
       CAST(COALESCE(SUM(CASE WHEN rendimento_trabalho_principal / 20 > 10 * {_WAGE_SQL} THEN 1 ELSE 0 END), 0) AS BIGINT) AS alvo_10sm
FROM survey GROUP BY ano"""))
def targets_wage(spark, d):
    """The IT target and income above ten minimum wages, with the real wage table."""
    df = SV.survey(spark, d)
    wage = X.minimum_wage(F.col("ano") + 20)                 # the test years lie before the table
    income = F.col("rendimento_trabalho_principal") / 20
    high = X.above_wages(income, wage, 10)
    return df.groupBy("ano").agg(F.count(F.lit(1)).alias("n"), count_if(F.col("eh_ti")).alias("alvo_ti"),
                                 F.count(high).alias("definido"),
                                 F.coalesce(F.sum(high), F.lit(0)).cast("long").alias("alvo_10sm"))


_DUMMY = {"sexo": [1, 2], "nivel_instrucao": [1, 2, 3, 4, 5], "uf": list(range(11, 36))}


@register("ml_table", "P10 P11 F1", survey_sql(" UNION ALL ".join(
    [f"SELECT '{c}_{v}' AS dummy, CAST(COUNT(CASE WHEN {c} = {v} THEN 1 END) AS BIGINT) AS n FROM t"
     for c, vs in _DUMMY.items() for v in vs]
    + [f"SELECT '{c}_nulo', CAST(COUNT(CASE WHEN {c} IS NULL THEN 1 END) AS BIGINT) FROM t" for c in _DUMMY]),
    extra="t AS (SELECT * FROM survey WHERE idade BETWEEN 35 AND 55)"))
def ml_table(spark, d):
    df = SV.survey(spark, d).filter(F.col("idade").between(35, 55))
    num, cat = SC.feature_projection(df, ["idade", "anos_estudo"], list(_DUMMY), ("y_true",))
    dummies = [F.when(F.col(c) == v, 1).otherwise(0).alias(f"{c}_{v}") for c in cat for v in _DUMMY[c]]
    dummies += [F.when(F.col(c).isNull(), 1).otherwise(0).alias(f"{c}_nulo") for c in cat]
    t = df.select(*num, *dummies, F.col("y_true").alias("label"))
    names = [c for c in t.columns if c not in num and c != "label"]
    row = t.agg(*[F.sum(c).cast("long").alias(c) for c in names])
    return row.unpivot([], names, "dummy", "n")


def _typed_dir(spark, d) -> str:
    def build():
        kind = F.element_at(F.array(F.lit("MOV"), F.lit("FOR"), F.lit("EXC")),
                            (F.col("event_id") % 3 + 1).cast("int"))
        f = FD.feed(spark, d).withColumn(
            "arquivo_nome", F.concat(F.lit("CAGED"), kind, F.lit("202401_"),
                                     F.when(F.col("eh_ti"), "ti").otherwise("nao_ti")))
        return K.write_dataset(f.select("event_id", "idade", "competencia", "arquivo_nome"),
                               scratch_path(spark, "typed"), partition_by=("arquivo_nome",))
    return _fixture(spark, d, "typed", build)


@register("file_type_filter", "F11 S12", with_views("mov", extra=FD.FEED_SQL) + """
SELECT CAST(eh_ti AS INT) AS flag_nome, COUNT(*) AS n FROM feed WHERE event_id % 3 = 0 GROUP BY 1""")
def file_type_filter(spark, d):
    df = spark.read.parquet(_typed_dir(spark, d)).withColumn("arquivo", F.col("_metadata.file_path"))
    kept = FL.file_type(df, ("MOV",), "arquivo")
    return kept.groupBy(FS.flag_from_name("arquivo_nome").alias("flag_nome")).agg(F.count(F.lit(1)).alias("n"))


@register("report_sink", "K5 A12", survey_sql("""
SELECT ROUND(proporcao_ti_ponderada, 6) AS proporcao_ti_ponderada,
       ROUND(idade_media_ti_ponderada, 4) AS idade_media_ti_ponderada,
       ROUND(idade_media_outros_ponderada, 4) AS idade_media_outros_ponderada FROM (
  SELECT SUM(CASE WHEN peso_populacional > 0 THEN CAST(eh_ti AS INT) * peso_populacional END)
           / SUM(CASE WHEN peso_populacional > 0 THEN peso_populacional END) AS proporcao_ti_ponderada,
         SUM(CASE WHEN eh_ti AND idade IS NOT NULL AND peso_populacional > 0 THEN idade * peso_populacional END)
           / SUM(CASE WHEN eh_ti AND idade IS NOT NULL AND peso_populacional > 0 THEN peso_populacional END)
           AS idade_media_ti_ponderada,
         SUM(CASE WHEN NOT eh_ti AND idade IS NOT NULL AND peso_populacional > 0 THEN idade * peso_populacional END)
           / SUM(CASE WHEN NOT eh_ti AND idade IS NOT NULL AND peso_populacional > 0 THEN peso_populacional END)
           AS idade_media_outros_ponderada FROM survey)"""))
def report_sink(spark, d):
    """The report written as JSON and, with a time in its name, as CSV; both read back alike."""
    t = materialise(weighted_summary(SV.survey(spark, d)), "resumo")
    j = spark.read.json(K.write_report(t, scratch_path(spark, "report"), "json"))
    path = K.write_report(t, scratch_path(spark, "report"), "csv", stamp="2024-01-31T10:00:00")
    text = spark.read.schema(", ".join(f"`{c}` STRING" for c in t.columns)).option("header", "true").csv(path)
    both = j.select(*[F.col(c).cast("double").alias(c) for c in t.columns]).unionByName(
        text.select(*[F.col(c).cast("double").alias(c) for c in t.columns]))
    cols = ["proporcao_ti_ponderada", "idade_media_ti_ponderada", "idade_media_outros_ponderada"]
    same = both.agg(*[F.max(c).alias(c) for c in cols], *[(F.max(c) - F.min(c)).alias(f"d_{c}") for c in cols]) \
               .filter(" AND ".join(f"d_{c} < 1e-9" for c in cols))
    return same.select(F.round(cols[0], 6).alias(cols[0]), *[F.round(c, 4).alias(c) for c in cols[1:]])


__all__ = ["mov"]
