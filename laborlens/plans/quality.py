"""Data-quality profiles: coverage, essential columns, column profile, code
coverage, rule differences, reclassification, top codes, suspicious ages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlens import params as P
from laborlens.functions import scalars as X
from laborlens.operators import aggregates as A
from laborlens.operators import quality as QO
from laborlens.plans import feed as FD
from laborlens.plans import registry_plans as RG
from laborlens.plans.registry import register
from laborlens.plans.views import micro, with_views, vinculos, mov, TEST_IT_CODES

# A second (test) IT rule to compare against: shares two codes with TEST_IT_CODES.
RULE_B = ("0011", "0012", "0014", "0023")
_A = ", ".join(f"'{c}'" for c in TEST_IT_CODES)
_B = ", ".join(f"'{c}'" for c in RULE_B)
_KEYS = ["record_id", "l_partkey", "l_suppkey", "l_shipdate"]


def _sql(body: str, views=("micro",), extra: str = "") -> str:
    return with_views(*views, extra=extra) + body


@register("code_rule_diff", "U3 X8", _sql(f"""
SELECT 'a_nao_b' AS direcao, cbo_familia FROM (
  SELECT DISTINCT cbo_familia FROM micro WHERE cbo_familia IN ({_A})
  EXCEPT SELECT DISTINCT cbo_familia FROM micro WHERE cbo_familia IN ({_B}))
UNION ALL
SELECT 'b_nao_a', cbo_familia FROM (
  SELECT DISTINCT cbo_familia FROM micro WHERE cbo_familia IN ({_B})
  EXCEPT SELECT DISTINCT cbo_familia FROM micro WHERE cbo_familia IN ({_A}))"""))
def code_rule_diff(spark, d):
    m = micro(spark, d).select("cbo_familia")
    a = m.filter(X.is_it("cbo_familia", TEST_IT_CODES))
    b = m.filter(X.is_it("cbo_familia", RULE_B))
    return (a.subtract(b).select(F.lit("a_nao_b").alias("direcao"), "cbo_familia")
            .unionByName(b.subtract(a).select(F.lit("b_nao_a").alias("direcao"), "cbo_familia")))


@register("reclassify_matrix", "Q6 X8", _sql(f"""
SELECT eh_ti AS regra_atual, COALESCE(cbo_familia IN ({_B}), false) AS regra_nova, COUNT(*) AS n
FROM micro GROUP BY 1, 2"""))
def reclassify_matrix(spark, d):
    m = micro(spark, d)
    return QO.reclassify(m, "eh_ti", X.is_it("cbo_familia", RULE_B))


@register("degenerate_flag", "Q6", _sql("""
SELECT base, n, n_ti, CASE WHEN n_ti = 0 THEN 'nenhum_ti' WHEN n_ti = n THEN 'todos_ti' ELSE 'ok' END AS status
FROM (SELECT 'pnad' AS base, COUNT(*) AS n, COUNT(CASE WHEN eh_ti THEN 1 END) AS n_ti FROM micro
      UNION ALL SELECT 'rais', COUNT(*), COUNT(CASE WHEN eh_ti THEN 1 END) FROM registry
      UNION ALL SELECT 'caged', COUNT(*), COUNT(CASE WHEN eh_ti THEN 1 END) FROM feed)""",
    views=("micro", "vinculos", "mov"), extra=RG.REGISTRY_SQL + "," + FD.FEED_SQL))
def degenerate_flag(spark, d):
    parts = [("pnad", micro(spark, d)), ("rais", RG.registry(spark, d)), ("caged", FD.feed(spark, d))]
    out = None
    for name, df in parts:
        t = QO.degenerate_flag(df, "eh_ti").select(F.lit(name).alias("base"), "n", "n_ti", "status")
        out = t if out is None else out.unionByName(t)
    return out


@register("top_codes", "T1 T2", _sql("""
SELECT cbo_familia, COUNT(*) AS n, BOOL_OR(eh_ti) AS eh_ti FROM micro
GROUP BY cbo_familia ORDER BY n DESC, cbo_familia LIMIT 10"""))
def top_codes(spark, d):
    return QO.top_values(micro(spark, d), "cbo_familia", 10, flag="eh_ti")


@register("suspicious_ages", "Q7 F2", _sql(f"""
SELECT ano, COUNT(*) AS n, COUNT(CASE WHEN idade < 14 THEN 1 END) AS n_menor_14,
       COUNT(CASE WHEN idade > 100 THEN 1 END) AS n_maior_100,
       COUNT(CASE WHEN eh_ti <> COALESCE(cbo_familia IN ({_B}), false) THEN 1 END) AS n_regras_divergem
FROM micro GROUP BY ano"""))
def suspicious_ages(spark, d):
    m = micro(spark, d)
    return m.groupBy("ano").agg(
        F.count(F.lit(1)).alias("n"), A.count_if(F.col("idade") < 14).alias("n_menor_14"),
        A.count_if(F.col("idade") > 100).alias("n_maior_100"),
        A.count_if(F.col("eh_ti") != X.is_it("cbo_familia", RULE_B)).alias("n_regras_divergem"))


@register("suspicious_sample", "Q7 T4", _sql("""
SELECT record_id, l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS l_shipdate, idade, cbo_familia
FROM micro WHERE idade < 14 ORDER BY record_id, l_partkey, l_suppkey, l_shipdate LIMIT 10"""))
def suspicious_sample(spark, d):
    m = micro(spark, d).filter(F.col("idade") < 14)
    top = m.select(*_KEYS, "idade", "cbo_familia").orderBy(*_KEYS).limit(10)
    return top.withColumn("l_shipdate", F.col("l_shipdate").cast("date"))


@register("prefix_counts", "Q9 X4", _sql("""
SELECT CASE WHEN substr(cbo_familia, 1, 2) IN ('14', '21', '31') THEN substr(cbo_familia, 1, 2)
            ELSE 'outros' END AS prefixo, substr(cbo_familia, 1, 3) AS prefixo3,
       nullif(regexp_extract('CBO ' || cbo_familia || '-05', '([0-9]{4})', 1), '') AS primeira_sequencia,
       COUNT(*) AS n FROM micro GROUP BY 1, 2, 3"""))
def prefix_counts(spark, d):
    m = micro(spark, d)
    p = X.cbo_prefix("cbo_familia", 2)
    written = F.concat(F.lit("CBO "), F.col("cbo_familia"), F.lit("-05"))
    return m.groupBy(F.when(p.isin("14", "21", "31"), p).otherwise("outros").alias("prefixo"),
                     X.cbo_prefix("cbo_familia", 3).alias("prefixo3"),
                     X.cbo_first_run(written).alias("primeira_sequencia")) \
            .agg(F.count(F.lit(1)).alias("n"))


_PROFILE_COLS = ("idade", "sexo", "uf", "cbo_familia", "peso_populacional",
                 "rendimento_trabalho_principal", "anos_estudo")


@register("column_profile", "Q3", _sql(" UNION ALL ".join(
    f"SELECT '{c}' AS coluna, COUNT(*) - COUNT({c}) AS ausentes, COUNT(DISTINCT {c}) AS distintos FROM micro"
    for c in _PROFILE_COLS)))
def column_profile(spark, d):
    return QO.column_profile(micro(spark, d), list(_PROFILE_COLS))


@register("age_profile", "Q3", _sql("""
SELECT MIN(idade) AS idade_min, MAX(idade) AS idade_max, ROUND(AVG(idade), 4) AS idade_media,
       COUNT(CASE WHEN idade > 100 THEN 1 END) AS acima_100 FROM micro"""))
def age_profile(spark, d):
    m = micro(spark, d)
    return m.agg(F.min("idade").alias("idade_min"), F.max("idade").alias("idade_max"),
                 F.round(F.avg("idade"), 4).alias("idade_media"),
                 A.count_if(F.col("idade") > 100).alias("acima_100"))


@register("code_coverage", "Q3 L1", _sql(f"""
SELECT c.codigo, COALESCE(m.n, 0) AS n
FROM (VALUES {', '.join(f"('{x}')" for x in TEST_IT_CODES)}) c(codigo)
LEFT JOIN (SELECT cbo_familia, COUNT(*) AS n FROM micro GROUP BY 1) m ON m.cbo_familia = c.codigo"""))
def code_coverage(spark, d):
    return QO.code_coverage(spark, micro(spark, d), "cbo_familia", TEST_IT_CODES)


@register("missing_ratio", "Q5", _sql(f"""
SELECT ano, ROUND(AVG(CASE WHEN cbo_familia IS NULL THEN 1.0 ELSE 0.0 END), 6) AS razao_sem_familia,
       AVG(CASE WHEN cbo_familia IS NULL THEN 1.0 ELSE 0.0 END) > {P.MISSING_FAMILY_ALERT} AS alerta,
       ROUND(AVG(CASE WHEN eh_ti THEN 1.0 ELSE 0.0 END), 6) AS razao_ti
FROM micro GROUP BY ano"""))
def missing_ratio(spark, d):
    return QO.missing_ratio(micro(spark, d), ["ano"], "cbo_familia", "eh_ti", P.MISSING_FAMILY_ALERT)


def _bases(spark, d):
    return [("pnad", micro(spark, d)), ("rais", vinculos(spark, d)), ("caged", mov(spark, d))]


_ESSENTIAL = {"pnad": P.SURVEY.essential_columns, "rais": ("ano", "idade", "cbo_ocupacao_2002"),
              "caged": P.FEED.essential_columns}


_MICRO_COLS = ("ano", "trimestre", "uf", "idade", "cbo_ocupacao", "peso_populacional")
V_COLS_RAIS = ("ano", "idade")
V_COLS_MOV = ("competencia", "idade", "cbo_ocupacao")


def _essential_sql() -> str:
    src = {"pnad": "micro", "rais": "vinculos", "caged": "mov"}
    present = {"pnad": _MICRO_COLS, "rais": V_COLS_RAIS + ("cbo_ocupacao_2002",), "caged": V_COLS_MOV}
    parts = []
    for base, req in _ESSENTIAL.items():
        for c in req:
            if c in present[base]:
                parts.append(f"SELECT '{base}' AS base, '{c}' AS coluna, true AS presente, "
                             f"COUNT({c}) AS nao_nulos FROM {src[base]}")
            else:
                parts.append(f"SELECT '{base}', '{c}', false, CAST(0 AS BIGINT)")
    return " UNION ALL ".join(parts)


@register("essential_columns", "Q2 P5", _sql(_essential_sql(), views=("micro", "vinculos", "mov")))
def essential_columns(spark, d):
    out = None
    for base, df in _bases(spark, d):
        t = QO.essential_check(df, _ESSENTIAL[base]).select(F.lit(base).alias("base"), "coluna",
                                                           "presente", "nao_nulos")
        out = t if out is None else out.unionByName(t)
    return out


@register("coverage_report", "Q1 A25", _sql("""
SELECT 'pnad' AS base, COUNT(*) AS linhas, COUNT(DISTINCT ano) AS anos, true AS tem_eh_ti,
       CASE WHEN COUNT(*) > 0 THEN 'ok' ELSE 'vazio' END AS status FROM micro
UNION ALL SELECT 'rais', COUNT(*), COUNT(DISTINCT ano), true, CASE WHEN COUNT(*) > 0 THEN 'ok' ELSE 'vazio' END
FROM registry
UNION ALL SELECT 'caged', COUNT(*), COUNT(DISTINCT ano), true, CASE WHEN COUNT(*) > 0 THEN 'ok' ELSE 'vazio' END
FROM feed""", views=("micro", "vinculos", "mov"), extra=RG.REGISTRY_SQL + "," + FD.FEED_SQL))
def coverage_report(spark, d):
    parts = [("pnad", micro(spark, d)), ("rais", RG.registry(spark, d)), ("caged", FD.feed(spark, d))]
    out = None
    for name, df in parts:
        t = QO.coverage(df).select(F.lit(name).alias("base"), "linhas", "anos", "tem_eh_ti", "status")
        out = t if out is None else out.unionByName(t)
    return out


__all__ = ["DataFrame"]
