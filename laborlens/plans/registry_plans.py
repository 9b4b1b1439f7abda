"""Employer-registry normalisation, group aggregates, the re-aggregation
hierarchy, and survey <-> registry joins (coverage, key fallback, agreement)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laborlens import params as P
from laborlens.functions import scalars as X
from laborlens.operators import aggregates as A
from laborlens.operators import quantiles as Q
from laborlens.operators import schema as SC
from laborlens.operators.joins import enrich
from laborlens.plans.registry import register
from laborlens.plans.views import vinculos, with_views, TEST_IT_CODES, micro
from laborlens.session import materialise

KEYS = ["ano", "uf", "eh_ti"]


def normalize_registry(v: DataFrame, it_codes=P.IT_CODES_REGISTRY) -> DataFrame:
    """X22 bundle: headers (P2), occupation column (P3), first-candidate picks (P4),
    state from municipality (X6), sex (X10), education (X11), family + IT (X2, X8),
    link status (X13/X14), numerics (X1)."""
    v = SC.resolve_occupation_column(SC.normalize_headers(v))
    mun, sexo = SC.pick(v, P.MUN_CANDIDATES), SC.pick(v, P.SEX_CANDIDATES)
    esc, sal = SC.pick(v, P.EDU_CANDIDATES), SC.pick(v, P.SAL_CANDIDATES)
    ativo, sit = SC.pick(v, P.ACTIVE_CANDIDATES), SC.pick(v, P.SITUATION_CANDIDATES)
    # stage 1: the regex-heavy text parts, once per row
    stage1 = {
        "_mun": X.municipio_digits(mun) if mun else F.lit(None).cast("string"),
        "_esc_num": X.to_number(esc) if esc else F.lit(None).cast("double"),
        "_esc_txt": X.normalize_text(esc) if esc else F.lit(None).cast("string"),
        "_fam": X.cbo_family("cbo_ocupacao") if "cbo_ocupacao" in v.columns else F.lit(None).cast("string"),
    }
    v = v.withColumns(stage1)
    uf = X.uf_from_municipio(None, "_mun") if mun else (X.uf_code("uf") if "uf" in v.columns
                                                       else F.lit(None).cast("int"))
    return v.select(
        X.to_number("ano", to_int=True).cast("int").alias("ano"),
        X.to_number("idade").alias("idade"),
        uf.alias("uf"),
        (X.sex_norm(sexo) if sexo else F.lit(None).cast("string")).alias("sexo"),
        X.education_level_parts("_esc_num", "_esc_txt").alias("escolaridade"),
        F.col("_fam").alias("cbo_familia"),
        X.is_it("_fam", it_codes).alias("eh_ti"),
        X.link_status(flag=ativo, situation=sit).alias("ativo_3112"),
        (X.parse_locale_number(sal) if sal else F.lit(None).cast("double")).alias("salario"),
    )


def registry(spark, d) -> DataFrame:
    return normalize_registry(vinculos(spark, d), TEST_IT_CODES)


_IT = ", ".join(f"'{c}'" for c in TEST_IT_CODES)
_EDU_SQL = "CASE TRY_CAST(trim(escolaridade_apos_2005) AS DOUBLE) " + " ".join(
    f"WHEN {k} THEN '{v}'" for k, v in P.REGISTRY_SCHOOLING.items()) + " END"
_TRUE = ", ".join(f"'{x}'" for x in P.FLAG_TRUE)
_FALSE = ", ".join(f"'{x}'" for x in P.FLAG_FALSE)

REGISTRY_SQL = f"""
registry AS (
  SELECT CAST(TRY_CAST(trim(ano) AS DOUBLE) AS INT) AS ano,
         TRY_CAST(trim(idade) AS DOUBLE) AS idade,
         CAST(substr(lpad(regexp_replace(trim(mun_trab), '\\D+', '', 'g'),
              CAST(greatest(6, length(regexp_replace(trim(mun_trab), '\\D+', '', 'g'))) AS INT), '0'), 1, 2) AS INT) AS uf,
         CASE lower(trim(sexo_trabalhador)) WHEN '1' THEN 'M' WHEN '2' THEN 'F' WHEN 'm' THEN 'M'
              WHEN 'f' THEN 'F' WHEN 'masc' THEN 'M' WHEN 'fem' THEN 'F' WHEN 'masculino' THEN 'M'
              WHEN 'feminino' THEN 'F' ELSE lower(trim(sexo_trabalhador)) END AS sexo,
         {_EDU_SQL} AS escolaridade,
         cbo_familia, COALESCE(cbo_familia IN ({_IT}), false) AS eh_ti,
         CASE WHEN lower(trim("vinculo_ativo_31/12")) IN ({_TRUE}) THEN 1
              WHEN lower(trim("vinculo_ativo_31/12")) IN ({_FALSE}) THEN 0 END AS ativo_3112,
         TRY_CAST(trim(vl_remun_media_nom) AS DOUBLE) AS salario
  FROM (SELECT *, NULLIF(lpad(NULLIF(regexp_replace(regexp_replace(trim(cbo_ocupacao_2002), '\\.0+$', ''),
                    '[^0-9]', '', 'g'), ''), 4, '0'), '0000') AS cbo_familia FROM vinculos))"""


def _sql(body: str, extra: str = "", views=("vinculos",)) -> str:
    return with_views(*views, extra=REGISTRY_SQL + ("," + extra if extra else "")) + body


def _r(c, places=4):
    return F.round(c.cast("double"), places)


def group_aggregate(df: DataFrame, keys: list[str]) -> DataFrame:
    """N, active rate (mean of the 0/1 status) and median salary per key
    (nulls kept as groups); the median is exact and distributed."""
    # one shuffle of the rows: a table per (keys, salary) that carries every
    # measure; the group stats and the exact median both come from it
    vt = df.groupBy(*keys, "salario").agg(F.count(F.lit(1)).alias("_n"),
                                         F.sum("ativo_3112").alias("_sa"),
                                         F.count("ativo_3112").alias("_ca"))
    vt = materialise(vt, "grupos")           # read by the sums and by each level of the median
    base = vt.groupBy(*keys).agg(F.sum("_n").alias("n"),
                                 (F.sum("_sa") / F.sum("_ca")).alias("taxa_ativo"))
    med = Q.exact_percentiles(vt, keys, "salario", [0.5], count_col="_n") \
           .withColumnRenamed("p0_5", "salario_mediana")
    return A.join_null_safe(base, med, keys, "left")


_GROUPS_SQL = """
grp AS (SELECT ano, uf, eh_ti, COUNT(*) AS n, AVG(ativo_3112) AS taxa_ativo,
               quantile_cont(salario, 0.5) AS salario_mediana FROM registry GROUP BY ano, uf, eh_ti)"""


@register("registry_groups", "A27 P2 P3 P4 X1 X5 X6 X10 X11 X13 X14 X22", _sql("""
SELECT ano, uf, eh_ti, n, ROUND(taxa_ativo, 6) AS taxa_ativo, ROUND(salario_mediana, 4) AS salario_mediana
FROM grp""", extra=_GROUPS_SQL))
def registry_groups(spark, d):
    g = group_aggregate(registry(spark, d), KEYS)
    return g.select(*KEYS, "n", _r(F.col("taxa_ativo"), 6).alias("taxa_ativo"),
                    _r(F.col("salario_mediana")).alias("salario_mediana"))


# Registry rows as older files have them: schooling and situation as text, money in locale form.
EDU_TEXT = ("Analfabeto", "Até 5ª incompleto", "5ª completo fundamental", "6ª a 9ª fundamental", "Fundamental completo",
            "Médio incompleto", "Médio completo", "Superior incompleto", "Superior completo", "Mestrado", "Doutorado")
EDU_EXPECTED = ("fundamental_incompleto", "fundamental_incompleto", "fundamental_completo", "fundamental_incompleto",
                "fundamental_completo", "medio_incompleto", "medio_completo", "superior_incompleto", "superior_completo",
                "pos_graduacao", "pos_graduacao")


@register("registry_profile", "T2 X10 X11 X14 X15 X22", _sql(f"""
SELECT sexo, escolaridade, ativo, n, soma_salario, CASE escolaridade {" ".join(
    f"WHEN '{v}' THEN {k}" for k, v in enumerate(P.SCHOOLING_LEVELS))} END AS ordem FROM (
SELECT sexo, CASE CAST(escolaridade_apos_2005 AS INT) {" ".join(f"WHEN {k + 1} THEN '{v}'" for k, v in enumerate(EDU_EXPECTED))} END
         AS escolaridade, CASE "vinculo_ativo_31/12" WHEN 'SIM' THEN 1 ELSE 0 END AS ativo, COUNT(*) AS n,
       ROUND(SUM(TRY_CAST(vl_remun_media_nom AS DOUBLE)), 2) AS soma_salario
FROM (SELECT *, CASE sexo_trabalhador WHEN '1' THEN 'M' WHEN '2' THEN 'F' WHEN 'masculino' THEN 'M' WHEN 'F' THEN 'F' END AS sexo
      FROM vinculos) GROUP BY 1, 2, 3)"""))
def registry_profile(spark, d):
    """Counts and salary sums by sex, schooling and link status, all read from text values."""
    text = F.array(*[F.lit(t) for t in EDU_TEXT])
    old = vinculos(spark, d).select(
        "ano", "idade", "mun_trab", "cbo_ocupacao_2002", "sexo_trabalhador",
        F.element_at(text, F.col("escolaridade_apos_2005").cast("int")).alias("grau_instrucao"),
        F.when(F.col("vinculo_ativo_31/12") == "SIM", "Vínculo Ativo").otherwise("Desligado").alias("situacao_vinculo"),
        F.translate(F.format_number(F.col("vl_remun_media_nom").cast("double"), 2), ",.", ".,").alias("salario"))
    reg = normalize_registry(old, TEST_IT_CODES)
    return reg.groupBy("sexo", "escolaridade", F.col("ativo_3112").alias("ativo")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("salario"), 2).alias("soma_salario")) \
        .withColumn("ordem", X.education_rank("escolaridade"))


def rollup_hierarchy(full: DataFrame) -> DataFrame:
    """Full -> (uf, eh_ti) -> (ano, eh_ti): Σn, unweighted mean of rates,
    median of medians (re-aggregation of the aggregate table, as specified)."""
    out = full.select(F.lit("full").alias("nivel"), *KEYS, "n", "taxa_ativo", "salario_mediana")
    for nivel, keys in (("uf", ["uf", "eh_ti"]), ("ano", ["ano", "eh_ti"])):
        s = full.groupBy(*keys).agg(F.sum("n").alias("n"), F.avg("taxa_ativo").alias("taxa_ativo"))
        m = Q.exact_percentiles(full, keys, "salario_mediana", [0.5]) \
             .withColumnRenamed("p0_5", "salario_mediana")
        lvl = A.join_null_safe(s, m, keys, "left")
        missing = [k for k in KEYS if k not in keys]
        lvl = lvl.withColumns({k: F.lit(None).cast("int") for k in missing})
        out = out.unionByName(lvl.select(F.lit(nivel).alias("nivel"), *KEYS, "n", "taxa_ativo",
                                         "salario_mediana"))
    return out


@register("registry_rollup", "A27 A28", _sql("""
SELECT nivel, ano, uf, eh_ti, CAST(n AS BIGINT) AS n, ROUND(taxa_ativo, 6) AS taxa_ativo,
       ROUND(salario_mediana, 4) AS salario_mediana FROM (
  SELECT 'full' AS nivel, ano, uf, eh_ti, n, taxa_ativo, salario_mediana FROM grp
  UNION ALL SELECT 'uf', NULL, uf, eh_ti, SUM(n), AVG(taxa_ativo), quantile_cont(salario_mediana, 0.5)
            FROM grp GROUP BY uf, eh_ti
  UNION ALL SELECT 'ano', ano, NULL, eh_ti, SUM(n), AVG(taxa_ativo), quantile_cont(salario_mediana, 0.5)
            FROM grp GROUP BY ano, eh_ti)""", extra=_GROUPS_SQL))
def registry_rollup(spark, d):
    # the full-key aggregate is read three times (itself + two coarser levels):
    # checkpoint it (bounded by the key domain) to the shared folder, cutting
    # the lineage instead of re-deriving it from the rows
    full = group_aggregate(registry(spark, d), KEYS).checkpoint()
    h = rollup_hierarchy(full)
    return h.select("nivel", F.col("ano").cast("int").alias("ano"), F.col("uf").cast("int").alias("uf"),
                    "eh_ti", F.col("n").cast("long").alias("n"),
                    _r(F.col("taxa_ativo"), 6).alias("taxa_ativo"),
                    _r(F.col("salario_mediana")).alias("salario_mediana"))


@register("registry_rollup_exact", "A28", _sql("""
SELECT ano, uf, eh_ti, COUNT(*) AS n, ROUND(AVG(ativo_3112), 6) AS taxa_ativo,
       ROUND(AVG(salario), 5) AS salario_medio
FROM registry GROUP BY GROUPING SETS ((ano, uf, eh_ti), (uf, eh_ti), (ano, eh_ti))"""))
def registry_rollup_exact(spark, d):
    """Row-level grouping-sets variant (one scan, one shuffle for all three levels)."""
    r = registry(spark, d)
    g = r.groupingSets([["ano", "uf", "eh_ti"], ["uf", "eh_ti"], ["ano", "eh_ti"]], *KEYS)
    return g.agg(F.count(F.lit(1)).alias("n"), _r(F.avg("ativo_3112"), 6).alias("taxa_ativo"),
                 _r(F.avg("salario"), 5).alias("salario_medio"))


@register("usable_keys", "P8", _sql("""
SELECT k AS chave FROM (
  SELECT 'ano' AS k, COUNT(ano) AS c FROM registry UNION ALL SELECT 'uf', COUNT(uf) FROM registry
  UNION ALL SELECT 'eh_ti', COUNT(eh_ti) FROM registry UNION ALL SELECT 'sexo_raw', COUNT(NULL) FROM registry)
WHERE c > 0"""))
def usable_keys(spark, d):
    """Candidate keys with at least one non-null value (one aggregate pass);
    the list drives which keys a registry aggregate is grouped on."""
    reg = registry(spark, d).withColumn("sexo_raw", F.lit(None).cast("string"))
    keys = SC.non_empty_columns(reg, KEYS + ["sexo_raw"])
    return reg.sparkSession.createDataFrame([(k,) for k in keys], "chave string")


# ---------------------------------------------------------------------------
# survey <-> registry
# ---------------------------------------------------------------------------

def _survey_keys(spark, d) -> DataFrame:
    from laborlens.plans.survey import survey
    return survey(spark, d)


_SURVEY_CTE = "survey AS (SELECT * FROM micro WHERE idade BETWEEN 14 AND 80)"


@register("enriched_survey", "L2 A27", _sql("""
SELECT s.record_id, s.ano, s.uf, s.eh_ti, g.n AS n_raisagg, ROUND(g.taxa_ativo, 6) AS taxa_ativo_raisagg,
       ROUND(g.salario_mediana, 4) AS salario_mediana_raisagg
FROM survey s LEFT JOIN grp g
  ON s.ano IS NOT DISTINCT FROM g.ano AND s.uf IS NOT DISTINCT FROM g.uf AND s.eh_ti IS NOT DISTINCT FROM g.eh_ti""",
    extra=_GROUPS_SQL + "," + _SURVEY_CTE, views=("vinculos", "micro")))
def enriched_survey(spark, d):
    s = _survey_keys(spark, d).select("record_id", *KEYS)
    g = materialise(group_aggregate(registry(spark, d), KEYS), "agregado")
    e = enrich(s, g, KEYS, "_raisagg")
    return e.select("record_id", *KEYS, "n_raisagg",
                    _r(F.col("taxa_ativo_raisagg"), 6).alias("taxa_ativo_raisagg"),
                    _r(F.col("salario_mediana_raisagg")).alias("salario_mediana_raisagg"))


@register("join_coverage", "L2 L3", _sql("""
SELECT ROUND(AVG(CASE WHEN g.n IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS cobertura_n,
       ROUND(AVG(CASE WHEN g.taxa_ativo IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS cobertura_taxa_ativo,
       ROUND(AVG(CASE WHEN g.salario_mediana IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS cobertura_salario_mediana,
       COUNT(*) AS linhas
FROM survey s LEFT JOIN grp g
  ON s.ano IS NOT DISTINCT FROM g.ano AND s.uf IS NOT DISTINCT FROM g.uf AND s.eh_ti IS NOT DISTINCT FROM g.eh_ti""",
    extra=_GROUPS_SQL + "," + _SURVEY_CTE, views=("vinculos", "micro")))
def join_coverage(spark, d):
    s = _survey_keys(spark, d).select(*KEYS)
    e = enrich(s, group_aggregate(registry(spark, d), KEYS), KEYS, "_raisagg")
    cov = [_r(F.avg(F.col(f"{c}_raisagg").isNotNull().cast("double")), 6).alias(f"cobertura_{c}")
           for c in ("n", "taxa_ativo", "salario_mediana")]
    return e.agg(*cov, F.count(F.lit(1)).alias("linhas"))


@register("years_in_both", "U2", _sql("""
SELECT ano FROM survey WHERE ano IS NOT NULL INTERSECT SELECT ano FROM registry WHERE ano IS NOT NULL""",
    extra=_SURVEY_CTE, views=("vinculos", "micro")))
def years_in_both(spark, d):
    a = _survey_keys(spark, d).select("ano").dropna()
    b = registry(spark, d).select("ano").dropna()
    return a.intersect(b)


# predictions grouped on keys (A29) and joined to registry aggregates with key fallback

def grouped_predictions(pred: DataFrame, keys: list[str]) -> DataFrame:
    """n_obs and mean probability per key."""
    return pred.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_obs"),
                                   F.avg("y_proba").alias("prob_media"))


def harmonize_keys(df: DataFrame) -> DataFrame:
    """Same key types on both sides (year int, state code int, IT flag boolean)."""
    out = df
    if "ano" in df.columns:
        out = out.withColumn("ano", X.to_number("ano", to_int=True).cast("int"))
    if "uf" in df.columns:
        out = out.withColumn("uf", X.uf_code("uf"))
    if "eh_ti" in df.columns:
        out = out.withColumn("eh_ti", F.col("eh_ti").cast("boolean"))
    return out


KEY_LEVELS = (("full", ["ano", "uf", "eh_ti"]), ("uf", ["uf", "eh_ti"]), ("ano", ["ano", "eh_ti"]))


def merge_best_keys(pred: DataFrame, reg: DataFrame) -> DataFrame:
    """L4: inner join on the finest key set that matches anything.  The decision
    is one `isEmpty()` per level on the small aggregated join (driver action on
    aggregates, never on rows)."""
    full = group_aggregate(reg, KEYS).checkpoint()      # reused by every key level
    hier = rollup_hierarchy(full)
    for nivel, keys in KEY_LEVELS:
        p = harmonize_keys(grouped_predictions(pred, keys))
        r = harmonize_keys(hier.filter(F.col("nivel") == nivel).select(*keys, "taxa_ativo", "n"))
        j = p.join(r, keys, "inner")
        if not j.isEmpty():
            return j.withColumn("nivel", F.lit(nivel))
    return p.join(r, keys, "inner").withColumn("nivel", F.lit("none"))


@register("keys_fallback", "A29 L4 L5", _sql("""
SELECT 'full' AS nivel, p.ano, p.uf, p.eh_ti, p.n_obs, ROUND(p.prob_media, 9) AS prob_media,
       ROUND(g.taxa_ativo, 6) AS taxa_ativo
FROM (SELECT ano, uf, eh_ti, COUNT(*) AS n_obs, AVG(y_proba) AS prob_media FROM survey GROUP BY 1, 2, 3) p
JOIN grp g ON p.ano = g.ano AND p.uf = g.uf AND p.eh_ti = g.eh_ti""",
    extra=_GROUPS_SQL + "," + _SURVEY_CTE, views=("vinculos", "micro")))
def keys_fallback(spark, d):
    j = merge_best_keys(_survey_keys(spark, d), registry(spark, d))
    return j.select("nivel", "ano", "uf", "eh_ti", "n_obs", _r(F.col("prob_media"), 9).alias("prob_media"),
                    _r(F.col("taxa_ativo"), 6).alias("taxa_ativo"))


def agreement(j: DataFrame, a: str = "prob_media", b: str = "taxa_ativo") -> DataFrame:
    """Pearson, Spearman (Pearson of average ranks), MAE, RMSE over the
    joined key table (one row per key: bounded by the key domain)."""
    allw = Window.partitionBy(F.lit(0))
    j = j.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    for c in (a, b):
        rk = F.rank().over(allw.orderBy(c))
        ties = F.count(F.lit(1)).over(Window.partitionBy(c))
        j = j.withColumn(f"_rk_{c}", rk + (ties - 1) / 2.0)
    dif = F.col(a) - F.col(b)
    return j.agg(F.count(F.lit(1)).alias("n"), _r(F.corr(a, b), 6).alias("pearson"),
                 _r(F.corr(f"_rk_{a}", f"_rk_{b}"), 6).alias("spearman"),
                 _r(F.avg(F.abs(dif)), 6).alias("mae"), _r(F.sqrt(F.avg(dif * dif)), 6).alias("rmse"))


@register("rate_agreement", "R3 L4", _sql("""
SELECT COUNT(*) AS n, ROUND(corr(prob_media, taxa_ativo), 6) AS pearson,
       ROUND(corr(ra, rb), 6) AS spearman, ROUND(AVG(abs(prob_media - taxa_ativo)), 6) AS mae,
       ROUND(sqrt(AVG((prob_media - taxa_ativo) * (prob_media - taxa_ativo))), 6) AS rmse
FROM (SELECT *, RANK() OVER (ORDER BY prob_media) + (COUNT(*) OVER (PARTITION BY prob_media) - 1) / 2.0 AS ra,
             RANK() OVER (ORDER BY taxa_ativo) + (COUNT(*) OVER (PARTITION BY taxa_ativo) - 1) / 2.0 AS rb
      FROM (SELECT p.prob_media, g.taxa_ativo
            FROM (SELECT ano, uf, eh_ti, AVG(y_proba) AS prob_media FROM survey GROUP BY 1, 2, 3) p
            JOIN grp g ON p.ano = g.ano AND p.uf = g.uf AND p.eh_ti = g.eh_ti)
      WHERE prob_media IS NOT NULL AND taxa_ativo IS NOT NULL)""",
    extra=_GROUPS_SQL + "," + _SURVEY_CTE, views=("vinculos", "micro")))
def rate_agreement(spark, d):
    return agreement(merge_best_keys(_survey_keys(spark, d), registry(spark, d)))


__all__ = ["registry", "REGISTRY_SQL", "micro"]
