"""Sampling and splitting (M1-M9, A35) over the survey view.

Rows are ordered by a uniform key, the first 60 bits of the MD5 of the columns that
identify a row (order and line number repeat in the test tables, so the part, the
supplier and the date count too), never by rand(); those columns break ties.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlens.operators import sampling as M
from laborlens.plans import survey as SV
from laborlens.plans.registry import register
from laborlens.plans.sqlbits import survey_sql
from laborlens.session import materialise

SAMPLE_FRACTION = 0.1
TEST_FRACTION = 0.25
PK = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
PK_SQL = " || '-' || ".join(f"CAST({c} AS STRING)" for c in PK)
PK_ORDER = ", ".join(PK)
HASH_SQL = f"CAST('0x' || substr(md5({PK_SQL}), 1, 15) AS BIGINT)"


def below_sql(fraction: float) -> str:
    return f"hk < {int(fraction * M.KEY_RANGE)}"


def hashed(spark, d) -> DataFrame:
    return SV.survey(spark, d).withColumn("hk", M.pk_hash(*PK))


def _keyed(spark, d) -> DataFrame:
    """Class and key of every row, written as the split reads them several times."""
    return materialise(hashed(spark, d).select("y_true", "hk"), "keyed")


_HK_CTE = f"hs AS (SELECT *, {HASH_SQL} AS hk FROM survey)"


def _quota_sql(src: str, keys: str, fraction: float, name: str = "q") -> str:
    max_rows = "alvo"
    return f"""
{name}_sz AS (SELECT {keys}, COUNT(*) AS n FROM {src} GROUP BY {keys}),
{name} AS (SELECT *, CAST(base + CASE WHEN rk <= short THEN 1 ELSE 0 END AS BIGINT) AS quota FROM (
  SELECT *, ROW_NUMBER() OVER (ORDER BY rem DESC, {keys}) AS rk,
         CASE WHEN tot <= {max_rows} THEN 0 ELSE {max_rows} - SUM(base) OVER () END AS short FROM (
    SELECT *, CASE WHEN tot <= {max_rows} THEN n ELSE CAST(floor(n * {max_rows} / tot) AS BIGINT) END AS base,
           CASE WHEN tot <= {max_rows} THEN 0.0 ELSE n * {max_rows} / tot - floor(n * {max_rows} / tot) END AS rem
    FROM (SELECT *, SUM(n) OVER () AS tot, CAST(floor(SUM(n) OVER () * CAST({fraction} AS DOUBLE)) AS BIGINT) AS alvo
          FROM {name}_sz))))"""


@register("quotas", "M2", survey_sql("SELECT ano, trimestre, n, quota FROM q",
                                     extra=_quota_sql("survey", "ano, trimestre", SAMPLE_FRACTION)))
def quotas(spark, d):
    sizes = SV.survey(spark, d).groupBy("ano", "trimestre").agg(F.count(F.lit(1)).alias("n"))
    return M.allocate_quotas(M.share_of(sizes, SAMPLE_FRACTION), ["ano", "trimestre"], "_alvo") \
            .select("ano", "trimestre", "n", "quota")


@register("strat_sample", "M2 M3", survey_sql("""
SELECT ano, trimestre, y_true, COUNT(*) AS n_amostra, MIN(hk) AS hk_min, MAX(hk) AS hk_max
FROM (SELECT hs.*, ROW_NUMBER() OVER (PARTITION BY hs.ano, hs.trimestre, hs.y_true ORDER BY hs.hk) AS rn, q2.quota
      FROM hs JOIN q2 ON hs.ano = q2.ano AND hs.trimestre = q2.trimestre AND hs.y_true = q2.y_true)
WHERE rn <= quota GROUP BY ano, trimestre, y_true""", extra=_HK_CTE + "," + _quota_sql(
    "survey", "ano, trimestre", SAMPLE_FRACTION) + """,
q2_sz AS (SELECT s.ano, s.trimestre, s.y_true, COUNT(*) AS n, MAX(q.quota) AS squota
          FROM survey s JOIN q ON s.ano = q.ano AND s.trimestre = q.trimestre GROUP BY 1, 2, 3),
q2 AS (SELECT *, CAST(base + CASE WHEN rk <= short THEN 1 ELSE 0 END AS BIGINT) AS quota FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY ano, trimestre ORDER BY rem DESC, y_true) AS rk,
         CASE WHEN tot <= squota THEN 0 ELSE squota - SUM(base) OVER (PARTITION BY ano, trimestre) END AS short FROM (
    SELECT *, CASE WHEN tot <= squota THEN n ELSE CAST(floor(n * squota / tot) AS BIGINT) END AS base,
           CASE WHEN tot <= squota THEN 0.0 ELSE n * squota / tot - floor(n * squota / tot) END AS rem
    FROM (SELECT *, SUM(n) OVER (PARTITION BY ano, trimestre) AS tot FROM q2_sz))))"""))
def strat_sample(spark, d):
    rows = materialise(hashed(spark, d).select("ano", "trimestre", "y_true", "hk", *PK), "strata")
    s = M.stratified_downsample(rows, ["ano", "trimestre"], "y_true", SAMPLE_FRACTION, "hk", PK)
    return s.groupBy("ano", "trimestre", "y_true").agg(
        F.count(F.lit(1)).alias("n_amostra"), F.min("hk").alias("hk_min"), F.max("hk").alias("hk_max"))


@register("split_sizes", "M5 A35", survey_sql(f"""
SELECT split, y_true, COUNT(*) AS n FROM (
  SELECT y_true, CASE WHEN ROW_NUMBER() OVER (PARTITION BY y_true ORDER BY hk)
                        <= round(COUNT(*) OVER (PARTITION BY y_true) * {TEST_FRACTION}) THEN 'teste' ELSE 'treino' END AS split
  FROM hs) GROUP BY split, y_true""", extra=_HK_CTE))
def split_sizes(spark, d):
    s = M.stratified_split(_keyed(spark, d), "y_true", TEST_FRACTION, "hk")
    return s.groupBy("split", "y_true").agg(F.count(F.lit(1)).alias("n"))


@register("class_counts", "A35 M5", survey_sql(f"""
SELECT split, COUNT(*) AS n, COUNT(CASE WHEN y_true = 1 THEN 1 END) AS n_pos,
       ROUND(AVG(CAST(y_true AS DOUBLE)), 6) AS prevalencia FROM (
  SELECT y_true, CASE WHEN ROW_NUMBER() OVER (PARTITION BY y_true ORDER BY hk)
                        <= round(COUNT(*) OVER (PARTITION BY y_true) * {TEST_FRACTION}) THEN 'teste' ELSE 'treino' END AS split
  FROM hs) GROUP BY split""", extra=_HK_CTE))
def class_counts(spark, d):
    s = M.stratified_split(_keyed(spark, d), "y_true", TEST_FRACTION, "hk")
    return M.class_distribution(s, "split", "y_true")


@register("temporal_split", "M6 F8", survey_sql("""
SELECT CASE WHEN ano = (SELECT MAX(ano) FROM survey) THEN 'teste' ELSE 'treino' END AS split,
       y_true, COUNT(*) AS n FROM survey GROUP BY 1, 2"""))
def temporal_split(spark, d):
    s = M.temporal_split(SV.survey(spark, d), "ano")
    return s.groupBy("split", "y_true").agg(F.count(F.lit(1)).alias("n"))


@register("undersample", "M7", survey_sql("""
SELECT y_true, COUNT(*) AS n FROM (
  SELECT hs.y_true, ROW_NUMBER() OVER (PARTITION BY hs.y_true ORDER BY hs.hk) AS rn, c.keep
  FROM hs JOIN (SELECT y_true, CASE WHEN n = MAX(n) OVER () AND n <> MIN(n) OVER ()
                                  THEN LEAST(n, CAST(floor(MIN(n) OVER () / 0.5) AS BIGINT)) ELSE n END AS keep
                FROM (SELECT y_true, COUNT(*) AS n FROM hs GROUP BY y_true)) c ON hs.y_true = c.y_true)
WHERE rn <= keep GROUP BY y_true""", extra=_HK_CTE))
def undersample(spark, d):
    s = M.undersample_majority(hashed(spark, d), "y_true", 0.5, "hk")
    return s.groupBy("y_true").agg(F.count(F.lit(1)).alias("n"))


@register("plain_sample", "M1 T4", survey_sql(f"""
SELECT record_id, l_partkey, y_true, hk FROM hs ORDER BY hk, {PK_ORDER} LIMIT 1000""", extra=_HK_CTE))
def plain_sample(spark, d):
    return M.first_n_by_hash(hashed(spark, d), 1000, "hk", PK).select("record_id", "l_partkey", "y_true", "hk")


@register("fraction_sample", "M1", survey_sql(f"""
SELECT record_id, ano, eh_ti FROM hs WHERE {below_sql(0.1)}""", extra=_HK_CTE))
def fraction_sample(spark, d):
    """A tenth of the rows by uniform key."""
    return M.fraction_by_hash(hashed(spark, d), 0.1, "hk").select("record_id", "ano", "eh_ti")


@register("prop_sample", "M4", survey_sql(f"""
SELECT y_true, COUNT(*) AS n, CAST(MIN(hk) AS BIGINT) AS hk_min, CAST(MAX(hk) AS BIGINT) AS hk_max
FROM hs WHERE {below_sql(0.2)} GROUP BY y_true""", extra=_HK_CTE))
def prop_sample(spark, d):
    """Proportional sample per class: the same fraction of each."""
    s = M.fraction_by_hash(hashed(spark, d), 0.2, "hk")
    return s.groupBy("y_true").agg(F.count(F.lit(1)).alias("n"), F.min("hk").alias("hk_min"),
                                   F.max("hk").alias("hk_max"))


SMOTE_RATIO = 0.75


@register("smote", "M8", survey_sql(f"""
SELECT y_true, FALSE AS sintetico, n, TRUE AS dentro FROM c
UNION ALL SELECT (SELECT arg_min(y_true, (n, y_true)) FROM c), TRUE,
  (SELECT CAST(ceil({SMOTE_RATIO}e0 * MAX(n)) AS BIGINT) - MIN(n) FROM c), TRUE
WHERE (SELECT ceil({SMOTE_RATIO}e0 * MAX(n)) > MIN(n) AND COUNT(*) > 1 FROM c)""",
    extra="c AS (SELECT y_true, COUNT(*) AS n FROM occ GROUP BY y_true)"))
def smote(spark, d):
    """Minority over-sampling; `dentro`: all values within the range of the real rows."""
    feats = ["idade", "anos_estudo", "renda"]
    df = materialise(SV.occ(spark, d).withColumn("hk", M.pk_hash(*PK)).select(
        "hk", "y_true", F.col("idade").cast("double").alias("idade"),
        F.col("anos_estudo").cast("double").alias("anos_estudo"),
        F.coalesce(F.col("rendimento_trabalho_principal"), F.lit(0.0)).alias("renda")), "smote")
    out = M.smote(df, "y_true", feats, "hk", ratio=SMOTE_RATIO, seed=42)
    lim = df.agg(*[a for c in feats for a in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))])
    ok = F.lit(True)
    for c in feats:
        ok = ok & F.coalesce(F.col(c).between(F.col(f"lo_{c}"), F.col(f"hi_{c}")), F.lit(True))
    return out.crossJoin(F.broadcast(lim)).groupBy("y_true", "sintetico").agg(         # one-row limits
        F.count(F.lit(1)).alias("n"), F.bool_and(ok).alias("dentro"))


def _poisson_sql(u: str) -> str:
    acc, p, cases = 0.0, math.exp(-1.0), []
    for k in range(12):
        acc += p
        cases.append(f"WHEN {u} < CAST({acc!r} AS DOUBLE) THEN {k}")
        p = p / (k + 1)
    return "CASE " + " ".join(cases) + " ELSE 12 END"


REPLICATES = 20


@register("bootstrap_auc", "M9 R9", survey_sql(f"""
SELECT COUNT(*) AS replicas, ROUND(AVG(auc), 6) AS auc_media, ROUND(stddev_samp(auc), 6) AS auc_desvio,
       ROUND(quantile_cont(auc, 0.025), 6) AS auc_q025, ROUND(quantile_cont(auc, 0.975), 6) AS auc_q975 FROM (
  SELECT r, SUM(wp * (cn - wn / 2)) / (SUM(wp) * MAX(tn)) AS auc FROM (
    SELECT *, SUM(wn) OVER (PARTITION BY r ORDER BY y_proba ROWS UNBOUNDED PRECEDING) AS cn,
           SUM(wn) OVER (PARTITION BY r) AS tn FROM (
      SELECT r, y_proba, SUM(CASE WHEN y_true = 1 THEN w ELSE CAST(0 AS DOUBLE) END) AS wp,
             SUM(CASE WHEN y_true = 1 THEN CAST(0 AS DOUBLE) ELSE w END) AS wn FROM (
        SELECT r, y_proba, y_true, CAST({_poisson_sql('u')} AS DOUBLE) AS w FROM (
          SELECT r, y_proba, y_true, CAST('0x' || substr(md5(CAST(hk AS STRING) || '-' || CAST(r AS STRING)), 1, 8)
                 AS BIGINT) / CAST(4294967296 AS DOUBLE) AS u
          FROM hs, (SELECT UNNEST(range(0, {REPLICATES})) AS r) WHERE y_proba IS NOT NULL))
      GROUP BY r, y_proba)) GROUP BY r)""", extra=_HK_CTE))
def bootstrap_auc(spark, d):
    """Bootstrap replicates of the exact AUC, summarised as mean / std / 2.5% / 97.5%."""
    df = hashed(spark, d).select("hk", "y_true", "y_proba")
    reps = M.bootstrap_auc(df, "y_true", "y_proba", "hk", replicates=REPLICATES)
    return reps.agg(F.count(F.lit(1)).alias("replicas"), F.round(F.avg("auc"), 6).alias("auc_media"),
                    F.round(F.stddev("auc"), 6).alias("auc_desvio"),
                    F.round(F.percentile("auc", 0.025), 6).alias("auc_q025"),
                    F.round(F.percentile("auc", 0.975), 6).alias("auc_q975"))
