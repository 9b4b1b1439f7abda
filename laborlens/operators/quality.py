"""Data-quality operators (Q1-Q9, T1): each is one aggregate pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laborlens.operators.aggregates import count_if


def top_values(df: DataFrame, col: str, k: int, flag: str | None = None) -> DataFrame:
    """Top-k value counts (ties broken by the value) -> TakeOrdered, no global sort."""
    aggs = [F.count(F.lit(1)).alias("n")]
    if flag:
        aggs.append(F.bool_or(flag).alias(flag))
    return df.groupBy(col).agg(*aggs).orderBy(F.desc("n"), F.asc(col)).limit(k)


def reclassify(df: DataFrame, old: str, new: Column) -> DataFrame:
    """Q6: 2x2 agreement of the stored flag and a re-derived one."""
    return df.groupBy(F.col(old).alias("regra_atual"), new.alias("regra_nova")) \
             .agg(F.count(F.lit(1)).alias("n"))


def degenerate_flag(df: DataFrame, flag: str) -> DataFrame:
    """Q6: all / none flagged?"""
    g = df.agg(F.count(F.lit(1)).alias("n"), count_if(F.col(flag)).alias("n_ti"))
    return g.withColumn("status", F.when(F.col("n_ti") == 0, "nenhum_ti")
                        .when(F.col("n_ti") == F.col("n"), "todos_ti").otherwise("ok"))


def column_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """Q3: missing and distinct counts per column in one aggregate, then unpivoted."""
    aggs = []
    for c in cols:
        aggs += [(F.count(F.lit(1)) - F.count(c)).alias(f"{c}__ausentes"),
                 F.countDistinct(c).alias(f"{c}__distintos")]
    row = df.agg(*aggs)
    parts = [row.select(F.lit(c).alias("coluna"), F.col(f"{c}__ausentes").alias("ausentes"),
                        F.col(f"{c}__distintos").alias("distintos")) for c in cols]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def code_coverage(spark: SparkSession, df: DataFrame, col: str, codes) -> DataFrame:
    """Q3: rows per listed code (codes with no rows -> 0); the code list is a
    fixed small dimension, broadcast."""
    dim = spark.createDataFrame([(c,) for c in codes], "codigo string")
    counts = df.groupBy(F.col(col).alias("codigo")).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(dim).join(counts, "codigo", "left").fillna(0, ["n"])


def missing_ratio(df: DataFrame, by: list[str], family: str, flag: str, alert: float) -> DataFrame:
    """Q5: share of rows without family (alert above `alert`) and IT share."""
    miss = F.avg(F.col(family).isNull().cast("double"))
    return df.groupBy(*by).agg(F.round(miss, 6).alias("razao_sem_familia"),
                               (miss > alert).alias("alerta"),
                               F.round(F.avg(F.col(flag).cast("double")), 6).alias("razao_ti"))


def essential_check(df: DataFrame, required) -> DataFrame:
    """Q2/P5: presence and non-null count of each required column."""
    present = [c for c in required if c in df.columns]
    counts = df.agg(*[F.count(c).alias(c) for c in present]) if present else None
    parts = []
    for c in required:
        if c in present:
            parts.append(counts.select(F.lit(c).alias("coluna"), F.lit(True).alias("presente"),
                                       F.col(c).alias("nao_nulos")))
        else:
            parts.append(df.sparkSession.range(1).select(
                F.lit(c).alias("coluna"), F.lit(False).alias("presente"),
                F.lit(0).cast("long").alias("nao_nulos")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def coverage(df: DataFrame, year: str = "ano", flag: str = "eh_ti") -> DataFrame:
    """Q1: rows, distinct years, IT flag present, status."""
    g = df.agg(F.count(F.lit(1)).alias("linhas"), F.countDistinct(year).alias("anos"))
    return g.withColumn("tem_eh_ti", F.lit(flag in df.columns)) \
            .withColumn("status", F.when(F.col("linhas") > 0, "ok").otherwise("vazio"))
