"""Mergeable partial aggregates, kept for each file.

A state row of a file has counts, sums, extremes and a HyperLogLog sketch of each profiled column.  States
are stored; a run computes only those of files it has not seen (``listed`` names, sizes and times),
and a report merges all states without reading a file again.  Counts, sums and extremes are
exact; distinct counts have the sketch's relative standard error, about 1.04 / sqrt(2^lg_k).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laborlens.session import materialise
from laborlens.sources.incremental import listed

LG_K = 14


def states(rows: DataFrame, by: list[str], columns: list[str], lg_k: int = LG_K) -> DataFrame:
    """One state row for each value of ``by``."""
    aggs = [F.count(F.lit(1)).alias("linhas")]
    for c in columns:
        number = F.col(c).try_cast("double") if dict(rows.dtypes)[c] == "string" else F.col(c).cast("double")
        aggs += [F.count(c).alias(f"{c}__n"), F.sum(number).alias(f"{c}__soma"), F.min(number).alias(f"{c}__min"),
                 F.max(number).alias(f"{c}__max"), F.hll_sketch_agg(F.col(c).cast("string"), lg_k).alias(f"{c}__hll")]
    return rows.groupBy(*by).agg(*aggs)


def merged(stored: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Measures of the union of the states' rows: n, missing, mean, extremes, distinct estimate of each column."""
    aggs = [F.sum("linhas").alias("linhas")]
    for c in columns:
        aggs += [F.sum(f"{c}__n").alias(f"{c}__n"), F.sum(f"{c}__soma").alias(f"{c}__soma"),
                 F.min(f"{c}__min").alias(f"{c}__min"), F.max(f"{c}__max").alias(f"{c}__max"),
                 F.hll_sketch_estimate(F.hll_union_agg(f"{c}__hll")).alias(f"{c}__distintos")]
    g = stored.groupBy(*by).agg(*aggs)
    column = [F.struct(F.lit(c).alias("coluna"), "linhas", F.col(f"{c}__n").alias("presentes"),
                       (F.col("linhas") - F.col(f"{c}__n")).alias("ausentes"),
                       (F.col(f"{c}__soma") / F.col(f"{c}__n")).alias("media"), F.col(f"{c}__min").alias("minimo"),
                       F.col(f"{c}__max").alias("maximo"), F.col(f"{c}__distintos").alias("distintos")) for c in columns]
    return g.select(*by, F.inline(F.array(*column)))


def update(spark: SparkSession, folder: str, store: str, columns: list[str], read=None,
           pattern: str = "*.parquet", lg_k: int = LG_K) -> int:
    """Adds the states of the files in ``folder`` that ``store`` has not got; their number.

    A file that changed (size or time) gets a new state; ``current`` takes each file's last one."""
    try:
        known = spark.read.parquet(store).select("arquivo", "tamanho", "alterado")
    except AnalysisException:
        known = spark.createDataFrame([], "arquivo string, tamanho long, alterado long")
    new = materialise(listed(spark, folder, pattern).join(known, ["arquivo", "tamanho", "alterado"], "left_anti"), "new")
    paths = [r[0] for r in new.select("caminho").collect()]                    # names of new files only
    if paths:
        rows = (read or (lambda p: spark.read.option("mergeSchema", "true").parquet(*p)))(paths)
        own = states(rows.withColumn("arquivo", F.col("_metadata.file_path")), ["arquivo"], columns, lg_k)
        new.drop("caminho").join(own, "arquivo").write.mode("append").parquet(store)
    return len(paths)


def current(spark: SparkSession, store: str) -> DataFrame:
    """Each file's last state."""
    every = spark.read.parquet(store)
    rest = [c for c in every.columns if c != "arquivo"]
    return every.groupBy("arquivo").agg(F.max_by(F.struct(*rest), "alterado").alias("e")).select("arquivo", "e.*")
