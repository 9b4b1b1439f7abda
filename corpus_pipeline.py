"""Corpus pipeline: documents in, packed training sequences out.

``STAGES`` are applied in order; each gets what its predecessor kept, written as
Parquet and read again.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from laborlens.llm import decontam, langid, packing, quality, simhash
from laborlens.llm.common import materialise, table
from laborlens.plans.registry import register

#: Documents less like every language profile than this are rejected.
MIN_LANGUAGE_SCORE = 0.25

#: Texts go to the Python workers in batches of at most that many rows: each task holds a batch twice, off the
#: JVM's heap and in its worker, beside what the workers keep.
BATCH_ROWS = 500
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: The stages use learned models, fingerprints and a tokenizer, which SQL can't express.
ORACLE_SQL = None


def small_batches(stage: Callable) -> Callable:
    """The stage under a session whose Arrow batches have at most ``BATCH_ROWS`` rows, as its rows are computed later."""
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not 0 < int(spark.conf.get(ARROW_ROWS)) <= BATCH_ROWS:
            spark.conf.set(ARROW_ROWS, str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run_stage


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    score = quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(score(F.col("text")) >= quality.THRESHOLD)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified."""
    predict = langid.predictor(docs)
    found = predict(F.col("text"))
    return docs.where((found["lang_pred"] != langid.UNKNOWN) & (found["score"] >= MIN_LANGUAGE_SCORE))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that of the smallest id, then fingerprint.

    An id repeated with other texts counts once in each of their classes.  A row without an id stays only in
    a class without ids, one row of the smallest fingerprint.  Only for ids with several fingerprints and for
    rows without an id are the fingerprints computed again.
    """
    members = materialise(simhash.classes(docs), "members")
    rows = members.where(F.col("doc_id").isNotNull())
    several = materialise(rows.groupBy("doc_id").agg((F.min("fp") != F.max("fp")).alias("_several"))
                          .where("_several").select("doc_id"), "several")

    first = (rows.where(F.col("doc_id") == F.col("component_id"))
             .groupBy("root", "doc_id").agg(F.min("fp").alias("_fp")).select("doc_id", "_fp"))
    plain = (docs.join(several, "doc_id", "left_anti").join(first.select("doc_id"), "doc_id", "left_semi")
             .dropDuplicates(["doc_id"]))
    fp = simhash.fingerprint(F.col("text"))
    many = (docs.join(several, "doc_id", "left_semi").withColumn("_fp", fp)
            .join(first, ["doc_id", "_fp"]).dropDuplicates(["doc_id", "_fp"]))
    nameless = (members.where(F.col("doc_id").isNull()).groupBy("root").agg(F.min("fp").alias("_fp"))
                .join(rows.select("root"), "root", "left_anti").select("_fp"))
    others = (docs.where(F.col("doc_id").isNull()).withColumn("_fp", fp)
              .join(nameless, "_fp").dropDuplicates(["_fp"]))
    return (plain.select(*docs.columns).union(many.select(*docs.columns)).union(others.select(*docs.columns)))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    clean = decontam.is_clean(docs, table(spark, sf_dir, "benchmark"))
    return docs.where(clean(F.col("text")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents, placed in sequences."""
    return packing.pack(docs).drop("copy")


STAGES = [(name, small_batches(stage)) for name, stage in (
    ("quality", keep_quality), ("language", keep_language), ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark), ("packing", pack))]


@register("pipeline", oracle=ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
