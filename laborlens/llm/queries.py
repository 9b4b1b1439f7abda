"""The registered ``opN_*`` queries: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from laborlens.llm import (alignment, ann, centroids, chat, decontam, langid, packing, pylm, quality, simhash, token_store,
                           toxicity, url_reputation)
from laborlens.llm.common import held_out, table
from laborlens.plans.registry import register


@register("op2_best_fit_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).drop("copy")


@register("op3_simhash_near_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@register("op1_quality_classifier")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.classify(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out(F.col("doc_id"), quality.MOD, quality.HELD).alias("held_out"),
                      F.col("quality_score").alias("score"), F.col("quality_pred").alias("predicted"))


@register("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return (langid.identify(docs)
            .select("doc_id", held_out(F.col("doc_id"), langid.MOD, langid.HELD).alias("held_out"),
                    "langid.lang_pred", "langid.score"))


@register("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.classify(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out(F.col("doc_id"), toxicity.MOD, toxicity.HELD).alias("held_out"),
                      F.col("toxic_score").alias("score"), F.col("toxic_pred").alias("predicted"))


@register("op5_benchmark_decontamination")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op6_url_reputation", oracle=url_reputation.ORACLE_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    outcomes = url_reputation.outcomes_from_labels(pages, table(spark, sf_dir, "labels"))
    return url_reputation.judge(pages, outcomes)


@register("op9_nearest_neighbours")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@register("op10_lm_scoring")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pylm.score(table(spark, sf_dir, "documents"))


@register("op4_chat_formatting")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.threads(table(spark, sf_dir, "conversations"))


@register("op11_token_store")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(table(spark, sf_dir, "documents")).drop("nth")


@register("op13_token_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


@register("op12_centroid_clustering", oracle=centroids.ORACLE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))
