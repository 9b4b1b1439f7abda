"""Values of fitted models on small tables with known answers."""

import pytest
from pyspark.sql import functions as F

from laborlens.operators import ml as ML
from laborlens.plans import models as MD
from laborlens.session import materialise


@pytest.fixture(scope="module")
def table(spark):
    """y follows idade (from 40 on) but for every tenth row; the other columns say nothing."""
    df = spark.range(2000).select(
        F.md5(F.col("id").cast("string")).alias("hk"), F.lit("treino").alias("split"),
        (20 + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(40))).cast("double").alias("idade"),
        F.pmod(F.xxhash64("id", F.lit(2)), F.lit(10)).cast("double").alias("anos_estudo"),
        F.pmod(F.xxhash64("id", F.lit(3)), F.lit(10)).cast("double").alias("horas_trabalhadas_semana"),
        *[F.pmod(F.xxhash64("id", F.lit(4 + k)), F.lit(2)).cast("string").alias(c) for k, c in enumerate(MD.CATEGORICAL)],
        "id")
    label = F.when(F.col("id") % 10 == 0, F.col("idade") < 40).otherwise(F.col("idade") >= 40)
    return materialise(df.withColumn("label", label.cast("double")), "known")


def test_importances_name_the_deciding_column(table):
    model = ML.forest(MD.NUMERIC, MD.CATEGORICAL, 10, 4, 5).fit(table)
    imp = {r.origem: r.importancia for r in MD.importance_table(model, table).collect()}
    assert set(imp) == set(MD.NUMERIC + MD.CATEGORICAL) and sum(imp.values()) == pytest.approx(1)
    assert imp["idade"] > 0.9


def test_coefficients_name_the_deciding_column(table):
    c = MD.coefficients(ML.logistic(MD.NUMERIC, MD.CATEGORICAL).fit(table), table)
    by = {r.origem: r.c for r in c.groupBy("origem").agg(F.max(F.abs("coef")).alias("c")).collect()}
    assert by.pop("idade") == pytest.approx(2.0, abs=0.4) and max(by.values()) < 0.4


def test_permuting_the_deciding_column_costs_f1(table):
    model = ML.forest(MD.NUMERIC, MD.CATEGORICAL, 10, 4, 5).fit(table)
    f1 = ML.f1_of(ML.positive_probability(model.transform(table))).first()[0]
    assert f1 == pytest.approx(0.9, abs=0.02)
    drop = {r.feature: r for r in ML.permutation_importance(model, table, ["idade", "sexo"], "hk").collect()}
    assert drop["idade"].media == pytest.approx(0.4, abs=0.06) and abs(drop["sexo"].media) < 0.01
    assert drop["idade"].q025 <= drop["idade"].media <= drop["idade"].q975 and drop["idade"].replicas == 20


def test_cross_validation_prefers_the_depth_that_can_tell(table):
    t = ML.group_folds(table.withColumn("g", F.pmod(F.xxhash64("id", F.lit(9)), F.lit(30))), ["g"], "label", 3)
    pipe = ML.forest(["idade"], [], 5, 1, 1)
    grid = ML.ParamGridBuilder().addGrid(pipe.getStages()[-1].maxDepth, [0, 2]).build()
    flat, deep = ML.cross_validate(t, pipe, grid, "fold").avgMetrics
    assert flat == pytest.approx(0.5, abs=0.01) and deep == pytest.approx(0.9, abs=0.03)


def test_clusters_of_age(spark):
    ages = spark.createDataFrame([(float(a),) for c in (20, 40, 60, 80) for a in (c - 1, c, c, c + 1)], "idade double")
    rows = ML.cluster_summary(ML.kmeans(ages, ["idade"], k=4).transform(ages), "idade").collect()
    assert sorted((r.media, r.minimo, r.maximo, r.n) for r in rows) == [
        (20.0, 19.0, 21.0, 4), (40.0, 39.0, 41.0, 4), (60.0, 59.0, 61.0, 4), (80.0, 79.0, 81.0, 4)]
