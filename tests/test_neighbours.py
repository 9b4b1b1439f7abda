"""k nearest neighbours: recall against brute force, copies, missing values, hot values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from laborlens.operators import neighbours as N
from laborlens.operators import sampling as M
from laborlens.plans import survey as SV
from tests.conftest import SF_SMALL


def scaled(x):
    s = x.std(axis=0, ddof=1)
    return (x - x.mean(axis=0)) / np.where(s > 0, s, 1)


def brute_distances(x, weights, k):
    """{point: distances of its k nearest other points}, scaled over all rows."""
    z = scaled(np.repeat(x, weights, axis=0))[np.cumsum(weights) - 1]
    far = ((z[:, None] - z[None]) ** 2).sum(axis=2)
    np.fill_diagonal(far, np.inf)
    return {tuple(p): np.sort(far[i])[:k] for i, p in enumerate(x)}


def recall(found, true):
    hits = total = 0
    for r in found:
        want = true[tuple(r.x)]
        hits += sum(s.far <= want[-1] * (1 + 1e-9) for s in r.near)
        total += len(want)
    return hits / total


@pytest.mark.parametrize("dim,n,shape", [(2, 3000, "even"), (3, 3000, "clusters"), (5, 2000, "even")])
def test_recall_on_points(spark, dim, n, shape):
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(n, dim)) if shape == "even" else \
        rng.normal(size=(20, dim))[rng.integers(0, 20, n)] + 0.01 * rng.normal(size=(n, dim))
    cols = [f"f{d}" for d in range(dim)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{c} double" for c in cols))
    found = N.nearest(df, cols, k=5).collect()
    assert len(found) == n and all(len(r.near) == 5 for r in found)
    assert recall(found, brute_distances(x, np.ones(n, int), 5)) >= 0.9


def test_recall_on_the_minority_of_the_survey(spark):
    df = SV.occ(spark, SF_SMALL.replace("sf0.001", "sf0.01")).filter("y_true = 1").select(
        F.col("idade").cast("double"), F.col("anos_estudo").cast("double"),
        F.coalesce("rendimento_trabalho_principal", F.lit(0.0)).alias("renda")).limit(6000)
    rows = df.groupBy(*df.columns).count().collect()
    x, w = np.asarray([r[:3] for r in rows], float), np.asarray([r[3] for r in rows])
    data = spark.createDataFrame([tuple(map(float, r[:3])) for r in rows for _ in range(r[3])],
                                 "idade double, anos_estudo double, renda double")
    found = N.nearest(data, data.columns, k=5).collect()
    assert recall(found, brute_distances(x, w, 5)) >= 0.9


def test_hot_value_is_one_point_and_copies_come_first(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 1.5).otherwise(F.col("id") / 7.0).alias("a"),
                                  F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.sin("id")).alias("b"))
    near = N.nearest(df, ["a", "b"], k=5)
    hot = near.filter("n > 1").collect()
    assert len(hot) == 1 and hot[0].n == 1667
    nbs = N.neighbour_rows(near, 5).filter("x = array(1.5D, 0.0D)").first().nbs
    assert nbs == [[1.5, 0.0]] * 5


def test_missing_values_and_few_rows(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 5.0), (float("nan"), 4.0), (-0.0, 1.0), (0.0, 1.0)], "a double, b double")
    near = {tuple(r.x): r for r in N.nearest(df, ["a", "b"], k=5).collect()}
    assert near[(0.0, 1.0)].n == 2 and len(near) == 4
    assert all(len(r.near) == 3 for r in near.values())
    one = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert N.neighbour_rows(N.nearest(one, ["a", "b"]), 5).first().nbs == []


def test_synthetic_rows_lie_towards_near_rows(spark):
    """Two far groups: a synthetic row never lies between them."""
    d = spark.range(3000).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"), M.pk_hash("id").alias("hk"),
                                 (F.col("id") % 20 * 100 + F.sin("id")).alias("a"), F.cos("id").alias("b"))
    synth = M.smote(d, "y", ["a", "b"], "hk", ratio=0.5).filter("sintetico").collect()
    assert len(synth) == 1350 - 300
    assert all(abs(r.a) <= 1 or abs(r.a - 1000) <= 1 for r in synth)
    assert {r.a > 500 for r in synth} == {True, False}


def test_large_cells_are_cut_by_aggregation_and_rows_not_rewritten(spark, monkeypatch):
    """Cells above ``whole`` points: the same recall, and only the points and the cuts are written."""
    written = []
    real = N.materialise
    monkeypatch.setattr(N, "materialise", lambda df, name: written.append(name) or real(df, name))
    x = np.random.default_rng(7).normal(size=(4000, 3))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    found = N.nearest(df, ["a", "b", "c"], k=5, whole=300).collect()
    assert len(found) == 4000 and all(len(r.near) == 5 for r in found)
    assert recall(found, brute_distances(x, np.ones(len(x), int), 5)) >= 0.9
    assert written.count("points") == 1 and written.count("cuts") >= 2
    assert set(written) == {"points", "cuts"}
