import numpy as np
import pytest
from pyspark.sql import functions as F

from laborlens.llm import ann
from tests.llm.helpers import pandas_table


def exact(ids, x, query, k=20):
    q = x[ids.index(query)]
    scored = sorted((-float((v * q).sum()), i) for i, v in zip(ids, x) if i != query)
    return [i for _, i in scored[:k]]


def recall(rows, ids, x):
    hit = total = 0
    for q, g in rows.groupby("query_id"):
        want = exact(ids, x, q)
        assert g.sort_values("rank").vec_id.is_unique and sorted(g["rank"]) == list(range(1, len(g) + 1))
        hit += len(set(want) & set(g.vec_id))
        total += len(want)
    return hit / total


def test_recall_on_embeddings(spark):
    sf = "/root/testdata/sf0.01"
    table = pandas_table(sf, "embeddings")
    ids, x = table.vec_id.tolist(), np.asarray(table.embedding.to_list(), float)
    rows = ann.nearest(spark.read.parquet(f"{sf}/embeddings.parquet"), F.col("vec_id") % 20 == 0).toPandas()
    assert recall(rows, ids, x) >= 0.9
    for r in rows.itertuples():
        assert r.score == pytest.approx(float((x[ids.index(r.vec_id)] * x[ids.index(r.query_id)]).sum()), abs=1e-12)


def test_recall_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 150)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1200, 24)) * rng.uniform(0.5, 2, (1200, 1))       # lengths differ
    x[300:700] = x[300]                                                     # many equal vectors
    frame = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = ann.nearest(frame, F.col("vec_id") % 20 == 0).toPandas()
    assert rows.query_id.nunique() == 60 and len(rows) == 1200
    assert recall(rows, list(range(1200)), x) >= 0.9
    own = rows[rows.query_id == 320].sort_values("rank").vec_id.tolist()
    assert own[0] in (300, *range(1200))


def test_odd_rows(spark):
    bad = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, float("nan")]), (6, [float("inf"), 1.0]),
           (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    good = [(20, [1.0, 0.0]), (40, [0.0, 1.0]), (41, [0.0, 1.0]), (42, [0.0, 1.0]), (42, [0.0, 1.0]), (60, [-1.0, 0.5])]
    frame = spark.createDataFrame(bad + good, "vec_id long, embedding array<double>").selectExpr("*", "1 AS block", "2 AS ids")
    rows = ann.nearest(frame, F.col("vec_id") % 20 == 0).toPandas()
    got = {q: g.sort_values("rank").vec_id.tolist() for q, g in rows.groupby("query_id")}
    assert got == {20: [40, 41, 42, 60], 40: [41, 42, 60, 20], 60: [40, 41, 42, 20]}
    assert ann.nearest(frame.where("vec_id < 3"), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_several_vectors_of_one_id(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (21, [5.0, 0.0]), (21, [0.0, 4.0]), (22, [3.0, 3.0]), (23, [1.0, 1.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 20).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(21, 5.0), (22, 3.0), (23, 1.0)]


def test_ties_of_long_vectors(spark):
    """Equal products at norms of 10^9: the smaller ids count, whatever rounding does."""
    x = np.random.default_rng(0).normal(size=64) * 1e9
    rows = [(20, [float(c) for c in x])] + [(100 + i, [float(c) for c in x * 0.5]) for i in range(50)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 20).collect()
    assert sorted(r.vec_id for r in got) == list(range(100, 120))


def test_chi_square_quantile():
    assert ann.chi2_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)
    assert ann.chi2_quantile(0.5, 2) == pytest.approx(1.38629, abs=1e-4)
