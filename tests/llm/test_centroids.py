import hashlib
import math

import numpy as np
import pytest

from laborlens.llm import centroids
from tests.conftest import SF_SMALL
from tests.llm.helpers import pandas_table
from tools.oracle_check import check, duck_con

SCHEMA = "vec_id long, embedding array<double>, cluster string, v long, ids string"


def brute(rows, k, rounds, dim, scale):
    """The same by plain Python integers."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        new = list(cents)
        for j in set(own):
            members = [v for (_, v), o in zip(kept, own) if o == j]
            new[j] = [sum(col) // len(members) for col in zip(*members)]
        cents = new
    found = [near(v) for _, v in kept]
    inertia = [sum(d for d, j in found if j == c) for c in range(len(cents))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, j, d, inertia[j], sum(inertia), sha[j]) for (i, _), (d, j) in zip(kept, found)), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("k,dim,n", [(4, 3, 200), (16, 2, 9), (3, 1, 40)])
def test_equals_brute_force(spark, monkeypatch, k, dim, n):
    monkeypatch.setattr(centroids, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(k)
    rows = [(int(i % (n - 3)), [float(x) for x in np.round(rng.normal(size=dim), 2)]) for i in range(n)]
    rows += [(1, None), (2, []), (3, [0.5] * (dim + 1)), (4, [float("nan")] * dim), (5, [float("inf")] * dim),
             (6, [None] * dim), (None, [0.25] * dim), (None, [-0.25] * dim), (7, [0.1] * dim), (7, [0.1] * dim)]
    df = spark.createDataFrame([(i, v, "x", 1, "y") for i, v in rows], SCHEMA).repartition(3)
    got = centroids.cluster(df, k=k, rounds=3, dim=dim, scale=64)
    assert got.columns == [f.split()[0] for f in centroids.CLUSTERED.split(", ")]
    assert rows_of(got) == brute(rows, k, 3, dim, 64)


def test_given_table(spark):
    t = pandas_table(SF_SMALL, "embeddings", ["vec_id", "embedding"])
    got = centroids.cluster(spark.read.parquet(f"{SF_SMALL}/embeddings.parquet"))
    assert rows_of(got) == brute([(int(i), [float(x) for x in v]) for i, v in zip(t.vec_id, t.embedding)], 16, 3, 64, 64)


def test_oracle(spark):
    from laborlens.llm import queries  # noqa: F401
    from laborlens.plans.registry import all_queries
    status, msg = check(spark, duck_con(SF_SMALL), all_queries()["op12_centroid_clustering"], SF_SMALL)
    assert status == "ok", msg


def test_large_numbers_and_empty_table(spark):
    wide = [(i, [1e30 * (-1) ** i, float(i)], "x", 1, "y") for i in range(6)]
    got = centroids.cluster(spark.createDataFrame(wide, SCHEMA), k=2, dim=2).collect()
    assert len(got) == 6 and all(0 <= r.distance <= r.cluster_inertia <= r.inertia for r in got)
    assert centroids.cluster(spark.createDataFrame([], SCHEMA)).count() == 0
