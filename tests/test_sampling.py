"""Samples spread over the keys, synthetic rows, permutations, p-values."""

import math

import pytest
from pyspark.sql import functions as F

from laborlens.operators import ml as ML
from laborlens.operators import sampling as M
from laborlens.operators import stats as ST
from laborlens.session import _ensure_checkpoint_dir


def keyed(spark, n=4000):
    return spark.range(n).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"), M.pk_hash("id").alias("hk"))


def test_key_is_uniform_and_follows_md5(spark):
    import hashlib
    rows = keyed(spark).collect()
    assert all(r.hk == int(hashlib.md5(str(r.id).encode()).hexdigest()[:15], 16) for r in rows[:50])
    share = [r.hk / M.KEY_RANGE for r in rows]
    assert abs(sum(share) / len(share) - 0.5) < 0.02 and max(share) > 0.99 and min(share) < 0.01


@pytest.mark.parametrize("draw", [
    lambda d: M.first_n_by_hash(d, 400, "hk"),
    lambda d: M.fraction_by_hash(d, 0.1, "hk"),
    lambda d: M.stratified_downsample(d.withColumn("s", F.lit(1)), ["s"], "y", 0.1, "hk"),
    lambda d: M.stratified_split(d, "y", 0.1, "hk").filter("split = 'teste'"),
    lambda d: M.undersample_majority(d, "y", 1.0, "hk").filter("y = 0"),
])
def test_samples_span_the_key_range(spark, draw):
    ids = sorted(r.id for r in draw(keyed(spark)).collect())
    assert 300 < len(ids) < 500
    assert ids[0] < 200 and ids[-1] > 3800
    quarters = [sum(1 for i in ids if k * 1000 <= i < (k + 1) * 1000) for k in range(4)]
    assert min(quarters) > 60


def test_smote_makes_the_asked_number_between_real_rows(spark):
    d = keyed(spark).withColumn("x", F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id") / 10)) \
        .withColumn("z", F.sin("id"))
    for ratio in (0.05, 0.2, 0.5, 1.0):
        out = M.smote(d, "y", ["x", "z"], "hk", ratio=ratio)
        rows = out.filter("sintetico").collect()
        assert len(rows) == max(0, math.ceil(ratio * 3600) - 400)
        assert all(r.y == 1 and 0 <= r.x <= 400 and -1 <= r.z <= 1 for r in rows)
        again = M.smote(d.repartition(7), "y", ["x", "z"], "hk", ratio=ratio).filter("sintetico").collect()
        assert sorted(tuple(r) for r in rows) == sorted(tuple(r) for r in again)
    assert M.smote(d.filter("y = 1"), "y", ["x"], "hk", 0.5).count() == 400


def test_permutation_keeps_all_rows_and_values(spark):
    d = keyed(spark).withColumn("v", F.col("id"))
    p = ML.permute_column(d, "v", "hk", seed=3)
    rows = p.collect()
    assert sorted(r.id for r in rows) == sorted(r.v for r in rows) == list(range(4000))
    assert sum(r.id != r.v for r in rows) > 2000
    assert {(r.id, r.v) for r in rows} == {(r.id, r.v) for r in ML.permute_column(d.repartition(5), "v", "hk", 3).collect()}


def test_folds_are_stratified(spark):
    t = ML.stratified_folds(keyed(spark), "y", "hk", 3).groupBy("fold", "y").count().collect()
    sizes = {y: sorted(r["count"] for r in t if r.y == y) for y in (0, 1)}
    assert sizes == {0: [1200, 1200, 1200], 1: [133, 133, 134]}


def test_single_class_and_deep_trees_are_refused(spark):
    with pytest.raises(ValueError):
        ML.require_two_classes(spark.createDataFrame([(1.0,), (1.0,)], "label double"))
    with pytest.raises(ValueError):
        ML.forest(["a"], [], max_depth=31)


def test_p_values_against_tables(spark):
    # two-sided p of Student's t: 1 and 2 degrees of freedom in closed form, then quantiles
    rows = [(1.0, 1.0, 0.5), (12.706, 1.0, 0.05), (4.303, 2.0, 0.05), (2.228, 10.0, 0.05), (3.169, 10.0, 0.01),
            (1.96, 1e6, 0.05), (0.0, 5.0, 1.0)]
    got = spark.createDataFrame(rows, "t double, v double, p double") \
        .select("p", ST.t_pvalue(F.col("t"), F.col("v")).alias("q")).collect()
    assert all(abs(r.p - r.q) < 2e-4 for r in got)


def test_trend_p_value(spark):
    rows = [("a", x, 2.0 * x + (0.5 if x % 2 else -0.5)) for x in range(8)] + [("b", 1, 1.0), ("b", 2, 2.0)]
    got = {r.g: r for r in ST.linear_trend(spark.createDataFrame(rows, "g string, x int, y double"), ["g"], "y", "x").collect()}
    assert got["a"].p_valor < 1e-6 and got["b"].p_valor is None


def test_checkpoint_folder_is_the_sessions(spark):
    assert _ensure_checkpoint_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_permutation_shuffles_the_rows_once(spark):
    """Every row gets the value whose place in its bucket is the row's own in another order, by one shuffle."""
    d = keyed(spark).withColumn("v", F.when(F.col("id") % 7 > 0, F.col("id"))).withColumn("none", F.lit(None).cast("string"))
    p = ML.permute_column(d, "v", "hk", seed=3, buckets=4)
    plan = p._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange") == 1 and "Join" not in plan

    def h(n):
        return F.xxhash64(F.col("hk"), F.lit(3), F.lit(n))
    rows = d.select("id", "v", "hk", F.pmod(h(0), F.lit(4)).alias("b"), h(1).alias("to"), h(2).alias("at")).collect()
    want = {}
    for b in range(4):
        own = [r for r in rows if r.b == b]
        want.update(zip([r.id for r in sorted(own, key=lambda r: (r["to"], r.hk))],
                        [r.v for r in sorted(own, key=lambda r: (r["at"], r.hk))]))
    assert {r.id: r.v for r in p.collect()} == want
    assert p.schema["v"].dataType == d.schema["v"].dataType and set(p.columns) == set(d.columns)
