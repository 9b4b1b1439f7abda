"""Ledger as stream state, incremental consolidation, partial states, sketches, forecast, folds by group."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from laborlens.operators import forecast as FC
from laborlens.operators import ml as ML
from laborlens.operators import partials as PT
from laborlens.operators import sketches as SK
from laborlens.operators import stats as ST
from laborlens.session import scratch_path
from laborlens.sources import incremental as IN
from laborlens.streaming import ledger as LG


# --- ledger ------------------------------------------------------------------

DAY0 = dt.datetime(2024, 1, 1)
ATTEMPTS = "nome string, chave long, quando timestamp, status string, origem string"


def attempt(i, name, day, status, origin="a"):
    return name, i, DAY0 + dt.timedelta(days=day), status, origin


def test_decisions_of_one_file():
    us = LG.DAY_US
    kind, e = LG.decide(None, "a", "failed", 0, 3)
    assert (kind, e) == ("novo", ("failed", "a", 1, 0))
    kind, e = LG.decide(e, "a", "failed", us, 3)
    assert (kind, e[2]) == ("repetir", 2)
    kind, e = LG.decide(e, "a", "success", 2 * us, 3)
    assert (kind, e) == ("repetir", ("success", "a", 0, 2 * us))
    assert LG.decide(e, "a", "failed", 5 * us, 3) == ("pular", e)
    assert LG.decide(e, "b", "success", 5 * us, 3)[0] == "outra_origem"
    assert LG.decide(e, "a", "success", 5 * us + 1, 3)[0] == "novo"


def test_ledger_over_three_runs(spark):
    """Failures, a retry, a skip over a restart, a purge by timer; no run decides an attempt twice."""
    runs = [[attempt(1, "x", 0, "failed"), attempt(2, "x", 1, "success"), attempt(3, "y", 1, "failed")],
            [attempt(4, "x", 2, "success"), attempt(5, "y", 2, "failed"), attempt(6, "z", 3, "success")],
            [attempt(7, "x", 9, "success"), attempt(8, "y", 9, "failed"), attempt(9, None, 9, "failed"),
             attempt(10, "z", 4, "success", "b")]]
    landing, out, ckpt = (scratch_path(spark, n) for n in ("attempts", "decided", "state"))
    for rows in runs:
        spark.createDataFrame(rows, ATTEMPTS).write.mode("append").parquet(landing)
        found = LG.run(spark, landing, out, ckpt, days=3, watermark="10 days")
    got = {r.chave: (r.decisao, r.status, r.tentativas) for r in found.collect()}
    assert found.count() == len(got) == 9
    assert got == {1: ("novo", "failed", 1), 2: ("repetir", "success", 0), 3: ("novo", "failed", 1),
                   4: ("pular", "success", 0), 5: ("repetir", "failed", 2), 6: ("novo", "success", 0),
                   7: ("novo", "success", 0), 8: ("novo", "failed", 1), 10: ("outra_origem", "success", 0)}
    assert LG.run(spark, landing, out, ckpt, days=3).count() == 9
    now = {r.nome: (r.status, r.processados) for r in LG.current(found).collect()}
    assert now == {"x": ("success", 3), "y": ("failed", 3), "z": ("success", 2)}


# --- consolidation --------------------------------------------------------------

def part(spark, year, rows, **more):
    df = spark.createDataFrame([(year, i % 2 == 0, i) for i in rows], "ano int, eh_ti boolean, idade int")
    return df.withColumns({k: F.lit(v) for k, v in more.items()})


def file_names(spark, target):
    rows = IN.data(spark, target).withColumn("f", F.input_file_name()).groupBy("ano", "eh_ti").agg(F.collect_set("f").alias("f")).collect()
    return {(r.ano, r.eh_ti): set(r.f) for r in rows}


def test_second_run_rewrites_only_its_partitions(spark):
    landing, target = scratch_path(spark, "landing"), scratch_path(spark, "target")
    part(spark, 2020, range(40)).union(part(spark, 2021, range(30))).write.parquet(f"{landing}/a")
    first = IN.consolidate(spark, landing, target, ["ano", "eh_ti"], forced={"uf": "int"})
    assert (first.run, first.rows) == (1, 70) and len(first.partitions) == 4
    before = file_names(spark, target)
    part(spark, 2021, [2, 4], extra="x").write.parquet(f"{landing}/b")
    second = IN.consolidate(spark, landing, target, ["ano", "eh_ti"])
    after = file_names(spark, target)
    assert second.partitions == ["ano=2021/eh_ti=true"] and second.rows == 2
    changed = {k for k in after if after[k] != before.get(k)}
    assert changed == {(2021, "true")}
    d = IN.data(spark, target)
    assert d.count() == 72 and "extra" not in d.columns and "uf" in d.columns
    assert len(after[(2021, "true")]) == 1                       # compacted
    third = IN.consolidate(spark, landing, target, ["ano", "eh_ti"])
    assert (third.run, third.files) == (2, 0) and file_names(spark, target) == after


def test_a_changed_file_replaces_its_rows(spark):
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq
    landing, target = scratch_path(spark, "landing"), scratch_path(spark, "target")
    folder = landing.replace("file:", "")
    os.makedirs(folder)

    def write(year, ages):
        pq.write_table(pa.table({"ano": pa.array([year] * len(ages), pa.int32()), "idade": pa.array(ages, pa.int32())}),
                       f"{folder}/a.parquet")

    write(2020, list(range(10)))
    IN.consolidate(spark, landing, target, ["ano"])
    write(2022, [1, 2, 3])
    again = IN.consolidate(spark, landing, target, ["ano"])
    assert again.rows == 3 and sorted(again.partitions) == ["ano=2020", "ano=2022"]
    assert {(r.ano, r.idade) for r in IN.data(spark, target).collect()} == {(2022, 1), (2022, 2), (2022, 3)}


def test_a_run_that_stopped_before_the_manifest_is_made_good(spark, monkeypatch):
    landing, target = scratch_path(spark, "landing"), scratch_path(spark, "target")
    part(spark, 2020, range(10)).write.parquet(f"{landing}/a")
    IN.consolidate(spark, landing, target, ["ano"])
    part(spark, 2020, range(5)).write.parquet(f"{landing}/b")
    with monkeypatch.context() as m:
        m.setattr(IN, "MANIFEST", "broken")
        real = IN._write

        def stop(*a):
            real(*a)
            raise RuntimeError("stopped")
        m.setattr(IN, "_write", stop)
        with pytest.raises(RuntimeError):
            IN.consolidate(spark, landing, target, ["ano"])
    assert IN.data(spark, target).count() == 15
    assert IN.consolidate(spark, landing, target, ["ano"]).rows == 5
    assert IN.data(spark, target).count() == 15


# --- partial states ----------------------------------------------------------------

def test_merged_states_equal_a_full_scan(spark):
    landing, store = scratch_path(spark, "landing"), scratch_path(spark, "states")
    df = spark.range(20_000).select((F.col("id") % 97).alias("a"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("b"),
                                    F.concat(F.lit("k"), F.col("id") % 7).alias("c"))
    df.filter("a < 50").repartition(3).write.parquet(f"{landing}/1")
    assert PT.update(spark, landing, store, ["a", "b", "c"]) == 3
    df.filter("a >= 50").repartition(2).write.parquet(f"{landing}/2")
    assert PT.update(spark, landing, store, ["a", "b", "c"]) == 2 and PT.update(spark, landing, store, ["a", "b", "c"]) == 0
    got = {r.coluna: r for r in PT.merged(PT.current(spark, store), [], ["a", "b", "c"]).collect()}
    whole = df.agg(F.avg("a"), F.count("b"), F.max("b")).first()
    assert got["a"].linhas == 20_000 and math.isclose(got["a"].media, whole[0]) and got["a"].distintos == 97
    assert (got["b"].presentes, got["b"].ausentes, got["b"].maximo) == (whole[1], 20_000 - whole[1], whole[2])
    assert abs(got["b"].distintos / whole[1] - 1) < 4 * 1.04 / math.sqrt(1 << PT.LG_K)
    assert got["c"].distintos == 7 and got["c"].media is None


# --- sketches ---------------------------------------------------------------------

@pytest.mark.parametrize("m", [20, 200])
def test_rank_error_is_bounded_on_skewed_weights(spark, monkeypatch, m):
    monkeypatch.setattr(SK, "BUFFER", 500)
    rng = np.random.default_rng(m)
    rows = [(int(g), float(v), float(w)) for g, v, w in zip(
        rng.choice([0, 0, 0, 1], 6000), np.round(rng.lognormal(3, 2, 6000), 3), rng.pareto(0.7, 6000) + 0.01)]
    df = spark.createDataFrame(rows + [(0, None, 1.0), (1, 5.0, None), (1, 5.0, -1.0)], "g int, v double, w double")
    ps = [0.05, 0.25, 0.5, 0.9, 0.99]
    out = {r.g: r for r in SK.quantiles(SK.sketch(df.repartition(4), ["g"], "v", "w", m), ["g"], ps).collect()}
    for g in (0, 1):
        v = np.asarray([r[1] for r in rows if r[0] == g])
        w = np.asarray([r[2] for r in rows if r[0] == g])
        assert out[g].total == pytest.approx(w.sum())
        for i, p in enumerate(ps):
            q = out[g][f"q_{i}"]
            low, high = w[v < q].sum() / w.sum(), w[v <= q].sum() / w.sum()
            assert low - 1 / m <= p <= high + 1 / m


def test_sketches_of_parts_merge_by_union(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.sin("id").alias("v"), F.lit(1.0).alias("w"))
    a, b = SK.sketch(df.filter("id % 2 = 0"), ["g"], "v", "w", 100), SK.sketch(df.filter("id % 2 = 1"), ["g"], "v", "w", 100)
    for r in SK.quantiles(a.unionByName(b), ["g"], [0.5]).collect():
        assert abs(r.q_0) < 0.05 and r.total in (1667, 1666)
    none = SK.quantiles(SK.sketch(df.filter("id < 0"), ["g"], "v", "w"), ["g"], [0.5])
    assert none.count() == 0


# --- forecast ----------------------------------------------------------------------

def design(t, last, period, harmonics, bends):
    x = [np.ones(len(t)), t]
    x += [np.maximum(0, t - last * (i + 1) / (bends + 1)) for i in range(bends)]
    for h in range(1, harmonics + 1):
        x.append(np.cos(2 * np.pi * h / period * t))
        if 2 * h != period:
            x.append(np.sin(2 * np.pi * h / period * t))
    return np.asarray(x).T


def test_forecast_equals_least_squares(spark):
    rng = np.random.default_rng(2)
    rows = [(k, 100 + t, 50 + 3 * t + 10 * math.cos(2 * math.pi * t / 12) * (k + 1) + float(rng.normal()))
            for k in (0, 1) for t in range(60)]
    s = spark.createDataFrame(rows + [(0, None, 1.0), (1, 105, None)], "k int, t long, y double")
    model = FC.fit(FC.normal_equations(s, ["k"], "t", "y", 12, 3, 2), ["k"])
    fits = {r.k: r for r in model.collect()}
    ahead = FC.project(model, ["k"], 6, 12, 3, 2).collect()
    assert len(ahead) == 12
    for k in (0, 1):
        t = np.arange(60.0)
        y = np.asarray([r[2] for r in rows if r[0] == k])
        x = design(t, 59.0, 12, 3, 2)
        beta, rss, rank, _ = np.linalg.lstsq(x, y, rcond=None)
        assert np.allclose(fits[k].coef, beta, rtol=1e-5, atol=1e-5) and fits[k].gl == 60 - rank
        assert fits[k].desvio == pytest.approx(math.sqrt(rss[0] / (60 - rank)), rel=1e-5)
        for r in (r for r in ahead if r.k == k):
            xt = design(np.asarray([r.t - 100.0]), 59.0, 12, 3, 2)[0]
            assert r.previsto == pytest.approx(xt @ beta, rel=1e-5)
            half = 2.0076 * fits[k].desvio * math.sqrt(1 + xt @ np.linalg.inv(x.T @ x) @ xt)
            assert r.superior - r.inferior == pytest.approx(2 * half, rel=1e-3)


def test_forecast_of_short_series(spark):
    s = spark.createDataFrame([(1, 5, 2.0), (2, 1, 1.0), (2, 2, 3.0)], "k int, t long, y double")
    out = FC.project(FC.fit(FC.normal_equations(s, ["k"], "t", "y", 4, 2, 2), ["k"]), ["k"], 2, 4, 2, 2).collect()
    assert len(out) == 4 and all(math.isfinite(r.previsto) and r.inferior is None for r in out)


def test_student_quantiles(spark):
    df = spark.createDataFrame([(0.975, 10.0), (0.95, 3.0), (0.975, 0.0)], "p double, v double")
    got = [r[0] for r in df.select(ST.student_quantile("p", "v")).collect()]
    assert got[:2] == [pytest.approx(2.228139, abs=1e-5), pytest.approx(2.353363, abs=1e-5)] and got[2] is None


# --- folds by group -----------------------------------------------------------------

def test_no_group_is_in_two_folds(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 50 < 17, 0).otherwise(F.col("id") % 50).alias("g"),
                                  (F.col("id") % 9 == 0).cast("int").alias("y"))
    df = df.unionByName(df.limit(5).withColumn("g", F.lit(None).cast("long")))
    out = ML.group_folds(df, ["g"], "y", 4)
    rows = out.groupBy("g").agg(F.countDistinct("fold").alias("k"), F.first("fold").alias("fold"), F.count("*").alias("n"),
                                F.sum("y").alias("pos")).collect()
    assert out.count() == 3005 and all(r.k == 1 for r in rows)
    sizes = [sum(r.n for r in rows if r.fold == f) for f in range(4)]
    positives = [sum(r.pos for r in rows if r.fold == f) for f in range(4)]
    assert max(sizes) == 1020 and min(sizes) >= 600          # one group holds a third of the rows
    assert min(positives) > 0.5 * sum(positives) / 4
