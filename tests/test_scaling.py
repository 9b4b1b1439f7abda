"""Steps that read or write less: splits and folds by the key, compressed lines, archives written as a stream."""

import glob
import math

import pytest
from pyspark.ml.feature import Imputer, StringIndexer
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import functions as F

from laborlens.operators import ml as ML
from laborlens.operators import sampling as M
from laborlens.plans import files as FP
from laborlens.plans import models as MD
from laborlens.session import materialise, scratch_path
from laborlens.sources import archives as AR
from laborlens.sources import sinks as K


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(spark, some):
    """(id, y, hk): classes of some sizes, one of them null; keys are spread, a few repeat."""
    rows = [(100_000 * k + i, y, (i // same) * 7919 % 10_007 * 1_000_003) for k, (y, n, same) in enumerate(some) for i in range(n)]
    return materialise(spark.createDataFrame(rows, "id long, y int, hk long"), "rows"), rows


@pytest.mark.parametrize("some", [[(0, 400, 1), (1, 41, 1), (None, 30, 1), (2, 1, 1)], [(0, 400, 7), (1, 60, 60)]])
def test_split_takes_the_first_keys_of_each_class(spark, some):
    df, rows = rows_of(spark, some)
    out = M.stratified_split(df, "y", 0.25, "hk")
    got = out.collect()
    assert sorted(r.id for r in got) == sorted(r[0] for r in rows)
    for y in {r[1] for r in rows}:
        keys = sorted(r[2] for r in rows if r[1] == y)
        n = math.floor(len(keys) * 0.25 + 0.5)
        assert sorted(r.hk for r in got if r.y == y and r.split == "teste") == keys[:n]
        assert all(r.split == "treino" for r in got if r.y == y and n and r.hk > keys[n - 1])


def test_split_moves_no_rows(spark):
    df, _ = rows_of(spark, [(0, 400, 1), (1, 41, 1)])
    own = plan(M.stratified_split(df, "y", 0.25, "hk"))
    assert "Window" not in own and "SortMergeJoin" not in own and "hashpartitioning" not in own


@pytest.mark.parametrize("k", [2, 3, 5])
def test_folds_go_round_in_the_order_of_the_key(spark, k):
    df, rows = rows_of(spark, [(0, 400, 1), (1, 41, 1), (None, 30, 1)])
    out = ML.stratified_folds(df, "y", "hk", k)
    for y in (0, 1, None):
        ids = [r[0] for r in sorted((r for r in rows if r[1] == y), key=lambda r: r[2])]
        fold = {r.id: r.fold for r in out.collect() if r.y == y}
        assert [fold[i] for i in ids] == [n % k for n in range(len(ids))]
    assert "SortMergeJoin" not in plan(out)


def test_lines_are_compressed_and_not_sorted_by_folder(spark):
    df = spark.range(5000).select(F.concat(F.lit(" " * 400), F.col("id").cast("string")).alias("value"),
                                  (F.col("id") % 7).alias("nome"))
    at = K.write_text(df, "value", scratch_path(spark, "lines"), ("nome",), "snappy")
    read = spark.read.text(at).select(F.trim("value").cast("long").alias("v"), "nome")
    assert read.count() == 5000 and read.filter("v % 7 <> nome").count() == 0
    sizes = [len(open(f.removeprefix("file:"), "rb").read()) for f in
             [r[0] for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(at).select("path").collect()]]
    assert sum(sizes) < 200_000
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", "0") in ("0", None)


def test_archives_hold_every_line_of_a_year_in_one_member(spark):
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, 50)
    try:
        years = F.when(F.col("id") % 11 == 0, F.lit(None)).otherwise(1995 + F.col("id") % 4).cast("int")
        lines = spark.range(2000, numPartitions=2).select(F.concat(F.lit("l"), F.col("id").cast("string")).alias("value"),
                                                          years.alias("ano"))
        path = FP.write_yearly_archive(lines, scratch_path(spark, "archives"))
    finally:
        spark.conf.set(size, before)
    got = {(r.membro, r.value) for r in AR.read_archives(spark, path, range_bytes=200).collect()}
    want = {(f"dados/PNADC_{None if i % 11 == 0 else 1995 + i % 4}.txt", f"l{i}") for i in range(2000)}
    assert got == want
    assert len(glob.glob(f"{path.removeprefix('file:')}/*.zip")) == 2


def test_predictions_have_a_row_for_each_row_whose_key_repeats(spark):
    df = spark.range(600).select(
        (F.col("id") % 300).alias("hk"), "id", F.col("id").alias("record_id"), F.col("id").alias("l_partkey"),
        F.when(F.col("id") % 4 == 0, "teste").otherwise("treino").alias("split"), (F.col("id") % 2).cast("int").alias("y_true"),
        (F.col("id") % 2).cast("double").alias("label"), F.lit(1.0).alias("peso_classe"),
        *[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(9)).cast("double").alias(c) for k, c in enumerate(MD.NUMERIC)],
        *[F.pmod(F.xxhash64("id", F.lit(9 + k)), F.lit(2)).cast("string").alias(c) for k, c in enumerate(MD.CATEGORICAL)])
    at = (spark.sparkContext.applicationId, "/none")
    MD._TABLES[at] = materialise(df, "ml")
    try:
        rows = MD.forest_predictions(spark, "/none").collect()
        assert sorted(r.l_partkey for r in rows) == list(range(600)) and all(r.prob_ok for r in rows)
        assert [tuple(r) for r in MD.batch_score(spark, "/none").collect()] == [(600, 0)]
    finally:
        del MD._TABLES[at]


def known(spark, n=900):
    """Rows with columns that the forests read; y follows idade."""
    df = spark.range(n).select(
        "id", F.abs(F.xxhash64("id", F.lit(7))).alias("hk"),
        *[F.when(F.col("id") % 31 != k, F.pmod(F.xxhash64("id", F.lit(k)), F.lit(40)).cast("double")).alias(c)
          for k, c in enumerate(MD.NUMERIC)],
        *[F.pmod(F.xxhash64("id", F.lit(9 + k)), F.lit(3)).cast("string").alias(c) for k, c in enumerate(MD.CATEGORICAL)])
    return materialise(df.withColumns({"label": (F.col("idade") + F.col("id") % 13 > 25).cast("double"),
                                       "fold": (F.col("id") % 3).cast("int")}).na.fill(0.0, ["label"]), "known")


@pytest.fixture
def fits(monkeypatch):
    """How often stages that prepare the rows are fitted."""
    seen = {}
    for kind in (Imputer, StringIndexer):
        def fit(self, df, fit=kind._fit, name=kind.__name__):
            seen[name] = seen.get(name, 0) + 1
            return fit(self, df)
        monkeypatch.setattr(kind, "_fit", fit)
    return seen


@pytest.mark.parametrize("replicates", [1, 16, 20])
def test_packed_weights_are_the_draws_of_each_replicate(spark, replicates):
    df = known(spark, 300).select("hk")
    got = ML.packed_weights(df, "hk", replicates).select("hk", *[ML.weight_of(r).alias(f"w{r}") for r in range(replicates)])
    want = df.select("hk", *[M.poisson1(M.uniform(F.col("hk"), F.lit(r))).cast("double") for r in range(replicates)])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_permuted_passes_draw_no_weights_anew(spark):
    df = known(spark)
    model = ML.forest(MD.NUMERIC, MD.CATEGORICAL, 3, 3, 5).fit(df)
    out = ML.permutation_importance(model, df, ["idade", "sexo", "uf"], "hk")
    assert "md5" not in plan(out)
    assert {r.feature for r in out.collect()} == {"idade", "sexo", "uf"}
    assert plan(ML.permute_column(df, "idade", "hk", 100, 4)).count("Exchange") == 1


def test_permuted_columns_hold_their_values_in_other_orders(spark):
    df = known(spark).select("id", "hk", "idade", "uf")
    rows = {r.id: r for r in df.collect()}
    moved = {}
    for k, c in enumerate(("idade", "uf")):
        got = ML.permute_column(df, c, "hk", 100 + k, 4).collect()
        assert sorted(r.id for r in got) == sorted(rows)
        assert sorted(map(str, (r[c] for r in got))) == sorted(str(r[c]) for r in rows.values())
        assert all(r[x] == rows[r.id][x] for r in got for x in ("hk", "idade", "uf") if x != c)
        moved[c] = sum(r[c] != rows[r.id][c] for r in got)
    assert moved["idade"] > 700 and moved["uf"] > 400


@pytest.mark.parametrize("strategies", [["median"], ["median", "mean"]])
def test_cross_validation_prepares_a_fold_once(spark, fits, strategies):
    df = known(spark)
    pipe = ML.forest(MD.NUMERIC, MD.CATEGORICAL, 4, 2, 5)
    imputer, forest = pipe.getStages()[0], pipe.getStages()[-1]
    grid = ML.ParamGridBuilder().addGrid(forest.maxDepth, [1, 3]).addGrid(imputer.strategy, strategies).build()
    kept = spark.sparkContext._jsc.getPersistentRDDs().size()
    cv = ML.cross_validate(df, pipe, grid, "fold")
    assert fits == {"Imputer": 3 * len(strategies) + 1, "StringIndexer": 3 * len(strategies) + 1}
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == kept
    ev = ML.BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="rawPrediction")
    plain = CrossValidator(estimator=pipe, estimatorParamMaps=grid, evaluator=ev, foldCol="fold").fit(df)
    assert cv.avgMetrics == plain.avgMetrics and cv.stdMetrics == plain.stdMetrics and len(set(cv.avgMetrics)) > 1
    p, q = (m.bestModel.transform(df).select("id", "probability").orderBy("id").collect() for m in (cv, plain))
    assert p == q


def test_forests_with_two_weights_share_their_preparation(spark, fits):
    df = known(spark).withColumn("w", (1 + F.col("id") % 3).cast("double"))
    pipes = [ML.forest(MD.NUMERIC, MD.CATEGORICAL, 4, 3, 5, w) for w in (None, "w")]
    models = ML.fit_alike(pipes, df)
    assert fits == {"Imputer": 1, "StringIndexer": 1}
    for p, m in zip(pipes, models):
        a, b = (x.transform(df).select("id", "probability").orderBy("id").collect() for x in (m, p.fit(df)))
        assert a == b


def test_forest_prepares_its_rows_once(spark, fits):
    df = known(spark).select("*", (F.col("id") % 4 == 0).alias("_t"), F.lit(1.5).alias("peso_classe"), F.lit(2.0).alias(MD.WGT))
    df = df.withColumn("split", F.when(F.col("_t"), "teste").otherwise("treino")).withColumn("y_true", F.col("label").cast("int"))
    at = (spark.sparkContext.applicationId, "/none")
    MD._TABLES[at] = materialise(df, "ml")
    try:
        rows = {r.pesos: r for r in MD.forest(spark, "/none").collect()}
    finally:
        del MD._TABLES[at]
    assert fits == {"Imputer": 1, "StringIndexer": 1}
    n_pos = df.filter("_t and label = 1").count()
    assert set(rows) == {"classe", "populacao"}
    assert all((r.n, r.n_pos, r.soma_ok, r.auc_ok, r.metricas_ok, r.peso_pos) == (225, n_pos, True, True, True, 1.5) for r in rows.values())
