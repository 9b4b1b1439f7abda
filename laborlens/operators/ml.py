"""Model operators on Spark ML.

Training and scoring are Spark ML pipelines (distributed); metrics are the
aggregate operators of `metrics`.  Nothing is collected to the driver except
model parameters (coefficients, importances: one value per feature).
"""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import (Imputer, OneHotEncoder, PCA, StandardScaler, StringIndexer,
                                VectorAssembler)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from laborlens.operators.aggregates import count_if, join_null_safe
from laborlens.operators.quantiles import coarse_bucket
from laborlens.operators.sampling import poisson1, small_table, uniform
from laborlens.session import materialise


def preprocess_stages(numeric: list[str], categorical: list[str]) -> tuple[list, str]:
    """Median-impute numerics, index (unknown kept) + one-hot categoricals."""
    stages = []
    num_out = [f"{c}__imp" for c in numeric]
    if numeric:
        stages.append(Imputer(inputCols=numeric, outputCols=num_out, strategy="median"))
    idx = [f"{c}__idx" for c in categorical]
    ohe = [f"{c}__ohe" for c in categorical]
    if categorical:
        stages.append(StringIndexer(inputCols=categorical, outputCols=idx, handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=idx, outputCols=ohe, handleInvalid="keep"))
    stages.append(VectorAssembler(inputCols=num_out + ohe, outputCol="features", handleInvalid="keep"))
    return stages, "features"


def prepare(df: DataFrame, numeric: list[str], categorical: list[str], label: str) -> DataFrame:
    """Cast features (categoricals as text for the indexer) and the label."""
    cols = [F.col(c).cast("double").alias(c) for c in numeric]
    cols += [F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias(c) for c in categorical]
    rest = [c for c in df.columns if c not in numeric and c not in categorical]
    return df.select(*rest, *cols).withColumn("label", F.col(label).cast("double"))


def balanced_weights(df: DataFrame, label: str = "label", out: str = "peso_classe") -> DataFrame:
    """Class-balanced weights n / (k * n_class) (the 'balanced' option)."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    k = Window.partitionBy(F.lit(0))   # one row per class
    c = c.withColumn(out, F.sum("_nc").over(k) / (F.count(F.lit(1)).over(k) * F.col("_nc")))
    return df.join(F.broadcast(materialise(c.select(label, out), "weights")), label)


def require_two_classes(df: DataFrame, label: str = "label") -> DataFrame:
    """Raise unless the training rows hold two classes."""
    if df.select(label).distinct().count() < 2:
        raise ValueError(f"the training rows have a single class of {label}")
    return df


def forest(numeric, categorical, num_trees=20, max_depth=8, min_leaf=5, weight_col=None,
           seed=42) -> Pipeline:
    """Random forest; `weight_col` holds class or survey weights."""
    if max_depth > 30:
        raise ValueError("Spark's trees are at most 30 levels deep")
    stages, feat = preprocess_stages(numeric, categorical)
    rf = RandomForestClassifier(featuresCol=feat, labelCol="label", numTrees=num_trees,
                                maxDepth=max_depth, minInstancesPerNode=min_leaf, seed=seed)
    if weight_col:
        rf.setWeightCol(weight_col)
    return Pipeline(stages=stages + [rf])


def columns_named(stages: list, params: tuple) -> set:
    """The column names that some parameters of these stages hold."""
    names = set()
    for stage in stages:
        for p in params:
            if stage.hasParam(p) and stage.isDefined(p):
                value = stage.getOrDefault(p)
                names.update([value] if isinstance(value, str) else value)
    return names


def kept_rows(prepared: DataFrame, estimators: list) -> DataFrame:
    """The columns that the estimators read, kept as long as they read them: a forest's fit makes four passes over its
    rows before it holds its own, each of which would compute the features again.  The partitions and their order
    stay, so forests draw the same bags.  The caller gives them up (``unpersist``)."""
    read = columns_named(estimators, ("featuresCol", "labelCol", "weightCol"))
    return prepared.select(*[c for c in prepared.columns if c in read]).persist()


def fit_alike(pipelines: list[Pipeline], df: DataFrame) -> list[PipelineModel]:
    """Fits pipelines that differ in their last stage only: the stages before it are fitted, and the features computed, once."""
    stages = [p.getStages() for p in pipelines]
    prepare = Pipeline(stages=stages[0][:-1]).fit(df)
    last = [s[-1] for s in stages]
    rows = kept_rows(prepare.transform(df), last)
    try:
        return [PipelineModel(prepare.stages + [e.fit(rows)]) for e in last]
    finally:
        rows.unpersist()


def logistic(numeric, categorical, weight_col=None) -> Pipeline:
    """Standardised logistic regression."""
    stages, feat = preprocess_stages(numeric, categorical)
    stages.append(StandardScaler(inputCol=feat, outputCol="features_std", withMean=False))
    lr = LogisticRegression(featuresCol="features_std", labelCol="label", maxIter=50)
    if weight_col:
        lr.setWeightCol(weight_col)
    return Pipeline(stages=stages + [lr])


def positive_probability(pred: DataFrame, out: str = "y_proba") -> DataFrame:
    return pred.withColumn(out, vector_to_array("probability")[1])


def feature_names(model: PipelineModel, features_col: str = "features", df: DataFrame | None = None) -> list:
    """Names of the assembled vector slots (from the ML attribute metadata)."""
    meta = df.schema[features_col].metadata if df is not None else {}
    attrs = meta.get("ml_attr", {}).get("attrs", {})
    slots = []
    for group in attrs.values():
        slots.extend(group)
    slots.sort(key=lambda a: a["idx"])
    return [a["name"] for a in slots]


def source_column(slot: str, sources: list[str]) -> str:
    """Map a vector slot name back to its source column by prefix match
    (longest source first, so multi-word names are not split)."""
    for s in sorted(sources, key=len, reverse=True):
        if slot.startswith(s):
            return s
    return slot


def kmeans(df: DataFrame, cols: list[str], k: int = 4, seed: int = 42, pca_k: int | None = None):
    """K-means on the given columns; optional standardise -> PCA first."""
    stages = [VectorAssembler(inputCols=cols, outputCol="_v", handleInvalid="skip")]
    feat = "_v"
    if pca_k:
        stages += [StandardScaler(inputCol="_v", outputCol="_s", withMean=True, withStd=True),
                   PCA(k=pca_k, inputCol="_s", outputCol="_pca")]
        feat = "_pca"
    stages.append(KMeans(k=k, seed=seed, featuresCol=feat, predictionCol="cluster"))
    return Pipeline(stages=stages).fit(df)


def cluster_summary(pred: DataFrame, col: str) -> DataFrame:
    """Per cluster mean / min / max / n."""
    return pred.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg(col).alias("media"),
                                       F.min(col).alias("minimo"), F.max(col).alias("maximo"))


def permute_column(df: DataFrame, col: str, key: str, seed: int, buckets: int = 1024) -> DataFrame:
    """A permutation of one column without a global sort.  Rows fall into buckets
    by a hash of the uniform `key` and the seed; inside a bucket the values go to the rows in
    another hash order.  Everything follows from the key, so a repeated task
    permutes alike.  One shuffle of the rows."""
    def place(n: int):
        return F.row_number().over(Window.partitionBy("_pb").orderBy(F.xxhash64(F.col(key), F.lit(seed), F.lit(n)), key))
    rest = F.struct(*[c for c in df.columns if c != col])
    bucket = F.pmod(F.xxhash64(F.col(key), F.lit(seed), F.lit(0)), F.lit(buckets)).cast("int")
    t = df.repartition(bucket).withColumn("_pb", bucket).withColumn("_to", place(1)).withColumn("_from", place(2))
    # a row's place and its value's place, in one order: a row's new value comes right behind it
    both = t.select("_pb", F.inline(F.array(
        F.struct(F.col("_to").alias("_k"), F.lit(False).alias("_value"), rest.alias("_row"), F.when(F.lit(False), F.col(col)).alias("_v")),
        F.struct(F.col("_from").alias("_k"), F.lit(True).alias("_value"), F.when(F.lit(False), rest).alias("_row"), F.col(col).alias("_v")))))
    both = both.withColumn("_next", F.lead("_v").over(Window.partitionBy("_pb").orderBy("_k", "_value")))
    return both.filter(~F.col("_value")).select("_row.*", F.col("_next").alias(col))


def columns_read(model: PipelineModel, df: DataFrame) -> list[str]:
    """The columns of `df` that the stages of a fitted pipeline read."""
    names = columns_named(model.stages, ("inputCol", "inputCols", "featuresCol"))
    return [c for c in df.columns if c in names]


PER_LONG = 16                    # Poisson weights (0 to 12) in a long, four bits each


def packed_weights(df: DataFrame, key: str, replicates: int) -> DataFrame:
    """Columns _w0, _w1, ... with the Poisson bootstrap weights of a row for all replicates (``weight_of``)."""
    names = [f"_u{r}" for r in range(replicates)]
    t = df.select("*", *[uniform(F.col(key), F.lit(r)).alias(u) for r, u in enumerate(names)])   # each MD5 once
    pack = lambda word, u: F.shiftleft(word, 4).bitwiseOR(poisson1(u).cast("long"))
    return t.select(*df.columns, *[
        F.aggregate(F.array(*reversed(names[at:at + PER_LONG])), F.lit(0).cast("long"), pack).alias(f"_w{at // PER_LONG}")
        for at in range(0, replicates, PER_LONG)])


def weight_of(r: int) -> Column:
    return F.shiftright(f"_w{r // PER_LONG}", 4 * (r % PER_LONG)).bitwiseAND(F.lit(15).cast("long")).cast("double")


def permutation_importance(model, test: DataFrame, features: list[str], key: str, replicates: int = 20,
                           seed: int = 100) -> DataFrame:
    """F1 drop of every feature when its column is permuted, with the mean, standard
    deviation and 2.5 % / 97.5 % quantiles over Poisson bootstrap weights of the test rows.

    The columns that the model reads and the weights of all replicates are written once; per feature one pass over
    them, in which the replicates are sums side by side.  Columns are permuted in buckets of about 4096 rows."""
    test = test.select(key, "label", *[c for c in columns_read(model, test) if c not in (key, "label")])
    test = materialise(packed_weights(test, key, replicates), "permuta")
    buckets = max(1, test.count() // 4096)

    def scores(df: DataFrame, name: str) -> DataFrame:
        pred = positive_probability(model.transform(df))
        p, y = F.col("y_proba") >= 0.5, F.col("label") == 1
        sums = [F.sum(F.when(cond, weight_of(r)).otherwise(0.0)).alias(f"{k}{r}") for r in range(replicates)
                for k, cond in (("tp", y & p), ("e", y != p))]
        row = pred.agg(*sums)
        f1 = F.array(*[2 * F.col(f"tp{r}") / F.greatest(2 * F.col(f"tp{r}") + F.col(f"e{r}"), F.lit(1.0))
                       for r in range(replicates)])
        return row.select(F.lit(name).alias("feature"), f1.alias("f1"))

    base = scores(test, "").select(F.col("f1").alias("f1_base"))
    parts = [scores(permute_column(test, c, key, seed + k, buckets), c) for k, c in enumerate(features)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    drops = every.crossJoin(F.broadcast(base)).select(                             # one-row base
        "feature", F.explode(F.zip_with("f1_base", "f1", lambda a, b: a - b)).alias("queda"))
    return drops.groupBy("feature").agg(
        F.count(F.lit(1)).alias("replicas"), F.avg("queda").alias("media"), F.stddev("queda").alias("desvio"),
        F.percentile("queda", 0.025).alias("q025"), F.percentile("queda", 0.975).alias("q975"))


def f1_of(pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    p = F.col("y_proba") >= threshold
    y = F.col("label") == 1
    tp, fp, fn = count_if(y & p), count_if(~y & p), count_if(y & ~p)
    return pred.agg((2 * tp / F.greatest(2 * tp + fp + fn, F.lit(1))).alias("f1"))


def stratified_folds(df: DataFrame, y: str, key: str, k: int, ties: tuple = ()) -> DataFrame:
    """Column `fold`: within each class the rows go round the k folds in hash order,
    so every fold has the class shares of the whole.

    Rows are numbered within ranges of the key, a shuffle of them; a range's first number follows from the counts of
    those before it.  ``df`` is read twice, so it should be a written table."""
    t = df.withColumn("_b", coarse_bucket(key))
    before = Window.partitionBy(y).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)     # 256 ranges an octave
    first = t.groupBy(y, "_b").agg(F.count(F.lit(1)).alias("_n"))
    first = first.select(y, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    rows = t.withColumn("_row", F.row_number().over(Window.partitionBy(y, "_b").orderBy(key, *ties)))
    rows = join_null_safe(rows, small_table(first), [y, "_b"])
    return rows.withColumn("fold", ((F.col("_first") + F.col("_row") - 1) % k).cast("int")).select(*df.columns, "fold")


MAX_GROUPS = 1_000_000


def group_folds(df: DataFrame, groups: list[str], y: str, k: int) -> DataFrame:
    """Column `fold`: whole groups (such as periods) go to one fold each.

    The groups, largest first (ties by their key), go one by one to the fold whose fullest class would then
    be the least full, as a share of that class over all rows (ties: the first fold).  One row
    a group goes through the driver, at most `MAX_GROUPS`."""
    cells = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"), F.count(F.when(F.col(y) == 1, 1)).alias("_n1"))
    rows = cells.orderBy(F.col("_n").desc(), *[F.col(g).asc_nulls_first() for g in groups]).limit(MAX_GROUPS + 1).collect()
    if len(rows) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups")
    n1 = sum(r["_n1"] for r in rows)
    n0 = sum(r["_n"] for r in rows) - n1
    held = [[0, 0] for _ in range(k)]
    dealt = []
    for r in rows:
        own = (r["_n"] - r["_n1"], r["_n1"])
        best = min(range(k), key=lambda f: (max((held[f][0] + own[0]) / max(n0, 1), (held[f][1] + own[1]) / max(n1, 1)), f))
        held[best][0] += own[0]
        held[best][1] += own[1]
        dealt.append((*[r[g] for g in groups], best))
    schema = StructType([*[cells.schema[g] for g in groups], StructField("fold", IntegerType())])
    table = df.sparkSession.createDataFrame(dealt, schema)
    same = [df[g].eqNullSafe(table[g]) for g in groups]
    return df.join(table, same).select(*[df[c] for c in df.columns], table["fold"])


class PreparedCrossValidator(CrossValidator):
    """Spark's cross-validation of a pipeline, with its folds, averages and last fit of the best; the stages before the last
    are fitted, and their columns computed, once per fold and not once per point of the grid that leaves them as they are."""

    def _fit(self, dataset: DataFrame) -> CrossValidatorModel:
        est, grid, ev = self.getEstimator(), self.getEstimatorParamMaps(), self.getEvaluator()
        *before, last = est.getStages()
        same = []                                                       # grid points by what they set in the stages before
        for j, point in enumerate(grid):
            rest = {p: v for p, v in point.items() if p.parent != last.uid}
            for known, js in same:
                if known == rest:
                    js.append(j)
                    break
            else:
                same.append((rest, [j]))
        metrics = []
        for train, validation in self._kFold(dataset):
            found = [0.0] * len(grid)
            for rest, js in same:
                prepare = Pipeline(stages=[s.copy(rest) for s in before]).fit(train)
                fit_on = kept_rows(prepare.transform(train), [last])
                test_on = kept_rows(prepare.transform(validation), [last])
                try:
                    for j in js:
                        found[j] = ev.evaluate(last.copy(grid[j]).fit(fit_on).transform(test_on))
                finally:
                    fit_on.unpersist()
                    test_on.unpersist()
            metrics.append(found)
        mean, std = self._gen_avg_and_std_metrics(metrics)
        best = grid[int(np.argmax(mean) if ev.isLargerBetter() else np.argmin(mean))]
        return self._copyValues(CrossValidatorModel(fit_alike([est.copy(best)], dataset)[0], mean, None, std))


def cross_validate(df: DataFrame, pipeline: Pipeline, grid_param_map, fold_col: str, seed: int = 42):
    """K-fold CV with a precomputed (hash) fold column and a small grid."""
    ev = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="rawPrediction")
    cv = PreparedCrossValidator(estimator=pipeline, estimatorParamMaps=grid_param_map, evaluator=ev,
                                foldCol=fold_col, seed=seed)
    return cv.fit(df)


__all__ = ["ParamGridBuilder", "PipelineModel", "BinaryClassificationEvaluator"]
