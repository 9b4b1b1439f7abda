"""Classification metrics as aggregates.

All metrics are conditional aggregates over (y, score, weight); the threshold
sweep evaluates every threshold inside one aggregate pass (no row x threshold
product), and the ranking metrics use distributed running sums over the
distinct scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laborlens import params as P
from laborlens.operators.quantiles import running_sums


def _w(w):
    return F.lit(1.0) if w is None else F.coalesce(F.col(w).cast("double"), F.lit(0.0))


def confusion_aggs(y: str, pred: Column, w: str | None = None, suffix: str = "") -> list:
    """tp, fp, tn, fn (weighted sums when `w` is given)."""
    yy = F.col(y) == 1
    ww = _w(w)
    return [F.sum(F.when(yy & pred, ww).otherwise(0.0)).alias(f"tp{suffix}"),
            F.sum(F.when(~yy & pred, ww).otherwise(0.0)).alias(f"fp{suffix}"),
            F.sum(F.when(~yy & ~pred, ww).otherwise(0.0)).alias(f"tn{suffix}"),
            F.sum(F.when(yy & ~pred, ww).otherwise(0.0)).alias(f"fn{suffix}")]


def derive_metrics(df: DataFrame, suffix: str = "", places: int = 6) -> DataFrame:
    """accuracy, balanced accuracy, precision, recall, specificity, F1 from tp/fp/tn/fn."""
    tp, fp, tn, fn = (F.col(f"{c}{suffix}") for c in ("tp", "fp", "tn", "fn"))
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    spec = F.when(tn + fp > 0, tn / (tn + fp)).otherwise(0.0)
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
    acc = F.when(tp + fp + tn + fn > 0, (tp + tn) / (tp + fp + tn + fn))
    r = lambda c: F.round(c, places)
    return df.withColumns({f"accuracy{suffix}": r(acc), f"balanced_accuracy{suffix}": r((rec + spec) / 2),
                           f"precision{suffix}": r(prec), f"recall{suffix}": r(rec),
                           f"f1{suffix}": r(f1)})


def classification_report(df: DataFrame, y: str, score: str, threshold: float = 0.5,
                          w: str | None = None, groups: list[str] | None = None) -> DataFrame:
    """Metrics at one threshold, per group."""
    pred = F.col(score) >= threshold
    g = df.groupBy(*(groups or []))
    t = g.agg(F.count(F.lit(1)).alias("n"), *confusion_aggs(y, pred, w))
    return derive_metrics(t)


def auc_exact(df: DataFrame, y: str, score: str, w: str | None = None,
              groups: list[str] | None = None) -> DataFrame:
    """Exact (weighted) ROC AUC with half credit for ties:
    Σ_s wp(s) (Wn(< s) + wn(s) / 2) / (Wp Wn), over distinct scores."""
    groups = groups or []
    ww = _w(w)
    t = df.filter(F.col(score).isNotNull()).groupBy(*groups, score).agg(
        F.sum(F.when(F.col(y) == 1, ww).otherwise(0.0)).alias("wp"),
        F.sum(F.when(F.col(y) == 1, 0.0).otherwise(ww)).alias("wn"))
    rt = running_sums(t, groups, score, ["wn"])
    below = F.col("cum_wn") - F.col("wn")
    out = rt.groupBy(*groups).agg(F.sum(F.col("wp") * (below + F.col("wn") / 2)).alias("_num"),
                                  F.sum("wp").alias("_p"), F.max("total_wn").alias("_n"))
    return out.select(*groups, F.when((F.col("_p") > 0) & (F.col("_n") > 0),
                                      F.col("_num") / (F.col("_p") * F.col("_n"))).alias("auc"))


def average_precision(df: DataFrame, y: str, score: str, w: str | None = None,
                      groups: list[str] | None = None) -> DataFrame:
    """PR AUC as average precision Σ_s (wp(s)/P) * precision(>= s)."""
    groups = groups or []
    ww = _w(w)
    t = df.filter(F.col(score).isNotNull()).groupBy(*groups, score).agg(
        F.sum(F.when(F.col(y) == 1, ww).otherwise(0.0)).alias("wp"),
        F.sum(F.when(F.col(y) == 1, 0.0).otherwise(ww)).alias("wn"))
    rt = running_sums(t, groups, score, ["wp", "wn"], descending=True)
    prec = F.col("cum_wp") / (F.col("cum_wp") + F.col("cum_wn"))
    return rt.groupBy(*groups).agg(
        F.sum(F.when(F.col("total_wp") > 0, F.col("wp") / F.col("total_wp") * prec)).alias("ap"))


def threshold_sweep(df: DataFrame, y: str, score: str, w: str | None = None,
                    thresholds=P.THRESHOLDS) -> DataFrame:
    """Metrics at each threshold.  Every row is counted once, in the
    bucket k = number of thresholds its score reaches (one small aggregate of
    len(thresholds)+1 rows); predicted-positive counts at threshold i are the
    sums over k >= i (the fixed 19-row threshold grid joined to that <= 20-row
    table — both sides bounded by the threshold count, not by the data)."""
    k = sum((F.col(score) >= F.lit(float(t))).cast("int") for t in thresholds)
    yy = F.col(y) == 1
    ww = _w(w)
    aggs = [F.sum(F.when(yy, 1.0).otherwise(0.0)).alias("_pos"),
            F.sum(F.when(yy, 0.0).otherwise(1.0)).alias("_neg")]
    if w is not None:
        aggs += [F.sum(F.when(yy, ww).otherwise(0.0)).alias("_pos_w"),
                 F.sum(F.when(yy, 0.0).otherwise(ww)).alias("_neg_w")]
    kb = df.groupBy(k.alias("_k")).agg(*aggs)
    grid = df.sparkSession.createDataFrame([(i + 1, float(t)) for i, t in enumerate(thresholds)],
                                           "_i int, limiar double")
    full = F.broadcast(grid).join(kb, F.col("_k") >= F.col("_i"), "left")   # <= 19 x 20 rows
    tot = kb.agg(*[F.sum(c).alias(f"{c}_t") for c in kb.columns if c != "_k"])
    sums = full.groupBy("_i", "limiar").agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(f"{c}_ge")
                                             for c in kb.columns if c != "_k"])
    t = sums.join(F.broadcast(tot), how="inner")                              # one-row totals
    cols = [F.col("limiar"),
            F.col("_pos_ge").alias("tp"), F.col("_neg_ge").alias("fp"),
            (F.col("_neg_t") - F.col("_neg_ge")).alias("tn"), (F.col("_pos_t") - F.col("_pos_ge")).alias("fn")]
    if w is not None:
        cols += [F.col("_pos_w_ge").alias("tp_w"), F.col("_neg_w_ge").alias("fp_w"),
                 (F.col("_neg_w_t") - F.col("_neg_w_ge")).alias("tn_w"),
                 (F.col("_pos_w_t") - F.col("_pos_w_ge")).alias("fn_w")]
    out = derive_metrics(t.select(*cols))
    if w is not None:
        out = derive_metrics(out, "_w")
    return out


def best_threshold(sweep: DataFrame, metric: str = "f1") -> DataFrame:
    """Arg-max threshold (ties -> smallest threshold)."""
    return sweep.agg(F.min_by("limiar", F.struct(-F.col(metric), F.col("limiar"))).alias("limiar"),
                     F.max(metric).alias(metric))


def calibration(df: DataFrame, y: str, score: str, bins: int = P.CALIBRATION_BINS) -> DataFrame:
    """Uniform bins of the score; mean score and observed rate per bin."""
    b = F.least(F.floor(F.col(score) * bins).cast("int"), F.lit(bins - 1))
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"),
                                          F.round(F.avg(score), 6).alias("prob_media"),
                                          F.round(F.avg(F.col(y).cast("double")), 6).alias("taxa_observada"))


def subgroup_metrics(df: DataFrame, y: str, score: str, group_cols: list[str],
                     threshold: float = 0.5, min_n: int = 10) -> DataFrame:
    """Metrics of every (group column, value).  `valido` says whether the group has
    min_n rows and both classes; the metrics of the others are null."""
    long = df.select(y, score, *[F.col(c).cast("string").alias(c) for c in group_cols]) \
             .unpivot([y, score], group_cols, "grupo", "valor")
    pred = F.col(score) >= threshold
    t = long.groupBy("grupo", "valor").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(y)).alias("_pos"), *confusion_aggs(y, pred))
    t = t.withColumn("valido", (F.col("n") >= min_n) & (F.col("_pos") > 0) & (F.col("_pos") < F.col("n")))
    t = derive_metrics(t.drop("_pos"))
    derived = ("accuracy", "balanced_accuracy", "precision", "recall", "f1")
    return t.withColumns({c: F.when(F.col("valido"), F.col(c)) for c in derived})


def class_report(df: DataFrame, y: str, score: str, threshold: float = 0.5, w: str | None = None) -> DataFrame:
    """Precision, recall, F1 and support of each class, and their macro and
    support-weighted means, from one aggregate row."""
    row = df.agg(*confusion_aggs(y, F.col(score) >= threshold, w))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))

    def line(name, hit, wrong, missed):
        prec = F.when(hit + wrong > 0, hit / (hit + wrong)).otherwise(0.0)
        rec = F.when(hit + missed > 0, hit / (hit + missed)).otherwise(0.0)
        f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
        return F.struct(F.lit(name).alias("classe"), prec.alias("precision"), rec.alias("recall"), f1.alias("f1"),
                        (hit + missed).alias("suporte"))

    both = row.select(line("0", tn, fn, fp).alias("a"), line("1", tp, fp, fn).alias("b"))

    def mean(name, wa, wb):
        cols = [((F.col(f"a.{c}") * wa + F.col(f"b.{c}") * wb) / (wa + wb)).alias(c)
                for c in ("precision", "recall", "f1")]
        return F.struct(F.lit(name).alias("classe"), *cols, (F.col("a.suporte") + F.col("b.suporte")).alias("suporte"))

    lines = both.select(F.inline(F.array(
        F.col("a"), F.col("b"), mean("macro", F.lit(1.0), F.lit(1.0)),
        mean("ponderada", F.col("a.suporte"), F.col("b.suporte")))))
    return lines.select("classe", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")],
                        F.round("suporte", 4).alias("suporte"))


def score_table(df: DataFrame, y: str, score: str, weights: dict) -> DataFrame:
    """One row per distinct score with the positive and negative weight of each variant
    (`weights`: name -> weight column or None): all ranking metrics need no more."""
    pos = F.col(y) == 1
    return df.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(*[a for name, w in weights.items() for a in (
        F.sum(F.when(pos, _w(w)).otherwise(0.0)).alias(f"wp_{name}"),
        F.sum(F.when(pos, 0.0).otherwise(_w(w))).alias(f"wn_{name}"))])


def curve_points(table: DataFrame, name: str) -> DataFrame:
    """A ROC and a precision-recall point per distinct score: the weights of the
    scores from it upwards, and fpr, tpr, precision, recall."""
    wp, wn = f"wp_{name}", f"wn_{name}"
    rt = running_sums(table.select("score", wp, wn), [], "score", [wp, wn], descending=True)
    tp, fp = F.col(f"cum_{wp}"), F.col(f"cum_{wn}")
    share = lambda a, b: F.when(b > 0, a / b)
    return rt.select("score", F.col(wp).alias("wp"), F.col(wn).alias("wn"), tp.alias("tp"), fp.alias("fp"),
                     share(fp, F.col(f"total_{wn}")).alias("fpr"), share(tp, F.col(f"total_{wp}")).alias("tpr"),
                     share(tp, tp + fp).alias("precision"), share(tp, F.col(f"total_{wp}")).alias("recall"),
                     F.col(f"total_{wp}").alias("total_p"), F.col(f"total_{wn}").alias("total_n"))


def ranking_metrics(table: DataFrame, names: list[str]) -> DataFrame:
    """Exact AUC (half credit for ties) and average precision of every variant of a
    score table, from one ordering of the scores."""
    cols = [f"{k}_{n}" for n in names for k in ("wp", "wn")]
    rt = running_sums(table, [], "score", cols, descending=True)

    def pair(n):
        wp, wn = F.col(f"wp_{n}"), F.col(f"wn_{n}")
        tp, fp = F.col(f"cum_wp_{n}"), F.col(f"cum_wn_{n}")
        below = F.col(f"total_wn_{n}") - fp
        return (F.sum(wp * (below + wn / 2)).alias(f"num_{n}"),
                (F.sum(wp) * F.max(f"total_wn_{n}")).alias(f"den_{n}"),
                F.sum(F.when(F.col(f"total_wp_{n}") > 0, wp / F.col(f"total_wp_{n}") * tp / (tp + fp))).alias(f"ap_{n}"))

    row = rt.agg(*[a for n in names for a in pair(n)])
    return row.select(F.inline(F.array(*[F.struct(
        F.lit(n).alias("variante"), F.when(F.col(f"den_{n}") > 0, F.col(f"num_{n}") / F.col(f"den_{n}")).alias("auc"),
        F.col(f"ap_{n}").alias("ap")) for n in names])))
