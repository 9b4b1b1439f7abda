"""Exact weighted quantiles and running weights at scale.

Plan (no task ever holds a whole group):

1. ``groupBy(g, v)`` -> one row per distinct value with Σw and min w
   (partial aggregation; a hot value collapses to one row).
2. Each distinct value gets a monotone *magnitude bucket*
   ``floor(65536 * log2|v|)`` (sign-separated); a bucket spans a factor of
   2^(1/65536) in value.  Bucket totals are a bounded table (at most 65536
   rows per octave spanned, per group), so their running offsets are a cheap
   window.
3. Inside a bucket, an ordered window gives the exact running sum; adding the
   bucket offset gives the running weight of every distinct value.

The running table then answers any percentile with one conditional aggregate
per group.  Java's ``Math.log`` is semi-monotonic, so the bucket order agrees
with the value order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laborlens.operators.aggregates import join_null_safe, w_ok

_UNB = Window.unboundedPreceding


BUCKETS_PER_OCTAVE = 65536
_SIGN_OFFSET = 1 << 28          # > 65536 * 1075 (the log2 range of doubles)


FINE_PER_COARSE = 256            # coarse buckets: 256 per octave


def _signed(x: Column, lg: Column) -> Column:
    return (F.when(x > 0, F.lit(_SIGN_OFFSET) + lg)
            .when(x < 0, F.lit(-_SIGN_OFFSET) - lg)
            .otherwise(F.lit(0))).cast("long")


def value_bucket(v) -> Column:
    """Monotone fine bucket of a value: floor(65536 * log2|v|), sign-separated.
    A bucket spans a factor 2^(1/65536), so even uniformly spread keys (hashes,
    scores) put ~1e-5 of an octave's rows in one bucket."""
    x = F.col(v) if isinstance(v, str) else v
    return _signed(x, F.floor(F.log2(F.abs(x)) * BUCKETS_PER_OCTAVE))


def coarse_bucket(v) -> Column:
    """Monotone coarse bucket (256 per octave) that contains whole fine buckets:
    floor(fine / 256) on the unsigned log index, then the same sign split."""
    x = F.col(v) if isinstance(v, str) else v
    lg = F.floor(F.log2(F.abs(x)) * BUCKETS_PER_OCTAVE)
    return _signed(x, F.floor(lg / FINE_PER_COARSE))


def value_weights(df: DataFrame, groups: list[str], v: str, w: str) -> DataFrame:
    """Step 1: distinct (groups, v) with sw = Σw and mw = min w (strict mask)."""
    ok = F.col(v).isNotNull() & w_ok(w)
    return (df.filter(ok).groupBy(*groups, v)
              .agg(F.sum(w).alias("sw"), F.min(w).alias("mw")))


def running_sums(vt: DataFrame, groups: list[str], v: str, cols: list[str],
                 descending: bool = False, ties: tuple = ()) -> DataFrame:
    """Running sums of `cols` ordered by `v` within `groups` (one row per
    distinct v expected): adds `cum_<c>` (inclusive) and `total_<c>`.

    Three levels, each window over a bounded partition: coarse-bucket totals
    (<= 256 per octave per group) get the group-wide window; fine-bucket totals
    are windowed inside their coarse bucket (<= 256 each); rows are ordered
    inside their fine bucket (2^-16 of an octave).  `ties`: columns that order
    rows of one v, where v may repeat."""
    key = F.col(v) if not descending else -F.col(v)
    vt = vt.withColumn("_cb", coarse_bucket(key)).withColumn("_fb", value_bucket(key))
    part = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    ct = vt.groupBy(*groups, "_cb").agg(*[F.sum(c).alias(f"_cs_{c}") for c in cols])
    for c in cols:
        zero = F.lit(0).cast(ct.schema[f"_cs_{c}"].dataType)
        ct = (ct.withColumn(f"_co_{c}", F.coalesce(
                  F.sum(f"_cs_{c}").over(part.orderBy("_cb").rowsBetween(_UNB, -1)), zero))
                .withColumn(f"total_{c}", F.sum(f"_cs_{c}").over(part)))
    ct = ct.drop(*[f"_cs_{c}" for c in cols])
    ft = vt.groupBy(*groups, "_cb", "_fb").agg(*[F.sum(c).alias(f"_fs_{c}") for c in cols])
    inner = Window.partitionBy(*groups, "_cb").orderBy("_fb").rowsBetween(_UNB, -1)
    for c in cols:
        zero = F.lit(0).cast(ft.schema[f"_fs_{c}"].dataType)
        ft = ft.withColumn(f"_fi_{c}", F.coalesce(F.sum(f"_fs_{c}").over(inner), zero))
    ft = join_null_safe(ft, ct, list(groups) + ["_cb"])
    ft = ft.select(*groups, "_fb", *[(F.col(f"_co_{c}") + F.col(f"_fi_{c}")).alias(f"_fo_{c}") for c in cols],
                   *[f"total_{c}" for c in cols])
    j = join_null_safe(vt.drop("_cb"), ft, list(groups) + ["_fb"])
    order = F.col(v).desc() if descending else F.col(v).asc()
    wv = Window.partitionBy(*groups, "_fb").orderBy(order, *ties).rowsBetween(_UNB, 0)
    for c in cols:
        j = j.withColumn(f"cum_{c}", F.col(f"_fo_{c}") + F.sum(c).over(wv))
    return j.drop("_fb", *[f"_fo_{c}" for c in cols])


def running_weights(vt: DataFrame, groups: list[str], v: str) -> DataFrame:
    """Add `cum` (Σw up to and including v), `before` (= cum - sw) and
    `total` per group to a distinct-value table with column `sw`."""
    j = running_sums(vt, groups, v, ["sw"])
    j = j.withColumnsRenamed({"cum_sw": "cum", "total_sw": "total"})
    return j.withColumn("before", F.col("cum") - F.col("sw"))


def _pname(p: float) -> str:
    s = f"{p:.4f}".rstrip("0").rstrip(".").replace(".", "_")
    return f"p{s}"


def weighted_percentiles(df: DataFrame, groups: list[str], v: str, w: str,
                         ps: list[float], interpolate: bool = True) -> DataFrame:
    """Per group, one column per p.

    interpolate=True  (A4): first v whose normalised running weight reaches p;
        if p falls on that value's first row, interpolate linearly from the
        previous value (rows of a value ordered by weight).
    interpolate=False (A5): value of the last row whose normalised running
        weight is <= p (else the smallest value).
    """
    return percentiles_from_values(value_weights(df, groups, v, w), groups, v, ps, interpolate)


def regroup_values(vt: DataFrame, groups: list[str], v: str) -> DataFrame:
    """Distinct-value table re-aggregated to coarser groups (Σ sw, min mw):
    several groupings share one scan of the rows."""
    return vt.groupBy(*groups, v).agg(F.sum("sw").alias("sw"), F.min("mw").alias("mw"))


def percentiles_from_values(vt: DataFrame, groups: list[str], v: str, ps: list[float],
                            interpolate: bool = True) -> DataFrame:
    """`weighted_percentiles` on a distinct-value table (groups, v, sw, mw)."""
    return percentiles_targeted(vt, groups, v, ps, interpolate)


def percentiles_full_order(vt: DataFrame, groups: list[str], v: str, ps: list[float],
                           interpolate: bool = True) -> DataFrame:
    """Reference path: running weight of every distinct value (W1), then the
    same rules; used by tests to cross-check the targeted path."""
    rt = running_weights(vt, groups, v)
    c = F.col("cum") / F.col("total")
    first_row = (F.col("before") + F.col("mw")) / F.col("total")
    aggs = []
    for p in ps:
        pl = F.lit(float(p))
        if interpolate:
            aggs += [F.min(F.when(c >= pl, F.col(v))).alias(f"_t{_pname(p)}"),
                     F.min_by(F.col("mw"), F.when(c >= pl, F.col(v))).alias(f"_m{_pname(p)}"),
                     F.max(F.when(c < pl, F.col(v))).alias(f"_v{_pname(p)}"),
                     F.max(F.when(c < pl, F.col("cum"))).alias(f"_b{_pname(p)}")]
        else:
            aggs.append(F.coalesce(F.max(F.when(first_row <= pl, F.col(v))), F.min(v))
                        .alias(_pname(p)))
    aggs += [F.max("total").alias("_total"), F.max(v).alias("_vmax")]
    out = rt.groupBy(*groups).agg(*aggs)
    if interpolate:
        for p in ps:
            n = _pname(p)
            tv, mw, pv, b = (F.col(f"_t{n}"), F.col(f"_m{n}"), F.col(f"_v{n}"), F.col(f"_b{n}"))
            T, pl = F.col("_total"), F.lit(float(p))
            x0, x1 = b / T, (b + mw) / T
            val = (F.when(tv.isNull(), F.col("_vmax"))
                   .when(pv.isNull(), tv)
                   .when(pl > x1, tv)
                   .otherwise(pv + (tv - pv) * (pl - x0) / (x1 - x0)))
            out = out.withColumn(n, val).drop(f"_t{n}", f"_m{n}", f"_v{n}", f"_b{n}")
    return out.drop("_total", "_vmax")


def exact_percentiles(df: DataFrame, groups: list[str], v: str, ps: list[float],
                      count_col: str | None = None) -> DataFrame:
    """Exact unweighted percentiles with linear interpolation (numpy 'linear' /
    SQL percentile_cont), computed from running counts of distinct values — no
    per-group value buffer, so a huge group never sits in one task's memory.
    With `count_col`, `df` is already one row per (groups, v) with its count."""
    if count_col is None:
        vt = (df.filter(F.col(v).isNotNull()).groupBy(*groups, v)
                .agg(F.count(F.lit(1)).cast("double").alias("sw")))
    else:
        vt = (df.filter(F.col(v).isNotNull()).groupBy(*groups, v)
                .agg(F.sum(count_col).cast("double").alias("sw")))
    return exact_percentiles_targeted(vt, groups, v, ps)


def _exact_percentiles_full(vt: DataFrame, groups: list[str], v: str, ps: list[float]) -> DataFrame:
    rt = running_weights(vt, groups, v)
    n = F.max("total")
    aggs = [n.alias("_n")]
    for p in ps:
        h = (F.col("total") - 1) * F.lit(float(p))
        lo = F.floor(h)
        aggs += [F.min(F.when(F.col("cum") > lo, F.col(v))).alias(f"_lo{_pname(p)}"),
                 F.min(F.when(F.col("cum") > lo + 1, F.col(v))).alias(f"_hi{_pname(p)}"),
                 F.max(h - lo).alias(f"_fr{_pname(p)}")]
    out = rt.groupBy(*groups).agg(*aggs)
    for p in ps:
        nm = _pname(p)
        lo_v, hi_v, fr = F.col(f"_lo{nm}"), F.col(f"_hi{nm}"), F.col(f"_fr{nm}")
        out = out.withColumn(nm, F.when(hi_v.isNull(), lo_v).otherwise(lo_v + fr * (hi_v - lo_v)))
        out = out.drop(f"_lo{nm}", f"_hi{nm}", f"_fr{nm}")
    return out.drop("_n")


def first_k_per_group(df: DataFrame, groups: list[str], order_col: str, k_col: str,
                      ties: tuple = ()) -> DataFrame:
    """Rows whose rank by `order_col` (then `ties`) within a group is <= the group's
    `k_col`.  Exact and distributed: running counts over bucketed order values,
    so a group holding a third of the rows is still spread over many tasks."""
    t = df.withColumn("_one", F.lit(1).cast("long"))
    rt = running_sums(t, groups, order_col, ["_one"], ties=ties)
    return rt.filter(F.col("cum__one") <= F.col(k_col)).drop("_one", "cum__one", "total__one")


# ---------------------------------------------------------------------------
# targeted selection: order only the buckets that hold the requested ranks
# ---------------------------------------------------------------------------

def _near(flag: str, order_part) -> Column:
    return (F.col(flag) | F.coalesce(F.lag(flag).over(order_part), F.lit(False))
            | F.coalesce(F.lead(flag).over(order_part), F.lit(False)))


def _crossing(off: str, size: str, targets: list) -> Column:
    hit = F.lit(False)
    for t in targets:
        tc = F.least(F.greatest(t, F.lit(0.0)), F.col("total"))
        hit = hit | ((F.col(off) < tc) & (tc <= F.col(off) + F.col(size))) | ((tc <= 0) & (F.col(off) == 0))
    return hit


def _targeted_rows(vt: DataFrame, groups: list[str], v: str, targets_of) -> DataFrame:
    """Rows of the fine buckets crossing any target running weight (plus their
    nonempty neighbours), with exact `cum` / `before`.  `targets_of(total)`
    returns the target Columns.  Only the coarse table is scanned whole; fine
    buckets are aggregated only inside the selected coarse buckets, and rows
    are ordered only inside the selected fine buckets."""
    vt = vt.withColumn("_cb", coarse_bucket(v)).withColumn("_fb", value_bucket(v))
    part = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    ct = vt.groupBy(*groups, "_cb").agg(F.sum("sw").alias("_cs"))
    zero = F.lit(0).cast(ct.schema["_cs"].dataType)
    ct = (ct.withColumn("_co", F.coalesce(F.sum("_cs").over(part.orderBy("_cb").rowsBetween(_UNB, -1)), zero))
            .withColumn("total", F.sum("_cs").over(part)))
    ct = ct.withColumn("_hit", _crossing("_co", "_cs", targets_of(F.col("total"))))
    ct = ct.withColumn("_keep", _near("_hit", part.orderBy("_cb")))
    sel_c = ct.filter(F.col("_keep")).select(*groups, "_cb", "_co", "total")
    inside = join_null_safe(vt, sel_c, list(groups) + ["_cb"])          # small right side
    ft = inside.groupBy(*groups, "_cb", "_fb").agg(F.sum("sw").alias("_fs"), F.max("_co").alias("_co"),
                                                   F.max("total").alias("total"))
    ft = ft.withColumn("_fo", F.col("_co") + F.coalesce(
        F.sum("_fs").over(Window.partitionBy(*groups, "_cb").orderBy("_fb").rowsBetween(_UNB, -1)),
        F.lit(0).cast(ft.schema["_fs"].dataType)))
    ft = ft.withColumn("_hit", _crossing("_fo", "_fs", targets_of(F.col("total"))))
    ft = ft.withColumn("_keep", _near("_hit", part.orderBy("_fb")))     # few coarse buckets' fines
    sel_f = ft.filter(F.col("_keep")).select(*groups, "_fb", "_fo", "total")
    rows = join_null_safe(inside.drop("_cb", "_co", "total"), sel_f, list(groups) + ["_fb"])
    wv = Window.partitionBy(*groups, "_fb").orderBy(v).rowsBetween(_UNB, 0)
    rows = rows.withColumn("cum", F.col("_fo") + F.sum("sw").over(wv))
    return rows.withColumn("before", F.col("cum") - F.col("sw")).drop("_fb", "_fo")


def value_at(vt: DataFrame, groups: list[str], v: str, target_of) -> DataFrame:
    """Per group, the value `_cut` at which the running sum of `sw` (ordered by `v`, which may repeat) reaches
    `_target` = target_of(total), with the sums before that value (`_before`) and of it (`_same`).  A target
    of 0 is reached by the first value."""
    rt = _targeted_rows(vt, groups, v, lambda T: [target_of(T)])
    per = rt.groupBy(*groups, v).agg(F.max("cum").alias("_cum"), F.sum("sw").alias("_same"),
                                     target_of(F.max("total")).alias("_target"))
    per = per.filter(F.col("_cum") >= F.col("_target"))
    by = F.struct("_cum", v)                              # the sums grow with the value
    out = per.groupBy(*groups).agg(F.min_by(v, by).alias("_cut"), F.min("_cum").alias("_cum"),
                                   F.min_by("_same", by).alias("_same"), F.max("_target").alias("_target"))
    return out.select(*groups, "_cut", (F.col("_cum") - F.col("_same")).alias("_before"), "_same", "_target")


def percentiles_targeted(vt: DataFrame, groups: list[str], v: str, ps: list[float],
                         interpolate: bool = True) -> DataFrame:
    """A4 / A5 percentiles from a distinct-value table (groups, v, sw, mw),
    ordering only the rows of the buckets around each requested rank."""
    rt = _targeted_rows(vt, groups, v, lambda T: [T * F.lit(float(p)) for p in ps])
    return _percentile_aggregate(rt, groups, v, ps, interpolate)


def _percentile_aggregate(rt: DataFrame, groups: list[str], v: str, ps: list[float],
                          interpolate: bool) -> DataFrame:
    c = F.col("cum") / F.col("total")
    first_row = (F.col("before") + F.col("mw")) / F.col("total")
    aggs = []
    for p in ps:
        pl = F.lit(float(p))
        if interpolate:
            aggs += [F.min(F.when(c >= pl, F.col(v))).alias(f"_t{_pname(p)}"),
                     F.min_by(F.col("mw"), F.when(c >= pl, F.col(v))).alias(f"_m{_pname(p)}"),
                     F.max(F.when(c < pl, F.col(v))).alias(f"_v{_pname(p)}"),
                     F.max(F.when(c < pl, F.col("cum"))).alias(f"_b{_pname(p)}")]
        else:
            aggs.append(F.coalesce(F.max(F.when(first_row <= pl, F.col(v))), F.min(v))
                        .alias(_pname(p)))
    aggs += [F.max("total").alias("_total"), F.max(v).alias("_vmax")]
    out = rt.groupBy(*groups).agg(*aggs)
    if interpolate:
        for p in ps:
            n = _pname(p)
            tv, mw, pv, b = (F.col(f"_t{n}"), F.col(f"_m{n}"), F.col(f"_v{n}"), F.col(f"_b{n}"))
            T, pl = F.col("_total"), F.lit(float(p))
            x0, x1 = b / T, (b + mw) / T
            val = (F.when(tv.isNull(), F.col("_vmax"))
                   .when(pv.isNull(), tv)
                   .when(pl > x1, tv)
                   .otherwise(pv + (tv - pv) * (pl - x0) / (x1 - x0)))
            out = out.withColumn(n, val).drop(f"_t{n}", f"_m{n}", f"_v{n}", f"_b{n}")
    return out.drop("_total", "_vmax")


def exact_percentiles_targeted(vt: DataFrame, groups: list[str], v: str, ps: list[float]) -> DataFrame:
    """Linear-interpolation percentiles from (groups, v, sw=count): the values
    at positions floor(h) and floor(h)+1 are located through the bucket index."""
    def targets_of(T):
        hs = [(T - 1) * F.lit(float(p)) for p in ps]
        return [F.floor(h) + 1 for h in hs] + [F.floor(h) + 2 for h in hs]
    rt = _targeted_rows(vt, groups, v, targets_of)
    aggs = []
    for p in ps:
        h = (F.col("total") - 1) * F.lit(float(p))
        lo = F.floor(h)
        aggs += [F.min(F.when(F.col("cum") > lo, F.col(v))).alias(f"_lo{_pname(p)}"),
                 F.min(F.when(F.col("cum") > lo + 1, F.col(v))).alias(f"_hi{_pname(p)}"),
                 F.max(h - lo).alias(f"_fr{_pname(p)}")]
    out = rt.groupBy(*groups).agg(*aggs)
    for p in ps:
        nm = _pname(p)
        lo_v, hi_v, fr = F.col(f"_lo{nm}"), F.col(f"_hi{nm}"), F.col(f"_fr{nm}")
        out = out.withColumn(nm, F.when(hi_v.isNull(), lo_v).otherwise(lo_v + fr * (hi_v - lo_v)))
        out = out.drop(f"_lo{nm}", f"_hi{nm}", f"_fr{nm}")
    return out


def percentiles_reference(vt: DataFrame, groups: list[str], v: str, ps: list[float],
                          interpolate: bool = True) -> DataFrame:
    """Test-only reference: one plain ordered window per group (small data)."""
    part = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    rt = vt.withColumn("cum", F.sum("sw").over(part.orderBy(v).rowsBetween(_UNB, 0))) \
           .withColumn("total", F.sum("sw").over(part))
    rt = rt.withColumn("before", F.col("cum") - F.col("sw"))
    return _percentile_aggregate(rt, groups, v, ps, interpolate)
