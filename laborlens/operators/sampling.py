"""Sampling and splitting operators (M1-M9).

Selections rank rows by a uniform key (MD5 of the primary key) and take the first k
per group with `first_k_per_group` (distributed running counts), so no stratum
is ever sorted inside one task.  Quota tables are per-stratum aggregates
(bounded by the number of strata).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laborlens.operators.aggregates import join_null_safe
from laborlens.operators.neighbours import nearest, neighbour_rows
from laborlens.operators.quantiles import first_k_per_group, running_sums, value_at
from laborlens.session import materialise

KEY_BITS = 60
KEY_RANGE = 1 << KEY_BITS


def pk_hash(*keys: str) -> Column:
    """A uniform key on [0, 2^60): the first 15 hex digits of the MD5 of the key
    columns, joined by '-'.  Equal digits are ordered by the key columns."""
    text = F.concat_ws("-", *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def uniform(*parts) -> Column:
    """A uniform number on [0, 1) from the MD5 of some columns joined by '-'."""
    text = F.concat_ws("-", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def below(order_key: str, fraction: float) -> Column:
    """Whether a row's uniform key lies in the first `fraction` of the range."""
    return F.col(order_key) < F.lit(int(fraction * KEY_RANGE))


def small_table(df: DataFrame, bound: int = 100_000) -> DataFrame:
    """Broadcast a table of classes, strata or quotas, whose size is checked first."""
    n = df.count()
    if n > bound:
        return df                      # too many strata: an ordinary join
    return F.broadcast(df)


def allocate_quotas(sizes: DataFrame, keys: list[str], cap, within: list[str] | None = None,
                    size_col: str = "n") -> DataFrame:
    """M2: largest-remainder allocation of `cap` (int, or a column of the sizes
    table) over the rows of a small sizes table, optionally within partitions."""
    within = within or []
    part = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    capc = F.lit(cap) if isinstance(cap, int) else F.col(cap)
    tot = F.sum(size_col).over(part)
    t = sizes.withColumn("_tot", tot).withColumn("_cap", capc)
    raw = F.col(size_col) * F.col("_cap") / F.col("_tot")
    small = F.col("_tot") <= F.col("_cap")
    t = (t.withColumn("_base", F.when(small, F.col(size_col)).otherwise(F.floor(raw).cast("long")))
          .withColumn("_rem", F.when(small, F.lit(0.0)).otherwise(raw - F.floor(raw))))
    order = [F.col("_rem").desc()] + [F.col(k).asc() for k in keys if k not in within]
    t = (t.withColumn("_rk", F.row_number().over(part.orderBy(*order)))
          .withColumn("_short", F.when(F.col("_tot") <= F.col("_cap"), F.lit(0))
                      .otherwise(F.col("_cap") - F.sum("_base").over(part))))
    q = F.col("_base") + F.when(F.col("_rk") <= F.col("_short"), 1).otherwise(0)
    return t.withColumn("quota", q.cast("long")).drop("_tot", "_cap", "_base", "_rem", "_rk", "_short")


def share_of(sizes: DataFrame, fraction: float, size_col: str = "n") -> DataFrame:
    """Adds `_alvo`: the number of rows that a sample of `fraction` of all rows has."""
    total = Window.partitionBy(F.lit(0))                 # a small sizes table
    return sizes.withColumn("_alvo", F.floor(F.sum(size_col).over(total) * F.lit(fraction)).cast("long"))


def stratified_downsample(df: DataFrame, strata: list[str], y: str, fraction: float,
                          order_key: str, ties: tuple = ()) -> DataFrame:
    """M3: a sample of `fraction` of the rows: quotas per stratum (M2), then per class
    within the stratum, then the first `quota` rows by hash order in every (stratum, class)."""
    cells = df.groupBy(*strata, y).agg(F.count(F.lit(1)).alias("n"))
    s1 = share_of(cells.groupBy(*strata).agg(F.sum("n").alias("n")), fraction)
    q1 = allocate_quotas(s1, strata, "_alvo").select(*strata, F.col("quota").alias("squota"))
    q2 = allocate_quotas(cells.join(q1, strata), strata + [y], "squota", within=strata).select(*strata, y, "quota")
    quotas = small_table(q2)
    return first_k_per_group(df.join(quotas, strata + [y]), strata + [y], order_key, "quota", ties).drop("quota")


def stratified_split(df: DataFrame, y: str, test_fraction: float, order_key: str) -> DataFrame:
    """M5: per class, the first round(n_class * f) rows in hash order are 'teste'.

    Only the key of each class's last test row is looked for (``value_at``); the rows stay where they are.
    ``df`` is read several times, so it should be a written table."""
    ones = df.select(y, order_key, F.lit(1).cast("long").alias("sw"))

    def last(total: Column) -> Column:
        return F.round(total * F.lit(test_fraction))

    cut = materialise(value_at(ones, [y], order_key, last), "cut").withColumn("_open", F.col("_target") - F.col("_before"))
    first, some = F.coalesce(F.col(order_key) < F.col("_cut"), F.col(order_key).isNull() & F.col("_cut").isNotNull()), \
        F.col(order_key).eqNullSafe(F.col("_cut")) & (F.col("_target") > 0)
    t = join_null_safe(df, small_table(cut.select(y, "_cut", "_target", "_open")), [y])
    if not cut.filter(F.col("_same") > F.col("_open")).head(1):
        test = first | some
    else:                                        # the last test key is that of other rows too
        row = F.row_number().over(Window.partitionBy(y, order_key).orderBy(order_key))
        ties = t.filter(some).withColumn("_row", row)
        t = t.filter(~some).withColumn("_row", F.lit(None).cast("int")).unionByName(ties)
        test = F.when(F.col("_row").isNull(), first).otherwise(F.col("_row") <= F.col("_open"))
    return t.withColumn("split", F.when(test, "teste").otherwise("treino")).select(*df.columns, "split")


def temporal_split(df: DataFrame, year: str = "ano", test_year: int | None = None) -> DataFrame:
    """M6: test = the given (or latest) year."""
    if test_year is None:
        mx = df.agg(F.max(year).alias("_ty"))
        j = df.join(F.broadcast(mx), how="inner")      # one-row scalar
        return j.withColumn("split", F.when(F.col(year) == F.col("_ty"), "teste")
                            .otherwise("treino")).drop("_ty")
    return df.withColumn("split", F.when(F.col(year) == test_year, "teste").otherwise("treino"))


def class_distribution(df: DataFrame, split: str, y: str) -> DataFrame:
    """Class counts and prevalence per split."""
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n"),
                                 F.count(F.when(F.col(y) == 1, 1)).alias("n_pos"),
                                 F.round(F.avg(F.col(y).cast("double")), 6).alias("prevalencia"))


def undersample_majority(df: DataFrame, y: str, ratio: float, order_key: str) -> DataFrame:
    """M7: keep min(n_maj, floor(n_min / ratio)) majority rows (hash order)."""
    c = df.groupBy(y).agg(F.count(F.lit(1)).alias("n"))
    allw = Window.partitionBy(F.lit(0))   # two rows (one per class)
    mx, mn = F.max("n").over(allw), F.min("n").over(allw)
    keep = F.when((F.col("n") == mx) & (F.col("n") != mn),
                  F.least(F.col("n"), F.floor(mn / F.lit(ratio)).cast("long"))).otherwise(F.col("n"))
    c = c.withColumn("keep", keep).select(y, "keep")
    return first_k_per_group(df.join(small_table(c), y), [y], order_key, "keep").drop("keep")


def first_n_by_hash(df: DataFrame, n: int, order_key: str, ties: tuple = ()) -> DataFrame:
    """M1: fixed-size sample = n smallest hash keys (TakeOrdered, distributed top-k)."""
    return df.orderBy(order_key, *ties).limit(n)


def fraction_by_hash(df: DataFrame, fraction: float, order_key: str) -> DataFrame:
    """M1/M4: the rows whose uniform key is below `fraction`; a class keeps its share."""
    return df.filter(below(order_key, fraction))


def smote(df: DataFrame, y: str, features: list[str], key: str, ratio: float = 0.3, seed: int = 42,
          k: int = 5) -> DataFrame:
    """M8: synthetic minority rows x + u (nb - x) until the minority has
    ceil(ratio * majority) rows; nb is one of the `k` nearest minority rows (``neighbours``).

    Every minority row gives the same number of copies, and the first rows by hash key one
    more, so which rows are used does not depend on the layout.  u and the choice of the
    neighbour follow from the key and the copy, so a repeated task makes the same rows.  A value
    that is missing in the neighbour stays the row's own.
    """
    base = df.withColumn("sintetico", F.lit(False))
    counts = {r[y]: r["n"] for r in df.groupBy(y).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return base
    minority = min(counts, key=lambda c: (counts[c], c))
    n_min, n_maj = counts[minority], max(counts.values())
    n_new = max(0, math.ceil(ratio * n_maj) - n_min)
    if n_new == 0:
        return base
    mino = df.filter(F.col(y) == minority)
    each, more = divmod(n_new, n_min)
    if more:
        extra = first_k_per_group(mino.select(y, key).withColumn("_k", F.lit(more).cast("long")), [y], key, "_k")
        mino = mino.join(extra.select(key, F.lit(1).alias("_more")), key, "left") \
                   .withColumn("_copies", F.lit(each) + F.coalesce("_more", F.lit(0)))
    else:
        mino = mino.withColumn("_copies", F.lit(each))
    near = neighbour_rows(nearest(df.filter(F.col(y) == minority), features, k, seed=seed), k) \
        .withColumnsRenamed({"x": "_x", "nbs": "_nbs"})
    clean = F.array(*[F.when(~F.isnan(F.col(c)), F.col(c) + F.lit(0.0)) for c in features])
    mino = mino.filter(F.col("_copies") > 0).withColumn("_x", clean).join(near, "_x", "left") \
               .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    u = uniform(F.lit(seed), F.col(key), F.col("_copy"))
    pick = F.floor(uniform(F.lit(seed), F.col(key), F.col("_copy"), F.lit("nb")) * F.size("_nbs")).cast("int") + 1
    mino = mino.withColumn("_u", u).withColumn("_nb", F.when(F.size("_nbs") > 0, F.element_at("_nbs", pick)))
    synth = mino.select(
        *[c for c in df.columns if c not in features],
        *[(F.col(c) + F.col("_u") * (F.coalesce(F.col("_nb")[i], F.col(c)) - F.col(c))).alias(c)
          for i, c in enumerate(features)])
    return base.unionByName(synth.withColumn("sintetico", F.lit(True)).select(*base.columns))


def poisson1(u: Column) -> Column:
    """Inverse-CDF draw of Poisson(1) from a uniform u in [0, 1)."""
    cdf, expr, acc, k = [], None, 0.0, 0
    p = math.exp(-1.0)
    while k < 12:
        acc += p
        cdf.append((k, acc))
        k += 1
        p = p / k
    for k, c in cdf:
        expr = F.when(u < c, k) if expr is None else expr.when(u < c, k)
    return expr.otherwise(12)


def bootstrap_auc(df: DataFrame, y: str, score: str, key: str, replicates: int = 20) -> DataFrame:
    """M9: AUC per bootstrap replicate with Poisson(1) row weights from the MD5 of
    (key, replicate).  The weights of all replicates are summed per distinct score
    side by side, and one ordering of the scores serves them all."""
    names = [(f"p{r}", f"n{r}") for r in range(replicates)]
    pos = F.col(y) == 1
    weights = df.filter(F.col(score).isNotNull()).select(
        score, pos.alias("_pos"), *[poisson1(uniform(F.col(key), F.lit(r))).cast("double").alias(f"w{r}")
                                    for r in range(replicates)])
    per = weights.groupBy(score).agg(*[a for r, (p, n) in enumerate(names) for a in (
        F.sum(F.when(F.col("_pos"), F.col(f"w{r}")).otherwise(0.0)).alias(p),
        F.sum(F.when(F.col("_pos"), 0.0).otherwise(F.col(f"w{r}"))).alias(n))])
    rt = running_sums(per, [], score, [n for _, n in names])
    sums = rt.agg(*[a for p, n in names for a in (
        F.sum(F.col(p) * (F.col(f"cum_{n}") - F.col(n) / 2)).alias(f"s_{p}"),
        (F.sum(p) * F.max(f"total_{n}")).alias(f"d_{p}"))])                       # one row
    return sums.select(F.inline(F.array(*[F.struct(
        F.lit(r).alias("replica"),
        F.when(F.col(f"d_{p}") > 0, F.col(f"s_{p}") / F.col(f"d_{p}")).alias("auc")) for r, (p, _) in enumerate(names)])))
