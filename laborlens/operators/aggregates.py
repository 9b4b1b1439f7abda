"""Survey-weighted aggregate expressions and grouped operators.

Null rule (stated once, used everywhere): a row counts towards a weighted
measure only when its weight is non-null and > 0 and, for means, its value is
non-null ("strict" rule).  Weighted totals (population sums) add non-null
weights as pandas ``sum`` does, empty -> 0.

Every operator here is a plain ``groupBy().agg()`` (partial aggregation on the
map side, one shuffle on the group keys) or a conditional aggregate in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def w_ok(w) -> Column:
    w = _c(w)
    return w.isNotNull() & (w > 0)


def wsum(w, cond: Column | None = None) -> Column:
    """Weighted total (pandas sum: nulls skipped, empty -> 0)."""
    x = _c(w) if cond is None else F.when(cond, _c(w))
    return F.coalesce(F.sum(x), F.lit(0.0))


def wmean(v, w, cond: Column | None = None) -> Column:
    """A1/A3 strict weighted mean."""
    ok = _c(v).isNotNull() & w_ok(w)
    if cond is not None:
        ok = ok & cond
    return F.try_divide(F.sum(F.when(ok, _c(v) * _c(w))), F.sum(F.when(ok, _c(w))))


def wshare(flag, w, cond: Column | None = None) -> Column:
    """A2 weighted proportion of a flag (null flag counts as 0), weight > 0 mask."""
    ok = w_ok(w)
    if cond is not None:
        ok = ok & cond
    f = F.coalesce(_c(flag).cast("int"), F.lit(0))
    return F.try_divide(F.sum(F.when(ok, f * _c(w))), F.sum(F.when(ok, _c(w))))


def share(flag, cond: Column | None = None) -> Column:
    """Unweighted mean of a 0/1 flag."""
    f = _c(flag).cast("int")
    return F.avg(f if cond is None else F.when(cond, f))


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def ratio(a, b) -> Column:
    """a / b when b > 0, else null."""
    return F.when(_c(b) > 0, F.try_divide(_c(a), _c(b)))


def pct(a, b) -> Column:
    """100 * a / b when b > 0, else 0 (the reference's percentage convention)."""
    return F.when(_c(b) > 0, F.lit(100.0) * _c(a) / _c(b)).otherwise(F.lit(0.0))


def share_of_total(col: str, *partition: str) -> Column:
    """X / sum(x) over the partition (row percent when * 100)."""
    w = Window.partitionBy(*partition) if partition else Window.partitionBy(F.lit(1))
    return F.try_divide(_c(col), F.sum(col).over(w))


def weighted_summary(df: DataFrame, w: str = "peso_populacional", flag: str = "eh_ti",
                     age: str = "idade") -> DataFrame:
    """Weighted IT share and weighted mean age of IT / others, one row."""
    f = F.col(flag)
    return df.agg(
        wshare(flag, w).alias("proporcao_ti_ponderada"),
        wmean(age, w, f).alias("idade_media_ti_ponderada"),
        wmean(age, w, ~f).alias("idade_media_outros_ponderada"),
    )


def employed_summary(df: DataFrame, w: str = "peso_populacional", flag: str = "eh_ti",
                     ocupado: str = "ocupado", by: tuple = ()) -> DataFrame:
    """Employed quick summary (n, IT n, simple and weighted share)."""
    occ = df.filter(F.col(ocupado) == 1)
    g = occ.groupBy(*by) if by else occ.groupBy()
    return g.agg(
        F.count(F.lit(1)).alias("ocupados_total"),
        count_if(F.col(flag)).alias("ocupados_ti"),
        share(flag).alias("prop_ti_ocup_simples"),
        wshare(flag, w).alias("prop_ti_ocup_ponderada"),
    )


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str],
                   how: str = "inner") -> DataFrame:
    """Equi-join on `keys` where null matches null (pandas merge semantics).
    Still a hash/sort-merge equi-join in the physical plan.  Without keys the right
    side must be one row (a scalar)."""
    if not keys:
        if right.limit(2).count() > 1:
            raise ValueError("a join without keys needs a right side of one row")
        return left.crossJoin(right) if how == "inner" else left.join(right, how=how)
    rn = {k: f"_r_{k}" for k in keys}
    r = right.withColumnsRenamed(rn)
    cond = None
    for k in keys:
        e = left[k].eqNullSafe(r[rn[k]])
        cond = e if cond is None else cond & e
    return left.join(r, cond, how).drop(*rn.values())
