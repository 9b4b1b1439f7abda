"""Window operators (W2-W5) for small ordered series (per-year / per-segment
tables after aggregation).  Every window here is partitioned by the series
keys, so a partition holds one short series (e.g. 18 schooling years), never a
whole table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_UNB = Window.unboundedPreceding
_UNF = Window.unboundedFollowing


def _w(partition, order):
    w = Window.partitionBy(*partition) if partition else Window.partitionBy(F.lit(0))
    return w.orderBy(*order)


def interpolate_linear(df: DataFrame, partition: list[str], order: str, value: str,
                       out: str | None = None) -> DataFrame:
    """Fill nulls by linear interpolation on *position* within the ordered
    partition; leading/trailing gaps take the nearest known value."""
    out = out or value
    w = _w(partition, [order])
    pos = "_pos"
    df = df.withColumn(pos, F.row_number().over(w))
    known_pos = F.when(F.col(value).isNotNull(), F.col(pos))
    back = w.rowsBetween(_UNB, 0)
    fwd = w.rowsBetween(0, _UNF)
    df = (df.withColumn("_pv", F.last(F.col(value), ignorenulls=True).over(back))
            .withColumn("_pp", F.last(known_pos, ignorenulls=True).over(back))
            .withColumn("_nv", F.first(F.col(value), ignorenulls=True).over(fwd))
            .withColumn("_np", F.first(known_pos, ignorenulls=True).over(fwd)))
    interp = (F.col("_pv") + (F.col("_nv") - F.col("_pv"))
              * (F.col(pos) - F.col("_pp")) / (F.col("_np") - F.col("_pp")))
    filled = (F.when(F.col(value).isNotNull(), F.col(value))
              .when(F.col("_pv").isNull(), F.col("_nv"))
              .when(F.col("_nv").isNull(), F.col("_pv"))
              .otherwise(interp))
    return df.withColumn(out, filled).drop(pos, "_pv", "_pp", "_nv", "_np")


def centred_mean(value: str, partition: list[str], order: str, half: int = 1) -> Column:
    """Centred moving average of width 2*half+1, min_periods 1 (nulls skipped)."""
    return F.avg(value).over(_w(partition, [order]).rowsBetween(-half, half))


def scale_by_max(values: list[str], partition: list[str]) -> list[Column]:
    """Each x / the largest of all the values over the partition, so that series stay
    comparable; a largest value <= 0 (or null) divides by 1."""
    w = Window.partitionBy(*partition) if partition else Window.partitionBy(F.lit(0))
    top = reduce(F.greatest, [F.max(v).over(w) for v in values])
    scale = F.when(top > 0, top).otherwise(F.lit(1.0))
    return [F.col(v) / scale for v in values]
