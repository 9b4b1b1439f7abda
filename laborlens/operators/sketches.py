"""A mergeable sketch for weighted quantiles of many groups in one pass (A4, A5).

A task holds up to ``BUFFER`` rows; then it sorts them by group and value and keeps, for each
group, at most ``m`` values and the last: those at which the running weight passes a multiple of (group's weight
in the buffer) / m, each with the weight since the value before.  Summaries merge by union: a group's
running weight over all kept values, in order, differs from the exact one by at most a buffer's step in
each buffer, so at most W / m over all, W being the group's weight.  A quantile read from them has a rank
error of at most 1 / m.  A row is summarised once, so the bound holds for any number of
partitions and merges; only summaries are shuffled.

Rows without value, or whose weight is null or not positive, count for nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

POINTS = 1000
BUFFER = 1 << 20


def summarise(v: np.ndarray, w: np.ndarray, m: int) -> tuple:
    """At most ``m`` values, and the last, with weights whose running weight errs by at most total / m."""
    order = np.argsort(v, kind="stable")
    v, cum = v[order], np.cumsum(w[order])
    last = np.append(v[1:] != v[:-1], True)                    # equal values are one
    v, cum = v[last], cum[last]
    if len(v) > m:
        step = np.floor(cum / cum[-1] * m)
        keep = np.diff(step, prepend=0.0) > 0                  # the first value of each step
        keep[-1] = True
        v, cum = v[keep], cum[keep]
    return v, np.diff(cum, prepend=0.0)


def sketch(df: DataFrame, groups: list[str], v: str, w: str, m: int = POINTS) -> DataFrame:
    """(groups, v, w): the summaries of all parts of ``df``; unions of them are sketches too."""
    src = df.where((F.col(w) > 0) & F.col(v).isNotNull()).select(
        *groups, F.col(v).cast("double").alias("v"), F.col(w).cast("double").alias("w"))
    names = list(groups)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def close() -> Iterator[pd.DataFrame]:
            whole = pd.concat(held, ignore_index=True)
            parts = whole.groupby(names, dropna=False, sort=False) if names else [((), whole)]
            for key, part in parts:
                values, weights = summarise(part["v"].to_numpy(), part["w"].to_numpy(), m)
                out = pd.DataFrame({"v": values, "w": weights})
                for name in reversed(names):
                    out.insert(0, name, pd.Series([part[name].iloc[0]] * len(out), dtype=part[name].dtype))
                yield out

        for frame in frames:
            held.append(frame)
            size += len(frame)
            if size >= BUFFER:
                yield from close()
                held, size = [], 0
        if held and size:
            yield from close()

    return src.mapInPandas(work, src.schema)


def quantiles(sketched: DataFrame, groups: list[str], ps: list[float]) -> DataFrame:
    """(groups, total, q_0 ...): the first value whose running weight reaches p of the group's.

    The kept values of a group are ordered after summing equal ones; their number is bounded by ``m`` a buffer.
    """
    part = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    each = sketched.groupBy(*groups, "v").agg(F.sum("w").alias("w"))
    run = each.withColumn("cum", F.sum("w").over(part.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))) \
              .withColumn("total", F.sum("w").over(part))
    picks = [F.min(F.when(F.col("cum") >= F.lit(p) * F.col("total") - F.lit(1e-9) * F.col("total"), F.col("v")))
             .alias(f"q_{i}") for i, p in enumerate(ps)]
    return run.groupBy(*groups).agg(F.max("total").alias("total"), *picks)
