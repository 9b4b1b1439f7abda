"""k nearest neighbours among the rows of a table (for M8), by a forest of projection trees.

Each of several tables cuts the points by quantiles along random (2-stable) projections, level by
level, until no cell holds more than about ``cell`` points: near points fall into one cell of most
tables.  Within a cell the exact distances of its points are compared and each keeps its ``k``
nearest; over the tables the best ``k`` remain.  Equal points are one point with a count, so a hot
value fills no cell, and cells are cut where the points lie, so a dense region has small ones.

Only the cuts of cells above ``whole`` points are computed by aggregation; a point's place among them follows from
these small tables, so its row is shuffled once a table, and the smaller cells are cut on by the task that gets them.

Recall (share of the true neighbours found) is measured in ``tests/test_neighbours.py``.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laborlens.session import materialise

TABLES = 6
CELL = 256
FAN = 8                       # cells that a cell is cut into at each level
WHOLE = 1 << 16               # points of a cell that one task cuts on
MAX_LEVELS = 24
MAX_CUTS = 20                 # levels cut by aggregation; a path is a long


def _scales(df: DataFrame, features: list[str]) -> list[tuple]:
    """(mean, deviation) of each feature."""
    facts = df.agg(*[a for c in features for a in (F.avg(c).alias(f"m_{c}"), F.stddev(c).alias(f"s_{c}"))]).first()
    return [(float(facts[f"m_{c}"] or 0.0), float(facts[f"s_{c}"] or 1.0)) for c in features]


def _clean(df: DataFrame, features: list[str]) -> DataFrame:
    """The features alone; -0.0 and 0.0 are one value, NaN is missing."""
    return df.select(*[F.when(~F.isnan(F.col(c)), F.col(c) + F.lit(0.0)).alias(c) for c in features])


def _directions(dim: int, tables: int, seed: int) -> list:
    """A random direction for each level and table."""
    rnd = random.Random(seed)
    return [[[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(tables)] for _ in range(MAX_LEVELS)]


def _in_tables(pts: DataFrame, scales: list[tuple], directions: list, cuts: list[DataFrame], levels: int) -> DataFrame:
    """(x, n, t, path, p0, p1 ..): the points in every table, the path of their cell under the ``cuts`` so far, and
    their place along the first ``levels`` directions.  A feature that is missing lies at the mean."""
    z = [F.coalesce((F.col("x")[i] - F.lit(m)) / F.lit(s), F.lit(0.0)) for i, (m, s) in enumerate(scales)]

    def along(direction: list) -> Column:
        out = F.lit(0.0)
        for v, d in zip(z, direction):
            out = out + v * F.lit(d)
        return out

    rows = pts.select("x", "n", F.inline(F.array(*[
        F.struct(F.lit(t).alias("t"), *[along(directions[k][t]).alias(f"p{k}") for k in range(levels)])
        for t in range(len(directions[0]))]))).withColumn("path", F.lit(0).cast("long"))
    for k, cut in enumerate(cuts):                         # a row for each WHOLE points of a table
        child = F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col(f"p{k}"))), F.lit(0))
        rows = (rows.join(F.broadcast(cut), ["t", "path"], "left")
                .withColumn("path", F.col("path") * FAN + F.when(F.col("cuts").isNull(), 0).otherwise(child)).drop("cuts"))
    return rows


def _cells(pts: DataFrame, scales: list[tuple], directions: list, whole: int) -> tuple[DataFrame, int]:
    """Points in every table with the path of a cell of at most about ``whole`` points, and the levels cut."""
    cuts: list = []
    size = pts.count()
    while size > whole and len(cuts) < MAX_CUTS:
        fan = min(FAN, max(2, math.ceil(size / whole)))
        k = len(cuts)
        own = _in_tables(pts, scales, directions, cuts, k + 1).groupBy("t", "path").agg(
            F.count(F.lit(1)).alias("size"), F.percentile_approx(f"p{k}", [i / fan for i in range(1, fan)], 2000).alias("cuts"))
        cut = materialise(own.filter(F.col("size") > whole), "cuts")
        size = cut.agg(F.max("size")).first()[0] or 0
        if size:
            cuts.append(cut.select("t", "path", "cuts"))
            size = math.ceil(size / fan * 1.05)            # the cuts are quantiles up to a 2000th
    return _in_tables(pts, scales, directions, cuts, len(cuts)).select("x", "n", "t", "path"), len(cuts)


def _leaves(z: np.ndarray, directions: list, t: int, level: int, cell: int) -> Iterator[np.ndarray]:
    """Rows of the cells of at most ``cell`` points that the points of one cell are cut into."""
    todo = [(np.arange(len(z)), level)]
    while todo:
        rows, k = todo.pop()
        if len(rows) <= cell or k >= MAX_LEVELS:
            if len(rows) > 4 * cell:
                raise ValueError(f"{len(rows)} points could not be told apart by projections")
            yield rows
            continue
        fan = min(FAN, max(2, math.ceil(len(rows) / cell)))
        p = z[rows] @ np.asarray(directions[k][t])
        cuts = np.sort(p)[[math.ceil(i * len(p) / fan) - 1 for i in range(1, fan)]]
        child = np.searchsorted(cuts, p, side="left")
        todo += [(rows[child == c], k + 1) for c in np.unique(child)]


def nearest(df: DataFrame, features: list[str], k: int = 5, tables: int = TABLES, cell: int = CELL,
            seed: int = 42, whole: int = WHOLE) -> DataFrame:
    """(x, n, near): each different feature vector and up to ``k`` others that are nearest by
    scaled Euclidean distance, ordered by distance and value, with their numbers of rows."""
    own = _clean(df, features)
    scales = _scales(own, features)
    pts = materialise(own.groupBy(F.array(*features).alias("x")).agg(F.count(F.lit(1)).alias("n")), "points")
    directions = _directions(len(features), tables, seed)
    cells, levels = _cells(pts, scales, directions, whole)
    dim = len(features)
    mean, deviation = np.asarray(scales).T

    def search(group: pa.Table) -> pa.Table:
        flat = group.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        order = np.lexsort(np.where(np.isnan(flat), -np.inf, flat).T[::-1])
        x, n = flat[order], group.column("n").to_numpy()[order]
        z = np.where(np.isnan(x), 0.0, (x - mean) / deviation)
        at, sizes, near = [], [], []
        for rows in _leaves(z, directions, group.column("t")[0].as_py(), levels, cell):
            rows = np.sort(rows)
            far = np.zeros((len(rows), len(rows)))
            for d in range(dim):
                far += (z[rows, None, d] - z[None, rows, d]) ** 2
            np.fill_diagonal(far, np.inf)
            best = np.argsort(far, axis=1, kind="stable")[:, :min(k, len(rows) - 1)]
            to = rows[best]
            at.append(rows)
            sizes.append(np.full(len(rows), best.shape[1] * (dim + 2)))
            near.append(np.concatenate([np.take_along_axis(far, best, 1)[..., None], n[to][..., None], x[to]], axis=2).ravel())
        at, ends = np.concatenate(at), np.cumsum(np.concatenate([[0], *sizes])).astype(np.int32)

        def lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.float64(), from_pandas=True))
        return pa.table({"x": lists(x[at].ravel(), np.arange(len(at) + 1) * dim), "n": pa.array(n[at]),
                         "near": lists(np.concatenate(near), ends)})

    found = cells.groupBy("t", "path").applyInArrow(search, "x array<double>, n long, near array<double>")
    merged = found.groupBy("x").agg(F.max("n").alias("n"), F.flatten(F.collect_list("near")).alias("flat"))   # tables * k at most
    width = dim + 2                                          # a neighbour's distance, rows and values
    one = F.transform(F.sequence(F.lit(0), F.size("flat") - width, F.lit(width)), lambda i: F.struct(
        F.get("flat", i).alias("far"), F.slice("flat", i + 3, dim).alias("x"), F.get("flat", i + 1).cast("long").alias("n")))
    near = F.when(F.size("flat") > 0, one).otherwise(F.expr("array()").cast("array<struct<far: double, x: array<double>, n: bigint>>"))
    return merged.select("x", "n", F.slice(F.array_sort(F.array_distinct(near)), 1, k).alias("near"))


def neighbour_rows(near: DataFrame, k: int = 5) -> DataFrame:
    """(x, nbs): the values of the ``k`` nearest other rows: copies of a row come first."""
    own = F.array_repeat(F.col("x"), F.least(F.col("n") - 1, F.lit(k)).cast("int"))
    rest = F.flatten(F.transform("near", lambda s: F.array_repeat(s["x"], F.least(s["n"], F.lit(k)).cast("int"))))
    return near.select("x", F.slice(F.concat(own, rest), 1, k).alias("nbs"))
