"""Approximate nearest neighbours: stable projections, kd-tree, chi-square stopping.

Nearness is the inner product.  Vectors are lifted to a common length M (the largest
norm) by one more component, sqrt(M^2 - |x|^2), and a query is scaled to length M, so
that the largest inner product is the smallest Euclidean distance.  ``PROJECTED``
Gaussian (2-stable) directions map a vector to a point p(x); for two vectors at
distance d the squared projected distance over d^2 is chi-square with ``PROJECTED``
degrees of freedom.

*Index.*  A kd-tree over the projected points.  Its top levels come from a sample of
at most ``TREE_SAMPLE`` points and deal all rows into blocks of about ``BLOCK_ROWS``;
within a block the tree goes on down to leaves of ``LEAF_ROWS`` points.  Every row is
indexed.

*Search.*  Leaves are opened in order of their projected distance; the points of an
opened leaf are verified with their exact inner product.  With d the distance of the
k-th best so far and D the next leaf's projected distance, the search ends when
chi2(D^2 / d^2) >= ``CONFIDENCE``: a point as near as d would, with that probability,
have been met.  A first round searches a query's own block; its k-th distance then
tells which other blocks can still hold something by the same test, and a second
round searches those.

Equal vectors are collapsed first to the k + 1 smallest ids, which is all that any
answer can use (ties go to smaller ids, and a query leaves out its own id), so copies
cost one point.

Defined cases: vectors that are null, empty, zero, or hold a null, NaN or infinite
component, take no part, as query or as candidate, nor do null ids; of several lengths
only the most frequent one (the longer of equals) takes part; a repeated (id, vector)
row counts once, and an id with several vectors counts by whichever is nearest, as query
and as candidate; a query returns all candidates if there are fewer than k; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from laborlens.llm.common import materialise

K = 20
PROJECTED = 8
CONFIDENCE = 0.98
TREE_SAMPLE = 20_000
BLOCK_ROWS = 16_384
MAX_BLOCKS = 1 << 16
LEAF_ROWS = 32
PARTS = 4                    # tasks that share a block's queries
HITS = "query_id long, vec_id long, score double"


def chi2_quantile(p: float, dof: int = PROJECTED) -> float:
    """Quantile of the chi-square distribution with an even number of degrees of freedom."""
    def cdf(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(dof // 2))
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return high


def directions(dim: int) -> np.ndarray:
    return np.random.default_rng(9).normal(size=(dim + 1, PROJECTED))


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """Vectors with the component that gives them all length ``top``."""
    norm2 = np.einsum("ij,ij->i", x, x)
    return np.hstack([x, np.sqrt(np.maximum(top * top - norm2, 0))[:, None]])


def scaled(q: np.ndarray, top: float) -> np.ndarray:
    """Queries scaled to length ``top``, without the added component."""
    return np.hstack([q * (top / np.linalg.norm(q, axis=1, keepdims=True)), np.zeros((len(q), 1))])


def matrix(column: pd.Series) -> np.ndarray:
    return np.asarray(column.to_list(), np.float64)


class Splits:
    """Top levels of the kd-tree: the widest dimension is cut at its median."""

    @staticmethod
    def of(points: np.ndarray, leaves: int) -> list:
        """Nested [dimension, cut, left, right]; a leaf is its block number."""
        count = iter(range(leaves))

        def cut(p: np.ndarray, n: int):
            if n == 1:
                return next(count)
            d = int(np.argmax(np.ptp(p, axis=0))) if len(p) else 0
            at = float(np.quantile(p[:, d], (n // 2) / n)) if len(p) else 0.0
            low = p[:, d] <= at
            return [d, at, cut(p[low], n // 2), cut(p[~low], n - n // 2)]

        return cut(points, leaves)

    @staticmethod
    def blocks(tree, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)

        def go(node, rows):
            if not isinstance(node, list):
                out[rows] = node
                return
            low = points[rows, node[0]] <= node[1]
            go(node[2], rows[low])
            go(node[3], rows[~low])

        go(tree, np.arange(len(points)))
        return out


def leaf_order(points: np.ndarray) -> np.ndarray:
    """Rows in kd-tree order, so that runs of ``LEAF_ROWS`` are leaves."""
    order = np.arange(len(points))
    work = [(0, len(points))]
    while work:
        a, b = work.pop()
        if b - a <= LEAF_ROWS:
            continue
        rows = order[a:b]
        p = points[rows]
        d = int(np.argmax(np.ptp(p, axis=0)))
        half = -(-((b - a) // 2) // LEAF_ROWS) * LEAF_ROWS
        order[a:b] = rows[np.argpartition(p[:, d], half - 1)]
        work += [(a, a + half), (a + half, b)]
    return order


class Block:
    """The part of the index that one task holds."""

    def __init__(self, x: np.ndarray, ids: list, top: float):
        a = directions(x.shape[1])
        points = lifted(x, top) @ a
        order = leaf_order(points)
        self.x, self.ids, points = x[order], [ids[i] for i in order], points[order]
        cuts = np.arange(0, len(x), LEAF_ROWS)
        self.low = np.minimum.reduceat(points, cuts)
        self.high = np.maximum.reduceat(points, cuts)
        self.many = np.asarray([len(i) for i in self.ids])
        self.top, self.a = top, a

    def search(self, query_id: int, q: np.ndarray, k: int, limit: float, bound: float) -> list:
        """The k best (id, score) found; ``bound``: a score that k candidates elsewhere reach."""
        wide = scaled(q[None, :], self.top)
        p = (wide @ self.a)[0]
        gap = np.maximum(np.maximum(self.low - p, p - self.high), 0)
        far = np.einsum("ij,ij->i", gap, gap)
        order = np.argsort(far, kind="stable")
        norm = float(np.linalg.norm(q))
        rows, scores, at, step = [], np.zeros(0), 0, 2
        while at < len(order):
            d2 = max(2 * self.top * (self.top - bound / norm), 0.0)
            if bound > -math.inf and far[order[at]] > limit * d2:
                break
            leaves = order[at:at + step]
            at, step = at + step, min(2 * step, 64)
            new = (leaves[:, None] * LEAF_ROWS + np.arange(LEAF_ROWS)).ravel()
            new = new[new < len(self.x)]
            got = self.x[new] @ q
            keep = got >= bound - 1e-12 * self.top * norm         # far above a product's rounding
            rows, scores = np.concatenate([rows, new[keep]]).astype(np.int64), np.concatenate([scores, got[keep]])
            best = np.argsort(-scores, kind="stable")
            full = np.searchsorted(np.cumsum(self.many[rows[best]]), k + 1)   # one may be the query
            if full < len(best):
                bound = max(bound, float(scores[best[full]]))
        exact = (self.x[rows] * q).sum(axis=1) if len(rows) else scores
        hits = [(-s, i) for r, s in zip(rows, exact) for i in self.ids[r] if i != query_id]
        return [(i, -s) for s, i in sorted(hits)[:k]]


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v): the rows that take part, each (id, vector) once."""
    v = F.col("v")
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"),
                         F.col(vec_col).cast("array<double>").alias("v"))
    own = own.where(F.col("vec_id").isNotNull() & v.isNotNull()
                    & F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
                    & F.exists(v, lambda c: c != 0))
    size = (own.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n"))
            .agg(F.max_by("size", F.struct("n", "size")).alias("size")))
    return own.join(F.broadcast(size), F.size("v") == F.col("size")).select("vec_id", "v").distinct()  # one row


def best_of_ids(hits: DataFrame) -> DataFrame:
    """One row a query id and candidate id, whichever of their vectors are nearest."""
    return hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))


def nearest(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id",
            vec_col: str = "embedding", confidence: float = CONFIDENCE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest of every query row.

    ``is_query``: a condition on the column ``vec_id``.
    """
    spark = vectors.sparkSession
    rows = materialise(valid(vectors, id_col, vec_col), "vectors")
    first = Window.partitionBy("v").orderBy("vec_id")                 # limited before the shuffle
    points = materialise(rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
                         .groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "points")
    norm2 = F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)
    n, top2 = points.agg(F.count(F.lit(1)), F.max(norm2)).collect()[0]
    out = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], out)
    top = math.sqrt(top2)
    share = F.pmod(F.xxhash64("v", F.lit(3)), F.lit(1 << 30)) < int(min(1.0, TREE_SAMPLE / n) * (1 << 30))
    sample = matrix(points.where(share).select("v").toPandas()["v"])   # about TREE_SAMPLE rows at most
    blocks = min(MAX_BLOCKS, -(-n // BLOCK_ROWS))
    tree = Splits.of(lifted(sample, top) @ directions(sample.shape[1]), blocks) if len(sample) else 0
    limit = chi2_quantile(confidence)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = matrix(pdf["v"])
                yield pdf.assign(block=Splits.blocks(tree, lifted(x, top) @ directions(x.shape[1])))

    placed = materialise(points.mapInPandas(deal, "v array<double>, ids array<long>, block long"), "placed")

    def box(pdf: pd.DataFrame) -> pd.DataFrame:
        x = matrix(pdf["v"])
        p = lifted(x, top) @ directions(x.shape[1])
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "low": [p.min(0)], "high": [p.max(0)]})

    boxes = (placed.groupBy("block").applyInPandas(box, "block long, low array<double>, high array<double>")
             .toPandas().sort_values("block"))                          # one row a block
    known = spark.sparkContext.broadcast(
        (boxes["block"].to_numpy(), matrix(boxes["low"]), matrix(boxes["high"])))

    asked = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "v")

    def at_home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The existing block whose box is nearest."""
        number, low, high = known.value
        for pdf in batches:
            if len(pdf):
                x = matrix(pdf["v"])
                p = scaled(x, top) @ directions(x.shape[1])
                far = [np.square(np.maximum(np.maximum(low - y, y - high), 0)).sum(1) for y in p]
                yield pdf.assign(block=[int(number[np.argmin(f)]) for f in far], bound=-math.inf)

    def elsewhere(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The other blocks that the stopping test doesn't rule out."""
        number, low, high = known.value
        for pdf in batches:
            if not len(pdf):
                continue
            x = matrix(pdf["v"])
            p = scaled(x, top) @ directions(x.shape[1])
            norm = np.linalg.norm(x, axis=1)
            for i in range(len(pdf)):
                far = np.square(np.maximum(np.maximum(low - p[i], p[i] - high), 0)).sum(1)
                d2 = max(2 * top * (top - pdf["bound"].iloc[i] / norm[i]), 0.0)
                other = number[(number != pdf["block"].iloc[i]) & (far <= limit * d2)]
                row = pdf.iloc[i]
                if len(other):
                    yield pd.DataFrame({"query_id": row["query_id"], "v": [row["v"]] * len(other),
                                        "block": other, "bound": row["bound"]})

    kind = "query_id long, v array<double>, block long, bound double"

    def search(queries: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        hits: list = []
        if len(queries) and len(held):
            index = Block(matrix(held["v"]), [list(i) for i in held["ids"]], top)
            for q, v, bound in zip(queries["query_id"], queries["v"], queries["bound"]):
                hits += [(q, i, s) for i, s in index.search(q, np.asarray(v, float), k, limit, bound)]
        return pd.DataFrame(hits, columns=["query_id", "vec_id", "score"])

    def searched(queries: DataFrame) -> DataFrame:
        # A block meets its queries in parts, so that many queries share its work.
        part = F.pmod(F.xxhash64("query_id"), F.lit(PARTS)).cast("int")
        copies = placed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        return (queries.withColumn("part", part).groupBy("block", "part")
                .cogroup(copies.groupBy("block", "part")).applyInPandas(search, HITS))

    here = materialise(asked.mapInPandas(at_home, kind), "home")
    found = materialise(best_of_ids(searched(here)), "found")
    # The k-th best so far is reached only if there are k.
    kth = (found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("worst"))
           .select("query_id", F.when(F.col("n") >= k, F.col("worst")).otherwise(F.lit(-1e300)).alias("bound")))
    again = (here.drop("bound").join(kth, "query_id", "left").fillna(-1e300, ["bound"])
             .select("query_id", "v", "block", "bound").mapInPandas(elsewhere, kind))
    every = best_of_ids(found.union(searched(again)))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return (every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))

