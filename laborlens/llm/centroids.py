"""Centroid clustering of integer vectors by scalar lookup tables.

Components become integers floor(scale * x).  Vectors are kept in blocks: for each dimension
the integer values that occur in the block, and every vector's place among them.  A round
tabulates, for each dimension, occurring value and centroid, the squared difference; the
distances of a block's vectors are then table rows gathered by those places and summed.
Each task adds up its clusters' components, and the centroids (``k`` rows) go through the driver.

Starting centroids are the ``k`` vectors with the smallest SHA-256 of ``1:<id>``, in that
order (equal ids: smaller components first; rows without an id last).  A vector goes to the
nearest centroid (equally near: the smaller number); a centroid becomes the floor of its
vectors' exact mean, and stays where it is without vectors.

Defined cases: vectors that are null, have another number of components, or hold a null, NaN
or infinite one take no part; null ids and repeated rows do; fewer vectors than ``k`` give as
many centroids; an empty table gives no rows; other columns are ignored.  Integers beyond
+-2^27 count as that, so that every distance fits a long; inertias beyond a long's range
are given as its largest value.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from laborlens.llm.common import materialise

DIM = 64
CENTROIDS = 16
ROUNDS = 3
SCALE = 64
LARGEST = 1 << 27
BLOCK_ROWS = 4096
TOP = (1 << 63) - 1

BLOCKS = "ids array<long>, places binary, values binary, sizes binary"
ASSIGNED = "vec_id long, cluster int, distance long"
CLUSTERED = ASSIGNED + ", cluster_inertia long, inertia long, centroid_sha256 string"


def integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, within the range that is kept."""
    def one(x: Column) -> Column:
        x = F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(LARGEST))), F.lit(float(-LARGEST))))
        return x.cast("long")
    return F.transform(vector, one)


def kept(vectors: DataFrame, dim: int = DIM, scale: int = SCALE, id_col: str = "vec_id",
         vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return (vectors.where(v.isNotNull() & (F.size(v) == dim) & ~bad)
            .select(F.col(id_col).cast("long").alias("vec_id"), integers(v, scale).alias("v")))


def blocks(rows: DataFrame, dim: int = DIM) -> DataFrame:
    """Vectors by the block: ids, and each dimension's occurring values and the vectors' places among them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                found = [np.unique(x[:, d], return_inverse=True) for d in range(dim)]
                row = ([part.column(0).to_pylist()],
                       [np.asarray([p for _, p in found], "<u2").tobytes()],
                       [np.concatenate([u for u, _ in found]).astype("<i8").tobytes()],
                       [np.asarray([len(u) for u, _ in found], "<i4").tobytes()])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row[0], pa.list_(pa.int64())), *[pa.array(c, pa.binary()) for c in row[1:]]],
                    names=["ids", "places", "values", "sizes"])

    return rows.select("vec_id", "v").mapInArrow(cut, BLOCKS)


class Block:
    """One row of ``blocks``."""

    def __init__(self, places: bytes, values: bytes, sizes: bytes):
        sizes = np.frombuffer(sizes, "<i4")
        self.values = np.split(np.frombuffer(values, "<i8"), np.cumsum(sizes)[:-1])
        self.places = np.frombuffer(places, "<u2").reshape(len(sizes), -1)

    def distances(self, centroids: np.ndarray) -> np.ndarray:
        """Squared distance of every vector to every centroid, from one table a dimension."""
        total = np.zeros((self.places.shape[1], len(centroids)), np.int64)
        for d, (values, places) in enumerate(zip(self.values, self.places)):
            table = (values[:, None] - centroids[None, :, d]) ** 2
            total += table[places]
        return total

    def sums(self, cluster: np.ndarray, k: int) -> np.ndarray:
        """Sum of each component, and number of vectors, by cluster."""
        out = np.zeros((k, len(self.values) + 1), np.int64)
        for d, (values, places) in enumerate(zip(self.values, self.places)):
            # exact: below 2^27 * 4096 in size
            out[:, d] = np.bincount(cluster, weights=values[places], minlength=k).astype(np.int64)
        out[:, -1] = np.bincount(cluster, minlength=k)
        return out


def _read(batch: pa.RecordBatch) -> Iterator[tuple]:
    for ids, *rest in zip(*[c.to_pylist() for c in batch.columns]):
        yield ids, Block(*rest)


def start(rows: DataFrame, k: int = CENTROIDS) -> np.ndarray:
    """The starting centroids: ``k`` rows by the hash of their ids."""
    key = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = rows.orderBy(key.asc_nulls_last(), "v").limit(k).select("v").collect()
    return np.asarray([r[0] for r in first], np.int64)


def moved(held: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    k, dim = centroids.shape

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dim + 1), np.int64)
        for batch in batches:
            for _, block in _read(batch):
                total += block.sums(block.distances(centroids).argmin(axis=1), k)
        used = np.flatnonzero(total[:, -1])
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used].tolist(), pa.list_(pa.int64()))],
                                         names=["cluster", "total"])

    parts = held.mapInArrow(add_up, "cluster int, total array<long>")
    sums = (parts.select("cluster", F.posexplode("total").alias("d", "x")).groupBy("cluster", "d")
            .agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect())       # k * (dim + 1) rows
    exact = {(r[0], r[1]): int(r[2]) for r in sums}
    out = centroids.copy()
    for c in {c for c, _ in exact}:
        n = exact[c, dim]
        out[c] = [exact[c, d] // n for d in range(dim)]
    return out


def assigned(held: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Every vector's cluster and squared distance."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, block in _read(batch):
                far = block.distances(centroids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(far.argmin(axis=1), pa.int32()), pa.array(far.min(axis=1))],
                    names=["vec_id", "cluster", "distance"])

    return held.mapInArrow(find, ASSIGNED)


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE,
            id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Every kept vector with its cluster, distance, inertias and its centroid's digest."""
    spark = vectors.sparkSession
    rows = kept(vectors, dim, scale, id_col, vector_col)
    centroids = start(rows, k)
    if not len(centroids):
        return spark.createDataFrame([], CLUSTERED)
    held = materialise(blocks(rows, dim), "blocks")
    for _ in range(rounds):
        centroids = moved(held, centroids)
    found = materialise(assigned(held, centroids), "assigned")
    sums = {r[0]: int(r[1]) for r in found.groupBy("cluster")
            .agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}           # at most k rows
    total = sum(sums.values())
    facts = spark.createDataFrame([(c, min(n, TOP), min(total, TOP), digest(centroids[c])) for c, n in sums.items()],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select(*[f.split()[0] for f in CLUSTERED.split(", ")])


def _oracle() -> str:
    """DuckDB SQL of the same rows: each round is a pair of common tables."""
    def difference(v: str, c: str) -> str:
        return f"list_sum(list_transform(list_zip({v}, {c}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"

    sql = f"""WITH raw AS (SELECT vec_id, CASE WHEN len(embedding) = {DIM}
    AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) THEN embedding END AS e
  FROM embeddings),
kept AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id,
    list_transform(e, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM raw WHERE e IS NOT NULL),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS k, v FROM (
    SELECT sha256('1:' || vec_id) AS h, v FROM kept ORDER BY h NULLS LAST, v LIMIT {CENTROIDS})),
"""
    for r in range(ROUNDS + 1):
        sql += f"""a{r} AS MATERIALIZED (SELECT row, arg_min(k, d * {CENTROIDS} + k) AS k, MIN(d) AS d FROM (
    SELECT row, k, {difference('kept.v', f'c{r}.v')} AS d FROM kept, c{r}) GROUP BY row),
"""
        if r < ROUNDS:
            sql += f"""s{r} AS (SELECT k, i, SUM(x) AS s, COUNT(*) AS n FROM (
    SELECT k, UNNEST(v) AS x, UNNEST(range({DIM})) AS i FROM kept JOIN a{r} USING (row)) GROUP BY k, i),
c{r + 1} AS MATERIALIZED (SELECT c{r}.k, COALESCE(m.v, c{r}.v) AS v FROM c{r} LEFT JOIN (
    SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{r} GROUP BY k) m ON m.k = c{r}.k),
"""
    return sql + f"""facts AS (SELECT k, SUM(d) AS own FROM a{ROUNDS} GROUP BY k)
SELECT vec_id, CAST(a{ROUNDS}.k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(own AS BIGINT) AS cluster_inertia,
  CAST((SELECT SUM(own) FROM facts) AS BIGINT) AS inertia, sha256(list_aggregate(c{ROUNDS}.v, 'string_agg', ',')) AS centroid_sha256
FROM kept JOIN a{ROUNDS} USING (row) JOIN facts ON facts.k = a{ROUNDS}.k JOIN c{ROUNDS} ON c{ROUNDS}.k = a{ROUNDS}.k"""


ORACLE_SQL = _oracle()
