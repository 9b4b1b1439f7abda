"""Quality classifier: random-indexing word vectors, pooled, then a small network.

* *Word vectors.*  Every word hashes to one of ``SLOTS`` slots.  A slot has a
  sparse ternary index vector (one +1, one -1); its context vector is the sum of
  the index vectors around all its occurrences, over the whole corpus.  The
  table is ``SLOTS`` x ``DIM`` whatever the corpus, so tasks add up tables of
  fixed size and the result may be broadcast.
* *Pooling.*  A document is the mean and the standard deviation of its words'
  unit vectors, the mean cosine of words 1 to ``LAGS`` apart (repetition) and the
  logarithm of its length.
* *Network.*  Two layers in numpy, fitted on a sample of at most
  ``MAX_LABELLED`` labelled documents (rows in the held-out fold never enter).
  A fifth of the sample is kept from the fit and sets the temperature that
  divides the logits, so that scores are calibrated probabilities.

Words are letter runs, digit runs and runs of other signs, case kept.

Defined cases: a null text counts as empty, an empty text has the zero vector
and gets the network's score for it; without labelled rows, or with one class
only, the score is that class share (0.5 without any); repeated rows get equal
scores; an empty table gives no rows; other columns stay as they are.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from laborlens.llm.common import free_worker, labelled_sample

SLOTS = 1 << 15
DIM = 32
WINDOW = 2
LAGS = 3
WIDTH = 2 * DIM + LAGS + 1   # numbers a document is pooled to
BLOCK = 256                  # slots in one shuffled row
MAX_LABELLED = 20_000        # labelled documents that a fit may use
HIDDEN = 32
THRESHOLD = 0.3
MOD, HELD = 5, 0
CACHE_WORDS = 200_000
WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
GATHER = 1 << 17             # words pooled at once


def _index_vectors() -> tuple:
    """Position of the +1 and of the -1 of each slot's index vector."""
    rng = np.random.default_rng(11)
    plus = rng.integers(0, DIM, SLOTS)
    minus = (plus + rng.integers(1, DIM, SLOTS)) % DIM
    return plus, minus


class Slots:
    """Word -> slot, remembered for a bounded number of words."""

    def __init__(self):
        self.known: dict = {}

    def of(self, text: str | None) -> np.ndarray:
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        known, words = self.known, WORD.findall(text or "")
        for w in set(words):
            if w not in known:
                known[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) % SLOTS
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def _add_contexts(total: np.ndarray, docs: list) -> None:
    """Add the contexts of some documents' slots; no window crosses documents."""
    plus, minus = _index_vectors()
    gap = np.full(WINDOW, -1)
    row = np.concatenate([x for d in docs for x in (d, gap)])
    for off in range(1, WINDOW + 1):
        a, b = row[:-off], row[off:]
        both = (a >= 0) & (b >= 0)
        a, b = a[both], b[both]
        for x, y in ((a, b), (b, a)):
            total += np.bincount(x * DIM + plus[y], minlength=total.size)
            total -= np.bincount(x * DIM + minus[y], minlength=total.size)


def context_table(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Unit context vectors of all slots, over every whole text."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        total, slots = np.zeros(SLOTS * DIM), Slots()
        for b in batches:
            for at in range(0, b.num_rows, 128):
                _add_contexts(total, [slots.of(t) for t in b.column(0).slice(at, 128).to_pylist()])
        yield from blocks(total)

    def blocks(total: np.ndarray) -> Iterator[pa.RecordBatch]:
        parts = total.reshape(-1, BLOCK * DIM).astype("<i8")
        used = np.flatnonzero(parts.any(axis=1))
        small = [p.astype("<i4") if np.abs(p).max() < 1 << 31 else p for p in parts[used]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array([p.tobytes() for p in small], pa.binary())],
            names=["block", "sums"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}                              # at most SLOTS / BLOCK blocks
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                new = np.frombuffer(raw, "<i4" if len(raw) == 4 * BLOCK * DIM else "<i8").astype(np.int64)
                sums[k] = sums[k] + new if k in sums else new
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()),
                 pa.array([s.astype("<i8").tobytes() for s in sums.values()], pa.binary())],
                names=["block", "sums"])

    kind = "block int, sums binary"
    table = np.zeros((SLOTS, DIM))
    found = (docs.select(F.col(text_col).alias("text")).mapInArrow(partial, kind)
             .repartition("block").mapInArrow(add_up, kind).collect())   # SLOTS x DIM numbers
    for r in found:
        table[r["block"] * BLOCK:(r["block"] + 1) * BLOCK] = np.frombuffer(r["sums"], "<i8").reshape(BLOCK, DIM)
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.where(norm > 0, norm, 1)).astype(np.float32)


def pooled(text: str | None, vectors: np.ndarray, slots: Slots) -> np.ndarray:
    """Mean and standard deviation of the word vectors of one whole text."""
    ids = slots.of(text)
    if not len(ids):
        return np.zeros(WIDTH, np.float32)
    one, two, near = np.zeros(DIM), np.zeros(DIM), np.zeros(LAGS)
    for at in range(0, len(ids), GATHER):
        v = vectors[ids[at:at + GATHER + LAGS]]
        own = v[:GATHER]
        one += own.sum(axis=0)
        two += np.einsum("ij,ij->j", own, own)
        for k in range(1, LAGS + 1):
            near[k - 1] += np.einsum("ij,ij->", v[:-k][:GATHER], v[k:][:GATHER])
    mean = one / len(ids)
    spread = np.sqrt(np.maximum(two / len(ids) - mean * mean, 0))
    near /= np.maximum(len(ids) - np.arange(1, LAGS + 1), 1)
    return np.concatenate([mean, spread, near, [np.log1p(len(ids))]]).astype(np.float32)


class Network:
    """tanh layer, linear output; features standardised; logits over a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, calibrate: np.ndarray, seed: int = 5):
        self.prior = float(y.mean()) if len(y) else 0.5
        self.weights = None
        fit = ~calibrate
        if len(np.unique(y[fit])) < 2:
            return
        self.mu, self.sd = x[fit].mean(0), x[fit].std(0) + 1e-6
        z = (x - self.mu) / self.sd
        rng = np.random.default_rng(seed)
        w = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN),
             rng.normal(0, HIDDEN ** -0.5, HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        zf, yf = z[fit], y[fit].astype(float)
        for _ in range(40):
            order = rng.permutation(len(yf))
            for at in range(0, len(yf), 256):
                i, step = order[at:at + 256], step + 1
                h = np.tanh(zf[i] @ w[0] + w[1])
                p = 1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30)))
                d = (p - yf[i]) / len(i)
                dh = np.outer(d, w[2]) * (1 - h * h)
                grads = (zf[i].T @ dh + 1e-4 * w[0], dh.sum(0), h.T @ d + 1e-4 * w[2], d.sum(keepdims=True))
                for k, g in enumerate(grads):        # Adam
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    w[k] -= 0.005 * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
        self.weights = w
        self.temperature = 1.0
        if calibrate.any():
            logit, yc = self.logits(x[calibrate]), y[calibrate]
            grid = np.exp(np.linspace(np.log(0.25), np.log(8), 121))
            loss = [np.mean(np.logaddexp(0, np.where(yc == 1, -1, 1) * logit / t)) for t in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    @classmethod
    def of(cls, state: dict) -> Network:
        """A fitted network from its ``vars()`` (plain arrays travel to the tasks)."""
        net = cls.__new__(cls)
        net.__dict__.update(state)
        return net

    def logits(self, x: np.ndarray) -> np.ndarray:
        w = self.weights
        return np.tanh((x - self.mu) / self.sd @ w[0] + w[1]) @ w[2] + w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        p = 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))
        return np.round(p, 9)                         # the same whatever rows are scored together


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id",
        text_col: str = "text", bound: int = MAX_LABELLED) -> Column:
    """Fit on the corpus and the labelled sample; a function text column -> score column."""
    spark = docs.sparkSession
    vectors = spark.sparkContext.broadcast(context_table(docs, text_col))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots = Slots()
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["_id"], "y": pdf["_y"], "x": [
                pooled(t, vectors.value, slots).astype("<f4").tobytes() for t in pdf["_text"]]})

    sample = labelled_sample(docs, labels, label, MOD, HELD, bound, id_col, text_col)
    rows = sample.mapInPandas(features, "id long, y int, x binary").toPandas()   # <= bound rows
    rows = rows.sort_values(["id", "x"])
    x = (np.frombuffer(b"".join(rows["x"]), "<f4").reshape(-1, WIDTH) if len(rows)
         else np.zeros((0, WIDTH)))
    aside = np.asarray([zlib.crc32(str(i).encode()) % MOD == 1 for i in rows["id"]], bool)
    net = spark.sparkContext.broadcast(vars(Network(x, rows["y"].to_numpy(), aside)))

    def score(text: Column) -> Column:
        @F.pandas_udf("double")
        def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            free_worker()
            slots, model = Slots(), Network.of(net.value)
            for texts in batches:
                x = np.asarray([pooled(t, vectors.value, slots) for t in texts]).reshape(-1, WIDTH)
                yield pd.Series(model.score(x))
        return of(text)

    return score


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **named) -> DataFrame:
    """``docs`` with columns ``quality_score`` and ``quality_pred``."""
    score = fit(docs, labels, **named)
    return (docs.withColumn("quality_score", score(F.col(named.get("text_col", "text"))))
            .withColumn("quality_pred", (F.col("quality_score") >= threshold).cast("int")))
