"""Toxicity: a linear classifier over character n-grams scaled by naive-Bayes ratios.

Features are the distinct character n-grams (``SIZES`` letters, lower-cased, white
space runs as one blank) of a whole text, hashed to ``SLOTS`` slots.  From labelled
texts each slot has a log-count ratio r = log((p / |p|) / (q / |q|)) of its smoothed
document counts in the two classes.  A logistic regression with L2 penalty is fitted on the presence
features times r, over all slots, by L-BFGS: the features of the labelled rows are written once, and each
step's gradient is summed in Spark tasks.  A fifth of the labelled rows is kept from the fit;
on them a scale and a shift of the log-odds are fitted, so that scores are probabilities.

The fit uses at most ``MAX_LABELLED`` labelled rows, none of the held-out fold; the
model has ``SLOTS`` numbers, so it may be broadcast.

Defined cases: a null text counts as empty; an empty text has no feature and gets
the intercept's score; without labelled rows, or with one class only, the score is
that class share (0.5 without any); repeated rows get equal scores; an empty table
gives no rows; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from laborlens.llm.common import id_crc, labelled_sample, materialise

SIZES = (3, 4, 5, 6)
SLOTS = 1 << 18
MAX_LABELLED = 20_000
L2 = 1e-2
STEPS = 25
MEMORY = 8                    # L-BFGS pairs
THRESHOLD = 0.5
MOD, HELD, ASIDE = 5, 0, 1
SLICE = 1 << 18
ROWS = 256                    # documents whose features are handled at once
TASKS = 8                     # that share the fit's bounded sample
_MULT = np.uint64(0x9E3779B97F4A7C15)


def flat_slices(text: str) -> Iterator[str]:
    """The text in lower case with one blank for each run of white space and at both ends, in slices."""
    yield " "
    open_word = False                                   # the slice before ended within a word
    for at in range(0, len(text), SLICE):
        raw = text[at:at + SLICE]
        flat = " ".join(raw.lower().split())
        if flat:
            yield flat if open_word and not raw[0].isspace() else flat if at == 0 or not open_word else " " + flat
            open_word = True
        if raw[-1].isspace() and open_word:
            yield " "
            open_word = False
    if open_word:
        yield " "


def slots(text: str | None) -> np.ndarray:
    """Distinct slots of a whole text's n-grams, sorted."""
    seen = np.zeros(SLOTS, bool)
    longest = SIZES[-1]
    held = np.zeros(0, np.uint64)
    for flat in flat_slices(text or ""):
        c = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        held = np.concatenate([held, c])
        if len(held) >= SLICE:
            _mark(held, seen)
            held = held[1 - longest:]
    _mark(held, seen)
    return np.flatnonzero(seen).astype(np.int32)


def _mark(c: np.ndarray, seen: np.ndarray) -> None:
    code = c + np.uint64(1)
    for k in range(1, SIZES[-1]):
        code = code[:-1] * _MULT + c[k:] + np.uint64(1)
        code ^= code >> np.uint64(29)
        if k + 1 in SIZES:
            seen[(code * _MULT >> np.uint64(46)).astype(np.int32)] = True


def log_count_ratios(sample: DataFrame) -> np.ndarray:
    """r per slot from rows (_text, _y)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros((2, SLOTS), np.int64)
        for pdf in batches:
            for text, y in zip(pdf["_text"], pdf["_y"]):
                n[int(y == 1), slots(text)] += 1
        used = np.flatnonzero(n.any(axis=0))
        yield pd.DataFrame({"slot": used, "n0": n[0, used], "n1": n[1, used]})

    total = (sample.select("_text", "_y").mapInPandas(count, "slot int, n0 long, n1 long")
             .groupBy("slot").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
             .toPandas())                                        # at most SLOTS rows
    n = np.zeros((2, SLOTS))
    n[0, total["slot"]], n[1, total["slot"]] = total["n0"], total["n1"]
    p, q = n[1] + 1, n[0] + 1
    return np.log((p / p.sum()) / (q / q.sum()))


def features(sample: DataFrame) -> DataFrame:
    """(aside, y, low, many): the slots of each labelled row, as the low 16 bits of each and how many
    there are of each high part."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), ROWS):
                part = pdf.iloc[at:at + ROWS]
                own = [slots(t) for t in part["_text"]]
                yield pd.DataFrame({"aside": part["_aside"], "y": part["_y"],
                                    "low": [(x & 0xFFFF).astype("<u2").tobytes() for x in own],
                                    "many": [np.bincount(x >> 16, minlength=SLOTS >> 16).astype("<i4").tobytes()
                                             for x in own]})

    return sample.mapInPandas(work, "aside boolean, y int, low binary, many binary")


def _index(low: list, many: list) -> tuple:
    """(slots of all rows in a row, number of each row)."""
    high = np.frombuffer(b"".join(many), "<i4")
    base = np.tile(np.arange(SLOTS >> 16, dtype=np.int32) << 16, len(many))
    idx = np.frombuffer(b"".join(low), "<u2").astype(np.int32) + np.repeat(base, high)
    return idx, high.reshape(len(many), -1).sum(axis=1)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(labels, slots of all rows in a row, row of each slot) of some rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            idx, size = _index(part.column("low").to_pylist(), part.column("many").to_pylist())
            yield part.column("y").to_numpy().astype(float), idx, np.repeat(np.arange(part.num_rows), size)


def log_odds(rows: DataFrame, weights: np.ndarray, bias: float) -> pd.DataFrame:
    """(y, z) of labelled rows; their number is bounded by the sample."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for y, idx, row in _rows(batches):
            z = np.bincount(row, shared.value[idx], len(y)) + bias
            yield pa.RecordBatch.from_pydict({"y": pa.array(y), "z": pa.array(z)})

    return rows.select("y", "low", "many").mapInArrow(work, "y double, z double").toPandas()


def loss_and_gradient(rows: DataFrame, ratio: np.ndarray, n: int, l2: float):
    """The objective of the fit as a function of the weights and the intercept."""
    context = rows.sparkSession.sparkContext

    def value(x: np.ndarray) -> tuple:
        shared = context.broadcast((x[:-1] * ratio, float(x[-1])))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights, bias = shared.value
            loss, slope, steep = 0.0, np.zeros(SLOTS), 0.0
            for y, idx, row in _rows(batches):
                z = np.bincount(row, weights[idx], len(y)) + bias
                loss += float((np.logaddexp(0, z) - y * z).sum())
                d = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
                slope += np.bincount(idx, d[row], SLOTS)
                steep += float(d.sum())
            yield pa.RecordBatch.from_pydict({"loss": [loss], "steep": [steep], "slope": [slope.astype("<f4").tobytes()]})

        parts = (rows.select("y", "low", "many").coalesce(TASKS)
                 .mapInArrow(work, "loss double, steep double, slope binary").collect())
        slope, loss, steep = np.zeros(SLOTS), 0.0, 0.0
        for r in parts:                                           # at most TASKS rows of SLOTS numbers
            slope += np.frombuffer(r["slope"], "<f4")
            loss += r["loss"]
            steep += r["steep"]
        shared.destroy()
        loss = loss / n + l2 / 2 * float(x[:-1] @ x[:-1])
        return loss, np.append(slope * ratio / n + l2 * x[:-1], steep / n)

    return value


def minimised(value, x: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """L-BFGS with halved steps until the loss falls enough."""
    pairs: list = []
    loss, g = value(x)
    for _ in range(steps):
        q, used = g.copy(), []
        for s, t in reversed(pairs):
            a = (s @ q) / (t @ s)
            used.append(a)
            q -= a * t
        q *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 0.1 / max(np.linalg.norm(g), 1e-12)
        for (s, t), a in zip(pairs, reversed(used)):
            q += s * (a - (t @ q) / (t @ s))
        step = 1.0
        while True:
            there = x - step * q
            new, slope = value(there)
            if new <= loss - 1e-4 * step * (g @ q) or step < 1e-6:
                break
            step /= 2
        if (there - x) @ (slope - g) > 1e-12:
            pairs = [*pairs, (there - x, slope - g)][-MEMORY:]
        done = abs(loss - new) < 1e-6 * max(1.0, abs(loss))
        x, loss, g = there, new, slope
        if done:
            break
    return x


def calibration(z: np.ndarray, y: np.ndarray) -> tuple:
    """(scale, shift) of log-odds with the least log-loss, by damped Newton steps."""
    def cost(p):
        t = p[0] * z + p[1]
        return (np.logaddexp(0, t) - y * t).sum() + 5e-4 * (p[0] - 1) ** 2

    at = np.asarray([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(at[0] * z + at[1], -500, 500)))
        w = p * (1 - p) + 1e-9
        g = np.asarray([((p - y) * z).sum() + 1e-3 * (at[0] - 1), (p - y).sum()])
        h = np.asarray([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-9]])
        move, step = np.linalg.solve(h, g), 1.0
        while cost(at - step * move) > cost(at) and step > 1e-9:
            step /= 2
        at = at - step * move
        if np.abs(step * move).max() < 1e-8:
            break
    return float(at[0]), float(at[1])


def train(sample: DataFrame) -> tuple:
    """(weight of each slot, intercept) from labelled rows (_id, _text, _y)."""
    aside = F.coalesce(id_crc(F.col("_id")) % MOD == ASIDE, F.lit(False))
    rows = sample.withColumn("_aside", aside)
    rows = materialise(features(rows), "features")
    known = {(r[0], r[1]): r[2] for r in rows.groupBy("aside", "y").count().collect()}
    n0, n1 = (sum(n for (_, y), n in known.items() if (y == 1) == c) for c in (False, True))
    fit0, fit1 = known.get((False, 0), 0), known.get((False, 1), 0)
    if not (fit0 and fit1):
        share = n1 / (n0 + n1) if n0 + n1 else 0.5
        return np.zeros(SLOTS), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    ratio = log_count_ratios(sample.where(~aside))
    own = rows.where("NOT aside")
    start = np.append(np.zeros(SLOTS), np.log(fit1 / fit0))
    x = minimised(loss_and_gradient(own, ratio, fit0 + fit1, L2), start)
    weights, bias = x[:-1] * ratio, float(x[-1])
    if known.get((True, 0), 0) and known.get((True, 1), 0):
        kept = log_odds(rows.where("aside"), weights, bias).sort_values(["z", "y"])
        scale, shift = calibration(kept["z"].to_numpy(), kept["y"].to_numpy())
        weights, bias = weights * scale, bias * scale + shift
    return weights, bias


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id",
        text_col: str = "text", bound: int = MAX_LABELLED):
    """Fit on the labelled sample; a function text column -> score column."""
    spark = docs.sparkSession
    sample = materialise(labelled_sample(docs, labels, label, MOD, HELD, bound, id_col, text_col), "labelled")
    model = spark.sparkContext.broadcast(train(sample))

    def score(text: Column) -> Column:
        @F.pandas_udf("double")
        def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            weights, b = model.value
            for texts in batches:
                z = np.asarray([weights[slots(t)].sum() + b for t in texts], float)
                yield pd.Series(1 / (1 + np.exp(-np.clip(z, -500, 500))))
        return of(text)

    return score


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **named) -> DataFrame:
    """``docs`` with columns ``toxic_score`` and ``toxic_pred``."""
    score = fit(docs, labels, **named)
    return (docs.withColumn("toxic_score", score(F.col(named.get("text_col", "text"))))
            .withColumn("toxic_pred", (F.col("toxic_score") >= threshold).cast("int")))
