"""Language identification by rank-order profiles (out-of-place distance).

A language's profile is its ``PROFILE`` most frequent character n-grams (1 to 3
letters, words apart by one blank), counted over every training text and put in
rank order.  A document's own most frequent n-grams are compared with each
profile: each n-gram costs the difference of its two ranks, or ``PROFILE`` if
the profile lacks it; the nearest profile names the language.  The score is one
minus the distance over the largest possible distance.

Counts are merged per task before they are shuffled; profiles are bounded
(languages x ``PROFILE``).  Ties of frequency go to the smaller n-gram code, ties
of distance to the smaller language name.

Defined cases: a null text, an empty one and one without any letter give
``und`` with score 0; so does every text when nothing was learned.  Training rows
with a null language or text are left out.  Repeated rows count each; an empty
table gives no rows; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from laborlens.llm.common import held_out, worker_cache

PROFILE = 300
MAX_N = 3
MOD, HELD = 4, 2
UNKNOWN = "und"
FLUSH = 2_000_000            # distinct n-grams a task holds before it emits them
SLICE = 1 << 20              # characters whose n-grams are sorted at once


def _letters() -> np.ndarray:
    """For each code point: is it a letter?"""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def code_points(text: str | None) -> np.ndarray:
    """Lower-cased letters; runs of anything else are one blank (0), also at both ends."""
    if not text:
        return np.zeros(0, np.int64)
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    c = np.where(worker_cache("letters", _letters)[c], c, 0)
    c = np.concatenate([[0], c, [0]])
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
    c = c[keep]
    return c if len(c) > 1 else np.zeros(0, np.int64)


def ngram_counts(text: str | None) -> tuple:
    """(codes, counts) of the n-grams of a whole text; a code packs its letters, 21 bits each."""
    c = code_points(text)
    codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for at in range(0, max(0, len(c)), SLICE):
        part = c[at:at + SLICE + MAX_N - 1]
        n = min(SLICE, len(c) - at)
        grams = [part[:n][part[:n] > 0]]
        code = part
        for k in range(1, MAX_N):
            code = code[:-1] << 21 | part[k:]
            grams.append(code[:n])
        new, m = np.unique(np.concatenate(grams), return_counts=True)
        codes, counts = (new, m) if not len(codes) else merged(codes, counts, new, m)
    return codes, counts


def merged(codes: np.ndarray, counts: np.ndarray, more: np.ndarray, m: np.ndarray) -> tuple:
    both, where = np.unique(np.concatenate([codes, more]), return_inverse=True)
    return both, np.bincount(where, np.concatenate([counts, m]), len(both)).astype(np.int64)


def top(codes: np.ndarray, counts: np.ndarray, k: int = PROFILE) -> np.ndarray:
    """The most frequent codes in rank order."""
    if len(codes) > 4 * k:                            # ties of the k-th count stay in
        few = counts >= np.partition(counts, len(counts) - k)[len(counts) - k]
        codes, counts = codes[few], counts[few]
    return codes[np.lexsort((codes, -counts))[:k]]


def profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> dict:
    """Language -> its n-gram codes in rank order, from all training rows."""
    train = (docs.where(~held_out(F.col(id_col), MOD, HELD))
             .where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
             .select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        queue: dict = {}

        def settle(lang):
            codes, counts = queue.pop(lang)
            both, where = np.unique(np.concatenate(codes), return_inverse=True)
            new = both, np.bincount(where, np.concatenate(counts), len(both)).astype(np.int64)
            held[lang] = merged(*held[lang], *new) if lang in held else new

        def emit():
            for lang in list(queue):
                settle(lang)
            for lang, (codes, counts) in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)],
                    names=["lang", "code", "n"])
            held.clear()

        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    codes, counts = ngram_counts(text)
                    c, n = queue.setdefault(lang, ([], []))
                    c.append(codes)
                    n.append(counts)
                for lang in [x for x, (c, _) in queue.items() if sum(map(len, c)) > 500_000]:
                    settle(lang)
                if sum(len(x[0]) for x in held.values()) > FLUSH:
                    yield from emit()
        yield from emit()

    totals = (train.mapInArrow(count, "lang string, code long, n long")
              .groupBy("lang", "code").agg(F.sum("n").alias("n")))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), F.asc("code"))
    ranked = (totals.withColumn("r", F.row_number().over(best))      # limited before the shuffle
              .where(F.col("r") <= PROFILE).orderBy("lang", "r"))
    out: dict = {}
    for r in ranked.collect():                                       # languages x PROFILE rows
        out.setdefault(r["lang"], []).append(r["code"])
    return {k: np.asarray(v, np.int64) for k, v in sorted(out.items())}


class Profiles:
    """Out-of-place distances to all languages from one sorted table."""

    def __init__(self, by_lang: dict):
        self.names = list(by_lang)
        self.codes = np.unique(np.concatenate([np.zeros(0, np.int64), *by_lang.values()]))
        self.ranks = np.full((len(self.names), len(self.codes) + 1), -1, np.int64)
        for k, codes in enumerate(by_lang.values()):
            self.ranks[k, np.searchsorted(self.codes, codes)] = np.arange(len(codes))

    def nearest(self, text: str | None) -> tuple:
        mine = top(*ngram_counts(text))
        if not len(mine) or not self.names:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.codes, mine), len(self.codes) - 1)
        at = np.where(self.codes[at] == mine, at, len(self.codes))
        ranks = self.ranks[:, at]
        cost = np.where(ranks < 0, PROFILE, np.abs(ranks - np.arange(len(mine)))).sum(axis=1)
        k = int(np.argmin(cost))
        return self.names[k], 1 - float(cost[k]) / (PROFILE * len(mine))


def predictor(docs: DataFrame, **cols):
    """Learn the profiles; a function text column -> struct(lang_pred, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles(docs, **cols))

    def predict(text: Column) -> Column:
        @F.pandas_udf("lang_pred string, score double")
        def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            known = Profiles(shared.value)
            for texts in batches:
                yield pd.DataFrame([known.nearest(t) for t in texts],
                                   columns=["lang_pred", "score"])
        return of(text)

    return predict


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """``docs`` with a struct column ``langid`` (lang_pred, score)."""
    predict = predictor(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    return docs.withColumn("langid", predict(F.col(text_col)))
