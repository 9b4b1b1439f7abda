"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming look-up.

Method, for every whole document:

1. Windows.  A window can pass the final check against an item only if it shares
   the item's five-word shingles, so for each item size the windows of that size are
   laid at every start from which they cover a shingle that some item of that size has,
   wherever it stands there.  Of ``m`` shingles in a window and ``n`` in the item, ``b``
   shared ones give a similarity of b / (m + n - b) at most; windows that hold too few
   such shingles to reach ``MIN_SIMILARITY`` by this are left out, so none that could pass.
2. Fingerprints.  Each window's 64-bit SimHash is taken over its shingles, counted
   as often as they occur; bit counts are rolled from window to window.
3. Multi-index Hamming blocks.  Fingerprints are cut into 8 blocks of 8 bits.  Two
   fingerprints within ``RADIUS`` = 23 bits agree in some block up to 2 bits (8 * 3 =
   24 > 23), so looking up every block value within 2 bits finds all items within
   the radius.
4. Verification.  Exact weighted-shingle similarity, sum of minimum counts over sum
   of maximum counts, of ``MIN_SIMILARITY`` or more.  Windows of one item that
   overlap a better one are left out.

The benchmark is cut into parts of at most ``PART_WORDS`` words; each part's index
is of bounded size and broadcast, and each part costs one scan of the documents.

Words are runs of letters and digits, lower-cased.  Defined cases: a null or empty
text matches nothing; an item with fewer than five words has no shingle and matches
nothing; null or repeated items are skipped or each reported; repeated document rows
are each reported; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SHINGLE = 5
MIN_SIMILARITY = 0.8
RADIUS = 23
PART_WORDS = 1_000_000       # words of benchmark text in one broadcast index
CACHE_WORDS = 300_000
CHUNK = 4096                 # shingles whose bits are counted at once
WORD = re.compile(r"\w+")
_MULT = np.uint64(0x9E3779B97F4A7C15)
MATCH = "doc_id long, item_id long, start_word long, end_word long, similarity double, distance int"


class WordHash:
    """64-bit hashes of a text's words, remembered for a bounded number of words."""

    def __init__(self):
        self.known: dict = {}

    def of(self, text: str | None) -> np.ndarray:
        from xxhash import xxh64_intdigest
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        known, words = self.known, WORD.findall((text or "").lower())
        for w in set(words):
            if w not in known:
                known[w] = xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray) -> np.ndarray:
    """Hash of the five words from each position."""
    n = len(words) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        h = (h ^ words[k:k + n]) * _MULT
        h ^= h >> np.uint64(31)
    return h


def simhash(hashes: np.ndarray) -> int:
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(hashes), bitorder="little").view("<u8")[0])


def rolled(doc: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list:
    """SimHash of each window; starts ascend.  Windows that lie close share the bit counts of their words."""
    out: list = []
    low = 0
    while low < len(starts):
        base = int(starts[low])
        reach = max(int(ends[low]) - base, CHUNK)
        high = max(low + 1, int(np.searchsorted(ends, base + reach, side="right")))
        part = doc[base:int(ends[high - 1])]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total = np.zeros((len(part) + 1, 64), np.int32)
        np.cumsum(bits, axis=0, dtype=np.int32, out=total[1:])
        a, b = starts[low:high] - base, ends[low:high] - base
        ones = 2 * (total[b] - total[a]) > (b - a)[:, None]
        out += np.packbits(ones, axis=1, bitorder="little").view("<u8")[:, 0].tolist()
        low = high
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted (multiset) Jaccard similarity of two shingle arrays."""
    x, y = Counter(a.tolist()), Counter(b.tolist())
    both = sum(min(n, y[k]) for k, n in x.items())
    total = len(a) + len(b) - both
    return both / total if total else 0.0


class Index:
    """One benchmark part: shingle places, fingerprints and their Hamming blocks."""

    def __init__(self, items: list):
        """``items``: (item_id, text) pairs."""
        words = WordHash()
        rows = [(i, shingles(words.of(t))) for i, t in items]
        rows = [(i, s) for i, s in rows if len(s)]
        self.ids = [i for i, _ in rows]
        self.items = [s for _, s in rows]
        self.size = np.asarray([len(s) for s in self.items], np.int64)
        self.prints = np.asarray([simhash(s) for s in self.items], np.uint64)
        flat = np.concatenate([np.zeros(0, np.uint64), *self.items])
        size = np.repeat(self.size, self.size)
        order = np.lexsort((size, flat))
        flat, size = flat[order], size[order]
        new = np.ones(len(flat), bool)
        new[1:] = (flat[1:] != flat[:-1]) | (size[1:] != size[:-1])
        self.flat, self.flat_size = flat[new], size[new]          # shingles and sizes of items that have them
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.flat >> np.uint64(44)] = True
        near = np.bitwise_count(np.arange(256)[:, None] ^ np.arange(256)[None, :]) <= RADIUS // 8
        blocks = self.prints.astype("<u8").view(np.uint8).reshape(-1, 8)
        self.blocks = [[np.flatnonzero(near[v][blocks[:, b]]) for v in range(256)] for b in range(8)]

    def within(self, window: int) -> np.ndarray:
        """All items within ``RADIUS`` bits of a fingerprint."""
        values = np.asarray([window], "<u8").view(np.uint8)
        found = np.unique(np.concatenate([self.blocks[b][v] for b, v in enumerate(values.tolist())]))
        return found[np.bitwise_count(self.prints[found] ^ np.uint64(window)) <= RADIUS]

    def windows(self, doc: np.ndarray) -> Iterator[tuple]:
        """(size, starts, ends) of the windows that could pass against an item of that size."""
        at = np.flatnonzero(self.seen[doc >> np.uint64(44)])
        low = np.searchsorted(self.flat, doc[at], side="left")
        many = np.searchsorted(self.flat, doc[at], side="right") - low
        at, low, many = at[many > 0], low[many > 0], many[many > 0]
        if not len(at):
            return
        size = self.flat_size[np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())]
        at = np.repeat(at, many)
        order = np.argsort(size, kind="stable")
        for hits in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
            n, hit = int(size[hits[0]]), at[hits]                 # places in ascending order
            if len(hit) < MIN_SIMILARITY * n - 1e-6:
                continue
            first = np.maximum(hit - n + 1, np.r_[-n, hit[:-1] + 1])      # starts not laid for the hit before
            long = hit + 1 - first
            start = np.repeat(first - np.cumsum(long) + long, long) + np.arange(long.sum())
            start, end = np.maximum(start, 0), np.minimum(start + n, len(doc))
            both = np.searchsorted(hit, end) - np.searchsorted(hit, start)
            could = both >= MIN_SIMILARITY * (end - start + n - both) - 1e-6
            spans = np.unique(np.stack([start[could], end[could]], axis=1), axis=0)
            if len(spans):
                yield n, spans[:, 0], spans[:, 1]

    def matches(self, doc: np.ndarray) -> list:
        """(item, start word, end word, similarity, distance) for one document's shingles."""
        found: dict = {}
        for size, starts, ends in self.windows(doc):
            for start, end, mark in zip(starts.tolist(), ends.tolist(), rolled(doc, starts, ends)):
                own = None
                for k in self.within(mark).tolist():
                    if self.size[k] != size:
                        continue
                    own = doc[start:end] if own is None else own
                    s = similarity(own, self.items[k])
                    if s >= MIN_SIMILARITY:
                        far = int(np.bitwise_count(self.prints[k] ^ np.uint64(mark)))
                        found.setdefault(k, []).append((-s, start, end + SHINGLE - 1, far))
        out = []
        for k, spans in found.items():
            kept: list = []
            for s, a, b, far in sorted(spans):
                if all(b <= x or a >= y for x, y in kept):
                    kept.append((a, b))
                    out.append((self.ids[k], a, b, -s, far))
        return out


def parts(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list]:
    """The benchmark's items in parts of bounded size."""
    items = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where(
        F.col("t").isNotNull())
    words = items.agg(F.sum(F.size(F.split("t", r"\s+"))).alias("n")).collect()[0]["n"] or 0
    n = max(1, -(-int(words) // PART_WORDS))
    part = F.pmod(F.xxhash64("i", "t"), F.lit(n))
    for k in range(n):
        yield [tuple(r) for r in items.where(part == k).collect()]


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per passage of a document that matches a benchmark item."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def scan(items: list):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, words = Index(shared.value), WordHash()
            for b in batches:
                rows = []
                for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                    rows += [(doc, *m) for m in index.matches(shingles(words.of(text.as_py())))]
                cols = list(zip(*rows)) or [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.float64(), pa.int32()])],
                    names=[f.split()[0] for f in MATCH.split(", ")])

        return src.mapInArrow(of, MATCH)

    out = None
    for items in parts(benchmark):
        found = scan(items)
        out = found if out is None else out.union(found)
    return out


def is_clean(docs: DataFrame, benchmark: DataFrame):
    """A function text column -> true where no benchmark item matches."""
    shared = [docs.sparkSession.sparkContext.broadcast(items) for items in parts(benchmark)]

    def clean(text: Column) -> Column:
        def of_part(items):
            @F.pandas_udf("boolean")
            def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
                index, words = Index(items.value), WordHash()
                for texts in batches:
                    yield pd.Series([not index.matches(shingles(words.of(t))) for t in texts], dtype=bool)
            return of(text)
        ok = F.lit(True)
        for items in shared:
            ok = ok & of_part(items)
        return ok

    return clean
