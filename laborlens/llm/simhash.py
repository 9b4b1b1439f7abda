"""SimHash near-duplicates found with pivot distance tables.

Fingerprint: 64 bits; bit i is set if more than half of the XXH64 hashes
(seed 42) of a text's word shingles have it.  Two fingerprints link at
``max_bits`` differing bits or fewer; classes are connected components.

Method: a table of Hamming distances from each fingerprint to many reference
fingerprints (pivots).  By the triangle inequality two fingerprints within r
bits have distances to any pivot that differ by r at most, so a pair whose
largest coordinate difference exceeds r is discarded unseen; survivors are
verified bit by bit.

The table is used twice:

* *Blocked pivots.*  The bits are cut into ``blocks`` groups.  The pivots of a
  group are zero outside it, so relative to the zero pivot their coordinates
  depend on that group alone.  A pair within r bits has equal coordinates in
  at least ``blocks - r`` groups; each choice of so many groups gives an
  equi-join key (with unit pivots the coordinates spell the group's bits), so
  candidate generation is a shuffle on keys and loses no pair.
* *Spread pivots* inside a key: the distances to them are computed once per
  fingerprint and travel with it.  The fingerprints of a key are ordered by the
  distance to the first; windows of difference <= r give pairs, the largest
  coordinate difference discards, and only what it leaves is verified by the XOR.

Equal fingerprints are collapsed first, so a group of copies costs one row.  A
key with more than ``CHUNK`` distinct fingerprints is cut into ranges of its
first coordinate and a hash; ranges meet two at a time in groups of their own, of
about 2 * CHUNK rows each, and a task handles one group after another.  A task returns links
to one member of each local class, never all pairs.

Defined cases: a null or empty text has no shingle and fingerprint zero, linked
like any other; fewer words than a shingle: the whole sequence; rows with a null
id are left out of the class ids (component null) but get a fingerprint; rows
with an equal id each return a row; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from laborlens.llm.common import materialise
from laborlens.llm.components import components

SHINGLE = 3
MAX_BITS = 3
BLOCKS = 5
SEED = 42
CHUNK = 2048
#: Spread pivots: seeded random reference fingerprints.
PIVOTS = np.random.default_rng(2024).integers(0, 1 << 63, 16, dtype=np.int64).view(np.uint64) * 2 + 1
BATCH_HASHES = 1 << 16       # hashes whose bits are counted at once


def _majority(hashes: np.ndarray) -> int:
    """Bits set in more than half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BATCH_HASHES):
        part = hashes[at:at + BATCH_HASHES]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)), bitorder="little").view("<u8")[0])


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """Fingerprint of one text (A-Z lower-cased, words apart at ASCII white space)."""
    from xxhash import xxh64_intdigest
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(flat, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    n = len(words) - shingle + 1
    hashes = np.fromiter(
        [xxh64_intdigest(flat[a:b], SEED)
         for a, b in zip(starts[:n].tolist(), ends[shingle - 1:].tolist())], np.uint64, n)
    return _majority(hashes)


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint of a text column as a signed long."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            prints = np.fromiter((fingerprint_of(t, shingle) for t in texts), np.uint64, len(texts))
            yield pd.Series(prints.view(np.int64))

    return of(text)


def block_masks(blocks: int = BLOCKS) -> list:
    """Bit masks of the groups, as even as 64 bits allow."""
    cuts = [round(i * 64 / blocks) for i in range(blocks + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def pivot_table(fp: Column) -> list:
    """Distances to all pivots, eight a long, as columns ``pv0``, ``pv1``, ..."""
    def of(k: int) -> Column:
        far = F.lit(0).cast("long")
        for i, p in enumerate(PIVOTS[8 * k:8 * k + 8]):
            far = far.bitwiseOR(F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(_signed(int(p))))).cast("long"), 8 * i))
        return far
    return [of(k).alias(f"pv{k}") for k in range(len(PIVOTS) // 8)]


TABLE = [f"pv{k}" for k in range(len(PIVOTS) // 8)]


def distances(columns: list) -> np.ndarray:
    """The table's rows from its columns' values: a distance for each fingerprint and pivot."""
    packed = np.stack([np.asarray(c, "<i8") for c in columns], axis=1)
    return packed.view(np.uint8).reshape(len(packed), -1).astype(np.int16)


def may_be_close(x: np.ndarray, y: np.ndarray, max_bits: int) -> np.ndarray:
    """Pairs of table rows whose largest coordinate difference does not exceed ``max_bits``."""
    return np.abs(x - y).max(axis=1, initial=0) <= max_bits


def blocked_keys(prints: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS) -> DataFrame:
    """One row per fingerprint and choice of groups: (fp, its row of the pivot table, choice, key).

    The key packs, for every group chosen, the coordinates to the group's unit
    pivots relative to the zero pivot: d(x, e_j) - d(x, 0) = 1 - 2 * bit j.
    """
    masks = block_masks(blocks)
    picks = [sum(masks[i] for i in c) for c in combinations(range(blocks), max(1, blocks - max_bits))]
    choices = F.array(*[F.struct(F.lit(i).cast("int").alias("choice"),
                                 F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
                        for i, m in enumerate(picks)])
    return prints.select("fp", *pivot_table(F.col("fp"))).select("fp", *TABLE, F.inline(choices))


def close_pairs(fps: np.ndarray, table: np.ndarray, max_bits: int = MAX_BITS) -> Iterator[tuple]:
    """Index pairs (i, j) within ``max_bits``, in batches, by the fingerprints' rows of the pivot table."""
    order = np.argsort(table[:, 0], kind="stable")
    first = table[order, 0]
    ends = np.searchsorted(first, first + max_bits, side="right")
    step = max(1, (1 << 20) // max(1, len(fps)))
    for at in range(0, len(fps), step):
        rows = np.arange(at, min(at + step, len(fps)))
        width = ends[rows] - rows - 1
        if not width.any():
            continue
        left = np.repeat(rows, width)
        right = np.arange(len(left)) - np.repeat(np.cumsum(width) - width, width) + left + 1
        i, j = order[left], order[right]
        for p in range(1, table.shape[1]):              # the largest coordinate difference
            ok = np.abs(table[i, p] - table[j, p]) <= max_bits
            if not ok.all():
                i, j = i[ok], j[ok]
        ok = np.bitwise_count(fps[i] ^ fps[j]) <= max_bits
        if ok.any():
            yield i[ok], j[ok]


def _local_roots(n: int, pairs: Iterator[tuple]) -> np.ndarray:
    """Smallest index reachable by the pairs, for each of n indices."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            if (a == b).all():
                break
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(root, high, low)
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def _links(fps: np.ndarray, table: np.ndarray, max_bits: int) -> tuple:
    fps, first = np.unique(fps, return_index=True)
    root = _local_roots(len(fps), close_pairs(fps.view(np.uint64), table[first], max_bits))
    own = root != np.arange(len(fps))
    return fps[root[own]], fps[own]


def links(prints: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS) -> DataFrame:
    """Links (a, b) that connect exactly the fingerprints (column fp, distinct)
    connected by pairs within ``max_bits``."""
    if blocks <= max_bits:
        raise ValueError("more blocks than differing bits are needed")
    keyed = materialise(blocked_keys(prints, max_bits, blocks), "keys")
    counts = (keyed.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    shared = keyed.join(counts, ["choice", "key"])
    shared = shared.withColumn("d", F.col("pv0").bitwiseAND(F.lit(255)).cast("int"))      # to the first pivot

    small = shared.where(F.col("n") <= CHUNK)
    group = small.select("fp", *TABLE, F.xxhash64("choice", "key").alias("g"))

    # Large keys: cells are (first coordinate, hash part); a pair's coordinates
    # differ by max_bits at most, so a cell meets its own and the next few.
    large = shared.where(F.col("n") > CHUNK)
    cells = large.groupBy("choice", "key", "d").agg(F.count(F.lit(1)).alias("cell_n")) \
        .withColumn("parts", F.ceil(F.col("cell_n") / F.lit(CHUNK)).cast("int"))
    mine = (large.join(cells, ["choice", "key", "d"])
            .withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")))
    others = cells.select("choice", "key", F.col("d").alias("d2"), F.col("parts").alias("parts2"))
    cell_pairs = (cells.select("choice", "key", "d", "parts").join(others, ["choice", "key"])
                  .where(F.abs(F.col("d") - F.col("d2")) <= max_bits)      # <= 65 cells a key
                  .withColumn("part2", F.explode(F.sequence(F.lit(0), F.col("parts2") - 1))))
    met = (mine.drop("parts").join(cell_pairs.drop("parts", "parts2"), ["choice", "key", "d"])
           .select("fp", *TABLE, F.xxhash64(
               "choice", "key",
               F.least(F.struct("d", "part"), F.struct(F.col("d2").alias("d"), F.col("part2").alias("part"))),
               F.greatest(F.struct("d", "part"), F.struct(F.col("d2").alias("d"), F.col("part2").alias("part"))),
               F.lit(1)).alias("g")))

    def found_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Groups lie together in a sorted partition; one that spans batches is carried on."""
        keep = None
        for pdf in batches:
            if keep is not None and len(keep):
                pdf = pd.concat([keep, pdf], ignore_index=True)
            if not len(pdf):
                continue
            g = pdf["g"].to_numpy()
            last = int(np.searchsorted(g, g[-1], side="left"))
            keep, done = pdf.iloc[last:], pdf.iloc[:last]
            if len(done):
                yield pairs_of_groups(done)
        if keep is not None and len(keep):
            yield pairs_of_groups(keep)

    def pairs_of_groups(pdf: pd.DataFrame) -> pd.DataFrame:
        g, fp = pdf["g"].to_numpy(), pdf["fp"].to_numpy()
        cut = np.flatnonzero(np.r_[True, g[1:] != g[:-1], True])
        size = np.diff(cut)
        table = distances([pdf[c] for c in TABLE])
        two = cut[:-1][size == 2]                       # most groups: one pair each
        two = two[may_be_close(table[two], table[two + 1], max_bits)]
        x, y = fp[two], fp[two + 1]
        ok = np.bitwise_count((x ^ y).view(np.uint64)) <= max_bits
        out_a, out_b = [np.minimum(x[ok], y[ok])], [np.maximum(x[ok], y[ok])]
        for s, n in zip(cut[:-1][size > 2].tolist(), size[size > 2].tolist()):
            a, b = _links(fp[s:s + n], table[s:s + n], max_bits)
            out_a.append(a)
            out_b.append(b)
        return pd.DataFrame({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})

    # A group never spans tasks: rows are dealt by g and sorted within a task.
    met_all = group.union(met).repartition("g").sortWithinPartitions("g")
    return met_all.mapInPandas(found_sorted, "a long, b long").distinct()


def classes(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS,
            blocks: int = BLOCKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, root, component_id) of every row; ``root`` tells classes apart, also those with
    one smallest id (an id may be repeated with other texts)."""
    prints = materialise(docs.select(F.col(id_col).cast("long").alias("doc_id"),
                                     fingerprint(F.col(text_col), shingle).alias("fp")), "prints")
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = components(links(distinct.select("fp"), max_bits, blocks))
    known = (distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
             .select("fp", "first_id", F.coalesce("root", "fp").alias("root")))
    smallest = known.groupBy("root").agg(F.min("first_id").alias("component_id"))
    # Only classes of several fingerprints need the look-up of their smallest id.
    of_print = materialise(known.join(smallest, "root").select("fp", "root", "component_id"), "classes")
    return prints.join(of_print, "fp").select(
        "doc_id", "fp", "root", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS,
                    blocks: int = BLOCKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    return classes(docs, shingle, max_bits, blocks, id_col, text_col).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
