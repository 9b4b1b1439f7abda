"""Best-fit packing of tokenised documents into fixed-size sequences.

Method: large-item matching.  Pieces above a third of the capacity fit at most
twice into a sequence, so they are matched greedily, largest first, each with
the longest partner that still fits; smaller pieces then go, longest first,
into the tightest remaining gap.  Pieces of one length are interchangeable:
the plan needs only how many pieces there are of each length (at most
``capacity`` counts, whatever the corpus), and each piece finds its place from
its rank among the pieces of its length.  Ranks come from counts per
(length, hash bucket), so no length, however common, meets in one task.

Defined cases: a null or empty text has only the separator id (one piece of
length 1); a repeated row is packed as often as it occurs; an empty table
gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from laborlens.llm.common import materialise, worker_cache

CAPACITY = 2048
SEPARATOR = 0
TOKENIZER = "word_bpe_49k.json"
CACHE_WORDS = 300_000        # chunks per generation of a worker's id cache
SLICE_BYTES = 4 << 20        # text tokenised at once
BUCKETS = 1024               # rank buckets per length

PIECES = "doc_id long, copy long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"


class WordIds:
    """Token ids of white-space separated chunks, each encoded once.

    The tokenizer drops white space before its merges, so the ids of a text
    are the concatenated ids of its chunks.  Chunks are split at ASCII white
    space only; other white space stays inside a chunk for the tokenizer.

    A chunk of Latin letters with ASCII signs after them (most are) falls into
    the letters and the signs, as the tokenizer's own split does; both go to
    its merge model directly.  Any other chunk goes through the whole tokenizer.
    Two generations of chunks bound the memory: the older is dropped when full.
    """

    #: Letters whose lower case is one character and which no normal form changes.
    PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿŒœ]+)([!-/:-@\\[-`{-~]*)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model.tokenize
        self.bytes_as_text = _byte_alphabet()
        self.young: dict = {}
        self.old: dict = {}
        self.parts: dict = {"": b""}

    def part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            shown = part.encode("utf-8").decode("latin-1").translate(self.bytes_as_text)
            ids = array("I", [t.id for t in self.merges(shown)]).tobytes()
            self.parts[part] = ids
        return ids

    def learn(self, chunks: list) -> None:
        if len(self.parts) > CACHE_WORDS // 2:
            self.parts = {"": b""}
        whole = []
        for w in chunks:
            ids = self.old.get(w)
            if ids is None:
                plain = self.PLAIN.fullmatch(w)
                if plain is None:
                    whole.append(w)
                    continue
                ids = self.part(plain[1].lower()) + self.part(plain[2])
            self.young[w] = ids
        if whole:
            found = self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)
            for w, e in zip(whole, found):
                self.young[w] = array("I", e.ids).tobytes()

    def encode(self, texts: pa.Array) -> tuple:
        """(ids of all texts in a row, where each text ends).

        Chunks are cut and numbered by Arrow; each different chunk is looked up once, and
        the ids are laid out by number.  A-Z are lower-cased first (the tokenizer does so for
        all letters) unless a text may hold a special token, which keeps its case.
        """
        texts = pc.fill_null(texts.cast(pa.string()), "")
        lower = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        rows = pc.ascii_split_whitespace(lower)
        chunks = rows.flatten().dictionary_encode()
        if len(self.young) > CACHE_WORDS:
            self.old, self.young = self.young, {}
        words = chunks.dictionary.to_pylist()
        self.learn([w for w in words if w not in self.young])
        ids = list(map(self.young.__getitem__, words))
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        pool = np.frombuffer(b"".join(ids), "<u4")
        number = chunks.indices.to_numpy()
        many = size[number]
        ends = np.cumsum(many)
        place = np.repeat((np.cumsum(size) - size)[number] - (ends - many), many)
        place += np.arange(len(place))
        cuts = np.concatenate([[0], ends])[rows.offsets.to_numpy()[1:] - rows.offsets[0].as_py()]
        return pool[place], cuts


def _slices(texts: pa.Array) -> Iterator[tuple]:
    """(first row, number of rows) of runs of about ``SLICE_BYTES`` of text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(size):
        done = size[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(size, done + SLICE_BYTES, side="right")))
        yield first, end - first
        first = end


def _byte_alphabet() -> dict:
    """The printable character that stands for each byte in byte-level vocabularies:
    printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: b for b in own} | {b: 256 + k for k, b in enumerate(rest)}


def _tokenizer_path(name: str) -> str:
    if "/" in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


def tokenise(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` ids of every document (ids, then the separator)."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        from pyspark import TaskContext
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc = worker_cache("ids_" + tokenizer.replace("/", "_").replace(".", "_"),
                           lambda: WordIds(_tokenizer_path(tokenizer)), large=True)
        tail = np.asarray([SEPARATOR], "<u4").tobytes()
        step = 4 * capacity
        serial = TaskContext.get().partitionId() << 33
        for batch in batches:
            cols = ([], [], [], [], [], [])
            for at, rows in _slices(batch.column(1)):
                part = batch.slice(at, rows)
                ids, ends = enc.encode(part.column(1))
                raw, begin = ids.tobytes(), 0
                for doc, end in zip(part.column(0).to_pylist(), ends.tolist()):
                    own, begin = raw[4 * begin:4 * end] + tail, end
                    for k, s in enumerate(range(0, len(own), step)):
                        cut = own[s:s + step]
                        for c, v in zip(cols, (doc, serial, k, s // 4, len(cut) // 4, zlib.crc32(cut))):
                            c.append(v)
                    serial += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32() if i == 2 else pa.int64()) for i, c in enumerate(cols)],
                names=["doc_id", "copy", "piece", "start", "length", "ids_crc32"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(pieces, PIECES)


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Packing plan from the number of pieces of each length.

    ``counts[n]`` pieces have length n.  Returns entries (length, first_rank,
    per_bin, bins, first_bin, offset): the pieces of ``length`` with ranks from
    ``first_rank`` on fill ``bins`` sequences from ``first_bin`` with
    ``per_bin`` pieces each, from ``offset``.  Sequences that look alike are
    handled as one run, so the plan's size follows the capacity, not the corpus.
    """
    left = counts.astype(np.int64).copy()
    used = np.zeros(capacity + 1, np.int64)          # ranks given out per length
    entries: list = []
    gaps: dict[int, list] = {}                       # gap -> runs (first_bin, bins)
    bins = 0

    def put(length: int, per: int, first: int, n: int, offset: int) -> None:
        entries.append((length, int(used[length]), per, n, first, offset))
        used[length] += per * n
        left[length] -= per * n
        rest = capacity - offset - per * length
        if rest:
            gaps.setdefault(rest, []).append((first, n))

    third = capacity // 3
    for big in range(capacity, third, -1):           # matching, largest first
        while left[big]:
            mate = min(big, capacity - big)
            while mate > third and not (left[mate] > (mate == big)):
                mate -= 1
            if mate <= third:
                n = int(left[big])
                put(big, 1, bins, n, 0)
            elif mate == big:
                n = int(left[big]) // 2
                put(big, 2, bins, n, 0)
            else:
                n = int(min(left[big], left[mate]))
                entries.append((big, int(used[big]), 1, n, bins, 0))
                used[big] += n
                left[big] -= n
                put(mate, 1, bins, n, big)
            bins += n
    for small in range(min(third, capacity), 0, -1):  # tightest gap first
        while left[small]:
            gap = min((g for g in gaps if g >= small), default=None)
            if gap is None:
                per = capacity // small
                n, one = divmod(int(left[small]), per)
                if n:
                    put(small, per, bins, n, 0)
                    bins += n
                if one:
                    put(small, one, bins, 1, 0)
                    bins += 1
                continue
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
            per = min(gap // small, int(left[small]))
            full = min(n, int(left[small]) // per)
            put(small, per, first, full, capacity - gap)
            if full < n:
                gaps.setdefault(gap, []).append((first + full, n - full))
    table = np.asarray(entries, np.int64).reshape(-1, 6)
    return table[np.lexsort((table[:, 1], table[:, 0]))]


def place(pieces: DataFrame, entries: np.ndarray, rank_col: str = "_rank") -> DataFrame:
    """Sequence and offset of each piece from its rank among its length."""
    shared = pieces.sparkSession.sparkContext.broadcast(entries)   # bounded by the capacity
    names = [f.split()[0] for f in PIECES.split(", ")]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = shared.value
        key = e[:, 0] << 40 | e[:, 1]
        for b in batches:
            length = b.column(names.index("length")).to_numpy(zero_copy_only=False)
            rank = b.column(len(names)).to_numpy(zero_copy_only=False)
            row = e[np.searchsorted(key, length << 40 | rank, side="right") - 1]
            k = rank - row[:, 1]
            per = np.maximum(row[:, 2], 1)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:len(names)], pa.array(row[:, 4] + k // per),
                 pa.array(row[:, 5] + k % per * length)], names=[*names, "sequence_id", "offset"])

    return pieces.select(*names, F.col(rank_col).cast("long")).mapInArrow(look_up, PLACED)


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece with its sequence and gapless offset (see the module text).

    ``copy`` numbers the input rows, so repeated rows stay apart.  The pieces are written once; counts and ranks read them back.
    """
    pieces = materialise(tokenise(docs, tokenizer, capacity, id_col, text_col), "pieces")
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "copy"), F.lit(BUCKETS)).cast("int")
    counts = (pieces.groupBy("length", bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n")))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)                 # at most BUCKETS rows a length
    first = counts.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    total = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("_n").alias("_n")).collect():  # <= capacity rows
        total[r[0]] = r[1]
    if not total.any():
        return pieces.select("*", F.lit(0).cast("long").alias("sequence_id"),
                             F.lit(0).cast("long").alias("offset")).limit(0)
    in_bucket = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "copy")
    ranked = (pieces.withColumn("_bucket", bucket)
              .withColumn("_in", F.row_number().over(in_bucket))
              .join(first.select("length", "_bucket", "_first"), ["length", "_bucket"])
              .withColumn("_rank", F.col("_first") + F.col("_in") - 1))
    return place(ranked, plan(total, capacity))
