"""Token ids in binary shards, found by document key through minimal perfect hashing.

*Shards.*  Every text's ids, closed by an end id, lie in ascending order of document id in
shard files: a header, the raw little-endian ids (16 bits each if the vocabulary allows), a footer with
their number and checksum.  Rows are dealt by ranges of (id, hash of the text), so equal
ids, however many, spread over shards; a task encodes its range and writes it as a stream.

*Index.*  A document's key is its id and its number among the rows of that id.  Keys are
dealt by hash to index parts of about ``PART_KEYS``; a part's minimal perfect hash maps each of
its n keys to its own slot of n.  Level by level the keys that fall alone on a bit of a bit
array take it, the others go on to the next, smaller array; a key's slot is the number of bits
before its own.  Keys left after ``LEVELS`` arrays (equal 64-bit hashes) are listed
themselves.  A slot stores a 32-bit fingerprint of its key, the shard, the offset and the
length: an access reads one bit array position or few, one slot and the ids.

Files get a fresh name in each attempt of a task, and only those that finished tasks name are
read, so a lost executor costs its tasks.  Files are written through the filesystem that the
folder's URI names (a shared folder or object store).

Defined cases: a null or empty text has the end id only; rows without an id come first, with the
null as their key; repeated rows are numbered and each kept; an absent key is found with the
chance of an equal fingerprint, 2^-32; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from laborlens.llm.byte_bpe import ByteIds, tokenizer_path
from laborlens.llm.common import worker_cache
from laborlens.session import scratch_path

TOKENIZER = "byte_bpe_50k.json"
END = 2
SHARD_BYTES = 128 << 20      # text of a shard
LEAST_SHARD = 4 << 20        # as many shards as shuffle partitions, if each has this much text
PART_KEYS = 50_000
LEVELS = 24
SPACE = 2.0                  # bits a key in each level
READ_BYTES = 4 << 20
RANGE_IDS = 1 << 20          # ids of a shard that one task reads in a row

SHARD_MAGIC, INDEX_MAGIC = b"LLIDSHD1", b"LLIDMPH1"
HEADER = "<8sII"                  # magic, bytes an id, unused
FOOTER = "<QQI8s"                 # ids, documents, checksum, magic
INDEX_HEADER = "<8sQII"           # magic, keys, levels, keys listed themselves
HEADER_BYTES = struct.calcsize(HEADER)
SLOT = np.dtype([("print", "<u4"), ("shard", "<u4"), ("at", "<u8"), ("n", "<u8")])
LISTED = np.dtype([("null", "u1"), ("doc_id", "<i8"), ("nth", "<i8")])

ENTRY = "shard int, file string, doc_id long, nth long, at long, n long"
FOUND = "doc_id long, nth long, shard int, at long, n long"
READ = "doc_id long, nth long, start long, n_tokens long, ids_crc32 long"


def folder(uri: str) -> tuple:
    """(filesystem, path) of a folder in shared storage."""
    from pyarrow import fs
    if ":" not in uri.split("/")[0]:
        uri = f"file://{uri}"
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))


# ---------------------------------------------------------------------------
# minimal perfect hashing
# ---------------------------------------------------------------------------

def mixed(h: np.ndarray, level: int) -> np.ndarray:
    """Another 64-bit hash of ``h`` for each level."""
    x = h.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Bit arrays one after another, and the number of bits before each word."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, before: np.ndarray):
        self.sizes, self.words, self.before = sizes, words, before
        self.firsts = np.cumsum(sizes) - sizes

    @classmethod
    def of(cls, h: np.ndarray) -> tuple:
        """(hash, places of the keys that no level holds alone)."""
        left, sizes, arrays = np.arange(len(h)), [], []
        for level in range(LEVELS):
            if not len(left):
                break
            size = -(-int(SPACE * len(left)) // 64) * 64
            at = (mixed(h[left], level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            arrays.append(alone)
            left = left[~alone[at]]
        bits = np.concatenate(arrays) if arrays else np.zeros(0, bool)
        words = np.packbits(bits, bitorder="little").view("<u8")
        before = np.cumsum(np.bitwise_count(words), dtype=np.int64) - np.bitwise_count(words)
        return cls(np.asarray(sizes, "<i8"), words, before.astype("<u4")), left

    def slots(self, h: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where no level holds it."""
        out, left = np.full(len(h), -1, np.int64), np.arange(len(h))
        for level, (first, size) in enumerate(zip(self.firsts, self.sizes)):
            at = (mixed(h[left], level) % np.uint64(size)).astype(np.int64) + first
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            held = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word[held] & ((np.uint64(1) << bit[held]) - np.uint64(1)))
            out[left[held]] = self.before[at[held] >> 6].astype(np.int64) + below
            left = left[~held]
        return out


class IndexPart:
    """One part of the index: perfect hash, listed keys, slots."""

    def __init__(self, hashed: PerfectHash, listed: np.ndarray, slots: np.ndarray):
        self.hashed, self.listed, self.slots = hashed, listed, slots
        first = len(slots) - len(listed)
        self.own = {tuple(k): first + i for i, k in enumerate(listed.tolist())}

    @classmethod
    def of(cls, h: np.ndarray, keys: np.ndarray, slots: np.ndarray) -> IndexPart:
        """From the keys' 64-bit hashes, the keys and their slots' contents."""
        hashed, rest = PerfectHash.of(h)
        at = hashed.slots(h)
        at[rest] = len(h) - len(rest) + np.arange(len(rest))
        table = np.zeros(len(h), SLOT)
        table[at] = slots
        return cls(hashed, keys[rest], table)

    def find(self, h: np.ndarray, prints: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The slot number of each key, -1 if it is absent."""
        at = self.hashed.slots(h)
        if self.own:
            at = np.asarray([self.own.get(tuple(k), s) for k, s in zip(keys.tolist(), at.tolist())], np.int64)
        if not len(self.slots):
            return at
        return np.where((at >= 0) & (self.slots["print"][at] == prints), at, -1)

    def to_bytes(self) -> bytes:
        p = self.hashed
        return b"".join([struct.pack(INDEX_HEADER, INDEX_MAGIC, len(self.slots), len(p.sizes), len(self.listed)),
                         p.sizes.tobytes(), p.words.tobytes(), p.before.tobytes(), self.listed.tobytes(),
                         self.slots.tobytes()])

    @classmethod
    def from_bytes(cls, raw: bytes) -> IndexPart:
        magic, n, levels, listed = struct.unpack_from(INDEX_HEADER, raw)
        if magic != INDEX_MAGIC:
            raise ValueError("not an index part")
        at = struct.calcsize(INDEX_HEADER)

        def take(kind, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, count, at)
            at += out.nbytes
            return out

        sizes = take("<i8", levels)
        words = int(sizes.sum()) // 64
        hashed = PerfectHash(sizes, take("<u8", words), take("<u4", words))
        return cls(hashed, take(LISTED, listed), take(SLOT, n))


def _hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id").isNull(), "doc_id", "nth")


def _hashed(keys: DataFrame, parts: int) -> DataFrame:
    """Keys with their part, 64-bit hash and fingerprint."""
    return keys.withColumns({"part": F.pmod(_hash(3), F.lit(parts)).cast("int"), "h": _hash(1),
                             "print": _hash(2).bitwiseAND(F.lit(0xFFFFFFFF))})


def _runs(values: np.ndarray) -> Iterator[tuple]:
    """(first, past the last) of runs of equal values."""
    cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
    edges = [0, *cuts.tolist(), len(values)]
    return zip(edges[:-1], edges[1:]) if len(values) else iter(())


def _key_array(batch: pa.RecordBatch) -> np.ndarray:
    ids = batch.column("doc_id")
    out = np.zeros(batch.num_rows, LISTED)
    out["null"] = ids.is_null().to_numpy(zero_copy_only=False)
    out["doc_id"] = ids.fill_null(0).to_numpy(zero_copy_only=False)
    out["nth"] = batch.column("nth").to_numpy(zero_copy_only=False)
    return out


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


# ---------------------------------------------------------------------------
# the store
# ---------------------------------------------------------------------------

@dataclass
class Store:
    """Folders of a written store: ``ids`` (shards), ``index`` (parts), and three small tables."""
    path: str
    parts: int

    def shards(self, spark: SparkSession) -> DataFrame:
        """(shard, file, start, carry, n_docs, n_ids): start: ids of all shards before; carry: rows of
        its first document's id in the shards before."""
        return spark.read.parquet(f"{self.path}/shards")

    def index(self, spark: SparkSession) -> DataFrame:
        """(part, file)"""
        return spark.read.parquet(f"{self.path}/parts")

    def keys(self, spark: SparkSession) -> DataFrame:
        """(doc_id, nth) of every document."""
        return self.entries(spark).select("doc_id", "nth")

    def entries(self, spark: SparkSession) -> DataFrame:
        """Keys and places, as the index holds them."""
        first = (F.col("doc_id").eqNullSafe(F.col("first_id"))).cast("long") * F.col("carry")
        own = self.shards(spark).select("shard", "first_id", "carry")
        return (spark.read.parquet(f"{self.path}/entries").join(own, "shard")
                .select("doc_id", (F.col("nth") + first).alias("nth"), "shard", "at", "n"))


def write_shards(rows: DataFrame, path: str, tokenizer: str, end: int, width: int) -> DataFrame:
    """Encodes rows (doc_id, text), dealt and sorted by id, into shard files; a row for each document."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        from pyspark import TaskContext
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc = worker_cache("byte_" + re.sub(r"\W", "_", tokenizer), lambda: ByteIds(tokenizer_path(tokenizer)), large=True)
        tail = end.to_bytes(width, "little")
        shard, file = TaskContext.get().partitionId(), f"shard-{uuid.uuid4().hex}.bin"
        out, crc, at, docs, last, nth = None, 0, 0, 0, (), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                fs, root = folder(f"{path}/ids")
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{root}/{file}")
                out.write(struct.pack(HEADER, SHARD_MAGIC, width, 0))
            entries = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1))):
                raw = np.frombuffer(ids, "<u4").astype(f"<u{width}").tobytes() + tail
                out.write(raw)
                crc = zlib.crc32(raw, crc)
                nth = nth + 1 if last == (doc_id,) else 0
                last = (doc_id,)
                entries.append((shard, file, doc_id, nth, at, len(raw) // width))
                at += len(raw) // width
            docs += len(entries)
            types = [pa.int32(), pa.string(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*entries), types)],
                                             names=[f.split()[0] for f in ENTRY.split(", ")])
        if out is not None:
            out.write(struct.pack(FOOTER, at, docs, crc, SHARD_MAGIC))
            out.close()

    return rows.select("doc_id", "text").mapInArrow(write, ENTRY)


def _shard_table(entries: DataFrame) -> DataFrame:
    """One row a shard; the windows run over these rows only."""
    order = F.struct("at")
    own = entries.groupBy("shard").agg(
        F.max("file").alias("file"), F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_ids"),
        F.min_by(F.struct("doc_id"), order).alias("_first"), F.max_by(F.struct("doc_id", "nth"), order).alias("_last"))
    by_shard = Window.orderBy("shard")
    before = by_shard.rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("_last.doc_id").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("_rows", F.sum(F.col("_last.nth") + 1).over(same))
    own = own.withColumns({"start": F.coalesce(F.sum("n_ids").over(before), F.lit(0)),
                           "_prior": F.lag(F.struct(F.col("_last.doc_id").alias("id"), F.col("_rows").alias("rows")))
                           .over(by_shard)})
    goes_on = F.col("_prior").isNotNull() & F.col("_prior.id").eqNullSafe(F.col("_first.doc_id"))
    return own.select("shard", "file", "start", F.col("_first.doc_id").alias("first_id"), "n_docs", "n_ids",
                      F.when(goes_on, F.col("_prior.rows")).otherwise(0).alias("carry"))


def write_index(entries: DataFrame, path: str, parts: int) -> DataFrame:
    """Index files; a row for each part."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = None
        for part, rows in _by_part(batches):
            if fs is None:
                fs, root = folder(f"{path}/index")
                fs.create_dir(root, recursive=True)
            slots = np.zeros(rows.num_rows, SLOT)
            for name in SLOT.names:
                slots[name] = _numbers(rows, name)
            held = IndexPart.of(_numbers(rows, "h").view(np.uint64), _key_array(rows), slots)
            file = f"part-{uuid.uuid4().hex}.mph"
            with fs.open_output_stream(f"{root}/{file}") as out:
                out.write(held.to_bytes())
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [file]})

    dealt = _hashed(entries, parts).repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(build, "part int, file string")


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(part, all its rows) from batches ordered by part."""
    part, held = None, []
    for batch in batches:
        for a, b in _runs(_numbers(batch, "part")):
            own = batch.column("part")[a].as_py()
            if own != part and held:
                yield part, pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            part = own
            held.append(batch.slice(a, b - a))
    if held:
        yield part, pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def write(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end: int = END, width: int = 2,
          id_col: str = "doc_id", text_col: str = "text") -> Store:
    """Writes shards and index of all documents under ``path``.  ``width``: bytes an id (2 for
    vocabularies up to 65 536 ids, else 4)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       F.xxhash64(text_col).alias("tie"))
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, -(-size // SHARD_BYTES), min(wide, -(-size // LEAST_SHARD)))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    dealt = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    write_shards(dealt, path, tokenizer, end, width).write.parquet(f"{path}/entries")
    _shard_table(spark.read.parquet(f"{path}/entries")).write.parquet(f"{path}/shards")
    store = Store(path, max(1, -(-n // PART_KEYS)))
    write_index(store.entries(spark), path, store.parts).write.parquet(f"{path}/parts")
    return store


def find(store: Store, keys: DataFrame) -> DataFrame:
    """Places of the keys (doc_id, nth) that the index holds."""
    spark = keys.sparkSession
    names = [f.split()[0] for f in FOUND.split(", ")]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, file, held = None, None, None
        for batch in batches:
            for a, b in _runs(_numbers(batch, "part")):
                rows = batch.slice(a, b - a)
                if rows.column("file")[0].as_py() != file:
                    file = rows.column("file")[0].as_py()
                    if fs is None:
                        fs, root = folder(f"{store.path}/index")
                    with fs.open_input_file(f"{root}/{file}") as raw:
                        held = IndexPart.from_bytes(raw.read())
                at = held.find(_numbers(rows, "h").view(np.uint64), _numbers(rows, "print").astype(np.uint32),
                               _key_array(rows))
                there = np.flatnonzero(at >= 0)
                found, rows = held.slots[at[there]], rows.take(pa.array(there))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("nth"), pa.array(found["shard"].astype(np.int32)),
                     pa.array(found["at"].astype(np.int64)), pa.array(found["n"].astype(np.int64))], names=names)

    keys = keys.select(F.col("doc_id").cast("long"), F.col("nth").cast("long"))
    dealt = _hashed(keys, store.parts).join(store.index(spark), "part")
    return dealt.repartition("part").sortWithinPartitions("part").mapInArrow(look_up, FOUND)


class ShardReader:
    """Ids of a shard file by place."""

    def __init__(self, path: str, file: str):
        fs, root = folder(f"{path}/ids")
        self.file = fs.open_input_file(f"{root}/{file}")
        magic, self.width, _ = struct.unpack(HEADER, self.file.read(HEADER_BYTES))
        if magic != SHARD_MAGIC:
            raise ValueError("not a shard")

    def ids(self, at: int, n: int) -> np.ndarray:
        self.file.seek(HEADER_BYTES + at * self.width)
        return np.frombuffer(self.file.read(n * self.width), f"<u{self.width}").astype("<u4")


def read(store: Store, found: DataFrame) -> DataFrame:
    """Start, length and checksum of the found documents' ids, from the shards."""
    spark = found.sparkSession
    names = [f.split()[0] for f in READ.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, shard = None, None
        for batch in batches:
            ats, ns = _numbers(batch, "at").tolist(), _numbers(batch, "n").tolist()
            crcs, held, first = [], np.zeros(0, "<u4"), 0
            for own, at, n, far in zip(batch.column("file").to_pylist(), ats, ns, _ahead(ats, ns)):
                if own != file:
                    file, shard, held = own, ShardReader(store.path, own), held[:0]
                if n > READ_BYTES // 4:                  # a very long document, piece by piece
                    crc = 0
                    for p in range(at, at + n, READ_BYTES // 4):
                        crc = zlib.crc32(shard.ids(p, min(READ_BYTES // 4, at + n - p)).tobytes(), crc)
                    crcs.append(crc)
                    continue
                if not first <= at <= at + n <= first + len(held):
                    first, held = at, shard.ids(at, far)
                crcs.append(zlib.crc32(held[at - first:at - first + n].tobytes()))
            start = _numbers(batch, "start") + np.asarray(ats, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("nth"), pa.array(start, pa.int64()), batch.column("n"),
                 pa.array(crcs, pa.int64())], names=names)

    rows = found.join(store.shards(spark).select("shard", "file", "start"), "shard")
    dealt = rows.repartition("shard", F.floor(F.col("at") / RANGE_IDS)).sortWithinPartitions("shard", "at")
    return dealt.select("doc_id", "nth", "at", "n", "file", "start").mapInArrow(work, READ)


def _ahead(ats: list, ns: list) -> list:
    """How many ids to read from each document on: those of the documents right behind it too."""
    out, end, limit = [0] * len(ats), -1, 0
    for k in range(len(ats) - 1, -1, -1):
        at, n = ats[k], ns[k]
        if k + 1 == len(ats) or at + n != ats[k + 1] or limit - at > READ_BYTES // 4:
            limit = at + n
        out[k] = limit - at
    return out


def ids_of(store: Store, spark: SparkSession, doc_id, nth: int = 0) -> np.ndarray | None:
    """One document's ids by its key, None if the store has no such key."""
    key = spark.createDataFrame([(doc_id, nth)], "doc_id long, nth long")
    row = find(store, key).join(store.shards(spark).select("shard", "file"), "shard").first()
    return None if row is None else ShardReader(store.path, row["file"]).ids(row["at"], row["n"])


def round_trip(docs: DataFrame, tokenizer: str = TOKENIZER, end: int = END, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Writes all documents, then reads every one back by its key."""
    spark = docs.sparkSession
    store = write(docs, scratch_path(spark, "token_store"), tokenizer, end, 2, id_col, text_col)
    return read(store, find(store, store.keys(spark)))
