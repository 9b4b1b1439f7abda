"""LM scoring: a hierarchical Pitman-Yor model of words in context and their spelling.

Tokens are the white-space separated words of a text (A-Z lower-cased) and one end token
(the empty word).  The model is a tree of Pitman-Yor restaurants:

* *Context restaurants.*  The context of a token is the word before it (at the start of a text, the
  end token).  Every training token is a customer of its context's restaurant.
* *Word restaurant.*  The parent that all contexts share.  A new table in a context is one
  customer here.
* *Spelling restaurants.*  A new table in the word restaurant is one spelled draw of the word:
  its bytes and a closing blank are customers of the restaurants of ``DEPTH`` earlier
  bytes, each sharing its parent with all contexts that differ only in the oldest byte.  The root's
  base is uniform over 256 bytes.

Seating is sampled by Gibbs sweeps.  Each dish of a restaurant (a word in a context, a byte after
a context) is seated anew, customer by customer of the Chinese restaurant process (beyond ``EXACT``
customers in doubling groups, whose new tables are Poisson), given the tables of all other dishes as
the sweep before left them; its own tables are taken out first.  All dishes are drawn side by side.  Random
numbers follow from the dish and the sweep, not from the layout.  After ``BURN_IN`` sweeps the predictive
probabilities of ``SAMPLES`` sweeps are averaged, each from the customers and tables of one seating, so that
they sum to one in every context; a text's score is the sum of their logarithms.

Data flow.  A task cuts its texts into blocks of about ``BLOCK_WORDS`` distinct words and writes each
document's cells (word, word before) by number, the block's words and its cells with their counts.  Words are
dealt by hash into word blocks of about ``WORDS`` words, which number them, hold their spelling as places in the
block's list of different spelling cells and send the numbers back.  Cells are dealt into a grid of cell blocks of about
``CELLS`` cells, by the word block of the word (row) and of the context (column), so that neither a frequent word
nor a frequent context meets in one task.  In a sweep a cell block gets, for its different words and
contexts, their totals and the words' spelling probabilities from the word blocks, seats its cells, and sends
them sums of tables by word and by context; the word blocks add these up, seat the words, and send their spelling
cells, with their customers, to parts dealt by a hash of the last two bytes of the context, about ``ENTRIES``
cells each.  Spelling restaurants of two and more bytes are seated in a task by the part, and the cells'
probabilities go back to the word blocks; those of one byte and none (at most 2^16 cells) are seated on the
driver.  Nothing that grows with the corpus is collected or broadcast, and counts cover all training documents.

Defined cases: a null or empty text is the end token alone; repeated rows are trained on and
returned each; without training tokens the base score is 0 and the model spells with the uniform
distribution; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from laborlens.llm.common import held_out
from laborlens.session import scratch_path

MOD, HELD = 10, 0
BITS = 4                     # 2 ** BITS contexts, where a table of words says no other number
DEPTH = 4
LOW = 2                      # spelling contexts from this length on are seated in tasks
LEVELS = DEPTH - LOW + 1
BLANK = 0x20
BLOCK_WORDS = 300_000
SMALLEST = 1024              # hashes of a block's words, to tell how many there are in all
BLOCK_TOKENS = 4_000_000     # a block of documents ends here too
WORDS = 32_768               # words of a word block, about
RANK_BITS = 24               # of a word's number within its word block
CELLS = 1_000_000            # cells of a cell block, about
ENTRIES = 500_000            # spelling cells of all word blocks that a part has, about
RANGE_BITS = 34              # a range of document blocks: those of 1024 tasks
BURN_IN, SAMPLES = 1, 2
INNER = 3                    # spelling sweeps for each sweep over the words
STRENGTH = 1.0
EXACT = 24
ADD = 0.1                    # of the base score
TEXTS = 256                  # texts handled at once

#: Rows of a block's words (kind 0), its cells (1) and documents (2).
BLOCKS = "block long, kind int, n long, smallest array<long>, doc_id long, held_out boolean, n_tokens long, words binary, cells binary"
DEALT = "wb long, range long, block long, words binary, cell binary, n binary"
GATHERED = "wb long, range long, words array<binary>, n binary, word binary, block binary, cell binary"
WORD_BLOCKS = "wb long, range long, map binary, seed binary, n binary, length binary, place binary, cells binary, entries long"
CELL_BLOCKS = "cb long, words binary, contexts binary, cells binary, blocks array<long>, places array<binary>"
SENT = "cb long, t binary, few array<long>, wb array<long>, sent array<binary>"
SEATED = ("wb long, tables binary, sums array<long>, cb array<long>, lists array<binary>, part array<int>, "
          "cells array<binary>")
SPELLED = "part int, wb long, tables binary, codes array<long>, n array<long>, ab binary"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once to the shared folder, more tightly packed than by default, and reads it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """The same, in files by the key's hash, so that joins by the key don't shuffle it again.  ``df`` should come from
    ``partitions`` partitions by the key: a file each."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    (df.write.bucketBy(partitions(df), key).option("compression", "zstd").option("path", path)
     .format("parquet").saveAsTable(table))
    return spark.table(table)


def words_of(text: str | None) -> list:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers from 0 (floats: single precision) in few bytes: first bytes of all, then second ones."""
    import zstandard
    out = []
    for x in arrays:
        if x.dtype.kind == "f":
            kind = "f4"
        else:
            most = int(x.max()) if len(x) else 0
            kind = next(k for k, bits in (("u1", 8), ("u2", 16), ("u4", 32), ("i8", 63)) if most < 1 << bits)
        out += [kind.encode(), len(x).to_bytes(8, "little"), x.astype("<" + kind).view("u1").reshape(len(x), np.dtype(kind).itemsize).T.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unsqueeze(raw: bytes) -> list:
    import zstandard
    raw, at, out = zstandard.ZstdDecompressor().decompress(raw), 0, []
    while at < len(raw):
        kind, n = np.dtype("<" + raw[at:at + 2].decode()), int.from_bytes(raw[at + 2:at + 10], "little")
        x = np.frombuffer(raw, "u1", n * kind.itemsize, at + 10).reshape(kind.itemsize, n)
        at += 10 + x.nbytes
        out.append(np.ascontiguousarray(x.T).view(kind).ravel().astype(float if kind.kind == "f" else np.int64))
    return out


def steps(rising: np.ndarray) -> np.ndarray:
    return np.diff(rising, prepend=0)


def rows_in(names: str, rows: list) -> pa.RecordBatch:
    """Rows of a schema in Spark's words."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    fields = [f.split() for f in names.split(", ")]
    types = [pa.list_(kinds[k[6:-1]]) if k.startswith("array") else kinds[k] for _, k in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), types)], names=[f for f, _ in fields])


def each_row(batch: pa.RecordBatch) -> Iterator[dict]:
    for k in range(batch.num_rows):
        yield {n: batch.column(n)[k].as_py() for n in batch.schema.names}


# --- blocks ---------------------------------------------------------------------

def contexts(words: np.ndarray, end: int) -> np.ndarray:
    """The word before each token; texts follow one another, each with its ``end`` token, the context of a text's start."""
    return np.concatenate([[end], words[:-1]])


def summed(keys: list, counts: list) -> tuple:
    """Distinct keys and their summed counts."""
    both, where = np.unique(np.concatenate(keys), return_inverse=True)
    return both, np.bincount(where, np.concatenate(counts), len(both)).astype(np.int64)


def word_hashes(words: list) -> np.ndarray:
    import xxhash
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) >> np.uint64(1)


def pack_words(words: list) -> bytes:
    import zstandard
    return zstandard.ZstdCompressor(level=1).compress(b" ".join(words))


def unpack_words(raw: bytes) -> list:
    import zstandard
    return zstandard.ZstdDecompressor().decompress(raw).split(b" ")


def distinct_words(listed: DataFrame) -> int:
    """About how many different words there are, from the smallest hashes."""
    rows = listed.select(F.explode("smallest").alias("h")).distinct().orderBy("h").limit(SMALLEST).collect()
    return len(rows) if len(rows) < SMALLEST else int((SMALLEST - 1) / (rows[-1]["h"] / (1 << 63)))


def blocks(docs: DataFrame, train: Column, id_col: str, text_col: str) -> DataFrame:
    """Rows of words, cells and documents of every block (see ``BLOCKS``)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        block = TaskContext.get().partitionId() << 24
        number: dict = {}
        keys, trained, sizes, rows = [], [], [], []

        def finish() -> Iterator[pa.RecordBatch]:
            size = np.concatenate(sizes)
            cell, at = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(at, np.repeat(trained, size), len(cell)).astype(np.int64)
            word = cell >> 32
            many = np.bincount(word, n, len(number)).astype(np.int64)
            smallest = np.sort(word_hashes(list(number)))[:SMALLEST]
            yield rows_in(BLOCKS, [(block, 0, None, smallest, None, None, None, pack_words(list(number)), squeeze(many)),
                                   (block, 1, len(cell), *[None] * 5, squeeze(steps(word), cell & 0xFFFFFFFF, n))])
            # a document's cells in ascending order
            at = np.sort(np.repeat(np.arange(len(size)), size) << 32 | at) & 0xFFFFFFFF
            ends = np.cumsum(size)
            for a in range(0, len(rows), TEXTS):
                yield rows_in(BLOCKS, [(block, 2, None, None, *rows[k], int(size[k]), None,
                                        squeeze(steps(at[ends[k] - size[k]:ends[k]])))
                                       for k in range(a, min(a + TEXTS, len(rows)))])

        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                ids, held, texts = (c.to_pylist() for c in b.slice(at, TEXTS).columns)
                own = [words_of(t) + [b""] for t in texts]
                for w in set().union(*own):
                    if w not in number:
                        number[w] = len(number)
                size = np.asarray([len(r) for r in own])
                flat = np.fromiter(map(number.__getitem__, chain.from_iterable(own)), np.int64, size.sum())
                keys.append(flat << 32 | contexts(flat, number[b""]))
                sizes.append(size)
                trained += [not h for h in held]
                rows += zip(ids, held)
                if len(number) > BLOCK_WORDS or sum(map(len, keys)) > BLOCK_TOKENS:
                    yield from finish()
                    for x in (number, keys, trained, sizes, rows):
                        x.clear()
                    block += 1
        if number:
            yield from finish()

    src = docs.select(F.col(id_col).cast("long"), (~train), F.col(text_col))
    return src.mapInArrow(cut, BLOCKS)


# --- random numbers -------------------------------------------------------------

def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit hash of each number, another one for each salt."""
    x = x.astype(np.uint64) + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(key: np.ndarray, salt: int) -> np.ndarray:
    return ((mixed(key, salt) >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)


def poisson(mean: np.ndarray, key: np.ndarray, salt: int) -> np.ndarray:
    """Poisson draws: by inversion, beyond a mean of 30 from the normal distribution."""
    u = uniform(key, salt)
    out = np.zeros(len(mean), np.int64)
    left = np.flatnonzero(mean < 30)
    p = np.exp(-mean[left])
    below, k = p.copy(), 0
    while len(left) and k < 200:
        more = u[left] > below
        left, p, below = left[more], p[more], below[more]
        k += 1
        p = p * mean[left] / k
        below = below + p
        out[left] = k
    large = np.flatnonzero(mean >= 30)
    normal = np.sqrt(-2 * np.log(u[large])) * np.cos(2 * np.pi * uniform(key[large], salt + 1))
    out[large] = np.maximum(np.rint(mean[large] + np.sqrt(mean[large]) * normal), 0)
    return out


def sample_tables(c: np.ndarray, strength: np.ndarray, d: float, key: np.ndarray, sweep: int = 0) -> np.ndarray:
    """Tables of each dish after seating its ``c`` customers.

    ``strength``: (theta + d * tables of the restaurant) * parent's probability.  Customer i
    (from 0) opens a table with probability strength / (strength + i - d * t).  ``key``: the dish, for its random numbers.
    """
    t = (c > 0).astype(np.int64)
    live = np.flatnonzero(c > 1)
    for i in range(1, EXACT):
        if not len(live):
            break
        a = strength[live]
        t[live] += uniform(key[live], sweep << 8 | i) < a / (a + i - d * t[live])
        live = live[c[live] > i + 1]
    at, salt = np.full(len(live), EXACT, np.int64), EXACT
    while len(live):
        to = np.minimum(2 * at, c[live])
        a, low = strength[live], np.maximum(at - d * t[live], 0.5)
        new = poisson(a * np.log((a + low + to - at) / (a + low)), key[live], sweep << 8 | salt)
        t[live] += np.minimum(new, to - at)
        more = to < c[live]
        live, at, salt = live[more], to[more], salt + 2
    return t


def share(one: int, two: int) -> float:
    """The discount: n1 / (n1 + 2 n2) from the numbers of dishes with one and two customers."""
    return float(np.clip(one / (one + 2 * two), 0.05, 0.95)) if one else 0.5


# --- spelling -----------------------------------------------------------------

def spelled(words: list) -> tuple:
    """(starts, cells) of words written one after the other; a cell is context << 8 | byte,
    the context the ``DEPTH`` bytes before, the oldest highest (blanks before the word)."""
    raw = np.frombuffer(b" ".join(words) + b" ", np.uint8).astype(np.int64)
    ends = np.flatnonzero(raw == BLANK)
    starts = np.concatenate([[0], ends[:-1] + 1])
    pos = np.arange(len(raw)) - np.repeat(starts, ends + 1 - starts)
    cell = raw.copy()
    for k in range(1, DEPTH + 1):
        before = np.full(len(raw), BLANK)
        before[k:] = np.where(pos[k:] >= k, raw[:-k], BLANK)
        cell |= before << 8 * k
    return starts, cell


def shortened(cell: np.ndarray, depth: int) -> np.ndarray:
    """The cell of the same byte after the last ``depth`` bytes of its context."""
    return cell & (1 << 8 * (depth + 1)) - 1


class Rooms:
    """Spelling restaurants with contexts of ``low`` to ``depth`` bytes.

    ``cells``: sorted codes of the longest contexts; shorter ones follow from them.  ``d``: the discount
    of each length.  Probabilities are kept as a + b * (that of the cell's parent below ``low``)."""

    def __init__(self, cells: np.ndarray, customers: np.ndarray, low: int, depth: int, d: list):
        self.low, self.depth, self.d = low, depth, d
        self.cells, self.up = {depth: cells}, {}
        for k in range(depth, low, -1):
            self.cells[k - 1], self.up[k] = np.unique(shortened(self.cells[k], k - 1), return_inverse=True)
        self.room = {k: np.unique(c >> 8, return_inverse=True)[1] for k, c in self.cells.items()}
        self.place = {depth: np.arange(len(cells))}                # of each longest cell's dish at each length
        for k in range(depth, low, -1):
            self.place[k - 1] = self.up[k][self.place[k]]
        self.c, self.t = {depth: customers.astype(np.int64)}, {}

    def fill(self, tables: np.ndarray | None) -> None:
        """The tables of the last sweep (``tables``' rows, see there); at first, one a dish."""
        for k in range(self.depth, self.low - 1, -1):
            self.t[k] = np.minimum(self.c[k], 1)
            if tables is not None:
                # customers may have left since: a dish has no more tables than customers
                at = np.unique(self.place[k], return_index=True)[1]
                self.t[k] = np.maximum(self.t[k], np.minimum(tables[self.depth - k][at], self.c[k]))
            self._send_up(k)

    def _send_up(self, k: int) -> None:
        if k > self.low:
            self.c[k - 1] = np.bincount(self.up[k], self.t[k], len(self.cells[k - 1])).astype(np.int64)

    def tables(self) -> np.ndarray:
        """For each longest cell, the tables of its own dish and of those above it."""
        return np.asarray([self.t[k][self.place[k]] for k in range(self.depth, self.low - 1, -1)])

    def _sums(self, k: int) -> tuple:
        """Customers and tables of each cell's restaurant."""
        room = self.room[k]
        return np.bincount(room, self.c[k])[room], np.bincount(room, self.t[k])[room]

    def predictive(self) -> dict:
        """(a, b) of each length's cells."""
        out = {}
        for k in range(self.low, self.depth + 1):
            customers, tables = self._sums(k)
            own = (self.c[k] - self.d[k] * self.t[k]) / (STRENGTH + customers)
            rest = (STRENGTH + self.d[k] * tables) / (STRENGTH + customers)
            if k == self.low:
                out[k] = own, rest
            else:
                a, b = out[k - 1]
                out[k] = own + rest * a[self.up[k]], rest * b[self.up[k]]
        return out

    def seat(self, base: np.ndarray, sweep: int) -> None:
        """``base``: probability below ``low`` of each shortest cell."""
        p = {k: a + b * (base if k == self.low else base[self._lowest(k)]) for k, (a, b) in self.predictive().items()}
        for k in range(self.depth, self.low - 1, -1):
            parent = base if k == self.low else p[k - 1][self.up[k]]
            others = self._sums(k)[1] - self.t[k] if len(self.t[k]) else self.t[k]
            self.t[k] = sample_tables(self.c[k], (STRENGTH + self.d[k] * np.maximum(others, 0)) * parent, self.d[k],
                                      mixed(self.cells[k], k), sweep)
            self._send_up(k)

    def _lowest(self, k: int) -> np.ndarray:
        """The shortest cell of each cell."""
        at = self.up[k]
        for j in range(k - 1, self.low, -1):
            at = self.up[j][at]
        return at

    def ones_and_twos(self) -> list:
        return [int((self.c[k] == m).sum()) for k in range(self.low, self.depth + 1) for m in (1, 2)]


def part_of(cells: np.ndarray, parts: int) -> np.ndarray:
    """The part of each cell, by the last ``LOW`` bytes of its context."""
    return (mixed(cells >> 8 & (1 << 8 * LOW) - 1, 0) % np.uint64(parts)).astype(np.int32)


def seat_spelling(seated: DataFrame, state: DataFrame | None, upper: dict, sweep: int) -> DataFrame:
    """A spelling sweep over all parts (see ``SPELLED``): a part's tables and the sums for the shorter
    contexts, and for each word block a and b of the cells that it sent.

    ``state``: the sweep before; ``upper``: the model of the shorter contexts."""
    shared = seated.sparkSession.sparkContext.broadcast((upper["p"], upper["d"]))       # 2^16 numbers
    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, d = shared.value
        for t in _runs(batches, 1):
            part, wbs, tables, own = (t.column(c).to_pylist() for c in ("part", "wb", "tables", "cells"))
            sent = [unsqueeze(x) for x in own if x is not None]
            if not sent:
                continue
            cells, at = np.unique(np.concatenate([np.cumsum(x) for x, _ in sent]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n for _, n in sent]))
            rooms = Rooms(cells, n.astype(np.int64), LOW, DEPTH, d)
            held = next((np.asarray(unsqueeze(x)) for x in tables if x is not None), None)
            rooms.fill(held)
            base = p[rooms.cells[LOW] & 0xFFFF]
            for k in range(INNER):
                rooms.seat(base, sweep * INNER + k)
            a, b = rooms.predictive()[DEPTH]
            codes, low = np.unique(rooms.cells[LOW] & 0xFFFF, return_inverse=True)
            few = rooms.ones_and_twos()
            out = [(part[0], None, squeeze(*rooms.tables()), [*codes, *range(-len(few), 0)],
                    [*np.bincount(low, rooms.t[LOW]).astype(np.int64), *few], None)]
            ends = np.cumsum([len(x) for x, _ in sent])
            for wb, own in zip([w for w in wbs if w is not None], np.split(at, ends[:-1])):
                out.append((part[0], wb, None, None, None, squeeze(a[own], b[own])))
            yield rows_in(SPELLED, out)

    rows = seated.select("wb", F.inline(F.arrays_zip("part", "cells"))).select(
        "part", "wb", F.lit(None).cast("binary").alias("tables"), "cells")
    if state is not None:
        rows = rows.union(state.where("wb IS NULL").select("part", "wb", "tables", F.lit(None).cast("binary").alias("cells")))
    return materialise(rows.repartition("part").sortWithinPartitions("part", "wb").mapInArrow(seat, SPELLED), "spelled")


def new_upper() -> dict:
    """The shorter contexts' model before any customer: uniform bytes."""
    return {"p": np.full(1 << 16, 1 / 256), "d": [0.5] * (DEPTH + 1), "t": None}


def seat_upper(spelled_rows: DataFrame, upper: dict, sweep: int) -> dict:
    """Contexts of one byte and none, seated on the driver from the groups' tables; and the discounts."""
    found = (spelled_rows.where("wb IS NULL").select(F.inline(F.arrays_zip("codes", "n"))).groupBy("codes").agg(F.sum("n").alias("n"))
             .toPandas())                                           # 2^16 cells and a few sums at most
    code, n = found["codes"].to_numpy(np.int64), found["n"].to_numpy(np.int64)
    customers = np.zeros(1 << 16, np.int64)
    customers[code[code >= 0]] = n[code >= 0]
    few = dict(zip(code[code < 0].tolist(), n[code < 0].tolist()))
    many = 2 * (DEPTH - LOW + 1)
    d = list(upper["d"])
    rooms = Rooms(np.arange(1 << 16), customers, 0, LOW - 1, d)
    rooms.fill(upper["t"])
    for k in range(INNER):
        rooms.seat(np.full(256, 1 / 256), sweep * INNER + k)
    a, b = rooms.predictive()[LOW - 1]
    own = rooms.ones_and_twos()
    for k in range(LOW):
        d[k] = share(own[2 * k], own[2 * k + 1])
    for k in range(LOW, DEPTH + 1):
        d[k] = share(*(few.get(2 * (k - LOW) + j - many, 0) for j in (0, 1)))
    return {"p": a + b / 256, "d": d, "t": rooms.tables()}


# --- word blocks ------------------------------------------------------------------

def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each value of the first ``keys`` columns, from ordered batches."""
    held, last = [], None
    for b in batches:
        if not b.num_rows:
            continue
        own = [b.column(k).to_numpy() for k in range(keys)]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in own], axis=0)) + 1
        for at, end in zip([0, *new.tolist()], [*new.tolist(), b.num_rows]):
            key = tuple(c[at] for c in own)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(b.slice(at, end - at))
    if held:
        yield pa.Table.from_batches(held)


def gather(listed: DataFrame, blocks_of_words: int) -> DataFrame:
    """Words, their counts and their places, for each word block and range of document blocks."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, raw, n in zip(*[c.to_pylist() for c in b.columns]):
                words, n = unpack_words(raw), unsqueeze(n)[0]
                wb = (word_hashes(words) % np.uint64(blocks_of_words)).astype(np.int64)
                order = pc.sort_indices(pa.array(words, pa.binary())).to_numpy().astype(np.int64)
                order = order[np.argsort(wb[order], kind="stable")]
                edge = np.flatnonzero(np.r_[True, np.diff(wb[order]) > 0, True])
                for a, e in zip(edge, edge[1:]):
                    cell = order[a:e]
                    yield rows_in(DEALT, [(int(wb[cell[0]]), block >> RANGE_BITS, block, pack_words([words[i] for i in cell.tolist()]),
                                           squeeze(cell), squeeze(n[cell]))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, 2):
            lists = [unpack_words(x) for x in t.column("words").to_pylist()]
            cell, n = (np.concatenate([unsqueeze(x)[0] for x in t.column(c).to_pylist()]) for c in ("cell", "n"))
            block = np.repeat(t.column("block").to_numpy(), [len(x) for x in lists])
            word = pa.array(list(chain.from_iterable(lists)), pa.binary()).dictionary_encode()
            order = pc.sort_indices(word.dictionary).to_numpy()
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            number = rank[word.indices.to_numpy()]
            yield rows_in(GATHERED, [(t.column("wb")[0].as_py(), t.column("range")[0].as_py(),
                                      word.dictionary.take(pa.array(order)).to_pylist(),
                                      squeeze(np.bincount(number, n, len(order)).astype(np.int64)),
                                      squeeze(number), squeeze(steps(block)), squeeze(cell))])

    rows = listed.select("block", "words", "cells").mapInArrow(deal, DEALT)
    return rows.repartition("wb", "range").sortWithinPartitions("wb", "range", "block").mapInArrow(work, GATHERED)


def word_blocks(gathered: DataFrame) -> DataFrame:
    """One row a word block (range -1), and one for each range with its words' places there."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        for t in _runs(batches, 1):
            wb = t.column("wb")[0].as_py()
            lists = t.column("words").to_pylist()
            words = lists[0] if len(lists) == 1 else sorted(set().union(*lists))
            number = dict(zip(words, range(len(words))))
            n, rows = np.zeros(len(words), np.int64), []
            for own, of, raw in zip(lists, t.column("range").to_pylist(), t.column("n").to_pylist()):
                at = np.fromiter(map(number.__getitem__, own), np.int64, len(own))
                n[at] += unsqueeze(raw)[0]
                rows.append((wb, of, squeeze(steps(at)), *[None] * 6))
            starts, cell = spelled(words)
            cells, place = np.unique(cell, return_inverse=True)
            length = np.diff(np.append(starts, len(cell)))
            seed = np.fromiter((xxhash.xxh32_intdigest(w) for w in words), np.int64, len(words))
            rows.append((wb, -1, None, squeeze(seed), squeeze(n), squeeze(length), squeeze(place), squeeze(steps(cells)),
                         len(cells)))
            yield rows_in(WORD_BLOCKS, rows)

    few = gathered.select("wb", "range", "words", "n")
    return few.repartition(partitions(few), "wb").sortWithinPartitions("wb", "range").mapInArrow(work, WORD_BLOCKS)


def coded(gathered: DataFrame, held: DataFrame) -> DataFrame:
    """(block, codes): the codes (word block, number there) and counts of the words of each block of documents."""
    maps = held.where("range >= 0").select("wb", "range", "map")
    counts = held.where("range < 0").select("wb", F.col("n").alias("c"))
    places = gathered.select("wb", "range", "word", "block", "cell").join(maps, ["wb", "range"]).join(counts, "wb")

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for wb, *raw in zip(*[b.column(k).to_pylist() for k in ("wb", "word", "block", "cell", "map", "c")]):
                word, block, cell, of, c = (unsqueeze(x)[0] for x in raw)
                word, block = np.cumsum(of)[word], np.cumsum(block)
                edge = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
                yield rows_in("block long, wb long, cells binary",
                              [(int(block[a]), wb, squeeze(cell[a:e], word[a:e], c[word[a:e]])) for a, e in zip(edge, edge[1:])])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, 1):
            own = [unsqueeze(x) for x in t.column("cells").to_pylist()]
            codes, counts = np.zeros((2, sum(len(x[0]) for x in own)), np.int64)
            for wb, (cell, word, c) in zip(t.column("wb").to_pylist(), own):
                codes[cell], counts[cell] = wb << RANK_BITS | word, c
            yield rows_in("block long, codes binary", [(t.column("block")[0].as_py(), squeeze(codes, counts))])

    rows = places.mapInArrow(back, "block long, wb long, cells binary")
    return rows.repartition("block").sortWithinPartitions("block", "wb").mapInArrow(code, "block long, codes binary")


# --- cell blocks ------------------------------------------------------------------

def dealt(pairs: bytes, codes: bytes, side: int) -> tuple:
    """(order, words, contexts, counts, cell blocks) of a block's cells, ordered by cell block, word and context."""
    word, of, n = unsqueeze(pairs)
    code = unsqueeze(codes)[0]
    w, u = code[np.cumsum(word)], code[of]
    cb = (w >> RANK_BITS) % side * side + (mixed(u >> RANK_BITS, 5) % np.uint64(side)).astype(np.int64)
    order = np.lexsort((u, w, cb))
    return order, w[order], u[order], n[order], cb[order]


def cell_blocks(pairs: DataFrame, codes: DataFrame, side: int) -> DataFrame:
    """A row a cell block (see ``CELL_BLOCKS``): its different words and contexts, its cells, and where those of each
    block of documents are among them."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, pairs, codes in zip(*[c.to_pylist() for c in b.columns]):
                _, w, u, n, cb = dealt(pairs, codes, side)
                edge = np.flatnonzero(np.r_[True, cb[1:] != cb[:-1], True])
                yield rows_in("cb long, block long, cells binary",
                              [(int(cb[a]), block, squeeze(steps(w[a:e]), u[a:e], n[a:e])) for a, e in zip(edge, edge[1:])])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, 1):
            w, u, n = zip(*map(unsqueeze, t.column("cells").to_pylist()))
            words, row = np.unique(np.concatenate([np.cumsum(x) for x in w]), return_inverse=True)
            of, z = np.unique(np.concatenate(u), return_inverse=True)
            key, at = np.unique(row * len(of) + z, return_inverse=True)
            n = np.bincount(at, np.concatenate(n), len(key)).astype(np.int64)
            places = np.split(at, np.cumsum([len(x) for x in u])[:-1])
            yield rows_in(CELL_BLOCKS, [(t.column("cb")[0].as_py(), squeeze(steps(words)), squeeze(steps(of)),
                                         squeeze(steps(key // len(of)), key % len(of), n),
                                         t.column("block").to_pylist(), [squeeze(steps(x)) for x in places])])

    rows = pairs.join(codes, "block").select("block", "cells", "codes").mapInArrow(deal, "cb long, block long, cells binary")
    return rows.repartition(partitions(rows), "cb").sortWithinPartitions("cb", "block").mapInArrow(work, CELL_BLOCKS)


class Words:
    """Words with their cells (word, context) laid out flat."""

    def __init__(self, seed: bytes, size: bytes, z: bytes, n: bytes, length: bytes, place: bytes):
        size = np.frombuffer(size, "u1")
        z = np.frombuffer(z, "u1").astype(np.int64)
        self.set(np.frombuffer(seed, "<u8"), np.repeat(np.arange(len(size)), size), z, np.frombuffer(n, "<i8"),
                 np.arange(1 << BITS))

    def set(self, seed: np.ndarray, row: np.ndarray, z: np.ndarray, n: np.ndarray, context_seed: np.ndarray) -> Words:
        self.seed, self.row, self.z, self.n, self.context_seed = seed, row, z, n, context_seed
        return self

    @classmethod
    def of(cls, *arrays: np.ndarray) -> Words:
        """From seeds of words, each cell's word, context and count, and seeds of contexts."""
        return cls.__new__(cls).set(*arrays)

    def per_word(self, cells: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, cells, len(self.seed)).astype(np.int64)

    def per_context(self, cells: np.ndarray) -> np.ndarray:
        return np.bincount(self.z, cells, len(self.context_seed)).astype(np.int64)

    def seat_cells(self, t: np.ndarray, c0: np.ndarray, t0: np.ndarray, model: dict, g: np.ndarray, sweep: int) -> np.ndarray:
        """Tables by cell, each dish seated anew given all others' tables.  ``c0``, ``t0``: each word's customers
        (from all contexts, here or elsewhere) and tables in the word restaurant."""
        d, d0 = model["d"], model["d0"]
        others = c0[self.row] - t                                 # the word's customers from other contexts
        t0_others = np.minimum(t0[self.row], others)
        p0 = (others - d0 * t0_others + (STRENGTH + d0 * (model["tables0"] - t0[self.row] + t0_others)) * g[self.row]) \
            / (STRENGTH + model["customers0"] - t)
        weight = STRENGTH + d * (model["tables"][self.z] - t)
        key = mixed(self.seed[self.row], 1) + self.context_seed[self.z].astype(np.uint64)
        return sample_tables(self.n, weight * p0, d, key, sweep)

    def seat(self, t: np.ndarray, t0: np.ndarray, model: dict, g: np.ndarray, sweep: int) -> tuple:
        """Tables by cell and word, if all cells of the words are here."""
        t = self.seat_cells(t, self.per_word(t), t0, model, g, sweep)
        return t, seat_dishes(self.per_word(t), t0, model, g, self.seed, sweep)

    def predictive(self, t: np.ndarray, t0: np.ndarray, model: dict, g: np.ndarray, c0: np.ndarray | None = None) -> np.ndarray:
        """Probability of each cell's word in its context, under one seating and its totals."""
        d, d0 = model["d"], model["d0"]
        c0 = self.per_word(t) if c0 is None else c0
        p0 = (c0 - d0 * t0 + (STRENGTH + d0 * model["tables0"]) * g) / (STRENGTH + model["customers0"])
        return (self.n - d * t + (STRENGTH + d * model["tables"][self.z]) * p0[self.row]) \
            / (STRENGTH + model["customers"][self.z])

    def sums(self, t: np.ndarray, t0: np.ndarray) -> list:
        """Customers and tables of each context, dishes with one and two customers, word restaurant's totals."""
        return [int(x) for x in np.concatenate([self.per_context(self.n), self.per_context(t), ones_and_twos(self.n),
                                                dish_sums(self.per_word(t), t0)])]


def ones_and_twos(c: np.ndarray) -> list:
    return [int((c == 1).sum()), int((c == 2).sum())]


def dish_sums(c0: np.ndarray, t0: np.ndarray) -> list:
    """Words with one and two customers in the word restaurant, its customers and tables."""
    return [*ones_and_twos(c0), int(c0.sum()), int(t0.sum())]


def seat_dishes(c0: np.ndarray, t0: np.ndarray, model: dict, g: np.ndarray, seed: np.ndarray, sweep: int) -> np.ndarray:
    """Tables of each word in the word restaurant."""
    return sample_tables(c0, (STRENGTH + model["d0"] * (model["tables0"] - t0)) * g, model["d0"], mixed(seed, 2), sweep)


def spelling(length: np.ndarray, place: np.ndarray, cells: np.ndarray, parts: int, ab: list, p: np.ndarray) -> np.ndarray:
    """Probability of each word's spelling from its cells', which come by the part."""
    order = np.argsort(part_of(cells, parts), kind="stable")
    own = np.empty((2, len(cells)))
    own[:, order] = np.concatenate([unsqueeze(x) for x in ab], axis=1)
    log = np.log(np.maximum(own[0] + own[1] * p[cells & 0xFFFF], 1e-300))
    return np.exp(np.add.reduceat(log[place], np.cumsum(length) - length))


def totals(rows: DataFrame, col: str, n: int) -> list:
    """The ``n`` sums over all blocks' lists."""
    found = rows.select(F.posexplode(col).alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect()
    x = [0] * n
    for r in found:                                                  # one row a sum
        x[r["k"]] = r["x"]
    return x


class CellBlock:
    """A row of ``CELL_BLOCKS``."""

    def __init__(self, row: dict):
        self.words, self.contexts = (np.cumsum(unsqueeze(row[k])[0]) for k in ("words", "contexts"))
        at, self.z, self.n = unsqueeze(row["cells"])
        self.row = np.cumsum(at)

    def told(self, told: list, model: dict) -> tuple:
        """The words' cells, their customers, tables and spelling in the word restaurant, and the model (see ``replies``)."""
        c0, t0, g, seed, tables, customers, context_seed = (np.concatenate(x) for x in zip(*[unsqueeze(r["told"]) for r in told]))
        own = Words.of(seed, self.row, self.z, self.n, context_seed)
        return own, c0, t0, g, {**model, "tables": tables, "customers": customers}


def seat_cells(cells: DataFrame, last: DataFrame | None, told: DataFrame | None, model: dict | None, sweep: int) -> DataFrame:
    """A sweep over all cells (see ``SENT``); at first, one table a dish.  ``last``: the one before; ``told``: what the word blocks
    say (see ``replies``)."""
    new = last is None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = (1 << RANK_BITS) - 1
        for batch in batches:
            for row in each_row(batch):
                cells, t = CellBlock(row), None
                words, of, n = cells.words, cells.contexts, cells.n
                if new:
                    t = np.minimum(n, 1)
                else:
                    own, c0, t0, g, full = cells.told(row["told"], model)
                    t = own.seat_cells(unsqueeze(row["t"])[0], c0, t0, full, g, sweep)
                own = Words.of(words, cells.row, cells.z, n, of)
                left, right = [own.per_word(t), (own.per_word(n > 1) > 0).astype(np.int64)], [
                    own.per_context(t), own.per_context(n), (own.per_context(n > 1) > 0).astype(np.int64)]
                wbs = np.unique(np.concatenate([words, of]) >> RANK_BITS)
                ends = [[np.searchsorted(x >> RANK_BITS, wbs, side) for side in ("left", "right")] for x in (words, of)]
                sent = [squeeze(steps(words[a:e] & mask), steps(of[b:f] & mask), *[x[a:e] for x in left], *[x[b:f] for x in right])
                        for a, e, b, f in zip(*ends[0], *ends[1])]
                yield rows_in(SENT, [(row["cb"], squeeze(t), [*ones_and_twos(n), int(n.sum())], wbs.tolist(), sent)])

    rows = cells.select("cb", "words", "contexts", "cells")
    if not new:
        rows = rows.join(last.select("cb", "t"), "cb").join(told, "cb")
    return materialise(rows.mapInArrow(work, SENT), "cells")


def seat_words(own: DataFrame, sent: DataFrame, last: DataFrame | None, parts: int, model: dict | None,
               upper: dict | None, sweep: int) -> DataFrame:
    """Totals of words and contexts, the words seated (``last`` None: one table a dish) and their spelling cells sent to their
    parts, with their customers.  ``last``: tables and the spelling cells' probabilities (see ``with_spelling``)."""
    p = None if upper is None else own.sparkSession.sparkContext.broadcast(upper["p"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in each_row(batch):
                seed, length, place, cells = (unsqueeze(row[k])[0] for k in ("seed", "length", "place", "cells"))
                cells = np.cumsum(cells)
                c0, tables, customers = np.zeros((3, len(seed)), np.int64)
                lists = []
                for s in row["sent"]:
                    words, of, tw, ask_w, tu, nu, ask_u = unsqueeze(s["sent"])
                    lists.append(squeeze(words, of, ask_w, ask_u))
                    words, of = np.cumsum(words), np.cumsum(of)
                    c0[words] += tw
                    tables[of] += tu
                    customers[of] += nu
                if model is None:
                    t0 = np.minimum(c0, 1)
                else:
                    g = spelling(length, place, cells, parts, row["ab"], p.value)
                    t0 = seat_dishes(c0, unsqueeze(row["tables"])[1], model, g, seed, sweep)
                spelt = np.bincount(place, np.repeat(t0, length), len(cells)).astype(np.int64)
                part = part_of(cells, parts)
                order = np.argsort(part, kind="stable")
                used, first = np.unique(part[order], return_index=True)
                pieces = [squeeze(steps(x), n) for x, n in zip(*[np.split(y[order], first[1:]) for y in (cells, spelt)])]
                yield rows_in(SEATED, [(row["wb"], squeeze(c0, t0, tables, customers),
                                        [*dish_sums(c0, t0), int((unsqueeze(row["n"])[0] > 0).sum())],
                                        [s["cb"] for s in row["sent"]], lists, used.tolist(), pieces)])

    said = (sent.select("cb", F.inline(F.arrays_zip("wb", "sent"))).groupBy("wb")
            .agg(F.array_sort(F.collect_list(F.struct("cb", "sent"))).alias("sent")))                # a row a cell block
    rows = own.join(said, "wb")
    if last is not None:
        rows = rows.join(last.select("wb", "tables", "ab"), "wb")
    return materialise(rows.mapInArrow(work, SEATED), "seated")


def replies(own: DataFrame, last: DataFrame, parts: int, upper: dict, all_cells: bool) -> DataFrame:
    """(cb, told): for the different words and contexts of each cell block, by word block, customers and tables of the words, their
    spelling's probability and their seed; tables, customers and seed of the contexts.  Unless ``all_cells``, only of those that have a
    cell there of several customers (others keep their one table); zeros of the others."""
    p = own.sparkSession.sparkContext.broadcast(upper["p"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in each_row(batch):
                seed, length, place, cells = (unsqueeze(row[k])[0] for k in ("seed", "length", "place", "cells"))
                g = spelling(length, place, np.cumsum(cells), parts, row["ab"], p.value)
                c0, t0, tables, customers = unsqueeze(row["tables"])
                out = []
                for cb, raw in zip(row["cb"], row["lists"]):
                    w, u, ask_w, ask_u = unsqueeze(raw)
                    w, u = np.cumsum(w), np.cumsum(u)
                    few_w, few_u = (1, 1) if all_cells else (ask_w, ask_u)
                    out.append((cb, row["wb"], squeeze(c0[w] * few_w, t0[w] * few_w, g[w] * few_w, seed[w] * ask_w,
                                                       tables[u] * few_u, customers[u] * few_u, seed[u] * ask_u)))
                yield rows_in("cb long, wb long, told binary", out)

    rows = own.select("wb", "seed", "length", "place", "cells").join(last.select("wb", "tables", "cb", "lists", "ab"), "wb")
    return (rows.mapInArrow(work, "cb long, wb long, told binary").groupBy("cb")
            .agg(F.array_sort(F.collect_list(F.struct("wb", "told"))).alias("told")))               # a row a word block


def with_spelling(spelled_rows: DataFrame) -> DataFrame:
    """(wb, ab): the probabilities of each word block's spelling cells, by the part."""
    own = (spelled_rows.where("wb IS NOT NULL").groupBy("wb")
           .agg(F.array_sort(F.collect_list(F.struct("part", "ab"))).alias("s")))         # a row a part
    return own.select("wb", F.col("s.ab").alias("ab"))


def rated(cells: DataFrame, samples: list) -> DataFrame:
    """(block, cb, p): log probabilities of the cells of each block of documents, by cell block, in ``dealt``'s order.

    ``samples``: (tables of the cells, what the word blocks say, totals) of each averaged sweep."""
    models = [model for _, _, model in samples]
    rows = cells
    for k, (sent, told, _) in enumerate(samples):
        rows = rows.join(sent.select("cb", F.col("t").alias(f"t_{k}")), "cb").join(
            told.withColumnRenamed("told", f"told_{k}"), "cb")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in each_row(batch):
                block, p = CellBlock(row), 0
                for k, model in enumerate(models):
                    own, c0, t0, g, full = block.told(row[f"told_{k}"], model)
                    p = p + own.predictive(unsqueeze(row[f"t_{k}"])[0], t0, full, g, c0)
                p = np.log10(np.maximum(p / len(models), 1e-300))
                yield rows_in("block long, cb long, p binary", [(b, row["cb"], squeeze(p[np.cumsum(unsqueeze(at)[0])]))
                                                               for b, at in zip(row["blocks"], row["places"])])

    return rows.mapInArrow(spread, "block long, cb long, p binary")


def score(docs: DataFrame, train: Column | None = None, id_col: str = "doc_id",
          text_col: str = "text", seed: int = 1) -> DataFrame:
    """Scores of every document; ``train``: which rows are learned from."""
    spark = docs.sparkSession
    train = ~held_out(F.col(id_col), MOD, HELD) if train is None else train
    cut = materialise(blocks(docs, train, id_col, text_col), "blocks")
    listed = cut.where("kind = 0")
    gathered = materialise(gather(listed, max(1, -(-distinct_words(listed) // WORDS))), "gathered")
    held = bucketed(word_blocks(gathered), "words", "wb")
    own = held.where("range < 0").drop("range", "map")
    entries = own.agg(F.sum("entries")).first()[0] or 0
    parts = max(1, -(-entries // ENTRIES))
    pairs = cut.where("kind = 1")
    codes = materialise(coded(gathered, held), "coded")
    side = math.ceil(math.sqrt(max(1, (pairs.agg(F.sum("n")).first()[0] or 0) / CELLS)))
    cells = bucketed(cell_blocks(pairs, codes, side), "cells", "cb")

    upper, state, samples = new_upper(), None, []
    sent = seat_cells(cells, None, None, None, 0)
    seated = seat_words(own, sent, None, parts, None, None, 0)
    *few, n = totals(sent, "few", 3)
    for k in range(BURN_IN + SAMPLES + 1):
        state = seat_spelling(seated, state, upper, k)
        upper = seat_upper(state, upper, k)
        one, two, customers0, tables0, v = totals(seated, "sums", 5)
        model = {"d": share(*few), "d0": share(one, two), "customers0": customers0, "tables0": tables0}
        last = with_spelling(state).join(seated.select("wb", "tables", "cb", "lists"), "wb")
        if k > BURN_IN:
            samples.append((sent, replies(own, last, parts, upper, True), model))
        if k < BURN_IN + SAMPLES:
            sent = seat_cells(cells, sent, replies(own, last, parts, upper, False), model, seed + k)
            seated = seat_words(own, sent, last, parts, model, upper, seed + k)

    rest = math.log10(n + ADD * (v + 1))
    none = {c: F.lit(None).cast(kind).alias(c) for c, kind in (
        ("doc_id", "long"), ("held_out", "boolean"), ("n_tokens", "long"))}
    first = [df.select("block", F.lit(k).cast("long").alias("k"), *[none[c] for c in ("doc_id", "held_out", "n_tokens")], col)
             for df, k, col in ((pairs, -2, "cells"), (codes, -1, "codes"))]
    known = rated(cells, samples).select("block", F.col("cb").alias("k"), *[none[c] for c in ("doc_id", "held_out", "n_tokens")], "p")
    rows = cut.where("kind = 2").select("block", F.lit(1 << 62).alias("k"), "doc_id", "held_out", "n_tokens", "cells")
    scored = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts_, ready = [], None
        for b in batches:
            out = []
            for _, k, i, held_, many, raw in zip(*(c.to_pylist() for c in b.columns)):
                if k == -2:                           # a block's cells, its words, the cells' probabilities, its documents
                    own_cells = raw
                elif k == -1:
                    order, parts_, ready = dealt(own_cells, raw, side)[0], [], None
                    c = unsqueeze(raw)[1][np.cumsum(unsqueeze(own_cells)[0])]
                elif k < 1 << 62:
                    parts_.append(raw)
                else:
                    if ready is None:
                        p = np.empty(len(order))
                        p[order] = np.concatenate([unsqueeze(x)[0] for x in parts_])
                        ready = c > 0, np.log10(c + ADD) - rest, p
                        parts_ = []
                    cell = np.cumsum(unsqueeze(raw)[0])
                    out.append((i, held_, many, int(ready[0][cell].sum()), float(ready[1][cell].sum()),
                                float(ready[2][cell].sum())))
            if out:
                yield rows_in(scored, out)

    return (first[0].union(first[1]).union(known).union(rows).repartition("block").sortWithinPartitions("block", "k")
            .mapInArrow(add_up, scored)
            .withColumn("train_tokens", F.lit(n).cast("long"))
            .withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
            .select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score",
                    "perplexity"))
