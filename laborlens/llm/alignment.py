"""Cross-tokenizer alignment by a hash-set intersection of cumulative ends.

Both tokenizers' tokens of a text have cumulative byte ends.  Two dictionaries map an end to
the number of tokens up to it; the ends that both hold, in order, cut both id lists into
groups, and within a group every pair of an A and a B occurrence whose byte ranges overlap is a link.

A text is first cut where both tokenizers surely end a token (before a space and around a line
end that stand alone; between a word's letters and the signs after it, where no piece of B's
vocabulary holds both characters); ids, ends and groups of such a unit don't depend on its
surroundings, so each different unit is aligned once by a worker and kept; the new ones of a block of
texts are aligned together, as one line of bytes.

An id pair's count is the number of documents that hold it linked.  Blocks of documents list
their different pairs once; the lists are summed by pair, every pair's sum goes back to the
blocks that hold it by a join, and each block's documents look their pairs up in its list.

Defined cases: a null or empty text, and one whose tokens of A or B don't give the text's bytes
back (U+2581 in it becomes a space), has no tokens: zeros and an empty digest; a repeated row
counts as a document of its own; null ids are kept; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from laborlens.llm.byte_bpe import (LONG_TEXT, WHITE, WHITE_RE2, WORD, ByteIds, chunk_of, cut, odd_rows,
                                    portions, tokenizer_path)
from laborlens.llm.common import materialise, worker_cache

A_VOCABULARY = "byte_bpe_50k.json"
B_VOCABULARY = "piece_bpe_32k.model"
BLOCK_BYTES = 2 << 20        # text of a block of documents
CACHE_UNITS = 300_000

#: White space next to other white space, but for two line ends before a word, and the same
#: with the space that is put before the text: no cut there.
_OTHER = WHITE_RE2.replace(r"\n", "")
UNSAFE = f"{_OTHER}{WHITE_RE2}|{WHITE_RE2}{_OTHER}|\n\n\n|\n\n$|^ |^\n\n"

#: Where texts with such runs are cut: around a lone line end and before a lone space.
SAFE_CUT = re.compile(f"(?<=[^{WHITE}])(?=[ \n][^{WHITE}])|(?<=[^{WHITE}]\n)(?=[^{WHITE}])")

ALIGNED = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
           "groups_sha256 string")
ENCODED = ("block long, is_doc boolean, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
           "groups_sha256 string, places binary, times binary, pairs array<long>, docs array<long>")


def groups(a_ends: list, b_ends: list) -> tuple:
    """(ends of the groups, A tokens up to each, B tokens up to each)."""
    at_a = {end: k for k, end in enumerate(a_ends, 1)}
    at_b = {end: k for k, end in enumerate(b_ends, 1)}
    ends = sorted(at_a.keys() & at_b.keys())
    return ends, [at_a[e] for e in ends], [at_b[e] for e in ends]


def links(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple:
    """(ends, A's places, B's places) of all pairs whose byte ranges overlap: between neighbouring ends
    of either lies one token of each, and no pair lies there twice.  A group's links are those up to its end."""
    ends = np.union1d(a_ends, b_ends)
    return ends, np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)


class Aligner:
    """Units of text by both vocabularies, numbered; the units that are new are aligned together."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor
        self.a = ByteIds(a_path, plain=True)
        shown = {c: b for b, c in self.a.shown.items()}
        vocabulary = self.a.tokenizer.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(shown[ord(c)] for c in token)
        self.b = SentencePieceProcessor(model_file=b_path)
        size = self.b.get_piece_size()
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i)
                        else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(size)]
        self.a_len, self.b_len = (np.asarray(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        pieces = [self.b.id_to_piece(i) for i in range(size) if not self.b.is_byte(i) and not self.b.is_control(i)]
        if any("\n" in p or "▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece goes over a cut before a space or around a line end")
        self.joined = {p[k:k + 2] for p in pieces for k in range(len(p) - 1)}
        self.clear()

    def clear(self) -> None:
        """Forgets all units.  Of unit k: numbers of tokens and groups (-1: its bytes differ), groups as
        text, links as id pairs (A's id << 32 | B's)."""
        self.pieces: dict = {}
        self.units: dict = {}
        self.n_a, self.n_b, self.n_groups, self.n_links = array("q"), array("q"), array("q"), array("q")
        self.text: list = []
        self.pairs: list = []

    def turn(self) -> None:
        """Between blocks."""
        if len(self.text) > CACHE_UNITS:
            self.clear()
        self.a.parts.turn()

    def _add(self, n_a: int, n_b: int, n_groups: int, text: str, pairs: bytes) -> int:
        self.n_a.append(n_a)
        self.n_b.append(n_b)
        self.n_groups.append(n_groups)
        self.n_links.append(len(pairs) // 8)
        self.text.append(text)
        self.pairs.append(pairs)
        return len(self.text) - 1

    def b_ids(self, units: list) -> list:
        """B puts a space before what it encodes; where a unit has none, a line end keeps them apart."""
        plain = [u[1:] if u[:1] == " " and len(u) > 1 else u if u[:1] == "\n" else "\n" + u for u in units]
        found = self.b.encode(plain, num_threads=1)
        return [ids if u[:1] == " " and len(u) > 1 else ids[1:] if u[:1] == "\n" else ids[2:]
                for u, ids in zip(units, found)]

    def align(self, units: list) -> list:
        """The numbers of new units."""
        if not units:
            return []
        raws = [u.encode() for u in units]
        a = [self.a.chunk(u) if len(u) <= LONG_TEXT else self.a.text(u, True) for u in units]
        b = self.b_ids(units)
        a_flat = np.frombuffer(b"".join(a), "<u4").astype(np.int64)
        b_flat = np.fromiter(chain.from_iterable(b), np.int64, sum(map(len, b)))
        same = b"".join(map(self.a_bytes.__getitem__, a_flat.tolist())) == b"".join(raws) == \
            b"".join(map(self.b_bytes.__getitem__, b_flat.tolist()))
        if not same:
            if len(units) == 1:
                return [self._add(-1, -1, -1, "", b"")]
            half = len(units) // 2
            return self.align(units[:half]) + self.align(units[half:])
        # the units one after another: their ends are ends of both, so no group goes over one
        a_ends, b_ends = np.cumsum(self.a_len[a_flat]), np.cumsum(self.b_len[b_flat])
        unit_ends = np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)))
        if not (np.isin(unit_ends, a_ends).all() and np.isin(unit_ends, b_ends).all()):
            half = len(units) // 2
            if not half:
                return [self._add(-1, -1, -1, "", b"")]
            return self.align(units[:half]) + self.align(units[half:])
        ends, a_cuts, b_cuts = groups(a_ends.tolist(), b_ends.tolist())
        a_text, b_text = list(map(str, a_flat.tolist())), list(map(str, b_flat.tolist()))
        texts = [f"{','.join(a_text[i:m])}|{','.join(b_text[j:n])}"
                 for i, m, j, n in zip([0, *a_cuts], a_cuts, [0, *b_cuts], b_cuts)]
        link_ends, i, j = links(a_ends, b_ends)
        raw = (a_flat[i] << 32 | b_flat[j]).astype("<i8").tobytes()
        first = [0, 0, 0, 0]
        out = []
        for last in zip(*[(np.searchsorted(x, unit_ends) + 1).tolist()
                          for x in (a_ends, b_ends, np.asarray(ends), link_ends)]):
            out.append(self._add(last[0] - first[0], last[1] - first[1], last[2] - first[2],
                                 ";".join(texts[first[2]:last[2]]), raw[8 * first[3]:8 * last[3]]))
            first = last
        return out

    def learn(self, units: list) -> list:
        """The numbers of units that are not known.  A word and its signs are aligned apart
        where no piece of B joins them."""
        parts = []
        for u in units:
            word = WORD.fullmatch(u)
            parts.append((u,) if word is None or not word[2] or word[1][-1] + word[2][0] in self.joined
                         else (word[1], word[2]))
        new = list(dict.fromkeys(p for own in parts for p in own if p not in self.units))
        for at in range(0, len(new), 20_000):
            some = new[at:at + 20_000]
            self.units.update(zip(some, self.align(some)))
        out = []
        for unit, own in zip(units, parts):
            k = self.units[own[0]]
            if len(own) == 2:
                m = self.units[own[1]]
                k = self._add(self.n_a[k] + self.n_a[m], self.n_b[k] + self.n_b[m], self.n_groups[k] + self.n_groups[m],
                              f"{self.text[k]};{self.text[m]}", self.pairs[k] + self.pairs[m]) \
                    if min(self.n_a[k], self.n_a[m]) >= 0 else self._add(-1, -1, -1, "", b"")
                self.units[unit] = k
            out.append(k)
        return out

    def numbers(self, texts: list, unsafe: set) -> list:
        """The unit numbers of a space and each text."""
        rows = [list(_cut_safely(" " + t)) if k in unsafe else cut(" " + t)[1:] for k, t in enumerate(texts)]
        odd = list({u for k in unsafe for u in rows[k] if u not in self.units})
        self.units.update(zip(odd, self.learn(odd)))
        new = list(set().union(*[r for k, r in enumerate(rows) if k not in unsafe]).difference(self.pieces))
        units = [chunk_of(p) for p in new]
        missing = [u for u in units if u not in self.units]
        self.units.update(zip(missing, self.learn(missing)))
        self.pieces.update(zip(new, map(self.units.__getitem__, units)))
        return [list(map((self.units if k in unsafe else self.pieces).__getitem__, r)) for k, r in enumerate(rows)]

    def long_numbers(self, text: str) -> Iterator[list]:
        """The unit numbers of a space and a long text, in portions."""
        for part in portions(_cut_safely(" " + text)):
            new = [u for u in set(part) if u not in self.units]
            self.units.update(zip(new, self.learn(new)))
            yield list(map(self.units.__getitem__, part))
            if len(self.text) > CACHE_UNITS:
                self.clear()


def _cut_safely(text: str) -> Iterator[str]:
    at = 0
    for m in SAFE_CUT.finditer(text):
        if m.start() > at:
            yield text[at:m.start()]
            at = m.start()
    yield text[at:]


class Tally:
    """Sums over the units of some documents: each row of ``of`` numbers one document's units."""

    def __init__(self, aligner: Aligner, of: list):
        size = np.fromiter(map(len, of), np.int64, len(of))
        unit = np.fromiter(chain.from_iterable(of), np.int64, int(size.sum()))
        doc = np.repeat(np.arange(len(of)), size)

        def total(values: array) -> np.ndarray:
            own = np.frombuffer(values, np.int64)[unit] if len(values) else np.zeros(0)
            return np.bincount(doc, own, len(of)).astype(np.int64)

        own_a = np.frombuffer(aligner.n_a, np.int64) if len(aligner.n_a) else np.zeros(0, np.int64)
        self.ok = (size > 0) & (np.bincount(doc, own_a[unit] < 0, len(of)) == 0)
        self.sums = [total(x) for x in (aligner.n_a, aligner.n_b, aligner.n_groups, aligner.n_links)]
        self.texts = [";".join(map(aligner.text.__getitem__, own)) for own in of]
        used = np.flatnonzero(np.bincount(unit, minlength=1))
        many = np.frombuffer(aligner.n_links, np.int64)[used] if len(used) else used
        keys, at = np.unique(np.frombuffer(b"".join([aligner.pairs[k] for k in used.tolist()]), "<i8"),
                             return_inverse=True)
        place = np.zeros(int(used.max(initial=-1)) + 1, np.int64)
        place[used] = np.arange(len(used))
        number = place[unit]
        links_of = many[number]                       # links of each unit, then of all units in a row
        ends = np.cumsum(links_of)
        link = np.repeat((np.cumsum(many) - many)[number] - (ends - links_of), links_of) + np.arange(links_of.sum())
        both, self.times = np.unique(np.repeat(doc, links_of) * max(1, len(keys)) + at[link], return_counts=True)
        self.doc, self.keys = both // max(1, len(keys)), keys[both % max(1, len(keys))]


def encode(docs: DataFrame, a: str = A_VOCABULARY, b: str = B_VOCABULARY,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of documents (their own sums; places in the block's pairs, and times) and of blocks
    (different pairs, and how many of the block's documents hold each)."""
    names = [f.split()[0] for f in ENCODED.split(", ")]
    types = [pa.int64(), pa.bool_(), *[pa.int64()] * 5, pa.string(), pa.binary(), pa.binary(),
             pa.list_(pa.int64()), pa.list_(pa.int64())]

    def rows_of(block: int, ids: list, ok, sums: list, digests: list, doc, keys, times) -> pa.RecordBatch:
        """doc, keys, times: a document's place, pair and its number there, ordered by document."""
        held = ok[doc] if len(doc) else np.zeros(0, bool)
        doc, times = doc[held], times[held]
        pairs, place = np.unique(keys[held], return_inverse=True)
        edges = np.searchsorted(doc, np.arange(len(ids) + 1)).tolist()
        rows = []
        for k, (doc_id, sha) in enumerate(zip(ids, digests)):
            if not ok[k]:
                rows.append((block, True, doc_id, 0, 0, 0, 0, "", b"", b"", None, None))
                continue
            own = slice(edges[k], edges[k + 1])
            rows.append((block, True, doc_id, *[int(x[k]) for x in sums], sha,
                         place[own].astype("<u4").tobytes(), times[own].astype("<u4").tobytes(), None, None))
        rows.append((block, False, None, 0, 0, 0, 0, None, None, None, pairs, np.bincount(place, minlength=len(pairs))))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def short(aligner: Aligner, block: int, ids: list, texts: list, unsafe: set) -> pa.RecordBatch:
        of = aligner.numbers(texts, unsafe)
        t = Tally(aligner, [own if text else [] for own, text in zip(of, texts)])
        shas = [hashlib.sha256(x.encode()).hexdigest() for x in t.texts]
        return rows_of(block, ids, t.ok, t.sums, shas, t.doc, t.keys, t.times)

    def long(aligner: Aligner, block: int, doc_id, text: str) -> pa.RecordBatch:
        sha, ok, sums = hashlib.sha256(), True, np.zeros(4, np.int64)
        keys, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for k, part in enumerate(aligner.long_numbers(text)):
            t = Tally(aligner, [part])
            ok = ok and bool(t.ok[0])
            sha.update((";" * bool(k) + t.texts[0]).encode())
            sums += [int(x[0]) for x in t.sums]
            keys, at = np.unique(np.concatenate([keys, t.keys]), return_inverse=True)
            times = np.bincount(at, np.concatenate([times, t.times]), len(keys)).astype(np.int64)
        return rows_of(block, [doc_id], np.asarray([ok]), sums[:, None], [sha.hexdigest()],
                       np.zeros(len(keys), np.int64), keys, times)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        from pyspark import TaskContext
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        key = re.sub(r"\W", "_", f"aligner_{a}_{b}")
        aligner = worker_cache(key, lambda: Aligner(tokenizer_path(a), tokenizer_path(b)), large=True)
        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.string()), "")
            unsafe = odd_rows(texts, UNSAFE)
            ids, texts = batch.column(0).to_pylist(), texts.to_pylist()
            at, size = 0, 0
            for k, text in enumerate([*texts, ""]):
                if k > at and (k == len(texts) or size + len(text) > BLOCK_BYTES):
                    aligner.turn()
                    if k - at == 1 and len(texts[at]) > LONG_TEXT:
                        yield long(aligner, block, ids[at], texts[at])
                    else:
                        yield short(aligner, block, ids[at:k], texts[at:k], {u - at for u in unsafe if at <= u < k})
                    block, at, size = block + 1, k, 0
                size += len(text) + 64 if len(text) <= LONG_TEXT else BLOCK_BYTES

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(work, ENCODED)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, n, best): documents that hold the id pair, and whether no pair of its A id has more."""
    each = blocks.select(F.inline(F.arrays_zip("pairs", "docs"))).withColumnsRenamed({"pairs": "pair", "docs": "n"})
    sums = materialise(each.groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    a_id = F.shiftrightunsigned("pair", 32)
    top = sums.groupBy(a_id.alias("a")).agg(F.max("n").alias("top"))
    return sums.withColumn("a", a_id).join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def align(docs: DataFrame, a: str = A_VOCABULARY, b: str = B_VOCABULARY,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's token, group and link numbers, with the corpus-wide counts of its links."""
    rows = materialise(encode(docs, a, b, id_col, text_col), "aligned")
    blocks = rows.where(~F.col("is_doc"))
    place = blocks.select("block", F.posexplode("pairs").alias("place", "pair"))
    known = place.join(pair_counts(blocks), "pair").select(F.col("block").alias("owner"), "place", "n", "best")
    own = rows.where("is_doc").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256",
                                      "places", "times")

    def look_up(docs_of: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        n, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        n[pairs["place"].to_numpy()] = pairs["n"].to_numpy()
        best[pairs["place"].to_numpy()] = pairs["best"].to_numpy()
        n_best, total = [], []
        for at, times in zip(docs_of["places"], docs_of["times"]):
            at, times = np.frombuffer(at, "<u4"), np.frombuffer(times, "<u4").astype(np.int64)
            n_best.append(int((best[at] * times).sum()))
            total.append(int((n[at] * times).sum()))
        out = docs_of.drop(columns=["block", "places", "times"]).assign(n_best=n_best, count_sum=total)
        return out[[f.split()[0] for f in ALIGNED.split(", ")]]

    return own.groupBy("block").cogroup(known.groupBy("owner")).applyInPandas(look_up, ALIGNED)
