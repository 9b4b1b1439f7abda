"""Byte-level BPE ids of many texts, each different chunk encoded once.

A text is cut into chunks where the tokenizer's own split surely ends a token: before a space
that a word follows, and around runs of other white space.  The ids of a text are the
ids of its chunks in a row.  Most texts are cut by splitting at spaces, many at once, and their pieces
numbered by Arrow; texts with long runs of white space are cut by a pattern.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_CHUNKS = 600_000
LONG_TEXT = 1 << 20          # longer texts are cut in portions
LONG_CHUNK = 200             # longer chunks are not kept
SLICE_BYTES = 8 << 20        # text cut at once

#: The characters that Unicode calls white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"

#: The same for Arrow's patterns.
WHITE_RE2 = (r"[\t\n\x0b\x0c\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")

CHUNK = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")

#: Runs of white space that a cut before every space and line end would break.
LONG_RUN = f"{WHITE_RE2}{{3}}|{WHITE_RE2}{{2}}$"

#: A word of Latin letters, perhaps after a space, and the signs that end it.
WORD = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\\[-`{-~]*)")


def byte_alphabet() -> dict:
    """The printable character that stands for each byte in byte-level vocabularies:
    printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: b for b in own} | {b: 256 + k for k, b in enumerate(rest)}


def tokenizer_path(name: str) -> str:
    """A file name of the installed vocabularies, or a path of one's own."""
    if "/" in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


def portions(chunks: Iterable, size: int = 1 << 17) -> Iterator[list]:
    """A long sequence in lists of at most ``size``."""
    part = []
    for c in chunks:
        part.append(c)
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part


class Pieces(dict):
    """What ``make`` returns for each piece of text, kept for the next time.

    Two generations bound the memory: the older is dropped when the younger is full.
    """

    def __init__(self, make, size: int = CACHE_CHUNKS):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, piece: str):
        value = self.old.get(piece)
        if value is None:
            value = self.make(piece)
        if len(piece) <= LONG_CHUNK:
            self[piece] = value
        return value

    def turn(self) -> None:
        """To be called between texts."""
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()


def odd_rows(texts: pa.Array, odd: str) -> set:
    """Places of the texts that a cut at every space and line end would break."""
    return set(pc.indices_nonzero(pc.match_substring_regex(texts, odd)).to_pylist())


def cut(text: str) -> list:
    """Pieces of a text, split at spaces and before line ends.  The first piece stands as it
    is; a later one follows a space unless it begins with a line end."""
    return text.replace("\n", " \n").split(" ")


def chunk_of(piece: str) -> str:
    """The chunk that a later piece stands for."""
    return piece if piece[:1] == "\n" else " " + piece


class ByteIds:
    """Ids of texts by a byte-level BPE vocabulary file.

    With ``plain`` the special tokens' strings in a text are ordinary text; otherwise a text
    that holds one goes through the whole tokenizer.
    """

    def __init__(self, path: str, plain: bool = False):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.special = [] if plain else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merges = self.tokenizer.model.tokenize
        self.shown = byte_alphabet()
        self.parts = Pieces(self.part)
        self.pieces = Pieces(lambda piece: self.chunk(chunk_of(piece)))

    def part(self, part: str) -> bytes:
        """Ids of what the tokenizer's split leaves whole."""
        if part.isascii() and part.isprintable():
            text = part.replace(" ", chr(self.shown[0x20]))
        else:
            text = part.encode("utf-8").decode("latin-1").translate(self.shown)
        return array("I", [t.id for t in self.merges(text)]).tobytes()

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def chunk(self, chunk: str) -> bytes:
        """Ids of one chunk as little-endian unsigned 32-bit numbers."""
        line = chunk[:1] == "\n" and len(chunk) > 1
        word = WORD.fullmatch(chunk, int(line))
        if word is None:
            return self.whole(chunk) if chunk else b""
        ids = self.parts[word[1]]
        if word[2]:
            ids += self.parts[word[2]]
        return self.parts["\n"] + ids if line else ids

    def text(self, text: str) -> bytes:
        """Ids of one text that isn't cut at every space."""
        if any(s in text for s in self.special):
            return self.whole(text)
        return b"".join(b"".join([self.chunk(m.group()) for m in part])
                        for part in portions(CHUNK.finditer(text)))

    def many(self, texts: pa.Array) -> list:
        """Ids of texts cut at every space and line end: each different piece is looked up once."""
        rows = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        starts = rows.offsets.to_numpy().astype(np.int64)
        starts, pieces = starts - starts[0], rows.flatten()
        first = pieces.take(pa.array(starts[:-1])).to_pylist()
        named = pieces.dictionary_encode()
        number = named.indices.to_numpy().astype(np.int64)
        ids = list(map(self.pieces.__getitem__, named.dictionary.to_numpy(zero_copy_only=False)))
        number[starts[:-1]] = len(ids) + np.arange(len(first))     # a text's first piece stands as it is
        ids += map(self.chunk, first)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        pool = np.frombuffer(b"".join(ids), "<u4")
        own = size[number]
        ends = np.cumsum(own)
        place = np.repeat((np.cumsum(size) - size)[number] - (ends - own), own)
        place += np.arange(len(place))
        out, edges = pool[place], np.concatenate([[0], ends])[starts]
        return [out[a:e].tobytes() for a, e in zip(edges[:-1].tolist(), edges[1:].tolist())]

    def encode(self, texts: pa.Array) -> list:
        """The ids of each text, as bytes; a null text has none."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        size = pc.binary_length(texts).to_numpy().astype(np.int64)
        alone = odd_rows(texts, LONG_RUN) | set(np.flatnonzero(size > LONG_TEXT).tolist())
        for s in self.special:
            alone |= set(pc.indices_nonzero(pc.match_substring(texts, s)).to_pylist())
        out: list = [None] * len(texts)
        for k in sorted(alone):
            out[k] = self.text(texts[k].as_py())
            self.turn()
        rest = np.delete(np.arange(len(texts)), sorted(alone))
        for some in np.split(rest, np.flatnonzero(np.diff(np.cumsum(size[rest]) // SLICE_BYTES)) + 1):
            if not len(some):
                continue
            for k, ids in zip(some.tolist(), self.many(texts.take(pa.array(some)))):
                out[k] = ids
            self.turn()
        return out

    def turn(self) -> None:
        self.parts.turn()
        self.pieces.turn()
