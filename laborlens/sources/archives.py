"""Archives and text files of any size as a Spark data source.

``spark.read.format("linhas_arquivadas")`` gives the lines of all members of zip archives (and of plain text
files) as rows (arquivo, membro, value).  A compressed member is one partition and is read as a stream, so
its size does not matter; a member that is stored uncompressed, and a plain file, is cut into byte ranges
of ``bytes`` each, a line belonging to the range it begins in.  Only the archives' directories are read
for planning.  Filters on ``arquivo`` and ``membro`` (=, IN, begins, ends or contains) are pushed down: members that don't
match are not opened.

Options: ``path`` (a folder, read recursively, or a file; a URI that pyarrow's filesystems open),
``encoding``, ``bytes``, ``maior`` ("true": only the largest .txt member of each archive, the rule of S13).
Stores that only Spark itself can open are read by ``files.read_zip_lines``.
"""

from __future__ import annotations

import re
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualTo, In, InputPartition, StringContains,
                                    StringEndsWith, StringStartsWith)

FORMAT = "linhas_arquivadas"
RANGE_BYTES = 128 << 20
CHUNK = 4 << 20
SCHEMA = "arquivo string, membro string, value string"
SUFFIXES = (".zip", ".txt", ".csv")


def opened(uri: str) -> tuple:
    """(filesystem, path within it, what to put before a path to get its URI)."""
    from pyarrow import fs
    if ":" not in uri.split("/")[0]:
        uri = f"file://{uri}"
    uri = re.sub("^file:/+", "file:///", uri)
    store, root = fs.FileSystem.from_uri(uri)
    return store, root, uri[:uri.rindex(root)] if root in uri else ""


@dataclass
class Part(InputPartition):
    """Bytes of one member: a stream of a compressed one, else a range of its file."""
    file: str
    member: str
    begin: int
    end: int
    first: int               # where the member's bytes begin in the file
    packed: bool


class Lines(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LineReader:
        return LineReader(dict(self.options))


class LineReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.encoding = options.get("encoding", "ISO-8859-1")
        self.range = int(options.get("bytes", RANGE_BYTES))
        self.largest = options.get("maior", "false").lower() == "true"
        self.tests: list = []

    def pushFilters(self, filters: list) -> Iterator:
        kinds = {EqualTo: lambda f: lambda v: v == f.value, In: lambda f: lambda v: v in f.value,
                 StringStartsWith: lambda f: lambda v: v.startswith(f.value),
                 StringEndsWith: lambda f: lambda v: v.endswith(f.value),
                 StringContains: lambda f: lambda v: f.value in v}
        for f in filters:
            if type(f) in kinds and f.attribute in (("arquivo",), ("membro",)):
                self.tests.append((f.attribute[0], kinds[type(f)](f)))
            else:
                yield f

    def wanted(self, file: str, member: str) -> bool:
        return all(test(file if column == "arquivo" else member) for column, test in self.tests)

    def partitions(self) -> list:
        from pyarrow import fs
        store, root, before = opened(self.path)
        info = store.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        out = []
        for f in sorted((f for f in found if f.type == fs.FileType.File and f.path.lower().endswith(SUFFIXES)
                         and not f.base_name.startswith((".", "_"))), key=lambda f: f.path):
            file = before + f.path
            if f.path.lower().endswith(".zip"):
                out += self._members(store, f.path, file)
            elif self.wanted(file, f.base_name):
                out += self._ranges(file, f.base_name, 0, f.size)
        return out

    def _members(self, store, path: str, file: str) -> list:
        out = []
        with store.open_input_file(path) as raw, zipfile.ZipFile(raw) as z:
            members = [m for m in z.infolist() if not m.is_dir() and m.file_size]
            if self.largest:
                texts = [m for m in members if m.filename.lower().endswith(".txt")]
                members = [max(texts, key=lambda m: m.file_size)] if texts else []
            for m in members:
                if not self.wanted(file, m.filename):
                    continue
                if m.compress_type == zipfile.ZIP_STORED:
                    raw.seek(m.header_offset + 26)
                    name, extra = struct.unpack("<HH", raw.read(4))
                    out += self._ranges(file, m.filename, m.header_offset + 30 + name + extra, m.file_size)
                else:
                    out.append(Part(file, m.filename, 0, m.file_size, 0, True))
        return out

    def _ranges(self, file: str, member: str, first: int, size: int) -> list:
        return [Part(file, member, at, min(at + self.range, size), first, False) for at in range(0, size, self.range)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        store, path, _ = opened(part.file)
        with store.open_input_file(path) as raw:
            if part.packed:
                with zipfile.ZipFile(raw) as z, z.open(part.member) as stream:
                    lines = _lines(iter(lambda: stream.read(CHUNK), b""))
                    yield from self._batches(part, lines)
            else:
                yield from self._batches(part, _range_lines(raw, part))

    def _batches(self, part: Part, lines: Iterator[list]) -> Iterator[pa.RecordBatch]:
        for some in lines:
            if some:
                text = [x.rstrip(b"\r").decode(self.encoding) for x in some]
                yield pa.RecordBatch.from_pydict({"arquivo": pa.array([part.file] * len(text)),
                                                  "membro": pa.array([part.member] * len(text)), "value": pa.array(text)})


def _lines(chunks: Iterator[bytes]) -> Iterator[list]:
    """Lines of a stream, some at a time; the last may lack its end."""
    rest: list = []
    for chunk in chunks:
        cut = chunk.split(b"\n")
        if len(cut) == 1:
            rest.append(chunk)
            continue
        cut[0] = b"".join([*rest, cut[0]])
        rest = [cut.pop()]
        yield cut
    last = b"".join(rest)
    if last:
        yield [last]


def _range_lines(raw, part: Part) -> Iterator[list]:
    """Lines that begin in the part's range.  The byte before the range tells whether one begins at its start."""
    size = part.end                                       # of the range; a line may go on behind it
    at = max(0, part.begin - 1)
    raw.seek(part.first + at)
    skip, done = part.begin > 0, False
    limit = [size]

    def chunks() -> Iterator[bytes]:
        here = at
        while True:
            if here >= limit[0]:
                return
            got = raw.read(min(CHUNK, limit[0] - here))
            if not got:
                return
            here += len(got)
            yield got

    # the line that begins last in the range ends behind it: read on to its end
    def extended() -> Iterator[bytes]:
        last = b""
        for c in chunks():
            last = c
            yield c
        if last and not last.endswith(b"\n"):
            while True:
                got = raw.read(1 << 16)
                if not got:
                    return
                end = got.find(b"\n")
                if end >= 0:
                    yield got[:end + 1]
                    return
                yield got

    for some in _lines(extended()):
        if skip and not done:
            some, done = some[1:], True
        yield some


def read_archives(spark: SparkSession, path: str, encoding: str = "ISO-8859-1", largest: bool = False,
                  range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(arquivo, membro, value): lines of all members of the archives and text files below ``path``."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Lines)
    return (spark.read.format(FORMAT).option("encoding", encoding).option("maior", str(largest).lower())
            .option("bytes", range_bytes).load(path))
