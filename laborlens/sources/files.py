"""Scans of raw files (S1-S13, S16): fixed-width, delimited, charset-probed,
separator-sniffed, header-less, zipped, multi-file, name-pruned, capped.

Every scan is a Spark read; the few driver-side steps touch metadata only
(a header line, a file list, one charset verdict per file).
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from laborlens.operators.schema import dedupe_names

def parse_layout(spec: dict) -> list[tuple[str, int, int]]:
    """Layout entries 'a,b' / 'a-b' / 'a:b' (1-based, inclusive) ->
    [(name, start, end)], reversed pairs swapped, invalid entries skipped."""
    out = []
    for name, raw in spec.items():
        if isinstance(raw, (tuple, list)) and len(raw) == 2:
            a, b = raw
        else:
            parts = re.split(r"\s*[,:\-]\s*", str(raw).strip())
            if len(parts) != 2 or not all(p.isdigit() for p in parts):
                continue
            a, b = int(parts[0]), int(parts[1])
        a, b = int(a), int(b)
        if a > b:
            a, b = b, a
        if a >= 1:
            out.append((name, a, b))
    return out


def read_lines(spark: SparkSession, paths, encoding: str = "ISO-8859-1", **opts) -> DataFrame:
    """Raw lines in a charset that keeps ASCII bytes: the text reader hands on the bytes
    of a line unchanged, and they are decoded here."""
    lines = spark.read.options(**opts).text(paths)
    return lines.select(F.decode(F.col("value").cast("binary"), encoding).alias("value"),
                        F.col("_metadata.file_path").alias("arquivo"))


def cut_fixed_width(lines: DataFrame, layout, keep=("arquivo",)) -> DataFrame:
    """Cut each line at the 1-based inclusive positions; trim; blank -> null."""
    cols = [F.nullif(F.trim(F.substring("value", s, e - s + 1)), F.lit("")).alias(n)
            for n, s, e in layout]
    return lines.select(*[c for c in keep if c in lines.columns], *cols)


def read_fixed_width(spark: SparkSession, paths, layout, encoding: str = "ISO-8859-1",
                     **opts) -> DataFrame:
    return cut_fixed_width(read_lines(spark, paths, encoding, **opts), layout)


def fixed_width_line(layout, values: dict) -> "F.Column":
    """Sink helper: one text line with each value right-aligned in its field."""
    pieces, pos = [], 1
    for name, s, e in sorted(layout, key=lambda t: t[1]):
        if s > pos:
            pieces.append(F.lit(" " * (s - pos)))
        v = values.get(name)
        w = e - s + 1
        pieces.append(F.lit(" " * w) if v is None
                      else F.lpad(F.coalesce(v.cast("string"), F.lit("")), w, " "))
        pos = e + 1
    return F.concat(*pieces)


def file_facts(spark: SparkSession, paths, glob: str | None = None, quote: str = '"') -> DataFrame:
    """One row per file, from one scan: is it UTF-8, does a quoted field span lines, the
    header line's bytes (the first line of the file's first block)."""
    lines = spark.read.options(**({"pathGlobFilter": glob} if glob else {})).text(paths).select(
        "value", F.col("_metadata.file_path").alias("arquivo"), F.col("_metadata.file_block_start").alias("_at"),
        F.monotonically_increasing_id().alias("_row"))
    odd = (F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))) % 2 == 1
    return lines.groupBy("arquivo").agg(
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.bool_or(odd).alias("multilinha"),
        F.min_by(F.col("value").cast("binary"), F.struct("_at", "_row")).alias("cabecalho"))


def split_header(line: str, sep: str, quote: str = '"') -> list[str]:
    """Field names of a header line; quotes may hold separators; duplicates get suffixes."""
    fields = next(csv.reader([line.lstrip("\ufeff")], delimiter=sep, quotechar=quote), [])
    return dedupe_names([f.strip() for f in fields])


def read_delimited(spark: SparkSession, paths, sep: str = ";", encoding: str | None = "UTF-8",
                   header: bool = True, names: list[str] | None = None,
                   quote: str = '"', glob: str | None = None) -> DataFrame:
    """Delimited text, all columns as strings.

    Every file has its own header, and columns are aligned by name; a missing column is
    null.  `encoding` None: each file's own (UTF-8 if all its lines are, else ISO-8859-1).
    Blank lines are skipped; lines with more fields than the header are dropped, shorter
    ones padded with null; quoted fields may span lines; leading blanks go.  Files are read
    in groups that share header, charset and form, so the plan grows with the variants,
    not with the files.
    """
    groups: dict = {}
    if header or encoding is None:
        for f in file_facts(spark, paths, glob, quote).collect():          # one row per file
            cs = encoding or ("UTF-8" if f["utf8"] else "ISO-8859-1")
            own = names or split_header(bytes(f["cabecalho"]).decode(cs, "replace"), sep, quote)
            groups.setdefault((cs, tuple(own), f["multilinha"]), []).append(f["arquivo"])
    else:
        groups[encoding, tuple(names), False] = paths
    out = None
    for (cs, own, spans), files in sorted(groups.items(), key=lambda g: g[0]):
        n = len(own)
        ddl = ", ".join(f"c{i} STRING" for i in range(n + 1))               # one spare field detects long lines
        reader = spark.read.schema(ddl).options(
            sep=sep, quote=quote, escape=quote, encoding=cs, header=str(header).lower(),
            multiLine=str(bool(spans)).lower(), mode="PERMISSIVE")
        if not (header or encoding is None) and glob:
            reader = reader.option("pathGlobFilter", glob)
        t = reader.csv(files).withColumn("arquivo", F.col("_metadata.file_path"))
        some = reduce(or_, [F.coalesce(F.trim(f"c{i}"), F.lit("")) != "" for i in range(n)])
        t = t.filter(F.col(f"c{n}").isNull() & some)
        t = t.select(*[F.ltrim(f"c{i}").alias(c) for i, c in enumerate(own)], "arquivo")
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def sniff_separator(spark: SparkSession, path: str, candidates=(";", ",", "\t"),
                    min_cols: int = 5, encoding: str = "UTF-8") -> str | None:
    """First candidate that splits the header line into > min_cols fields."""
    first = read_lines(spark, path, encoding).select("value").limit(1).first()
    if not first:
        return None
    for c in candidates:
        if len(first["value"].split(c)) > min_cols:
            return c
    return None


def detect_charsets(spark: SparkSession, paths, glob: str | None = None) -> DataFrame:
    """Per-file charset verdict over the whole file: valid UTF-8 -> 'UTF-8', else
    'ISO-8859-1'.  One aggregate per file — no file is ever held whole."""
    return file_facts(spark, paths, glob).select(
        F.col("arquivo").alias("path"), F.when(F.col("utf8"), "UTF-8").otherwise("ISO-8859-1").alias("charset"))


def year_from_name(col: str = "arquivo") -> "F.Column":
    """year = 4 digits after the quarter in a PNADC_QQYYYY name."""
    return F.regexp_extract(F.col(col), r"PNADC_\d{2}(\d{4})", 1).try_cast("int")


def flag_from_name(col: str = "arquivo") -> "F.Column":
    """S12: '..._nao_ti...' -> 0 (tested first), '..._ti...' -> 1, else null."""
    name = F.lower(F.regexp_extract(F.col(col), r"([^/]+)$", 1))
    return (F.when(name.rlike(r"nao[_-]?ti"), 0)
            .when(name.rlike(r"(^|[_-])ti([_.-]|$)"), 1))


def file_preview(lines: DataFrame, layout, number_field: str) -> DataFrame:
    """What a preview of a file's first rows would show, from all its rows: the number
    of lines, of lines as long as the layout, and the range of one numeric field."""
    width = max(e for _, _, e in layout)
    s, e = next((s, e) for n, s, e in layout if n == number_field)
    value = F.trim(F.substring("value", s, e - s + 1)).try_cast("int")
    return lines.groupBy(F.col("arquivo").alias("nome_arquivo")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.length("value") >= width, 1)).alias("validas"),
        F.min(value).alias("idade_min"), F.max(value).alias("idade_max"))


def multi_scan(spark: SparkSession, paths, fmt: str = "parquet", glob: str | None = None,
               recursive: bool = False) -> DataFrame:
    """File or directory or list; glob filter; recursive listing;
    parquet schemas merged by name."""
    r = spark.read.format(fmt)
    if fmt == "parquet":
        r = r.option("mergeSchema", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    return r.load(paths)


_ZIP_SCHEMA = StructType([StructField("arquivo", StringType()), StructField("membro", StringType()),
                          StructField("value", StringType())])


def _expand_archives(batches, encoding: str):
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                txt = [i for i in z.infolist() if i.filename.lower().endswith(".txt")]
                if not txt:
                    continue
                main = max(txt, key=lambda i: i.file_size)      # largest text member
                with z.open(main) as fh:
                    chunk = []
                    for raw in io.TextIOWrapper(fh, encoding=encoding, newline=""):
                        chunk.append(raw.rstrip("\r\n"))
                        if len(chunk) >= 50_000:
                            yield pd.DataFrame({"arquivo": path, "membro": main.filename, "value": chunk})
                            chunk = []
                    if chunk:
                        yield pd.DataFrame({"arquivo": path, "membro": main.filename, "value": chunk})


def read_zip_lines(spark: SparkSession, paths, encoding: str = "ISO-8859-1") -> DataFrame:
    """Archives -> lines of their largest .txt member.  One archive is one
    binaryFile row (one task); lines stream out in bounded batches."""
    b = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(paths)
    return b.select("path", "content").mapInPandas(lambda it: _expand_archives(it, encoding),
                                                   _ZIP_SCHEMA)


def canonical_archive_name(member: str = "membro", path: str = "arquivo") -> "F.Column":
    """S13 naming rule: strip a trailing _YYYYMMDD from the member stem, append
    the year found in the archive path."""
    stem = F.regexp_replace(F.regexp_extract(F.col(member), r"([^/]+)\.txt$", 1), r"_\d{8}$", "")
    year = F.regexp_extract(F.col(path), r"((?:19|20)\d{2})", 1)
    return F.concat(stem, F.when(year != "", F.concat(F.lit("_"), year)).otherwise(F.lit("")), F.lit(".txt"))
