"""Sinks (K1-K6) and the ingestion ledger."""

from __future__ import annotations

import re
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlens.operators.schema import ensure_columns


def write_dataset(df: DataFrame, path: str, partition_by=(), mode: str = "overwrite") -> str:
    """K1/K2: Parquet (snappy), optionally partitioned (e.g. 'ano', 'eh_ti')."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def export_csv(df: DataFrame, path: str, sep: str = ";", header: bool = True,
               compression: str | None = None, encoding: str = "UTF-8") -> str:
    """K4/K6: delimited export; the codec decides the file extension."""
    w = df.write.mode("overwrite").option("sep", sep).option("header", str(header).lower()) \
          .option("encoding", encoding)
    if compression:
        w = w.option("compression", compression)
    w.csv(path)
    return path


def export_with_count(df: DataFrame, path: str, **options) -> int:
    """K4: export and the number of rows of the exported table (a count reads no column)."""
    export_csv(df, path, **options)
    return df.count()


BOM = "\ufeff"


def write_report(df: DataFrame, path: str, fmt: str = "json", stamp: str | None = None) -> str:
    """K5: a small metrics table as JSON, or as CSV with a byte-order mark before the header
    (spreadsheets then read UTF-8).  `stamp` (a time) is added to the folder's name."""
    if stamp:
        path = f"{path}_{re.sub('[^0-9]', '', stamp)}"
    w = df.coalesce(1).write.mode("overwrite")
    if fmt == "csv":
        first, *rest = df.columns
        df = df.withColumnRenamed(first, BOM + first)
        w = df.coalesce(1).write.mode("overwrite").option("header", "true")
    w.format(fmt).save(path)
    return path


def consolidate(frames: list[DataFrame], forced: dict | None = None) -> DataFrame:
    """K3: the first frame's columns are the contract; later frames are aligned
    by name (missing -> null, extras dropped); `forced` columns always exist."""
    contract = list(frames[0].columns)
    for c in (forced or {}):
        if c not in contract:
            contract.append(c)
    out = None
    for f in frames:
        f, _ = ensure_columns(f, forced or {})
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out.select(*contract)


OPEN_FILES = 128


def write_text(df: DataFrame, col: str, path: str, partition_by=(), compression: str = "none") -> str:
    """Lines of text, in a folder for each value of `partition_by`.  A task keeps up to `OPEN_FILES` files open, so
    the lines are sorted by folder only where there are more."""
    spark, files = df.sparkSession, "spark.sql.maxConcurrentOutputFileWriters"
    w = df.select(col, *partition_by).write.mode("overwrite").option("compression", compression)
    if partition_by:
        w = w.partitionBy(*partition_by)
    before = spark.conf.get(files, None)
    spark.conf.set(files, OPEN_FILES)
    try:
        w.text(path)
    finally:
        spark.conf.set(files, before) if before is not None else spark.conf.unset(files)
    return path


def write_zip_archives(df: DataFrame, col: str, path: str, member: str = "dados.txt",
                       encoding: str = "ISO-8859-1") -> str:
    """Fixture sink: every partition writes one .zip holding its lines, batch by
    batch; returns the folder (an absolute path or URI in shared storage).  The
    file is named by the partition, so a repeated task writes it anew."""
    from pyarrow import fs as pafs
    uri = path if ":" in path.split("/")[0] else f"file://{path}"
    if uri.startswith("file:") and not re.match("file:/+[^/]", uri):
        raise ValueError(f"an absolute path is needed: {path}")
    filesystem, root = pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))
    filesystem.create_dir(root, recursive=True)

    def _write(batches):
        from pyarrow import fs as pafs_
        from pyspark import TaskContext
        fsys, base = pafs_.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))
        n, part = 0, TaskContext.get().partitionId()
        with fsys.open_output_stream(f"{base}/part-{part:05d}.zip") as fh, \
                zipfile.ZipFile(fh, "w", zipfile.ZIP_DEFLATED) as z, z.open(member, "w", force_zip64=True) as out:
            for pdf in batches:
                n += len(pdf)
                out.write("".join(f"{x}\n" for x in pdf[col]).encode(encoding, "replace"))
        yield pd.DataFrame({"n": [n]})

    df.select(col).mapInPandas(_write, "n long").collect()   # one count per partition
    return path


# ---------------------------------------------------------------------------
# ingestion ledger
# ---------------------------------------------------------------------------

def latest_status(ledger: DataFrame, key: str = "nome") -> DataFrame:
    """Latest entry per input: status, total attempts, last time."""
    return ledger.groupBy(key).agg(F.max_by("status", "quando").alias("status"),
                                   F.sum("tentativas").alias("tentativas"),
                                   F.max("quando").alias("ultimo"))


def pending(inputs: DataFrame, ledger: DataFrame, key: str = "nome") -> DataFrame:
    """Inputs not done yet = inputs anti-joined with successful entries
    (failures are always retried)."""
    done = latest_status(ledger, key).filter(F.col("status") == "success").select(key)
    return inputs.join(done, key, "left_anti")


def purge_older_than(ledger: DataFrame, days: int) -> DataFrame:
    """Keep entries newer than `days` before the latest entry."""
    mx = ledger.agg(F.max("quando").alias("_mx"))
    j = ledger.join(F.broadcast(mx), how="inner")   # one-row scalar
    return j.filter(F.col("quando") >= F.col("_mx") - F.make_interval(days=F.lit(days))).drop("_mx")


def drop_failures(ledger: DataFrame) -> DataFrame:
    """Forget failures so they are retried."""
    return ledger.filter(F.col("status") != "failed")


def failures_by_origin(ledger: DataFrame) -> DataFrame:
    """Failed inputs per origin."""
    f = ledger.filter(F.col("status") == "failed")
    return f.groupBy("origem").agg(F.count(F.lit(1)).alias("falhas"),
                                   F.countDistinct("nome").alias("arquivos"),
                                   F.max("quando").alias("ultima"))


def name_collisions(ledger: DataFrame, key: str = "nome") -> DataFrame:
    """Base names with more than one entry."""
    return ledger.groupBy(key).agg(F.count(F.lit(1)).alias("entradas"),
                                   F.countDistinct("origem").alias("origens")) \
                 .filter(F.col("entradas") > 1)
