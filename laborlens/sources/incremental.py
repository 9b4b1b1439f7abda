"""Consolidation of only what is new (K2, K3), into Parquet partitioned by year and segment.

A manifest names the files that a dataset holds, with size and time.  A run takes the files that are
not in it, or that changed; reads them; and writes only the partitions they touch: rows that those
partitions hold from other files, and the new rows.  Dynamic partition overwrite leaves all
other partitions' files as they are, and a run without new files writes nothing.  Touched
partitions are compacted: their old and new files become files of about ``target_bytes``.

Data are written before the manifest, and every row names its file, so a run that was stopped
between the two is simply made good by the next: the rows of the file are replaced, not doubled.
A file whose rows moved to other partitions is also taken out of those that held it before.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laborlens.operators.schema import ensure_columns
from laborlens.session import materialise

SOURCE = "_arquivo"
MANIFEST = "arquivo string, tamanho long, alterado long, rodada int, linhas long, particoes array<string>"
TARGET_BYTES = 128 << 20


@dataclass
class Increment:
    """What a run did."""
    run: int
    files: int
    rows: int
    partitions: list


def listed(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """(arquivo, tamanho, alterado, caminho) of the files below a folder; their contents are not read.
    ``arquivo`` is the name that the rows of a scan have in ``_metadata.file_path``."""
    found = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", pattern).load(folder))
    return found.select(F.col("_metadata.file_path").alias("arquivo"), F.col("length").alias("tamanho"),
                        F.unix_micros(F.col("modificationTime")).alias("alterado"), F.col("path").alias("caminho"))


def _held(spark: SparkSession, path: str) -> DataFrame | None:
    """What was written there, None if nothing was."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def manifest(spark: SparkSession, target: str) -> DataFrame:
    """The last entry of each file; empty before the first run."""
    runs = _held(spark, f"{target}/manifesto")
    if runs is None:
        return spark.createDataFrame([], MANIFEST)
    last = runs.groupBy("arquivo").agg(
        F.max_by(F.struct("tamanho", "alterado", "rodada", "linhas", "particoes"), "rodada").alias("e"))
    return last.select("arquivo", "e.*")


def data(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(f"{target}/dados")


def _part_name(keys: list[str]):
    """Text that names a row's partition, as its folder does."""
    return F.concat_ws("/", *[F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit("null"))) for k in keys])


def consolidate(spark: SparkSession, folder: str, target: str, keys: list[str], read=None,
                forced: dict | None = None, target_bytes: int = TARGET_BYTES, pattern: str = "*.parquet") -> Increment:
    """One run: takes what is new in ``folder`` into ``target``.

    ``read(paths)`` gives the files' rows (default: Parquet by name); the columns of the first run are the
    contract: later files are aligned to them, missing ones null, others dropped; ``forced`` columns
    (name -> type) always exist.
    """
    known = manifest(spark, target)
    last = known.agg(F.coalesce(F.max("rodada"), F.lit(0))).first()[0]
    new = materialise(listed(spark, folder, pattern).join(known.select("arquivo", "tamanho", "alterado"),
                                                          ["arquivo", "tamanho", "alterado"], "left_anti"), "new")
    paths = [r[0] for r in new.select("caminho").collect()]               # names of new files only
    if not paths:
        return Increment(last, 0, 0, [])
    rows = (read or (lambda p: spark.read.option("mergeSchema", "true").parquet(*p)))(paths)
    rows = rows.withColumn(SOURCE, F.col("_metadata.file_path"))
    rows, _ = ensure_columns(rows, forced or {})
    held = _held(spark, f"{target}/dados")
    if held is not None:
        rows = rows.select(*[F.col(c).cast(held.schema[c].dataType).alias(c) if c in rows.columns
                             else F.lit(None).cast(held.schema[c].dataType).alias(c) for c in held.columns])
    fresh = materialise(rows.withColumn("_part", _part_name(keys)), "fresh")
    per_file = fresh.groupBy(SOURCE).agg(F.count(F.lit(1)).alias("linhas"),
                                         F.array_sort(F.collect_set("_part")).alias("particoes"))
    before = (known.join(new.select("arquivo"), "arquivo").select(F.explode("particoes").alias("_part")))
    touched = materialise(fresh.select("_part").union(before).distinct(), "touched")  # one row a partition
    parts = sorted(r[0] for r in touched.collect())
    if held is not None:
        # only the touched partitions of the dataset are read: their key values are literals
        wanted = _part_name(keys).isin(parts)
        kept = held.where(wanted).join(new.select(F.col("arquivo").alias(SOURCE)), SOURCE, "left_anti")
        fresh = materialise(fresh.drop("_part").unionByName(kept), "merged")
    else:
        fresh = fresh.drop("_part")
    _write(spark, fresh, target, keys, target_bytes)
    gone = set(parts) - {r[0] for r in fresh.select(_part_name(keys)).distinct().collect()}
    for part in gone:                                        # partitions that the changed files left empty
        _drop(spark, f"{target}/dados/{part.replace('=null', '=__HIVE_DEFAULT_PARTITION__')}")
    entry = (new.join(per_file.withColumnRenamed(SOURCE, "arquivo"), "arquivo", "left")
             .select("arquivo", "tamanho", "alterado", F.lit(last + 1).alias("rodada"),
                     F.coalesce("linhas", F.lit(0)).alias("linhas"),
                     F.coalesce("particoes", F.expr("CAST(array() AS array<string>)")).alias("particoes")))
    n = per_file.agg(F.coalesce(F.sum("linhas"), F.lit(0))).first()[0]
    entry.coalesce(1).write.mode("append").parquet(f"{target}/manifesto")
    return Increment(last + 1, len(paths), n, parts)


def _drop(spark: SparkSession, path: str) -> None:
    """Removes the folder of an emptied partition of the dataset."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _write(spark: SparkSession, rows: DataFrame, target: str, keys: list[str], target_bytes: int) -> None:
    """Overwrites the partitions that ``rows`` holds.  Rebalancing by the keys splits what is
    larger than ``target_bytes`` in the shuffle and joins what is smaller."""
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size, None)
    spark.conf.set(size, target_bytes)
    try:
        (rows.hint("rebalance", *keys).write.option("partitionOverwriteMode", "dynamic").mode("overwrite")
         .partitionBy(*keys).parquet(f"{target}/dados"))
    finally:
        spark.conf.set(size, before) if before is not None else spark.conf.unset(size)
