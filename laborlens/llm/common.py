"""Helpers shared by the operators of this package."""

from __future__ import annotations

import gc
import sys
import types
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from laborlens.session import materialise  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(col: Column) -> Column:
    """CRC-32 of an id written as text (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def held_out(col: Column, mod: int, rest: int) -> Column:
    return id_crc(col) % F.lit(mod) == F.lit(rest)


def worker_cache(key: str, make: Callable, large: bool = False):
    """A value that lives as long as the Python worker process.

    Functions of this package are shipped by value, so module globals start
    anew in every task; a registered module does not.  A worker keeps one ``large`` value
    only, as it goes on to serve the tasks of other operators.
    """
    store = sys.modules.setdefault("_laborlens_worker", types.ModuleType("_laborlens_worker"))
    if large:
        free_worker(key)
    if not hasattr(store, key):
        setattr(store, key, make())
    return getattr(store, key)


def free_worker(but: str | None = None) -> None:
    """Drops the large value that this worker keeps, unless its key is ``but``; then notes ``but`` as the large one."""
    store = sys.modules.setdefault("_laborlens_worker", types.ModuleType("_laborlens_worker"))
    held = getattr(store, "_large", None)
    if held not in (None, but) and hasattr(store, held):
        delattr(store, held)
        gc.collect()
    store._large = but


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, rest: int,
                    bound: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, y) of about ``bound`` labelled training rows at most.

    A classifier's fit may use a bounded, documented sample.  Rows whose
    CRC-32 remainder is held out never enter; conflicting labels of one id
    count as their largest; null labels are left out.  Rows are kept by a hash
    of the id, so the sample is the same on every run, and its ids are small
    enough (``bound``) to be broadcast.
    """
    known = (labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y"))
             .where(F.col("_id").isNotNull() & F.col("_y").isNotNull())
             .where(~held_out(F.col("_id"), mod, rest))
             .groupBy("_id").agg(F.max("_y").alias("_y")))
    n = known.count()
    if n > bound:
        known = known.where(F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(1 << 30))
                            < int(bound / n * (1 << 30)))
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return (own.join(F.broadcast(known), "_id")
            .select("_id", F.coalesce("_text", F.lit("")).alias("_text"), "_y"))
