"""Structured Streaming forms of ingestion (S14) and the monthly feed counts.

* `ingest_files`: a file-source stream over a landing folder, processed with
  `trigger(availableNow=True)` into the Parquet file sink.  The checkpoint records which
  files are done and the sink's log which files belong to a finished batch, so a re-run
  picks up only new files and a repeated batch leaves no duplicates.
* `windowed_moves`: hires / exits per event-time window with a watermark, in append mode:
  a window is written once, when the watermark closes it, and its state goes.
All state and outputs live under the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _finish(stream: DataFrame, out: str, checkpoint: str) -> str:
    q = (stream.writeStream.format("parquet").outputMode("append").option("path", out)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def ingest_files(spark: SparkSession, landing: str, schema: StructType, out: str, checkpoint: str,
                 transform=None, fmt: str = "parquet") -> str:
    """Process every not-yet-seen file of `landing` once (availableNow)."""
    stream = spark.readStream.format(fmt).schema(schema).load(landing)
    return _finish(stream if transform is None else transform(stream), out, checkpoint)


def windowed_moves(stream: DataFrame, ts: str = "ts", window: str = "1 day",
                   watermark: str = "2 days") -> DataFrame:
    """Hire / exit counts per event-time window and IT flag (streaming plan)."""
    return (stream.withWatermark(ts, watermark)
            .groupBy(F.window(ts, window).alias("janela"), "eh_ti")
            .agg(F.count(F.when(F.col("eh_admissao"), 1)).alias("admissoes"),
                 F.count(F.when(F.col("eh_demissao"), 1)).alias("demissoes")))


def run_windowed(spark: SparkSession, landing: str, schema: StructType, out: str,
                 checkpoint: str, transform, **kw) -> str:
    """Run `windowed_moves` over what has landed; windows that the watermark has not
    closed yet stay in the state for the next run."""
    stream = transform(spark.readStream.format("parquet").schema(schema).load(landing))
    agg = windowed_moves(stream, **kw)
    return _finish(agg.select(F.col("janela.start").alias("inicio"), "eh_ti", "admissoes", "demissoes"),
                   out, checkpoint)
