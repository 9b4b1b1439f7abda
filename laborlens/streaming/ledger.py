"""The ingestion ledger as the state of a stream.

Each row of the stream is an attempt to ingest a file: its name, where it came from, when, and
how it ended.  The state holds one entry a file, as the ledger does: status, origin, failed attempts in a
row, and the time of the last entry.  An attempt is

* ``pular`` (skipped) if the file was ingested from the same origin: the entry stays as it is,
* ``novo`` (no entry), ``outra_origem`` (another origin) or ``repetir`` (it had failed) otherwise:
  a failure counts one attempt more, a success none.

An entry that is older than ``days`` when its file comes again counts as none; a timer at that age removes it
from the state, so the state holds only the files of that time.  Whether the timer or the
next attempt comes first does not change a decision.  The decisions go to a Parquet sink, whose log makes
a repeated batch write nothing twice; state, timers and log lie in the checkpoint folder.

The attempts of one file in one micro-batch are put in order of time (then ``chave``) in memory;
``files_per_batch`` bounds a micro-batch.  Rows without a name or a time are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

KEEP_DAYS = 30
DECISIONS = ("nome string, chave long, quando timestamp, origem string, decisao string, status string, "
             "tentativas int")
ENTRY = "status string, origem string, tentativas int, quando long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_US = 86_400_000_000


def decide(entry: tuple | None, origin: str, status: str, at: int, days: int) -> tuple:
    """(decision, entry afterwards) of one attempt at time ``at`` (microseconds).

    An entry is (status, origin, failed attempts, time)."""
    if entry is not None and at - entry[3] > days * DAY_US:
        entry = None
    if entry is not None and entry[0] == "success" and entry[1] == origin:
        return "pular", entry
    kind = "novo" if entry is None else "outra_origem" if entry[1] != origin else "repetir"
    tries = (entry[2] if entry is not None else 0) + 1 if status == "failed" else 0
    return kind, (status, origin, tries, at)


class FileLedger(StatefulProcessor):
    """State and timer of one file."""

    def __init__(self, days: int):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", ENTRY)

    def _expiry(self, entry: tuple) -> int:
        return (entry[3] + self.days * DAY_US) // 1000 + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.entry.get() if self.entry.exists() else None
        entry, out = before, []
        batch = pd.concat(list(rows)).sort_values(["quando", "chave"], kind="stable")
        times = batch["quando"].astype("datetime64[us]").astype("int64")
        for nth, origin, status, when, at in zip(batch["chave"], batch["origem"], batch["status"], batch["quando"], times):
            kind, entry = decide(entry, origin, status, int(at), self.days)
            out.append((key[0], nth, when, origin, kind, entry[0], entry[2]))
        if before is None or tuple(before) != tuple(entry):
            if before is not None:
                self.handle.deleteTimer(self._expiry(before))
            self.entry.update(entry)
            self.handle.registerTimer(self._expiry(entry))
        yield pd.DataFrame(out, columns=[f.split()[0] for f in DECISIONS.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.entry.exists() and self._expiry(self.entry.get()) <= expiredTimerInfo.getExpiryTimeInMs():
            self.entry.clear()
        return iter(())

    def close(self) -> None:
        pass


def run(spark: SparkSession, landing: str, out: str, checkpoint: str, days: int = KEEP_DAYS,
        watermark: str = "1 day", files_per_batch: int = 1000) -> DataFrame:
    """Decides all attempts that landed since the last run; returns the decisions of all runs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    schema = spark.read.parquet(landing).schema
    attempts = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
                .where("nome IS NOT NULL AND quando IS NOT NULL").withWatermark("quando", watermark))
    decisions = attempts.groupBy("nome").transformWithStateInPandas(
        FileLedger(days), DECISIONS, "Append", "EventTime")
    query = (decisions.writeStream.format("parquet").outputMode("append").option("path", out)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(DECISIONS).parquet(out)


def current(decisions: DataFrame) -> DataFrame:
    """The ledger itself: each file's entry after its last attempt that was not skipped."""
    order = F.struct("quando", "chave")
    return (decisions.where("decisao <> 'pular'").groupBy("nome")
            .agg(F.max_by(F.struct("status", "origem", "tentativas", "quando"), order).alias("e"),
                 F.count(F.lit(1)).alias("processados"))
            .select("nome", "e.*", "processados"))
