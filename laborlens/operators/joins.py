"""Join operators.

Broadcast policy: only *fixed* dimensions (state table, education tables,
minimum-wage table, threshold grid — sizes known in advance, independent of the
data) are broadcast explicitly, and aggregates only after their rows were counted.
Other data-derived sides are joined plainly and AQE decides at runtime from real
sizes (broadcast under ``spark.sql.autoBroadcastJoinThreshold``, sort-merge above
it), so nothing that grows with the data is ever forced into memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laborlens.operators.aggregates import join_null_safe

# Hard cap on what `dimension` may broadcast (rows); fixed tables are far below it.
MAX_BROADCAST_ROWS = 100_000


def dimension(spark: SparkSession, mapping: dict, key: str, value: str,
              key_type: str = "int", value_type: str = "string") -> DataFrame:
    """A fixed lookup table (dict) as a small DataFrame (L1)."""
    if len(mapping) > MAX_BROADCAST_ROWS:
        raise ValueError("dimension too large to broadcast")
    rows = [(k, v) for k, v in mapping.items()]
    return spark.createDataFrame(rows, f"{key} {key_type}, {value} {value_type}")


def lookup(df: DataFrame, dim: DataFrame, on: str | list[str], how: str = "left") -> DataFrame:
    """L1: equi lookup against a fixed, bounded dimension -> broadcast hash join."""
    return df.join(F.broadcast(dim), on, how)


def int_range(df: DataFrame, partition: list[str], col: str) -> DataFrame:
    """Integer densification — one row per value min..max per partition
    (`sequence` + `explode` over the small min/max table)."""
    mm = df.groupBy(*partition).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    return mm.select(*partition, F.explode(F.sequence("_lo", "_hi")).alias(col))


def enrich(left: DataFrame, right: DataFrame, keys: list[str], suffix: str) -> DataFrame:
    """L2: left join on `keys` (null matches null), right measures suffixed.  The right side is
    an aggregate: its rows are counted, and up to MAX_BROADCAST_ROWS it is broadcast, so
    that the left rows aren't shuffled on a few hundred keys; a larger one is joined plainly."""
    if right.count() <= MAX_BROADCAST_ROWS:
        right = F.broadcast(right)
    rn = {c: f"{c}{suffix}" for c in right.columns if c not in keys}
    return join_null_safe(left, right.withColumnsRenamed(rn), keys, "left")
