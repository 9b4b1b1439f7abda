"""Connected components of a link table, in rounds of joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from laborlens.llm.common import materialise

MAX_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root: its smallest node.

    Each round looks at the grandparents of a node's neighbours and hooks the
    node, and the node's parent, to the smallest of them (the FastSV scheme);
    rounds grow with the logarithm of a component's width.  Every step is an
    equi-join or a minimum with map-side combine; no component meets in one
    task.  Labels are written to the shared folder after each round.
    """
    both = materialise(links.select("a", "b").union(links.select("b", "a"))
                       .where(F.col("a") != F.col("b")).distinct(), "links")
    labels = materialise(both.groupBy(F.col("a").alias("node"))
                         .agg(F.least(F.col("node"), F.min("b")).alias("root")), "labels")
    for _ in range(MAX_ROUNDS):
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("grand"))
        grand = labels.join(up, "root").select("node", "root", "grand")
        near = (both.join(grand.select(F.col("node").alias("b"), "grand"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("grand").alias("near")))
        seen = (grand.join(near, "node")
                .select("node", "root", F.least("grand", "near").alias("best")))
        offer = seen.select(F.explode(F.array(
            F.struct(F.col("node"), F.col("best"), F.col("root").alias("was")),
            F.struct(F.col("root").alias("node"), F.col("best"),
                     F.lit(None).cast(labels.schema["node"].dataType).alias("was")))).alias("o"))
        after = materialise(offer.groupBy(F.col("o.node").alias("node"))
                            .agg(F.min("o.best").alias("root"), F.max("o.was").alias("was")), "labels")
        labels = after.select("node", "root")
        if after.where(F.col("root") != F.col("was")).isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
