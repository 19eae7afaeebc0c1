"""Connected components by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinequarry.plans.scratch import settle


def connected_components(links: DataFrame) -> DataFrame:
    """node, label of every node of ``links`` (a, b): label is the smallest node reachable.

    Every round is one written table, so lineage stays short and a lost
    executor repeats a round at most. Hub nodes only meet partial minima and
    joins that Spark can split.
    """
    edges = settle(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = settle(edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")))
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        met = labels.join(near, "node").select("node", F.col("label").alias("before"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
        moved = settle(met.join(up, "label", "left").select("node", "before", F.least("label", F.coalesce("root", "label")).alias("label")))
        labels = moved.select("node", "label")
        if not moved.where("label <> before").limit(1).count():
            return labels
