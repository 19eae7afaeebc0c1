"""Fusion of ranked channels: rows (query_id, id, signal, score)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinequarry.plans.scratch import settle

RANK_SHIFT = 60

# Channels and their weights by intent; a channel that is not listed doesn't run.
PROFILES = {
    "auto": {"lexical": 0.30, "semantic": 0.70, "transcript": 0.05, "metadata": 0.05},
    "fact": {"lexical": 0.30, "semantic": 0.40, "transcript": 0.10, "metadata": 0.05, "embedding": 0.15},
    "speech": {"transcript": 0.60, "lexical": 0.25, "semantic": 0.15},
    "semantic": {"semantic": 0.45, "embedding": 0.35, "lexical": 0.20},
    "creative": {"lexical": 0.30, "semantic": 0.45, "transcript": 0.05, "metadata": 0.20},
    "similar": {"semantic": 0.45, "embedding": 0.35, "lexical": 0.20},
}
#: Weights of description, tags, objects, actions and mood where they differ from 1.
FIELD_WEIGHTS = {"fact": {"objects": 1.2, "actions": 1.2, "mood": 0.8}}


def pool(channels: DataFrame, size: int) -> DataFrame:
    """The best ``size`` rows of every query and signal, so that what is fused doesn't grow with the corpus."""
    return _ranked(channels).where(F.col("rank") <= size).drop("rank")


def _ranked(channels: DataFrame) -> DataFrame:
    order = Window.partitionBy("query_id", "signal").orderBy(F.desc("score"), "id")
    return channels.withColumn("rank", F.row_number().over(order))


def _ranked_apart(channels: DataFrame) -> DataFrame:
    """_ranked() of any number of rows: sorted in ranges, so that no query's channel is one task's, each row counted from its range's first."""
    order = [F.desc("score"), F.asc("id")]
    ranges = settle(channels.repartitionByRange("query_id", "signal", *order).withColumn("__part", F.spark_partition_id()))
    parts = ranges.groupBy("query_id", "signal", "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("query_id", "signal").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("query_id", "signal", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = F.row_number().over(Window.partitionBy("query_id", "signal", "__part").orderBy(*order))
    return ranges.withColumn("rank", within).join(F.broadcast(starts), ["query_id", "signal", "__part"]).withColumn("rank", F.col("__start") + F.col("rank")).drop("__part", "__start")


def _weight(weights: Mapping[str, float]) -> Column:
    pairs = [x for name, w in sorted(weights.items()) for x in (F.lit(name), F.lit(float(w)))]
    return F.coalesce(F.create_map(*pairs)[F.col("signal")], F.lit(0.0)) if pairs else F.lit(0.0)


def _total(parts: DataFrame) -> DataFrame:
    """Sum parts in the order of their signals, so the same rows give the same float on every run."""
    gathered = parts.groupBy("query_id", "id").agg(F.array_sort(F.collect_list(F.struct("signal", "part"))).alias("parts"))
    return gathered.select("query_id", "id", F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["part"]).alias("score"))


def weighted_blend(channels: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """query_id, id, score: weighted sums of scores over zero."""
    return _total(channels.withColumn("part", _weight(weights) * F.col("score"))).where("score > 0")


def rrf(channels: DataFrame, shift: int = RANK_SHIFT, apart: bool = False) -> DataFrame:
    """query_id, id, score: sums of 1 / (shift + rank), ranks from 1 with ties by id; ``apart`` for channels of very many rows."""
    return _total((_ranked_apart if apart else _ranked)(channels).withColumn("part", 1 / (F.lit(shift) + F.col("rank"))))


def weighted_rrf(channels: DataFrame, weights: Mapping[str, float], shift: int = RANK_SHIFT, apart: bool = False) -> DataFrame:
    """rrf() with a weight a channel; channels without a positive one are left out."""
    used = channels.where(_weight(weights) > 0)
    return _total((_ranked_apart if apart else _ranked)(used).withColumn("part", _weight(weights) / (F.lit(shift) + F.col("rank"))))


def legacy_rrf(channels: DataFrame, shift: int = RANK_SHIFT) -> DataFrame:
    """rrf() over positive scores alone."""
    return rrf(channels.where("score > 0"), shift)


def fuse(channels: DataFrame, intent: str, size: int | None = 200) -> DataFrame:
    """The default fusion of an intent: plain ranks for auto and fact, weighted ones for the others.

    ``size`` cuts every channel to its best rows first, see pool(); None ranks all.
    """
    weights = PROFILES[intent]
    used = channels.where(F.col("signal").isin(*weights))
    used = used if size is None else pool(used, size)
    apart = size is None
    return rrf(used, apart=apart) if intent in ("auto", "fact") else weighted_rrf(used, weights, apart=apart)
