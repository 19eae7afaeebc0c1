"""Exact nearest neighbours that skip blocks which can't hold one.

On unit vectors the angle is a metric. Rows go to the nearest of some pivots
and, by their angle to it, into rings; the triangle inequality bounds how near
a query can be to any row of a ring. Each query's most promising blocks are
compared first, and of all others only those whose bound reaches the k-th
score found. A block has a bounded number of rows, however many are alike.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinequarry.functions.vectors import _matrices, best_pairs
from cinequarry.plans.broadcasts import checked
from cinequarry.plans.scratch import settle

#: Pivots, rows they are chosen from, rings around each, rows of a block and queries that meet one at once.
PIVOTS, SAMPLE, RINGS, ROWS, QUERIES = 64, 4096, 8, 2048, 2048
#: Rounding of angles and scores that a bound allows for.
SLACK = 1e-6


@dataclass(frozen=True)
class Compared:
    """Pairs of a query and a row that there are, and how many of them were compared."""

    there: int
    compared: int


def choose_pivots(sample: np.ndarray, most: int) -> np.ndarray:
    """Rows of a sample of unit vectors, each as far as can be from those before it."""
    chosen = [0]
    near = sample @ sample[0]
    while len(chosen) < min(most, len(sample)):
        at = int(near.argmin())
        if near[at] > 1 - 1e-9:  # all are like one of them
            break
        chosen.append(at)
        near = np.maximum(near, sample @ sample[at])
    return sample[chosen]


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def pruned_nearest(corpus: DataFrame, queries: DataFrame, *, k: int, digits: int = 6, exclude_self: bool = True, pivots: int = PIVOTS, rings: int = RINGS, rows: int = ROWS) -> tuple[DataFrame, Compared]:
    """(query_id, id, score, rank as vectors.nearest() gives them; what was compared) of ``corpus`` and ``queries`` (id, vector).

    Only vectors of the commonest width among the queries are pruned; the
    queries must be of one width, and rows of another never match them.
    """
    spark = corpus.sparkSession
    widths = {r["w"]: r["n"] for r in queries.where("vector IS NOT NULL").groupBy(F.size("vector").alias("w")).agg(F.count("*").alias("n")).collect()}
    widths.pop(0, None)
    if len(widths) > 1:
        raise ValueError(f"queries of {len(widths)} widths: ask for each on its own")
    kinds = dict(queries.dtypes)["id"], dict(corpus.dtypes)["id"]
    out_schema = f"query_id {kinds[0]}, id {kinds[1]}, score double"
    if not widths:
        return spark.createDataFrame([], f"{out_schema}, rank long"), Compared(0, 0)
    width = next(iter(widths))
    own = corpus.where((F.size("vector") == width) & F.exists("vector", lambda x: x != 0)).select("id", "vector")
    drawn = _matrices(own.orderBy(F.xxhash64("id")).limit(SAMPLE).toPandas())
    if not drawn:
        return spark.createDataFrame([], f"{out_schema}, rank long"), Compared(0, 0)
    centres = spark.sparkContext.broadcast(choose_pivots(drawn[0][2], pivots))
    wide = np.pi / rings

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            for _, ids, matrix in _matrices(frame):
                angle = _angles(matrix, centres.value)
                pivot = angle.argmin(axis=1)
                at = angle[np.arange(len(pivot)), pivot]
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("id").type), pa.array(list(matrix), pa.list_(pa.float64())), pa.array(pivot.astype(np.int32)), pa.array((at / wide).astype(np.int32)), pa.array(at)], names=["id", "vector", "pivot", "ring", "angle"])

    placed = settle(own.mapInArrow(place, f"id {kinds[1]}, vector array<double>, pivot int, ring int, angle double"))
    sizes = placed.groupBy("pivot", "ring").agg(F.count("*").alias("n"))
    parted = settle(placed.join(checked(sizes), ["pivot", "ring"]).withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / rows)).cast("int")).drop("n"))
    # Blocks are at most pivots times rings, and one more for every ``rows`` rows.
    found = parted.groupBy("pivot", "ring", "part").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("n"))
    blocks = settle(found.withColumn("block", F.xxhash64("pivot", "ring", "part")))
    shape = blocks.agg(F.sum("n").alias("rows"), F.count("*").alias("blocks")).first()
    shells = blocks.groupBy("pivot", "ring").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
    shell = spark.sparkContext.broadcast(shells.toPandas())  # pivots times rings
    asked = settle(queries.where(F.size("vector") == width).select(F.col("id").alias("query_id"), "vector"))

    def bounds(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shell.value
        pivot, low, high, n = (table[c].to_numpy() for c in ("pivot", "low", "high", "n"))
        for batch in batches:
            for _, ids, matrix in _matrices(batch.to_pandas().rename(columns={"query_id": "id"})):
                angle = _angles(matrix, centres.value)[:, pivot]
                least = np.maximum(np.maximum(angle - high, low - angle), 0.0)
                bound = np.cos(np.maximum(least - SLACK, 0.0))
                order = np.argsort(-bound, axis=1, kind="stable")
                before = np.cumsum(n[order], axis=1) - n[order]
                early = np.zeros(bound.shape, bool)
                np.put_along_axis(early, order, before < 2 * k + 1, axis=1)
                q, b = np.nonzero(bound > 0)
                yield pa.RecordBatch.from_arrays([pa.array(ids[q], batch.schema.field("query_id").type), pa.array(pivot[b]), pa.array(table["ring"].to_numpy()[b]), pa.array(bound[q, b]), pa.array(early[q, b])], names=["query_id", "pivot", "ring", "bound", "early"])

    waves = settle(asked.mapInArrow(bounds, f"query_id {kinds[0]}, pivot int, ring int, bound double, early boolean"))

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return best_pairs(a.rename(columns={"query_id": "id"}), b, k, digits, exclude_self)

    def scored(chosen: DataFrame) -> tuple[DataFrame, int]:
        pairs = settle(chosen.select("query_id", "pivot", "ring").join(checked(blocks.select("pivot", "ring", "block", "part", "n")), ["pivot", "ring"]))
        many = settle(pairs.groupBy("block").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("groups")))
        sides = pairs.join(checked(many), "block").withColumn("group", F.pmod(F.xxhash64("query_id"), F.col("groups")).cast("int"))
        left = sides.join(asked, "query_id").select("query_id", "vector", "block", "group")
        groups = many.join(checked(blocks.select("pivot", "ring", "part", "block")), "block").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
        right = parted.join(checked(groups.select("pivot", "ring", "part", "block", "group")), ["pivot", "ring", "part"]).select("id", "vector", "block", "group")
        told = settle(left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInPandas(compare, out_schema))
        return told, int(pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])

    one, first = scored(waves.where("early"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    least = one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    rest = waves.where("NOT early").join(checked(settle(least)), "query_id", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - F.lit(10.0**-digits)))
    two, second = scored(rest)
    ranked = one.unionByName(two).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
    return ranked, Compared(int(shape["rows"]) * asked.count(), first + second)
