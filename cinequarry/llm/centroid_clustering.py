"""Centroid clustering by dimension-sharded Lloyd rounds, in exact integers.

Vectors are cut into blocks of columns. A task that reads a block holds the
centroids' slice of that block alone and computes exact partial distances; the
blocks of the same vectors meet by key, where the parts are added and the
nearest centroid is taken. The assignment goes back to the blocks, and each
block sums its own columns, from which its own slice of the next centroids
comes. Vectors travel in chunks of bounded size, so no key is hot, whatever
the clusters' sizes.

Kept are vectors of exactly ``dims`` components, none null, NaN or infinite.
Null and repeated ids keep their rows; ties go to the centroid of the smaller
number; a table without kept vectors gives no rows, and one with fewer than
``k`` as many clusters as vectors. Further columns are not read. A component
of 2**21 or more in size is an error, as squared distances would pass 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinequarry.plans.scratch import scratch_path, settle

from .common import as_long

#: Columns of a block, vectors of a chunk.
BLOCK, CHUNK = 16, 1024
#: Chunks whose assignment (4 KB each) may be broadcast; beyond, they meet their blocks in a shuffle.
BROADCAST_CHUNKS = 4096
#: Integers up to this size multiply exactly as doubles; the largest that are taken at all.
_FLOAT_MOST, _MOST = 1 << 20, 1 << 27
_SHARD = "block int, chunk long, ids array<long>, data binary"
_SHARD_ARROW = pa.schema([("block", pa.int32()), ("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("data", pa.binary())])
_RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def _kept(vectors: DataFrame, id_column: str, vector: str, dims: int, scale: int) -> DataFrame:
    """id, xs: the integers of the vectors that count."""
    v: Column = F.col(vector)
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    ints = vectors.where((F.size(v) == dims) & usable).select(as_long(id_column).alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("xs"))
    too_large = F.exists("xs", lambda x: F.abs(x) > _MOST)
    return ints.withColumn("xs", F.when(too_large, F.raise_error(F.lit("a vector's component is too large for exact distances in 64 bits"))).otherwise(F.col("xs")))


def _shards(kept: DataFrame, dims: int, width: int, chunk: int) -> DataFrame:
    """Blocks of columns of chunks of vectors, written by block. Block 0 carries the ids."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                xs = part.column("xs").flatten().to_numpy().reshape(part.num_rows, dims).astype("<i4")
                for b, first in enumerate(range(0, dims, width)):
                    ids = part.column("id").to_pylist() if b == 0 else None
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([np.ascontiguousarray(xs[:, first : first + width]).tobytes()])], schema=_SHARD_ARROW)
                number += 1

    spark = kept.sparkSession
    path = scratch_path(spark)
    kept.mapInArrow(cut, _SHARD).write.partitionBy("block").parquet(path)
    return spark.read.schema(_SHARD).parquet(path)


def _distances(xs: np.ndarray, slice_: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row to every centroid, over these columns."""
    if max(np.abs(xs).max(initial=0), np.abs(slice_).max(initial=0)) <= _FLOAT_MOST and xs.shape[1] <= 1 << 10:
        dots = (xs.astype(np.float64) @ slice_.T.astype(np.float64)).astype(np.int64)
    else:
        dots = xs.astype(np.int64) @ slice_.T
    return (xs.astype(np.int64) ** 2).sum(axis=1)[:, None] - 2 * dots + (slice_**2).sum(axis=1)[None, :]


def _assign(shards: DataFrame, centroids: np.ndarray, width: int, *, rows: bool) -> DataFrame:
    """chunk, clusters: the nearest centroid of each vector; or, with ``rows``, id, cluster, distance."""
    k = len(centroids)
    sc = shards.sparkSession.sparkContext
    slices = [sc.broadcast(np.ascontiguousarray(centroids[:, first : first + width])) for first in range(0, centroids.shape[1], width)]  # a task fetches those of its blocks

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data, i in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist(), range(batch.num_rows), strict=True):
                slice_ = slices[block].value
                parts = _distances(np.frombuffer(data, "<i4").reshape(-1, slice_.shape[1]), slice_)
                yield pa.RecordBatch.from_arrays([batch.column("chunk").slice(i, 1), batch.column("ids").slice(i, 1), pa.array([parts.tobytes()])], names=["chunk", "ids", "parts"])

    def nearest(keys: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(p, np.int64).reshape(-1, k) for p in table.column("parts").to_pylist())
        best = total.argmin(axis=1).astype(np.int32)  # the first of equals
        if not rows:
            return pa.table({"chunk": pa.array([keys[0].as_py()], pa.int64()), "clusters": pa.array([best.tobytes()])})
        ids = next(i for i in table.column("ids").to_pylist() if i is not None)
        return pa.table({"vec_id": pa.array(ids, pa.int64()), "cluster": pa.array(best), "distance": pa.array(total[np.arange(len(best)), best])})

    source = shards if rows else shards.withColumn("ids", F.lit(None).cast("array<long>"))
    met = source.select("block", "chunk", "ids", "data").mapInArrow(partial, "chunk long, ids array<long>, parts binary").groupBy("chunk")
    return met.applyInArrow(nearest, "vec_id long, cluster int, distance long" if rows else "chunk long, clusters binary")


def _updated(shards: DataFrame, assigned: DataFrame, centroids: np.ndarray, width: int) -> np.ndarray:
    """Each block's columns summed by cluster, and from them its slice of the next centroids; empty clusters stay."""
    k, dims = centroids.shape

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for block, data, clusters in zip(*(batch.column(c).to_pylist() for c in ("block", "data", "clusters")), strict=True):
                w = min(width, dims - block * width)
                total, count = held.setdefault(block, (np.zeros((k, w), np.int64), np.zeros(k, np.int64)))
                own = np.frombuffer(clusters, np.int32)
                np.add.at(total, own, np.frombuffer(data, "<i4").reshape(-1, w))
                count += np.bincount(own, minlength=k)
        for block, (total, count) in held.items():
            c, d = np.nonzero(np.broadcast_to(count[:, None] > 0, total.shape))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(d + block * width, pa.int32()), pa.array(total[c, d]), pa.array(count[c])], names=["cluster", "dim", "total", "count"])

    side = F.broadcast(assigned) if assigned.count() <= BROADCAST_CHUNKS else assigned
    parts = shards.select("block", "chunk", "data").join(side, "chunk").select("block", "data", "clusters").mapInArrow(sums, "cluster int, dim int, total long, count long")
    out = centroids.copy()
    for r in parts.groupBy("cluster", "dim").agg(F.sum("total").alias("total"), F.sum("count").alias("count")).collect():  # k times dims numbers
        out[r["cluster"], r["dim"]] = r["total"] // r["count"]
    return out


def cluster_vectors(vectors: DataFrame, *, id_column: str = "vec_id", vector: str = "embedding", dims: int = 64, k: int = 16, rounds: int = 3, scale: int = 64, seed: int = 1, width: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: a row for each kept vector.

    Components become floor(scale * x). Centroids start as the ``k`` vectors
    with the least sha256 of ``seed:id`` (ties, and null ids as empty: by the
    vector), move ``rounds`` times to the floored mean of their vectors, and
    the vectors are then assigned once more.
    """
    spark = vectors.sparkSession
    kept = settle(_kept(vectors, id_column, vector, dims, scale))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    start = kept.select(hashed.alias("h"), "xs").orderBy("h", "xs").limit(k).collect()
    if not start:
        return spark.createDataFrame([], _RESULT)
    centroids = np.array([r["xs"] for r in start], np.int64)
    shards = _shards(kept, dims, width, chunk)
    for _ in range(rounds):
        centroids = _updated(shards, settle(_assign(shards, centroids, width, rows=False)), centroids, width)
    final = settle(_assign(shards, centroids, width, rows=True))
    own = {r["cluster"]: int(r["s"]) for r in final.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    told = [(c, s, sum(own.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in own.items()]
    return final.join(F.broadcast(spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select(*(c.split()[0] for c in _RESULT.split(", ")))
