"""Dimension-sharded Lloyd against a plain loop in Python's integers."""

from __future__ import annotations

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from cinequarry.llm import centroid_clustering
from cinequarry.llm.centroid_clustering import cluster_vectors

SCHEMA = "vec_id long, embedding array<double>, cluster string, distance string, id string"


def plain(rows, dims, k, rounds):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    centroids = [list(v) for _, v in sorted(kept, key=lambda x: (name(x[0]), x[1]))[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda v: min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c))
    for _ in range(rounds):
        own: dict[int, list] = {}
        for _, v in kept:
            own.setdefault(nearest(v), []).append(v)
        for c, vs in own.items():
            centroids[c] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    found = [(i, nearest(v), far(v, centroids[nearest(v)])) for i, v in kept]
    inertia: dict[int, int] = {}
    for _, c, d in found:
        inertia[c] = inertia.get(c, 0) + d
    sha = lambda c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
    return sorted(((i is None, i or 0, c, d, inertia[c], sum(inertia.values()), sha(c)) for i, c, d in found))


def got(df):
    return sorted((r["vec_id"] is None, r["vec_id"] or 0, *r[1:]) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    around = [[r.uniform(-1, 1) for _ in range(10)] for _ in range(5)]
    out = [(i, [x + r.gauss(0, 0.2) for x in r.choice(around)]) for i in range(300)]
    out += [(1000 + i, [0.5] * 10) for i in range(40)]  # copies, and ties with what follows
    out += [(1100 + i, [0.25] * 5 + [-0.25] * 5) for i in range(40)]
    out += [(7, [0.1] * 10), (7, [0.1] * 10), (None, [0.3] * 10), (2**60 + 1, [0.2] * 10)]
    out += [(2000, None), (2001, []), (2002, [0.1] * 9), (2003, [0.1] * 11), (2004, [0.1] * 9 + [None]), (2005, [0.1] * 9 + [math.nan]), (2006, [math.inf] + [0.1] * 9)]
    return out


@pytest.mark.parametrize(("width", "chunk", "broadcast"), [(3, 7, 4096), (16, 1000, 4096), (4, 50, 0)])
def test_plain_loop(spark, rows, monkeypatch, width, chunk, broadcast):
    monkeypatch.setattr(centroid_clustering, "BROADCAST_CHUNKS", broadcast)
    table = spark.createDataFrame([(i, v, "clash", "clash", "clash") for i, v in rows], SCHEMA).repartition(5)
    assert got(cluster_vectors(table, dims=10, k=6, rounds=3, width=width, chunk=chunk)) == plain(rows, 10, 6, 3)


def test_few_and_no_vectors(spark, rows):
    few = [(1, [0.5] * 10), (2, [0.5] * 10), (3, [-0.5] * 10)]
    assert got(cluster_vectors(spark.createDataFrame([(i, v, "", "", "") for i, v in few], SCHEMA), dims=10)) == plain(few, 10, 16, 3)
    assert cluster_vectors(spark.createDataFrame([], SCHEMA), dims=10).count() == 0
    assert cluster_vectors(spark.createDataFrame([(1, None, "", "", "")], SCHEMA), dims=10).count() == 0


def test_large_components(spark):
    r = random.Random(4)
    rows = [(i, [r.uniform(-2e6, 2e6) for _ in range(4)]) for i in range(60)]  # beyond exact products of doubles
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(cluster_vectors(table, dims=4, k=5, width=2)) == plain(rows, 4, 5, 3)
    with pytest.raises(Exception, match="too large"):
        cluster_vectors(table.withColumn("embedding", F.transform("embedding", lambda x: x * 1000)), dims=4)
