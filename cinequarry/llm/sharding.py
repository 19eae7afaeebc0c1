"""Sharding by histogram sort.

Each row has a 64-bit key: the upper 40 bits hash its text, so copies are
neighbours in key order, and the lower 24 bits hash its id, so that even a
group of copies with a third of all bytes can be cut. Splitters are found by
iteration: every round broadcasts a few probe keys for each open splitter,
partitions count exact bytes and rows between probes, and the sums (one row a
probe) narrow the brackets, until each splitter meets the tolerance or its
bracket holds no further boundary. Only then are the rows exchanged, once.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import as_long, partitions, settle

GROUP_BITS = 24
_SPAN = 1 << 63


@dataclass
class _Bracket:
    """Keys and what lies below them, around the place where a splitter must go."""

    target: float
    lo: int
    lo_bytes: int
    lo_rows: int
    hi: int
    hi_bytes: int
    hi_rows: int
    step: int = 1 << GROUP_BITS

    def nearest(self) -> tuple[int, int, int, float]:
        low, high = self.target - self.lo_bytes, self.hi_bytes - self.target
        return (self.lo, self.lo_bytes, self.lo_rows, low) if low <= high else (self.hi, self.hi_bytes, self.hi_rows, high)

    def probes(self, many: int) -> list[int]:
        """Keys strictly inside, multiples of the step, evenly spaced."""
        first, last = self.lo // self.step + 1, (self.hi - 1) // self.step
        n = min(many, last - first + 1)
        return [(first + (last - first) * i // max(1, n - 1)) * self.step for i in range(n)] if n > 0 else []


def _histogram(keys: DataFrame, probes: np.ndarray) -> pd.DataFrame:
    """Exact bytes and rows of each gap between probes; a row a gap, summed inside tasks first."""

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
        for b in batches:
            gap = np.searchsorted(probes, b["key"].to_numpy(), side="right")
            np.add.at(size, gap, b["size"].to_numpy())
            rows += np.bincount(gap, minlength=len(rows))
        at = np.flatnonzero(rows)
        yield pd.DataFrame({"gap": at, "size": size[at], "rows": rows[at]})

    partial = keys.select("key", "size").mapInPandas(count, "gap long, size long, rows long")
    found = partial.groupBy("gap").agg(F.sum("size").alias("size"), F.sum("rows").alias("rows")).toPandas()
    full = pd.DataFrame({"size": 0, "rows": 0}, index=range(len(probes) + 1))
    full.loc[found["gap"], ["size", "rows"]] = found[["size", "rows"]].to_numpy()
    return full


def find_splitters(keys: DataFrame, parts: int, tolerance: float, cut_tolerance: float = 0.0, probes_each: int = 16, rounds: int = 64) -> list[tuple[int, int]]:
    """(key, rows below it) of the parts-1 splitters of ``keys`` (key, size).

    A splitter is first sought between groups of equal texts; it cuts a group
    only where no place between groups comes within ``cut_tolerance`` (at least
    ``tolerance``) of its target.
    """
    total = _histogram(keys, np.empty(0, np.int64)).iloc[0]
    size, rows = int(total["size"]), int(total["rows"])
    if not rows:
        return [(_SPAN - 1, 0)] * (parts - 1)
    allowed = tolerance * size / parts
    brackets = [_Bracket(size * (i + 1) / parts, 0, 0, 0, _SPAN - 1, size, rows) for i in range(parts - 1)]
    known: dict[int, tuple[int, int]] = {0: (0, 0), _SPAN - 1: (size, rows)}
    for _ in range(rounds):
        wanted: set[int] = set()
        for b in brackets:
            if b.nearest()[3] <= allowed:
                continue
            new = b.probes(probes_each)
            if not new and b.step > 1:
                if b.nearest()[3] <= max(allowed, cut_tolerance * size / parts):
                    continue
                b.step = 1
                new = b.probes(probes_each)
            if b.hi_rows - b.lo_rows > 1:  # else no further boundary is inside
                wanted.update(new)
        if not wanted:
            break
        probes = np.array(sorted(wanted), np.int64)
        below = _histogram(keys, probes - 1).cumsum()  # rows with key < probe
        for p, (b_size, b_rows) in zip(probes.tolist(), below.iloc[:-1].itertuples(index=False, name=None), strict=True):
            known[p] = (int(b_size), int(b_rows))
        order = sorted(known)
        sizes = [known[p][0] for p in order]  # never falls with the key
        for b in brackets:
            at = bisect_right(sizes, b.target)
            if order[at - 1] > b.lo:
                b.lo, (b.lo_bytes, b.lo_rows) = order[at - 1], known[order[at - 1]]
            if at < len(order) and order[at] < b.hi:
                b.hi, (b.hi_bytes, b.hi_rows) = order[at], known[order[at]]
    out = [(b.nearest()[0], b.nearest()[2]) for b in brackets]
    return sorted(out)


def shard_by_bytes(docs: DataFrame, *, shards: int = 8, text: str = "text", doc_id: str = "doc_id", tolerance: float = 0.002, cut_tolerance: float = 0.02, ranges_per_shard: int | None = None) -> DataFrame:
    """All columns of ``docs`` plus size, text_crc32, shard and slot.

    size is the UTF-8 bytes of the text plus 1 (null texts: 1). Shards get
    near-equal bytes: each splitter lies within ``tolerance`` of a shard's
    bytes of its place, or at the nearest row boundary where rows are larger
    than that. Copies of a text share a shard unless only a cut through their
    group comes within ``cut_tolerance``. slot numbers the rows of a shard from 0 on.

    A shard is made of key ranges of near-equal bytes, one a task, so tasks
    don't grow with the number of shards fixed. Rows equal in text and id
    can't be told apart and stay together, in any order. Null ids sort first.
    Very long texts are rows like all others, whole.
    An empty table gives no rows. Input columns named like an output column
    are replaced.
    """
    spark = docs.sparkSession
    own = F.coalesce(F.col(text), F.lit(""))
    fresh = ("size", "text_crc32", "shard", "slot")
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in fresh])
    group = F.shiftright(F.xxhash64(own), GROUP_BITS).bitwiseAND((1 << 39) - 1)
    key = F.shiftleft(group, GROUP_BITS).bitwiseOR(F.xxhash64(as_long(doc_id), F.lit("id")).bitwiseAND((1 << GROUP_BITS) - 1))
    keyed = kept.withColumns({"__key": key.cast(LongType()), "size": (F.octet_length(own) + 1).cast(LongType()), "text_crc32": F.crc32(own.cast("binary"))})
    keys = settle(keyed.select(F.col("__key").alias("key"), "size"))
    shard_cuts = find_splitters(keys, shards, tolerance, cut_tolerance)
    each = ranges_per_shard or max(1, -(-partitions(spark) // shards))
    fine = find_splitters(keys, shards * each, 0.25) if each > 1 else []
    cuts = sorted({k for k, _ in shard_cuts} | {k for k, _ in fine})
    below = dict(zip(cuts, _histogram(keys, np.array(cuts, np.int64) - 1)["rows"].cumsum().tolist()[:-1], strict=True))
    starts = [0, *cuts]
    shard_keys = [k for k, _ in shard_cuts]
    shard_of = [int(np.searchsorted(shard_keys, s, side="right")) for s in starts]
    first_row = [0, *[below[c] for c in cuts]]
    shard_first = [first_row[min((i for i, s in enumerate(shard_of) if s == n), default=0)] for n in range(shards)]
    base = [first_row[i] - shard_first[s] for i, s in enumerate(shard_of)]
    bounds = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def range_of(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, k.to_numpy(), side="right").astype(np.int32))

    # One row a range: as many as tasks, whatever the data.
    placing = F.broadcast(spark.createDataFrame(list(zip(range(len(starts)), shard_of, base, strict=True)), "__range int, shard int, __base long"))
    placed = keyed.withColumn("__range", range_of("__key"))
    order = Window.partitionBy("__range").orderBy("__key", as_long(doc_id), "text_crc32")
    numbered = placed.withColumn("__row", F.row_number().over(order)).join(placing, "__range")
    return numbered.withColumn("slot", F.col("__base") + F.col("__row") - 1).drop("__key", "__range", "__base", "__row")


def crc32_of(text: str) -> int:
    """What text_crc32 holds, for checks on the driver."""
    return zlib.crc32(text.encode())
