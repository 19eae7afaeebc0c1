"""Vector columns and batched exact nearest-neighbour search."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of query vectors up to which all go to the tasks at once, and rows of a block beyond.
SENT_BYTES, BLOCK, CORPUS_BLOCK = 64 << 20, 32_768, 65_536
#: Scores that are there at once and columns of them, rows that become objects at once, rows given back at once.
TILE, TILE_COLUMNS, SLICE, OUT_ROWS = 1 << 19, 2048, 2048, 50_000
#: Bytes of a cell's query vectors and their heads, and tasks of a grid at most; a task may have several cells, one after the other.
CELL_BYTES, MOST_TASKS = 32 << 20, 2_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: str | Column, b: str | Column, mismatch: float = 0.0) -> Column:
    """Cosine of two array columns; ``mismatch`` where sizes differ, a side is null or a norm is zero."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    lengths = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | a.isNull() | b.isNull() | (lengths == 0), F.lit(mismatch)).otherwise(dot(a, b) / lengths)


def unit(a: str | Column) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    return F.when(norm(a) > 0, F.transform(a, lambda x: x / norm(a))).otherwise(a)


def _matrices(frame: pd.DataFrame) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(width, ids, unit vectors as rows) of each width; vectors that are null or without length are left out."""
    frame = frame[frame["vector"].notna()]
    widths = frame["vector"].map(len).to_numpy() if len(frame) else np.empty(0, int)
    out = []
    for width in sorted(set(widths.tolist()) - {0}):
        own = frame[widths == width]
        matrix = np.stack(own["vector"].to_numpy()).astype(float)
        lengths = np.linalg.norm(matrix, axis=1)
        good = (lengths > 0) & np.isfinite(lengths)
        out.append((width, own["id"].to_numpy()[good], matrix[good] / lengths[good, None]))
    return out


class _Heads:
    """The k best positive pairs a query of what was met so far: k scores and ids a query, and tiles of scores of bounded size."""

    def __init__(self, queries: list, k: int, digits: int, exclude_self: bool) -> None:
        self.queries, self.k, self.digits, self.exclude_self = queries, k, digits, exclude_self
        self.scores = [np.zeros((len(ids), k)) for _, ids, _ in queries]  # 0: no pair
        self.ids: list[np.ndarray | None] = [None] * len(queries)
        self.short = [matrix.astype(np.float32) for _, _, matrix in queries]
        self.half = 0.5 * 10.0**-digits  # what rounds to a positive score is this at least
        # Products of unit vectors of single precision are off by (width + 4) * 2 ** -24 at most.
        self.slack = [1.1 * self.half + (width + 8) * 2.0**-24 for width, _, _ in queries]

    def meet(self, corpus: list) -> None:
        for at, (width, ids, _) in enumerate(self.queries):
            for other, own, vectors in corpus:
                if other != width or not len(ids) or not len(own):
                    continue
                if self.ids[at] is None:
                    self.ids[at] = np.full(self.scores[at].shape, own[0], own.dtype)
                order = np.argsort(own, kind="stable")  # so that ties go by id within a tile
                for c in range(0, len(own), TILE_COLUMNS):
                    some = order[c : c + TILE_COLUMNS]
                    step = max(1, TILE // len(some))
                    tile = own[some], vectors[some], vectors[some].astype(np.float32)
                    for q in range(0, len(ids), step):
                        self._tile(at, slice(q, q + step), *tile)

    def _near(self, at: int, rows: slice, vectors: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Rows, columns and exact scores of all pairs that single precision cannot rule out; None if these are many."""
        rough = self.short[at][rows] @ short.T
        least = (np.maximum(self.scores[at][rows][:, -1], 2 * self.half) - self.slack[at]).astype(np.float32)
        hot = np.flatnonzero(rough.max(axis=1) >= least)
        near = rough[hot] >= least[hot, None]
        if 16 * np.count_nonzero(near) > near.size:
            return None
        q, c = np.nonzero(near)
        q = hot[q]
        return q, c, np.round(np.einsum("ij,ij->i", self.queries[at][2][rows][q], vectors[c]), self.digits)

    def _tile(self, at: int, rows: slice, own: np.ndarray, vectors: np.ndarray, short: np.ndarray) -> None:
        k, best, named = self.k, self.scores[at][rows], self.ids[at][rows]
        asked, near = self.queries[at][1][rows], self._near(at, rows, vectors, short)
        if near is not None:
            q, c, some = near
            good = (some > 0) & (some >= best[q, -1])
            if self.exclude_self:
                good &= asked[q] != own[c]
            q, c, some = q[good], c[good], some[good]
        else:
            scores = np.round(self.queries[at][2][rows] @ vectors.T, self.digits)
            if self.exclude_self:
                scores[asked[:, None] == own[None, :]] = 0
            wanted = (scores > 0) & (scores >= best[:, -1:])
            many = np.flatnonzero(wanted.sum(axis=1) > k)
            if len(many):  # of these rows the k best, what ties with the last of them by id
                own_scores = scores[many]
                least = np.partition(own_scores, -k, axis=1)[:, -k][:, None]
                over, ties = own_scores > least, own_scores == least
                wanted[many] = over | ties & (np.cumsum(ties, axis=1) <= k - over.sum(axis=1, keepdims=True))
            q, c = np.nonzero(wanted)
            some = scores[q, c]
        if not len(q):
            return
        met, first, n = np.unique(q, return_index=True, return_counts=True)
        row, place = np.repeat(np.arange(len(met)), n), np.arange(len(q)) - np.repeat(first, n)
        found, other = np.zeros((len(met), n.max())), np.full((len(met), n.max()), own[0], own.dtype)
        found[row, place], other[row, place] = some, own[c]
        found, other = np.hstack([best[met], found]), np.hstack([named[met], other])
        by = other if other.dtype != object else np.unique(other, return_inverse=True)[1].reshape(other.shape)
        order = np.lexsort((by, -found), axis=1)[:, :k]
        best[met], named[met] = np.take_along_axis(found, order, 1), np.take_along_axis(other, order, 1)

    def found(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """query ids, ids and scores of the pairs, at most ``TILE`` at once."""
        step = max(1, TILE // self.k)
        for (_, ids, _), scores, named in zip(self.queries, self.scores, self.ids, strict=True):
            for lo in range(0, len(ids) if named is not None else 0, step):
                q, c = np.nonzero(scores[lo : lo + step] > 0)
                yield ids[lo + q], named[lo + q, c], scores[lo + q, c]

    def batches(self) -> Iterator[pa.RecordBatch]:
        for own in self.found():
            for lo in range(0, len(own[0]), OUT_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + OUT_ROWS]) for x in own], names=["query_id", "id", "score"])


def best_pairs(queries: pd.DataFrame, corpus: pd.DataFrame, k: int, digits: int, exclude_self: bool) -> pd.DataFrame:
    """query_id, id, score: the k best positive pairs a query of rows (id, vector) that fit a task."""
    heads = _Heads(_matrices(queries), k, digits, exclude_self)
    heads.meet(_matrices(corpus))
    found = [pd.DataFrame(dict(zip(("query_id", "id", "score"), own, strict=True))) for own in heads.found()]
    return pd.concat(found) if found else pd.DataFrame({"query_id": pd.Series(dtype="object"), "id": pd.Series(dtype="object"), "score": pd.Series(dtype="float64")})


def nearest(corpus: DataFrame, queries: DataFrame, *, k: int, digits: int = 6, exclude_self: bool = True, sent_bytes: int = SENT_BYTES, block: int = BLOCK) -> DataFrame:
    """query_id, id, score, rank: the k best rows of ``corpus`` (id, vector) for every row of ``queries``, exactly.

    Only positive scores count, rounded, ties by id; rows of another width
    than the query, null vectors and zero vectors never match. Query vectors
    of checked size go to the tasks, which read the corpus once; more of them
    meet the corpus in a grid of cells. A cell's query vectors, ``block`` or
    ``sent_bytes`` of them, come first, and its part of the corpus streams by.
    Either way a task keeps its own k best a query, and a tile of scores.
    """
    chosen = queries.where("vector IS NOT NULL").select("id", "vector")
    total = chosen.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("vector")), F.lit(0)).alias("x"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("w")).first()
    kinds = dict(queries.dtypes)["id"], dict(corpus.dtypes)["id"]
    out_schema = f"query_id {kinds[0]}, id {kinds[1]}, score double"
    if 8 * (total["x"] + total["n"]) <= sent_bytes and 16 * k * total["n"] <= sent_bytes:
        sent = _matrices(chosen.toPandas())

        def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            heads = _Heads(sent, k, digits, exclude_self)
            for batch in batches:
                for part in _slices(batch):
                    heads.meet(_matrices(part.to_pandas()))
            yield from heads.batches()

        out = corpus.select("id", "vector").mapInArrow(search, out_schema)
    else:
        block = max(1, min(block, CELL_BYTES // (8 * max(1, total["w"]) + 16 * k)))
        cells = max(1, -(-corpus.count() // CORPUS_BLOCK))
        # The corpus is read once for each block of queries, so these are large, unless there would be fewer cells than cores.
        few = min(-(-total["n"] // 4096), -(-2 * corpus.sparkSession.sparkContext.defaultParallelism // cells))
        rows = max(1, few, -(-total["n"] // block))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        q = chosen.select(F.pmod(F.xxhash64("id"), F.lit(rows)).cast("int").alias("row"), every(cells).alias("cell"), F.lit(0).alias("side"), F.col("id").alias("query_id"), F.lit(None).cast(kinds[1]).alias("id"), "vector")
        c = corpus.where("vector IS NOT NULL").select(every(rows).alias("row"), F.pmod(F.xxhash64("id"), F.lit(cells)).cast("int").alias("cell"), F.lit(1).alias("side"), F.lit(None).cast(kinds[0]).alias("query_id"), "id", "vector")
        spread = min(rows * cells, MOST_TASKS)
        met = q.unionByName(c).repartition(spread, "row", "cell").sortWithinPartitions("row", "cell", "side")

        def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A cell's rows follow each other, its queries first."""
            now, asked, heads = None, [], None
            for batch in batches:
                keys = np.stack([batch.column(name).to_numpy(zero_copy_only=False) for name in ("row", "cell", "side")])
                ends = [*(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
                lo = 0
                for hi in ends:
                    if hi == lo:
                        continue
                    run, cell, side = batch.slice(lo, hi - lo), (keys[0, lo], keys[1, lo]), keys[2, lo]
                    lo = hi
                    if cell != now:
                        if heads is not None:
                            yield from heads.batches()
                        now, asked, heads = cell, [], None
                    if side == 0:
                        asked.append(_matrices(run.select(["query_id", "vector"]).rename_columns(["id", "vector"]).to_pandas()))
                        continue
                    if heads is None:
                        heads, asked = _Heads(_stacked(asked), k, digits, exclude_self), []
                    for part in _slices(run.select(["id", "vector"])):
                        heads.meet(_matrices(part.to_pandas()))
            if heads is not None:
                yield from heads.batches()

        out = met.mapInArrow(stream, out_schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of few rows, as its vectors become objects."""
    for lo in range(0, batch.num_rows, SLICE):
        yield batch.slice(lo, SLICE)


def _stacked(parts: list[list]) -> list:
    """One (width, ids, matrix) of each width of several _matrices()."""
    widths = sorted({width for part in parts for width, _, _ in part})
    own = {width: [(ids, matrix) for part in parts for w, ids, matrix in part if w == width] for width in widths}
    return [(width, np.concatenate([ids for ids, _ in own[width]]), np.concatenate([matrix for _, matrix in own[width]])) for width in widths]


def similar_pairs(rows: DataFrame, least: float, *, block: int = 1024) -> DataFrame:
    """a, b of rows (id, vector) whose cosine is at least ``least``: enough pairs to connect all that are alike.

    Rows are cut into blocks; every two blocks meet in one task, which gives
    no pair between rows that it has connected already.
    """
    kind = dict(rows.dtypes)["id"]
    blocks = max(1, -(-rows.count() // block))
    own = rows.select("id", "vector", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    placed = own.select("id", "vector", F.col("block"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    cells = placed.select("id", "vector", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        for _, ids, matrix in _matrices(frame):
            root = list(range(len(ids)))

            def top(i: int, root: list = root) -> int:
                while root[i] != i:
                    root[i] = i = root[root[i]]
                return i

            for i, j in zip(*np.nonzero(np.triu(matrix @ matrix.T >= least - 1e-12, 1)), strict=True):
                a, b = top(int(i)), top(int(j))
                if a != b:
                    root[b] = a
                    out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
        return pd.DataFrame(out, columns=["a", "b"])

    return cells.groupBy("x", "y").applyInPandas(meet, f"a {kind}, b {kind}").distinct()
