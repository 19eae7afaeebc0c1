"""A lexical index in segments: a refresh writes what changed, a reader sees one version.

A segment is a set of tables that are never changed: postings (sorted by
token), the blocks of frequent tokens, the frequency of every token, and the
keys that the segment speaks for. A later segment's keys replace those of
earlier ones, present there or not, so its list of keys is the tombstones of
all before it. A manifest names the segments of a version and what is alive in
it; it is written whole and then moved into place, so readers see a version or
the one before. When the later segments are many or large, all is merged into
one; older versions stay readable until vacuum().
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinequarry.plans.broadcasts import checked
from cinequarry.plans.scratch import discard, settle, shares, written
from cinequarry.plans.versions import commit, files, forget, read, size_of, versions

#: Ranges of length an octave, and parts of a range by the key's hash: rows of one range are of like length, and the fewer
#: they are, the less their best score says too much of the others.
STEPS, PARTS = 8, 16
#: Of BM25: how soon more of a token stops counting, and how much length matters.
K1, B = 1.2, 0.75
#: Rows that hold a token from which on its blocks are listed; others are read whole.
HEAVY = 256
#: Tokens that a task numbers at once.
SLICE_TOKENS = 200_000
#: Segments that may be open, and the share of the index that later ones may hold.
MOST_SEGMENTS, MOST_SHARE = 8, 0.5


@dataclass(frozen=True)
class Segment:
    name: str
    n: int  # keys with a row
    rows: int  # postings
    bytes: int
    mean: float  # length when it was written


@dataclass(frozen=True)
class Index:
    """One version of an index."""

    spark: SparkSession
    path: str
    key: str
    version: int
    segments: tuple[Segment, ...]
    n: int
    length: int

    @property
    def mean(self) -> float:
        return self.length / self.n if self.n else 1.0

    def table(self, name: str) -> DataFrame:
        """A table of all segments, with the segment's number."""
        parts = [self.spark.read.parquet(f"{self.path}/{s.name}/{name}").withColumn("segment", F.lit(i)) for i, s in enumerate(self.segments)]
        return reduce(DataFrame.unionByName, parts)

    def live(self, rows: DataFrame) -> DataFrame:
        """Rows (key, segment, ...) whose key no later segment speaks for."""
        if len(self.segments) == 1:
            return rows
        later = self.table("keys").where("segment > 0").groupBy(F.col(self.key).alias("__key")).agg(F.max("segment").alias("__last"))
        return rows.join(checked(later), (rows[self.key] == F.col("__key")) & (rows["segment"] < F.col("__last")), "left_anti")

    @property
    def postings(self) -> DataFrame:
        """key, field, token, tf, positions, length, range, first, segment of all rows that are alive."""
        return self.live(self.table("postings"))

    @property
    def lengths(self) -> DataFrame:
        return self.live(self.table("keys").where("length IS NOT NULL")).select(self.key, "length")


def range_of(length: np.ndarray, part: np.ndarray) -> np.ndarray:
    return (np.floor(np.log2(np.maximum(length, 1)) * STEPS) * PARTS + part).astype(np.int32)


def slices(batch: pa.RecordBatch, lists: Sequence[str], most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose lists have ``most`` elements or so between them: whole rows, one at least."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for name in lists:
        sizes += np.nan_to_num(np.asarray(batch.column(name).value_lengths().to_numpy(zero_copy_only=False), float)).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def row_postings(rows: DataFrame, key: str, fields: Mapping[str, Column], *, bare: bool = False) -> DataFrame:
    """key, field, token, tf, positions, length, range, first: each row's tokens, gathered inside the row.

    A field's tokens are together already, so nothing is shuffled. ``first``
    marks one of a row's fields that hold the token. With ``bare`` each row
    also gives one without a token, for its length.
    """
    names = list(fields)
    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, field string, token string, tf long, positions array<int>, length long, `range` int, first boolean"

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for batch in batches for part in slices(batch, [f"__{name}" for name in names], SLICE_TOKENS)):
            keys, count = batch.column(key), batch.num_rows
            lists = [batch.column(f"__{name}") for name in names]
            sizes = [np.nan_to_num(np.asarray(x.value_lengths().to_numpy(zero_copy_only=False), float)).astype(np.int64) for x in lists]
            length = np.sum(sizes, axis=0) if sizes else np.zeros(count, np.int64)
            spans = range_of(length, batch.column("__part").to_numpy())
            rows_, places, codes, of = [], [], [], []
            coded = pa.chunked_array([x.flatten().cast(pa.string()) for x in lists]).combine_chunks().dictionary_encode()
            every = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            at = 0
            for f, n in enumerate(sizes):
                total = int(n.sum())
                rows_.append(np.repeat(np.arange(count), n))
                places.append(np.arange(total) - np.repeat(np.cumsum(n) - n, n))
                codes.append(every[at : at + total])
                of.append(np.full(total, f))
                at += total
            row, place, code, field = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (rows_, places, codes, of))
            order = np.lexsort((place, field, code, row))
            row, place, code, field = row[order], place[order], code[order], field[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1]) | (field[1:] != field[:-1])
            begin = np.flatnonzero(new)
            first = np.ones(len(begin), bool)
            first[1:] = (row[begin][1:] != row[begin][:-1]) | (code[begin][1:] != code[begin][:-1])
            offsets = np.append(begin, len(row)).astype(np.int32)
            owner = row[begin]
            columns = [
                keys.take(pa.array(owner)),
                pa.array(np.array(names, object)[field[begin]], pa.string()),
                coded.dictionary.take(pa.array(code[begin])),
                pa.array(np.diff(offsets).astype(np.int64)),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(place.astype(np.int32))),
                pa.array(length[owner]),
                pa.array(spans[owner]),
                pa.array(first),
            ]
            made = [key, "field", "token", "tf", "positions", "length", "range", "first"]
            yield pa.RecordBatch.from_arrays(columns, names=made)
            if bare:
                empty = lambda t: pa.nulls(count, t)
                yield pa.RecordBatch.from_arrays([keys, empty(pa.string()), empty(pa.string()), empty(pa.int64()), empty(pa.list_(pa.int32())), pa.array(length), pa.array(spans), empty(pa.bool_())], names=made)

    return rows.select(key, F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int").alias("__part"), *[F.coalesce(tokens, F.array().cast("array<string>")).alias(f"__{name}") for name, tokens in fields.items()]).mapInArrow(gather, schema)


def saturation(f: Column, length: Column, mean: Column) -> Column:
    """BM25's share of a token that a row has ``f`` times, under its weight by rarity."""
    return f * (K1 + 1) / (f + K1 * (1 - B + B * length / mean))


def _blocks(postings: DataFrame, mean: float, *more: str) -> DataFrame:
    """token, field, range, best (of a row's saturation), n of postings."""
    return postings.groupBy("token", "field", "range", *more).agg(F.max(saturation(F.col("tf"), F.col("length"), F.lit(mean))).alias("best"), F.count("*").alias("n"))


def _commit(index: Index) -> Index:
    body = {"key": index.key, "n": index.n, "length": index.length, "segments": [vars(s) for s in index.segments]}
    commit(index.spark, index.path, index.version, body)
    return index


def open_index(spark: SparkSession, path: str, version: int | None = None) -> Index:
    """The latest version of an index, or a given one."""
    version, body = read(spark, path, version)
    return Index(spark, path, body["key"], version, tuple(Segment(**s) for s in body["segments"]), body["n"], body["length"])


def _write_segment(raw: DataFrame, key: str, path: str, removed: DataFrame | None = None) -> tuple[Segment, int]:
    """(the segment of written postings ``raw`` (with bare rows), its total length). ``removed`` (key) have no row any more."""
    spark = raw.sparkSession
    name = f"segment-{uuid.uuid4().hex}"
    own = f"{path}/{name}"
    keys = raw.where("token IS NULL").select(key, "length")
    if removed is not None:
        gone = removed.select(key).distinct().join(keys.select(key), key, "left_anti")
        keys = keys.unionByName(gone.select(key, F.lit(None).cast("long").alias("length")))
    keys.write.parquet(f"{own}/keys")
    real = raw.where("token IS NOT NULL")
    # A token in very many rows spans partitions, as the key is part of the order.
    real.repartitionByRange(shares(spark, raw.count()), "token", "range", key).sortWithinPartitions("token", "range", key).write.parquet(f"{own}/postings")
    stored = spark.read.parquet(f"{own}/postings")
    df = stored.groupBy("token").agg(F.count_if("first").alias("df"))
    df.write.parquet(f"{own}/tokens")
    heavy = spark.read.parquet(f"{own}/tokens").where(F.col("df") >= HEAVY).select("token")
    total = spark.read.parquet(f"{own}/keys").agg(F.count("length").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")).first()
    mean = int(total["length"]) / int(total["n"]) if total["length"] else 1.0
    blocks = _blocks(stored.join(checked(heavy), "token", "left_semi"), mean)
    blocks.repartitionByRange("token").sortWithinPartitions("token").write.parquet(f"{own}/blocks")
    return Segment(name, int(total["n"]), stored.count(), size_of(spark, own), mean), int(total["length"])


def write_index(rows: DataFrame, key: str, fields: Mapping[str, Column], path: str) -> Index:
    """Build the index of ``rows`` (one a key) from columns of tokens, as the next version at ``path``."""
    spark = rows.sparkSession
    raw = settle(row_postings(rows, key, fields, bare=True))
    made = written(spark)[-1:]
    segment, length = _write_segment(raw, key, path)
    discard(spark, made)
    return _commit(Index(spark, path, key, max(versions(spark, path), default=0) + 1, (segment,), segment.n, length))


def refresh_index(index: Index, rows: DataFrame, fields: Mapping[str, Column], removed: DataFrame | None = None) -> Index:
    """The next version, in which ``rows`` stand for their keys and ``removed`` (key) are gone.

    Written is a segment of these rows alone; that of a version which someone
    else has followed with another is an error.
    """
    spark, key = index.spark, index.key
    raw = settle(row_postings(rows, key, fields, bare=True))
    made = written(spark)[-1:]
    segment, length = _write_segment(raw, key, index.path, removed)
    discard(spark, made)
    named = spark.read.parquet(f"{index.path}/{segment.name}/keys").select(key).distinct()
    before = index.lengths.join(checked(named), key, "left_semi").agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")).first()
    fresh = Index(spark, index.path, key, index.version + 1, (*index.segments, segment), index.n - int(before["n"]) + segment.n, index.length - int(before["length"]) + length)
    fresh = _commit(fresh)
    later = fresh.segments[1:]
    if len(fresh.segments) > MOST_SEGMENTS or sum(s.rows for s in later) > MOST_SHARE * max(1, sum(s.rows for s in fresh.segments)):
        return compact(fresh)
    return fresh


def compact(index: Index) -> Index:
    """The next version, of one segment with all that is alive."""
    columns = [index.key, "field", "token", "tf", "positions", "length", "range", "first"]
    bare = index.lengths.select(index.key, *[F.lit(None).cast(t).alias(c) for c, t in (("field", "string"), ("token", "string"), ("tf", "long"), ("positions", "array<int>"))], "length", F.lit(0).alias("range"), F.lit(None).cast("boolean").alias("first"))
    raw = settle(index.postings.select(*columns).unionByName(bare.select(*columns)))
    made = written(index.spark)[-1:]
    segment, length = _write_segment(raw, index.key, index.path)
    discard(index.spark, made)
    return _commit(Index(index.spark, index.path, index.key, index.version + 1, (segment,), segment.n, length))


def vacuum(index: Index) -> None:
    """Delete the manifests before this version and every segment that no manifest names; readers of older versions lose them."""
    forget(index.spark, index.path, index.version)
    kept = {s.name for version in versions(index.spark, index.path) for s in open_index(index.spark, index.path, version).segments}
    fs, at = files(index.spark, index.path)
    for status in fs.listStatus(at(index.path)):
        name = status.getPath().getName()
        if name.startswith("segment-") and name not in kept:
            fs.delete(status.getPath(), True)


@dataclass(frozen=True)
class Reading:
    """Rows of postings that the asked tokens have, and how many of them were read to rank."""

    there: int
    read: int


def top_terms(index: Index, asked: DataFrame, k: int, part: object, idf: object, weight: object) -> tuple[DataFrame, Reading]:
    """(query_id, key, score of at least the k best rows that hold all tokens of a query (query_id, token); what was read).

    Blocks are the postings of one token in one range. A block's best row
    bounds the others, and a range's bound for a query is the sum over its
    tokens. The best ranges of each query are
    scored first; of the others only those are read whose bound reaches the
    k-th score found, so the result is that of reading everything. ``part``,
    ``idf`` and ``weight`` are the ranking's column functions.
    """
    spark, key = index.spark, index.key
    asked = settle(asked.select("query_id", "token").distinct())
    needed = asked.groupBy("query_id").agg(F.count("*").alias("needed"))
    tokens = asked.select("token").distinct()
    n, mean = F.lit(index.n), F.lit(float(index.mean) or 1.0)
    stored = index.table("postings").join(checked(tokens), "token", "left_semi")
    alive = index.live(stored)
    df = index.table("tokens").join(checked(tokens), "token", "left_semi")
    if len(index.segments) == 1:
        df = settle(df.groupBy("token").agg(F.sum("df").alias("df")))
    else:  # some of a token's rows may be gone: count those that are not
        df = settle(alive.where("first").groupBy("token").agg(F.count("*").alias("df")))
    listed = index.table("blocks").join(checked(tokens), "token", "left_semi")
    light = index.table("tokens").where(F.col("df") < HEAVY).join(checked(tokens), "token", "left_semi").select("token", "segment")
    whole = stored.join(checked(light), ["token", "segment"], "left_semi")
    # A row's share grows by the quotient of the means at most, if documents have become longer; weights of fields add up at most.
    longer = F.create_map(*[F.lit(x) for i, seg in enumerate(index.segments) for x in (i, max(1.0, index.mean / (seg.mean or 1.0)))])
    columns = ("token", "field", "range", "best", "n")
    blocks = settle(listed.withColumn("best", F.col("best") * longer[F.col("segment")]).select(*columns).unionByName(_blocks(whole, float(index.mean) or 1.0, "segment").select(*columns)))
    per_field = blocks.groupBy("token", "field", "range").agg(F.max("best").alias("best"), F.sum("n").alias("n"))
    bound = per_field.groupBy("token", "range").agg(F.sum(F.when(weight() > 0, F.greatest(weight(), F.lit(1.0)) * F.col("best")).otherwise(0.0)).alias("best"), F.sum("n").alias("n")).join(checked(df), "token")
    bound = bound.withColumn("most", idf(n, F.col("df")) * F.col("best"))
    ranges = bound.join(checked(asked), "token").groupBy("query_id", "range").agg(F.sum("most").alias("bound"), F.count("*").alias("has"), F.min("n").alias("rows")).join(checked(needed), "query_id").where("has = needed")
    ranges = settle(ranges.select("query_id", "range", "bound", "rows"))

    def scored(chosen: DataFrame) -> DataFrame:
        wanted = chosen.join(checked(asked), "query_id").select("query_id", "range", "token")
        found = alive.join(checked(settle(wanted)), ["token", "range"])
        hits = found.groupBy("query_id", "token", key).agg(F.sum(weight() * F.col("tf")).alias("f"), F.max("length").alias("length"))
        parts = hits.join(checked(df), "token").groupBy("query_id", key).agg(F.sum(part(idf(n, F.col("df")), F.col("f"), F.col("length"), mean)).alias("score"), F.count("*").alias("has"))
        return settle(parts.join(checked(needed), "query_id").where("has = needed").select("query_id", key, "score"))

    by_bound = Window.partitionBy("query_id").orderBy(F.desc("bound"), "range")
    # The first ranges that could give k rows between them, by what their rarest token has there.
    waves = settle(ranges.withColumn("before", F.coalesce(F.sum("rows").over(by_bound.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("early", F.col("before") < 2 * k))
    one = scored(waves.where("early").select("query_id", "range"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    least = one.withColumn("place", F.row_number().over(order)).where(F.col("place") == k).select("query_id", F.col("score").alias("least"))
    rest = settle(waves.where("NOT early").join(checked(least), "query_id", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 1e-9 * F.abs("least"))).select("query_id", "range"))
    both = one.unionByName(scored(rest))
    used = waves.where("early").select("query_id", "range").unionByName(rest).join(checked(asked), "query_id").select("token", "range").distinct()
    sizes = blocks.groupBy("token", "range").agg(F.sum("n").alias("n"))
    there = int(sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    read = int(sizes.join(checked(used), ["token", "range"], "left_semi").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    return both, Reading(there, read)
