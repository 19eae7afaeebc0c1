"""Phrase collocations by direct-address tiling.

Frequent words are ranked by frequency into dense numbers, and a corpus is
chunks of such numbers with gaps where a piece ends or a word is rare. Pairs
of neighbouring numbers are counted in tiles of the square of all pairs: a
tile that gets many pairs by bincount into a dense array, all others as sorted
coordinates. Frequent pairs are ranked again into dense numbers, which replace
the corpus' numbers, and pairs of these (two phrases that overlap in all but
their outer words) are the phrases with one word more: the same step counts
every length.

Tasks count what they read before the shuffle, so a pair costs one row a task
at most, and no key is hot. Null and empty texts have no words; a null
language is ``und``; repeated rows count as often as they are there; a table
without frequent phrases gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinequarry.plans.scratch import discard, settle, written

from .common import LOWER, partitions, raw_texts, run_starts, slices, small

#: Numbers a side of a tile; pairs from which on a tile is counted as a dense array; pairs a task counts at once.
TILE, DENSE, BUFFER = 1024, 1 << 17, 1 << 23
#: Frequent pairs whose numbers (16 bytes each) may go to the tasks; beyond, each chunk's pairs meet them in a shuffle.
BROADCAST_PAIRS = 2_000_000
#: Frequent words that may go to the tasks, likewise.
BROADCAST_WORDS = 500_000
#: Parts of a language that are ranked apart before the whole.
PARTS = 64
#: Where a piece ends, and what a text becomes before it is split at blanks: a full stop is no part of any word.
ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_FOLD = bytes(46 if b in ENDS else 32 if b == 9 else LOWER[b] for b in range(256))
_SHIFT = 32  # of the first number of a pair


def _chunks(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """chunk, lang, codes (a word's place among ``words``, -1 where a piece ends), words, counts."""
    schema = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("codes", pa.binary()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in slices(batches):
            own: dict[str, list[bytes]] = {}
            for name, raw in zip(batch.column("lang").to_pylist(), raw_texts(batch), strict=True):
                if raw:
                    own.setdefault(name, []).append(raw)
            for name, texts in own.items():
                joined = b".".join(texts).translate(_FOLD).replace(b".", b" . ")
                coded = pc.ascii_split_whitespace(pa.array([joined]).cast(pa.string())).flatten().dictionary_encode()
                words, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
                for gap in (".", ""):
                    at = pc.index(words, gap).as_py()
                    if at >= 0 and gap:
                        codes = np.where(codes == at, np.int32(-1), codes)
                    elif at >= 0:  # of blanks at the ends
                        codes = codes[codes != at]
                counts = np.bincount(codes[codes >= 0], minlength=len(words))
                at = np.flatnonzero(counts)
                place = np.cumsum(counts > 0) - 1
                codes = np.where(codes >= 0, place[codes], -1).astype("<i4")
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([name]), pa.array([codes.tobytes()]), pa.array([words.take(pa.array(at)).to_pylist()], schema.field("words").type), pa.array([counts[at]], schema.field("counts").type)], schema=schema)
                number += 1

    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text")).mapInArrow(split, "chunk long, lang string, codes binary, words array<string>, counts array<long>")


def _ranked(counted: DataFrame, *keys: str) -> DataFrame:
    """``counted`` (keys, f) with a dense number ``id`` by falling frequency, written.

    Ranges of the order are numbered in their tasks; the driver adds up one
    count a range.
    """
    n = partitions(counted.sparkSession)
    placed = settle(counted.repartitionByRange(n, F.desc("f"), *keys).sortWithinPartitions(F.desc("f"), *keys).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    base, before = {}, 0
    for p in sorted(sizes):
        base[p], before = before, before + sizes[p]
    if before >= 1 << 31:
        raise ValueError("more frequent phrases of one length than 31 bits can number: raise the least frequency")
    starts = placed.sparkSession.createDataFrame([*base.items()], "__part int, __base long")  # a row a range
    return placed.withColumn("__part", part.cast("int")).join(F.broadcast(starts), "__part").withColumn("id", F.col("__base") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at", "__part", "__base")


def _gapped(numbers: np.ndarray) -> bytes:
    """Numbers as bytes, each run of gaps as one: only neighbours matter."""
    gap = numbers < 0
    return numbers[~(gap & np.concatenate(([True], gap[:-1])))].astype("<i4").tobytes()


def _pairs(numbers: np.ndarray) -> np.ndarray:
    """The key of each number with its next neighbour, -1 where one of them is a gap."""
    a, b = numbers[:-1].astype(np.int64), numbers[1:].astype(np.int64)
    return np.where((a >= 0) & (b >= 0), (a << _SHIFT) | b, -1)


def count_tiles(keys: np.ndarray, tile: int = TILE, dense: int = DENSE) -> tuple[np.ndarray, np.ndarray]:
    """(distinct pair keys, how often each is there).

    Tiles with at least ``dense`` pairs are addressed directly, the others
    are sorted as coordinates.
    """
    a, b = keys >> _SHIFT, keys & ((1 << _SHIFT) - 1)
    side = int(max(a.max(initial=0), b.max(initial=0))) // tile + 1
    tiles = (a // tile) * side + b // tile
    left = np.ones(len(keys), bool)
    found, counts = [], []
    # Numbers are ranked by frequency: full tiles lie at the low ones, so a bounded head of them is looked at.
    full = np.flatnonzero(np.bincount(tiles[tiles < 1 << 20], minlength=1) >= dense)
    for t in full.tolist():
        own = tiles == t
        cells = np.bincount((a[own] % tile) * tile + b[own] % tile, minlength=tile * tile)
        at = np.flatnonzero(cells)
        found.append(((at // tile + t // side * tile) << _SHIFT) | (at % tile + t % side * tile))
        counts.append(cells[at])
        left &= ~own
    rest = np.sort(keys[left])
    first = run_starts(rest)
    found.append(rest[first])
    counts.append(np.diff(np.append(first, len(rest))))
    return np.concatenate(found), np.concatenate(counts).astype(np.int64)


def _counted(corpus: DataFrame, least: int, buffer: int) -> DataFrame:
    """key, f of the pairs of neighbouring numbers with f >= least."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def told() -> Iterator[pa.RecordBatch]:
            keys, counts = count_tiles(np.concatenate(held))
            for at in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + (1 << 16)]), pa.array(counts[at : at + (1 << 16)])], names=["key", "n"])

        for batch in batches:
            for raw in batch.column("numbers").to_pylist():
                keys = _pairs(np.frombuffer(raw, "<i4"))
                held.append(keys[keys >= 0])
                size += len(held[-1])
                if size >= buffer:
                    yield from told()
                    held, size = [], 0
        if size:
            yield from told()

    return corpus.select("numbers").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("f")).where(F.col("f") >= least)


def _renumbered(corpus: DataFrame, ranked: DataFrame, most: int) -> DataFrame:
    """The corpus in numbers of its frequent pairs."""
    spark = corpus.sparkSession
    schema = "chunk long, numbers binary"

    def found(keys: np.ndarray, known: np.ndarray, ids: np.ndarray) -> bytes:
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return _gapped(np.where((keys >= 0) & (known[at] == keys), ids[at], -1))

    if ranked.count() <= most:
        pairs = ranked.select("key", "id").toArrow()
        keys, ids = pairs.column("key").to_numpy(), pairs.column("id").to_numpy()
        order = np.argsort(keys)
        table = spark.sparkContext.broadcast((keys[order], ids[order].astype(np.int32)))

        def looked_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, ids = table.value
            for batch in batches:
                for chunk, raw in zip(batch.column("chunk"), batch.column("numbers").to_pylist(), strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array([chunk.as_py()], pa.int64()), pa.array([found(_pairs(np.frombuffer(raw, "<i4")), known, ids)])], names=["chunk", "numbers"])

        return settle(corpus.select("chunk", "numbers").mapInArrow(looked_up, schema))

    def distinct(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, raw in zip(batch.column("chunk").to_pylist(), batch.column("numbers").to_pylist(), strict=True):
                keys = np.unique(_pairs(np.frombuffer(raw, "<i4")))
                keys = keys[keys >= 0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), chunk)), pa.array(keys)], names=["chunk", "key"])

    own = corpus.select("chunk", "numbers").mapInArrow(distinct, "chunk long, key long").join(ranked.select("key", "id"), "key")
    named = own.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("key", "id"))).alias("pairs"))  # a chunk's own pairs

    def met(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (chunk, raw) in enumerate(zip(batch.column("chunk").to_pylist(), batch.column("numbers").to_pylist(), strict=True)):
                pairs = batch.column("pairs").slice(i, 1).flatten()
                keys, ids = (pairs.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("key", "id"))
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([found(_pairs(np.frombuffer(raw, "<i4")), keys, ids)])], names=["chunk", "numbers"])

    return settle(corpus.select("chunk", "numbers").join(named, "chunk").mapInArrow(met, schema))


def _numbered_words(chunks: DataFrame, words: DataFrame, most: int) -> DataFrame:
    """The corpus in numbers of its frequent words: each chunk's own words meet the vocabulary, in a shuffle if it has more than ``most`` words."""
    if words.count() <= most:
        found = words.select("lang", "word", "id").toArrow().combine_chunks()
        langs = found.column("lang").to_numpy()
        vocabulary = {}
        for name in set(langs.tolist()):
            at = np.flatnonzero(langs == name)
            own = found.take(pa.array(at))
            vocabulary[name] = own.column("word").combine_chunks(), np.append(own.column("id").to_numpy(), -1).astype(np.int32)
        table = chunks.sparkSession.sparkContext.broadcast(vocabulary)

        def looked_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = table.value
            for batch in batches:
                for i, (chunk, name, raw) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("chunk", "lang", "codes")), strict=True)):
                    if name in known:
                        frequent, ids = known[name]
                        own = batch.column("words").slice(i, 1).flatten()
                        at = pc.fill_null(pc.index_in(own, value_set=frequent.cast(own.type)), -1).to_numpy()
                        names = np.append(ids[at], np.int32(-1))  # -1 is the last place, a gap
                        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([_gapped(names[np.frombuffer(raw, "<i4")])])], names=["chunk", "numbers"])

        return settle(chunks.select("chunk", "lang", "codes", "words").mapInArrow(looked_up, "chunk long, numbers binary"))

    own = chunks.select("chunk", "lang", F.posexplode("words").alias("place", "word")).join(words.select("lang", "word", "id"), ["lang", "word"])
    named = own.groupBy("chunk").agg(F.collect_list(F.struct("place", "id")).alias("pairs"))

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (chunk, raw) in enumerate(zip(batch.column("chunk").to_pylist(), batch.column("codes").to_pylist(), strict=True)):
                pairs = batch.column("pairs").slice(i, 1).flatten()
                place, ids = (pairs.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("place", "id"))
                codes = np.frombuffer(raw, "<i4")
                names = np.full(max(int(codes.max(initial=0)), int(place.max(initial=0))) + 2, -1, np.int64)
                names[place] = ids
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([_gapped(names[codes])])], names=["chunk", "numbers"])  # -1 is the last place, a gap

    return settle(chunks.select("chunk", "codes").join(named, "chunk").mapInArrow(number, "chunk long, numbers binary"))


def frequent_phrases(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = 100, longest: int = 5, most: int = BROADCAST_PAIRS, buffer: int = BUFFER) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f of every phrase of 1 to ``longest`` words with f >= least; lang, n of all words)."""
    spark = docs.sparkSession
    chunks = settle(_chunks(docs, text, lang))
    counts = settle(chunks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f")))
    totals = settle(counts.groupBy("lang").agg(F.sum("f").alias("n")))
    words = _ranked(counts.where(F.col("f") >= least), "lang", "word")
    level = words.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f")
    levels = [level.withColumn("size", F.lit(1))]
    corpus = _numbered_words(chunks, words, min(most, BROADCAST_WORDS))
    for size in range(2, longest + 1):
        own = written(spark)[-1]  # of the corpus in these numbers
        ranked = _ranked(settle(_counted(corpus, least, buffer)), "key")
        left = level.select(F.col("id").alias("a"), "lang", "phrase")
        right = level.select(F.col("id").alias("b"), "last")
        pairs = ranked.withColumns({"a": F.shiftright("key", _SHIFT), "b": F.col("key").bitwiseAND((1 << _SHIFT) - 1)})
        level = settle(pairs.join(left, "a").join(right, "b").select("id", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "f"))
        levels.append(level.withColumn("size", F.lit(size)))
        if size == longest or not level.limit(1).count():
            break
        corpus = _renumbered(corpus, ranked, most)
        discard(spark, [own])
    return reduce(DataFrame.unionByName, (x.select("lang", "phrase", "size", "f") for x in levels)), totals


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = 100, longest: int = 5, top: int = 2000, most: int = BROADCAST_PAIRS, buffer: int = BUFFER) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases.

    a is the phrase's frequency, l and r those of the parts of the cut with
    the least score floor(1000 * a * n / (l * r)) (ties: the first cut), n the
    language's words. A phrase inside a longer one of the same frequency goes.
    Products are 38-digit decimals.
    """
    phrases, totals = frequent_phrases(docs, text=text, lang=lang, least=least, longest=longest, most=most, buffer=buffer)
    phrases = settle(phrases)
    words = F.split("phrase", " ", -1)
    part = lambda first, n: F.array_join(F.slice(F.col("w"), first, n), " ")
    candidates = phrases.where("size >= 2").select("lang", "phrase", "size", F.col("f").alias("a"), words.alias("w"))
    cuts = candidates.select("lang", "phrase", "a", "size", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    known = phrases.select("lang", "phrase", "f")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    scored = cuts.join(small(totals), "lang")
    whole = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    scored = scored.withColumns({"__top": (F.col("a") * 1000).cast("decimal(19,0)") * whole("n", 18), "__bottom": whole("l", 19) * whole("r", 18)}).withColumn("score", F.expr("__top div __bottom"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # Of phrases that hold another, those one word longer decide: all between have at least the longest one's frequency.
    inside = candidates.where("size >= 3").select("lang", F.explode(F.array(part(F.lit(1), F.col("size") - 1), part(F.lit(2), F.col("size") - 1))).alias("phrase"), F.col("a").alias("longer"))
    held = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = best.join(held, ["lang", "phrase"], "left").where("longer IS NULL OR longer < a").select("lang", "phrase", "a", "n", "cut.score", "cut.l", "cut.r")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = left.withColumn("__part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    first = parts.withColumn("__rank", F.row_number().over(Window.partitionBy("lang", "__part").orderBy(*order))).where(F.col("__rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
