"""Shared pieces of the training-data operators: whole-text batching and
vectorised word hashing.

Words are runs of bytes other than space and \\x09-\\x0D, so ``bytes.split()``
and Arrow's ASCII split yield them exactly; other Unicode spaces stay inside a
word.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from xxhash import xxh3_64_intdigest

from cinequarry.plans.scratch import settle

#: Text bytes a task tokenises at once; bounds the Python objects of a batch.
SLICE_BYTES = 4 << 20

#: Bytes of an Arrow batch between Spark and a Python worker where small_batches() has set it; Spark's own limit is 64 MB.
BATCH_BYTES = 8 << 20

#: ASCII upper case folded, every other byte kept.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_STEP = 0x9E3779B97F4A7C15


#: Ids that may be broadcast, at 16 bytes each or so; beyond, Spark shuffles.
BROADCAST_IDS = 1_000_000


def small(ids: DataFrame) -> DataFrame:
    """``ids`` (written, a few numbers a row) marked for broadcast if it is of bounded size."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def text_code(text: str | Column = "text") -> Column:
    """Hash that tells apart rows of one id."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def keep_rows(docs: DataFrame, marked: DataFrame, doc_id: str, code: Column) -> DataFrame:
    """The rows of ``docs`` that ``marked`` (doc_id, code, kept; a row each) keeps; of rows equal in id and code, one.

    Rows are told by id, null or not, and ``code``, so an id of several texts
    loses only those that go.
    """
    keys = settle(marked.groupBy("doc_id", "code").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("times")))
    own = docs.withColumns({"__id": as_long(doc_id), "__code": code})
    match = lambda k: F.col("__id").eqNullSafe(F.col("doc_id_")) & (F.col("__code") == F.col("code_"))
    named = keys.select(F.col("doc_id").alias("doc_id_"), F.col("code").alias("code_"), "kept", "times")
    gone = settle(named.where("NOT kept").select("doc_id_", "code_"))
    left = own.join(small(gone), match(gone), "left_anti")
    twice = settle(named.where("kept AND times > 1").select("doc_id_", "code_"))
    if twice.limit(1).count():
        repeated = left.join(small(twice), match(twice), "left_semi").dropDuplicates(["__id", "__code"])
        left = left.join(small(twice), match(twice), "left_anti").unionByName(repeated)
    return left.drop("__id", "__code")


def small_batches(spark: SparkSession) -> None:
    """Send texts to the Python workers in smaller Arrow batches: tasks cut them into slices anyway.

    A batch is held by the executor, which doubles a buffer until it fits, and
    by the worker, for each core; the same rows pass. A smaller limit of the
    session stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(\d+)\s*([bkmg]?)[a-z]*", spark.conf.get(name).strip().lower()).groups()
    if int(number) << {"k": 10, "m": 20, "g": 30}.get(unit, 0) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts: one column-pruned aggregate."""
    row = docs.agg(F.sum(F.octet_length(F.col(text))).alias("n")).first()
    return int(row["n"] or 0)


def as_long(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast(LongType())


def trim() -> None:
    """Give freed memory back to the system: a worker lives on and serves other stages."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError, TypeError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds at most ``limit`` bytes in each (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    trim()


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """Texts as UTF-8 bytes; null counts as empty."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def words_of(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, place among them of every word of all texts, words of each text).

    Each batch's words are told apart once; what follows works on their places.
    """
    column = pc.fill_null(texts if pa.types.is_string(texts.type) else texts.view(pa.string()), "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(column) if lower else column)
    counts = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    values, codes = coded.dictionary.cast(pa.binary()), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    blank = pc.index(values, b"").as_py()  # of white space at a text's ends
    if blank >= 0:
        real = codes != blank
        owner = np.repeat(np.arange(len(counts)), counts)
        codes, counts = codes[real], np.bincount(owner[real], minlength=len(counts))
    return values, codes, counts


def word_hashes(values: pa.Array) -> np.ndarray:
    """64-bit hash of each word's bytes."""
    return np.fromiter(map(xxh3_64_intdigest, values.to_pylist()), np.uint64, len(values))


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; the last k-1 positions are missing."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        odd = np.uint64((_STEP * (2 * j + 1)) & 0xFFFFFFFFFFFFFFFF | 1)
        out += mix(codes[j : j + n] + np.uint64(j + 1)) * odd
    return mix(out)


def word_codes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word of all texts, words of each text)."""
    values, places, counts = words_of(texts, lower)
    return word_hashes(values)[places] if len(places) else np.empty(0, np.uint64), counts


def split_sets(codes: np.ndarray, hashes: np.ndarray, counts: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingles of each text, from its words' hashes and those of all k-grams."""
    out, at = [], 0
    for n in counts.tolist():
        if n >= k:
            out.append(np.unique(hashes[at : at + n - k + 1]))
        elif n:
            out.append(gram_hashes(codes[at : at + n], n) ^ np.uint64(n))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def shingle_sets(texts: pa.Array, k: int = 5) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each lower-cased text.

    Fewer than k words count as one shingle, no words as none.
    """
    codes, counts = word_codes(texts, lower=True)
    return split_sets(codes, gram_hashes(codes, k), counts, k)


def run_starts(values: np.ndarray) -> np.ndarray:
    """Positions where a run of equal neighbours begins."""
    if not len(values):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
