"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents long, so their Jaccard similarity is tiny
and symmetric MinHash bands miss them. Containment is searched with sketches
of least hashes instead: an item's sketch is its ``size`` shingles of least
hash under a seeded permutation, and a document that holds ``threshold`` of
the item's shingles must hold at least ``least`` of the sketch, whichever they
are. Items are partitioned by size. A size class has a scale, the largest hash
in its sketches; a document's sketch for the class is its own hashes up to
that scale, and documents smaller than what the class needs have none.
Candidates are verified by exact containment of the shingles' words.

A benchmark of checked size goes to the tasks; a larger one stays distributed
and meets the documents' sketches in a shuffle. Both find the same pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, as_long, mix, raw_texts, settle, shingle_sets, slices, text_bytes

#: Bytes of item texts up to which they are sent to the tasks.
SENT_BYTES = 8 << 20
_SEED = np.uint64(0x5EED0F5C37C4E5)
_PAIR = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_item", pa.int64()), ("n_shared", pa.int64())])
_PAIR_SQL = "doc_id long, item_id long, n_item long, n_shared long"


def _shingles(text: bytes, k: int) -> set[tuple[bytes, ...]]:
    words = text.translate(LOWER).split()
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def needed(size: int, threshold: Fraction) -> int:
    """Shared shingles at which an item of this size counts as contained."""
    return max(1, -(-threshold.numerator * size // threshold.denominator))


def sketch(hashes: np.ndarray, threshold: Fraction) -> tuple[np.ndarray, int]:
    """(the item's least permuted hashes, how many of them a holder must have)."""
    need = needed(len(hashes), threshold)
    least = max(1, need // 4)
    return np.sort(mix(hashes ^ _SEED))[: len(hashes) - need + least], least


class ItemIndex:
    """Items by size class, for a benchmark that is sent to the tasks."""

    def __init__(self, items: list[tuple[int, str]], k: int, threshold: Fraction):
        self.k, self.ids = k, [i for i, _ in items]
        self.sets = [_shingles(t.encode(), k) for _, t in items]
        self.need = np.array([needed(len(s), threshold) for s in self.sets], np.int64)
        hashes = shingle_sets(pa.array([t for _, t in items], pa.string()), k)
        classes: dict[int, list[tuple[int, np.ndarray, int]]] = {}
        for item, s in enumerate(hashes):
            if len(s):
                classes.setdefault(len(s).bit_length(), []).append((item, *sketch(s, threshold)))
        #: Least size of a document, entries (sorted hashes, their items), and the sketch hits that each item needs.
        self.classes = []
        for members in classes.values():
            entry = np.concatenate([h for _, h, _ in members])
            owner = np.repeat([i for i, _, _ in members], [len(h) for _, h, _ in members])
            order = np.argsort(entry, kind="stable")
            self.classes.append((int(self.need[[i for i, _, _ in members]].min()), entry[order], owner[order], {i: least for i, _, least in members}))

    def search(self, batch: pa.RecordBatch, text: str = "text") -> Iterator[tuple[int, int, int]]:
        """(text's place, item's place, shared shingles) of every contained item."""
        if not self.classes:
            return
        sets = shingle_sets(batch.column(text), self.k)
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        flat = mix(np.concatenate(sets) ^ _SEED)
        owner = np.repeat(np.arange(len(sets)), sizes)
        candidates: list[tuple[int, int]] = []
        for smallest, entries, items, least in self.classes:
            drawn = np.flatnonzero((flat <= entries[-1]) & (sizes[owner] >= smallest))  # the documents' sketches at this class's scale
            first = np.searchsorted(entries, flat[drawn], side="left")
            met = np.searchsorted(entries, flat[drawn], side="right") - first
            drawn, first, met = drawn[met > 0], first[met > 0], met[met > 0]
            if not len(drawn):
                continue
            place = np.repeat(first - np.cumsum(met) + met, met) + np.arange(int(met.sum()))
            pairs, hits = np.unique(np.repeat(owner[drawn], met) * len(self.ids) + items[place], return_counts=True)
            candidates += [(p // len(self.ids), p % len(self.ids)) for p, n in zip(pairs.tolist(), hits.tolist(), strict=True) if n >= least[p % len(self.ids)]]
        own: dict[int, set] = {}
        for doc, item in sorted(candidates):
            if sizes[doc] < self.need[item]:
                continue
            if doc not in own:
                own = {doc: _shingles((batch.column(text)[doc].as_py() or "").encode(), self.k)}
            shared = len(self.sets[item] & own[doc])
            if shared >= self.need[item]:
                yield doc, item, shared


def _items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    return benchmark.select(as_long(item_id).alias("item_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def _sent(items: DataFrame, k: int, threshold: Fraction, most: int) -> ItemIndex | None:
    """The items' index if their texts have at most ``most`` bytes."""
    if text_bytes(items) + 16 * items.count() > most:
        return None
    return ItemIndex([(r["item_id"], r["text"]) for r in items.collect()], k, threshold)


def _key(text: str = "text") -> Column:
    return F.xxhash64("doc_id", text)


def _distributed(source: DataFrame, items: DataFrame, k: int, threshold: Fraction) -> DataFrame:
    """key, doc_id, item_id, n_item, n_shared: sketches meet in a shuffle, candidates' texts in another."""
    items = settle(items.withColumn("item", F.monotonically_increasing_id()))

    def item_sketches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            cols: list[list] = [[], [], [], []]
            for item, s in zip(batch.column("item").to_pylist(), shingle_sets(batch.column("text"), k), strict=True):
                h, least = sketch(s, threshold) if len(s) else (s, 0)
                for col, value in zip(cols, ([item] * len(h), [least] * len(h), [needed(len(s), threshold)] * len(h), h.view(np.int64).tolist()), strict=True):
                    col += value
            yield pa.RecordBatch.from_pydict({n: pa.array(c, pa.int64()) for n, c in zip(("item", "least", "need", "hash"), cols, strict=True)})

    def doc_sketches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text"), k)
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            flat = mix(np.concatenate(sets) ^ _SEED)
            kept = flat <= scale
            keys = np.repeat(batch.column("key").to_numpy(), sizes)[kept]
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys), "size": pa.array(np.repeat(sizes, sizes)[kept]), "hash": pa.array(flat[kept].view(np.int64))})

    entries = settle(items.mapInArrow(item_sketches, "item long, least long, need long, hash long"))
    # Unsigned order of the hashes, which Spark keeps as signed numbers.
    top = entries.agg(F.max(F.col("hash").bitwiseXOR(F.lit(-(1 << 63)))).alias("h")).first()["h"]
    scale = np.uint64((top if top is not None else -(1 << 63)) + (1 << 63))
    keyed = source.withColumn("key", _key())
    drawn = keyed.select("key", "text").mapInArrow(doc_sketches, "key long, size long, hash long").distinct()
    met = drawn.join(entries, "hash").where("size >= need").groupBy("key", "item", "least").agg(F.count("*").alias("hits")).where("hits >= least").select("key", "item")
    both = keyed.join(met, "key").join(items.withColumnRenamed("text", "item_text"), "item")

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(slices(batches), "item_text"):
            rows, last, own = [], None, set()
            for key, doc, item, text, other in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "item_id")), raw_texts(batch), raw_texts(batch, "item_text"), strict=True):
                if text != last:
                    last, own = text, _shingles(text, k)
                wanted = _shingles(other, k)
                shared = len(wanted & own)
                if shared >= needed(len(wanted), threshold):
                    rows.append((key, doc, item, len(wanted), shared))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["key", *_PAIR.names])

    return both.select("key", "doc_id", "item_id", "text", "item_text").mapInArrow(verify, f"key long, {_PAIR_SQL}")


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", k: int = 5, threshold: Fraction = Fraction(3, 4), sent_bytes: int = SENT_BYTES) -> DataFrame:
    """doc_id, item_id, n_item, n_shared of every item that a document holds.

    An item is held when at least ``threshold`` of its distinct k-word
    shingles (ASCII lower case) are among the document's, wherever they stand.
    A text of fewer words is one shingle of them all; a text without words, or
    null, holds nothing and is held by nothing. Very long texts are searched
    whole. Repeated rows and ids give a pair each, with null ids kept as null.
    Empty tables give no rows; further columns are ignored.
    """
    source = docs.select(as_long(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    items = _items(benchmark, item_id, item_text)
    index = _sent(items, k, threshold, sent_bytes)
    if index is None:
        return _distributed(source, items, k, threshold).drop("key")

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = batch.column("doc_id")
            rows = [(ids[d].as_py(), index.ids[i], len(index.sets[i]), shared) for d, i, shared in index.search(batch)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=_PAIR)

    return source.mapInArrow(search, _PAIR_SQL)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", k: int = 5, threshold: Fraction = Fraction(3, 4), sent_bytes: int = SENT_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, that hold no item (see contaminated_pairs)."""
    items = _items(benchmark, item_id, item_text)
    index = _sent(items, k, threshold, sent_bytes)
    if index is None:
        own = (as_long(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        held = settle(_distributed(docs.select(*own), items, k, threshold).select(F.col("key").alias("__held")).distinct())
        return docs.withColumn("__key", F.xxhash64(as_long(doc_id), F.coalesce(F.col(text), F.lit("")))).join(held, F.col("__key") == F.col("__held"), "left_anti").drop("__key")

    def clean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            held = np.zeros(batch.num_rows, bool)
            held[[d for d, _, _ in index.search(batch, text)]] = True
            yield batch.filter(pa.array(~held))

    return docs.mapInArrow(clean, docs.schema)
