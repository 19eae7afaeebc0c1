"""Best-fit packing with certified bounds.

Every document is tokenised whole and cut into pieces of at most ``capacity``
tokens. Pieces are dealt evenly to partitions, and each is packed by best-fit
decreasing. Dual feasible functions give a lower bound on the bins that any
packing of a partition (and of the corpus) needs: a partition that meets its
bound is certified and stays as it is. Partitions with a gap give the pieces
of their bins with room to the next round, where they mix with other
partitions' and best-fit decreasing runs again, until the corpus meets its
own bound or a round saves nothing.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, as_long, settle, slices, trim, words_of

CAPACITY = 4096
#: Pieces a partition packs at once.
PIECES = 4096
#: Rounds at most; partitions grow eightfold with each, up to this many pieces.
ROUNDS, MOST_PIECES = 5, 1 << 20
#: Distinct words whose ids a task keeps.
CACHE_WORDS = 1_000_000
#: Text bytes that a task encodes at once where its worker serves other stages too.
PASSING_BYTES = 1 << 20
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECE_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    return made


class WordIds:
    """Ids of words in one flat array, remembered between batches.

    The tokenizer's pieces never span white space, so a text's ids are those
    of its words in order; where it folds case, words are folded first.
    """

    def __init__(self, path: str, most: int = CACHE_WORDS):
        self.path, self.most = path, most
        letters = _tokenizer(path).encode_batch_fast([*ascii_uppercase, *ascii_lowercase], add_special_tokens=False)
        self.folds = all(a.ids == b.ids for a, b in zip(letters[:26], letters[26:], strict=True))
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.starts, self.lengths, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, "<u4")

    def places(self, words: list[bytes]) -> np.ndarray:
        """Where each of the (distinct) words is; new ones are encoded."""
        new = [w for w in words if w not in self.known]
        if new and len(self.known) + len(new) > self.most:
            self.forget()
            new = words
        if new:
            coded = _tokenizer(self.path).encode_batch_fast([w.decode() for w in new], add_special_tokens=False)
            ids = [e.ids for e in coded]
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.starts = np.append(self.starts, len(self.flat) + np.cumsum(lengths) - lengths)
            self.lengths = np.append(self.lengths, lengths)
            self.flat = np.append(self.flat, np.fromiter(chain.from_iterable(ids), "<u4", int(lengths.sum())))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def ids(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with its end; how many each text has)."""
        values, codes, counts = words_of(texts, lower=self.folds)
        place = self.places([w for w in values.to_pylist() if w])
        if len(place) < len(values):  # the blank word has no ids
            at = np.flatnonzero(np.asarray(pc.binary_length(values)) > 0)
            place = np.bincount(at, place, len(values)).astype(np.int64)
        sizes, begin = self.lengths[place][codes], self.starts[place][codes]
        stop = np.cumsum(counts)  # one more id behind a text's last word
        sizes, begin = np.insert(sizes, stop, 1), np.insert(begin, stop, len(self.flat))
        into = np.cumsum(sizes) - sizes
        ids = np.append(self.flat, np.array([end_id], "<u4"))[np.repeat(begin - into, sizes) + np.arange(int(sizes.sum()))]
        ends = np.append(into, len(ids))[stop + np.arange(1, len(stop) + 1)]
        return ids, np.diff(ends, prepend=0)


@lru_cache(maxsize=2)
def _word_ids(path: str, most: int) -> WordIds:
    """One memory for all tasks of a worker."""
    return WordIds(path, most)


def pieces_of(docs: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY, end_id: int = 1, text: str = "text", doc_id: str = "doc_id", cache_words: int = CACHE_WORDS, lasting: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: only documents over ``capacity`` are cut."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _word_ids(tokenizer_path, cache_words)
        for batch in slices(batches, limit=SLICE_BYTES if lasting else PASSING_BYTES):
            ids, counts = known.ids(batch.column("text"), end_id)
            pieces = -(-counts // capacity)
            owner = np.repeat(np.arange(len(counts)), pieces)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(capacity, counts[owner] - start)
            at = (np.cumsum(counts) - counts)[owner] + start
            raw = memoryview(ids).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            cols = [batch.column("doc_id").take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, schema=_PIECE_ARROW)
        if not lasting:
            del known
            _word_ids.cache_clear()
            _tokenizer.cache_clear()
            trim()

    return docs.select(as_long(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(cut, _PIECE)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs; counts[n] is the number of items of length n.

    The best of three families of dual feasible functions: the plain sum, the
    threshold functions (items over capacity - e count whole, those under e
    not at all) and the rounding functions of k+1 parts.
    """
    lengths = np.arange(len(counts))
    total = int((counts * lengths).sum())
    best = -(-total // capacity)
    present = np.flatnonzero(counts)
    mass, many = np.concatenate(([0], np.cumsum(counts * lengths))), np.concatenate(([0], np.cumsum(counts)))
    for e in present[present <= capacity // 2].tolist():
        whole = int(many[-1] - many[capacity - e + 1]) * capacity
        best = max(best, -(-(whole + int(mass[capacity - e + 1] - mass[e])) // capacity))
    for k in range(1, 33):
        scaled = (k + 1) * lengths
        value = np.where(scaled % capacity == 0, lengths * k, scaled // capacity * capacity)  # times k
        best = max(best, -(-int((counts * value).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each item, its offset there, fill of each bin).

    Open bins are kept by free space; a bit set finds the tightest that fits.
    """
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, fill = 0, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        if room > n:
            by_room[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins, offsets, np.array(fill, np.int64)


def _histogram(df: DataFrame, capacity: int) -> np.ndarray:
    """Items of each length: at most ``capacity`` rows."""
    counts = np.zeros(capacity + 1, np.int64)
    for row in df.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    return counts


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, pieces_each: int = PIECES, most_pieces: int = MOST_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """``pieces`` (with a length column, 1 to capacity) plus sequence_id, offset.

    Any number of pieces, repeated rows and ties included; no rows give none.
    A sequence's offsets are gapless from 0.
    """
    columns = pieces.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema), "sequence_id long, offset long, released boolean"])

    def run(number: int):
        def packed(keys: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            lengths = table.column("length").to_numpy()
            bins, offsets, fill = best_fit_decreasing(lengths, capacity)
            room = fill < capacity
            if len(fill) <= lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity):
                # Certified: only what rounding the bound up may have left goes on, the emptiest bin.
                room &= np.arange(len(fill)) == fill.argmin()
            out = table.select(columns)  # Arrow throughout: a null beside an id would make floats of a pandas column
            for name, values in (("sequence_id", bins + (keys[0].as_py() << 24) + (number << 58)), ("offset", offsets), ("released", room[bins])):
                out = out.append_column(name, pa.array(values))
            return out

        return packed

    todo = settle(pieces)
    n = todo.count()
    bound = lower_bound(_histogram(todo, capacity), capacity) if n else 0
    parts: list[DataFrame] = []
    closed, before, held = 0, 0, None  # bins that are final; bins that this round's pieces filled, and how
    for number in range(rounds):
        groups = max(1, -(-n // min(most_pieces, pieces_each << 3 * number)))
        # An even deal, whatever the ids: the table is written, so a row's number stays the same.
        dealt = todo.withColumn("__part", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(number)), F.lit(groups)))
        done = settle(dealt.groupBy("__part").applyInArrow(run(number), schema))
        tally = done.where("offset = 0").agg(F.count("*").alias("bins"), F.count_if("released").alias("released")).first()
        bins, released = int(tally["bins"]), int(tally["released"])
        if held is not None and bins >= before:  # the exchange saved nothing
            parts.append(held)
            break
        if closed + bins <= bound or released <= 1 or groups == 1 or number == rounds - 1:
            parts.append(done)
            break
        parts.append(done.where("NOT released"))
        held = done.where("released")
        closed, before = closed + bins - released, released
        todo = held.select(*columns)
        n = todo.count()
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("released")


def pack_documents(docs: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id", cache_words: int = CACHE_WORDS, lasting: bool = True) -> DataFrame:
    """Best-fit packing of whole documents: a row per piece, see pieces_of() and pack().

    Null and empty texts give a piece of one token, the end id. Very long
    texts are cut, never shortened. Null and repeated ids keep their rows as
    they are, and so do ids beside a null. An empty table gives no rows;
    further columns of ``docs`` are not read, whatever their names. A task
    keeps the ids of ``cache_words`` words, some 150 bytes each; fewer cost
    time, not results. So does forgetting them at a task's end (``lasting``
    False), which leaves a worker's memory to other stages.
    """
    return pack(pieces_of(docs, tokenizer_path, capacity=capacity, text=text, doc_id=doc_id, cache_words=cache_words, lasting=lasting), capacity=capacity)
