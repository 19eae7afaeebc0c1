"""Substring dedup by prefix-partitioned suffix trees over words.

Suffixes are grouped by a prefix, each group's suffixes form a subtree, and an
internal node as deep as the window is a repeated window. Shipping a window's
words with every suffix would cost twenty times the corpus, so:

* the tree is sparse. Every window of ``window`` words picks one of its
  ``prefix``-word grams (the one of least hash, leftmost), so equal windows
  pick alike, and only suffixes that start at a picked gram, the anchor, are
  in the tree. One record with the words around an anchor stands for all
  windows that picked it. The anchor is the prefix that Spark partitions by.
* anchors that occur once are dropped before any words are shipped.
* each task first builds the trees of its own batch, so a passage that a third
  of all documents share goes out once a batch.
* an anchor of more records than a task holds gets longer prefixes: each of its
  windows is a record of its own, under the hash of all its words. Such a group
  has one first occurrence, however many different words stand around the anchor.

In a subtree, nodes are refined level by level, to the right of the anchor and
to its left; a window is a pair of nodes whose depths add up to ``window``.
Comparisons are of words, not of hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_long, gram_hashes, mix, partitions, raw_texts, run_starts, settle, slices, word_codes

WINDOW, PREFIX = 20, 6
#: Records a task holds to build the subtrees of whole groups.
RECORDS = 20_000
_LOW32 = (1 << 32) - 1


def picked(codes: np.ndarray, counts: np.ndarray, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, anchor, hash) of every run of windows that pick one anchor; places are in ``codes``."""
    none = np.empty(0, np.int64)
    if len(codes) < window:
        return none, none, none, np.empty(0, np.uint64)
    hashes = gram_hashes(codes, prefix)
    span, best, width = window - prefix + 1, np.arange(len(hashes)), 1

    def least(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.where(hashes[left] <= hashes[right], left, right)

    while 2 * width <= span:
        best, width = least(best[:-width], best[width:]), 2 * width
    if width < span:
        best = least(best[: len(best) - (span - width)], best[span - width :])
    ends = np.repeat(np.cumsum(counts), counts)[: len(best)]
    starts = np.flatnonzero(np.arange(len(best)) + window <= ends)
    if not len(starts):
        return none, none, none, np.empty(0, np.uint64)
    anchor = best[starts]
    first = run_starts(anchor)
    # The next document's windows never share an anchor, as theirs start behind the boundary.
    return starts[first], np.diff(np.append(first, len(anchor))), anchor[first], hashes[anchor[first]]


class Records:
    """Records of one batch: words around anchors, and which of their windows are open."""

    def __init__(self, hashes, docs, starts, left, opened, words):
        self.hashes, self.docs, self.starts, self.left, self.opened, self.words = hashes, docs, starts, left, opened, words

    def repeated(self, window: int) -> np.ndarray:
        """Bits of the open windows that occur before, in this batch; bit j is the window at starts + j."""
        n = len(self.words)
        removed = np.zeros(n, np.int64)
        if n < 2:
            return removed
        sizes = np.fromiter(map(len, self.words), np.int64, n)
        flat = np.fromiter(chain.from_iterable(self.words), object, int(sizes.sum()))
        codes = np.append(pd.factorize(flat)[0].astype(np.int64), -1)
        base = np.cumsum(sizes) - sizes
        many = int(codes.max()) + 2

        def refine(nodes: np.ndarray, at: np.ndarray) -> np.ndarray:
            inside = (at >= 0) & (at < sizes)
            code = codes[np.where(inside, base + at, len(codes) - 1)]
            return np.unique(nodes * many + code + 1, return_inverse=True)[1]

        right = [np.unique(self.hashes, return_inverse=True)[1]]
        for d in range(window):
            right.append(refine(right[-1], self.left + d))
        left = np.zeros(n, np.int64)
        for o in range(int(self.left.max()) + 1):
            if o:
                left = refine(left, self.left - o)
            j = self.left - o
            valid = (j >= 0) & ((self.opened >> np.maximum(j, 0)) & 1).astype(bool)
            who = np.flatnonzero(valid)
            if len(who) < 2:
                continue
            node = right[window - o][who] * n + left[who]
            start = self.starts[who] + j[who]
            order = np.lexsort((start, self.docs[who], node))
            who, node, start, doc = who[order], node[order], start[order], self.docs[who][order]
            runs = run_starts(node)
            head = np.repeat(runs, np.diff(np.append(runs, len(node))))
            later = (doc != doc[head]) | (start != start[head])
            removed[who[later]] |= np.int64(1) << j[who[later]]
        return removed


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    own = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.coalesce(as_long(doc_id), F.lit(-(1 << 63))).alias("doc"), as_long(doc_id).alias("doc_id"), own.alias("text")).withColumn("crc", F.crc32(F.col("text").cast("binary")))


def _repeated_anchors(source: DataFrame, window: int, prefix: int) -> DataFrame:
    """doc, crc, anchors of documents with anchors that occur again; one anchor a batch goes out.

    A row without doc holds, as crc, the gram of an anchor that occurs more than RECORDS times.
    """

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            codes, counts = word_codes(batch.column("text"))
            _, _, anchor, hashes = picked(codes, counts, window, prefix)
            begin = np.cumsum(counts) - counts
            owner = np.searchsorted(np.cumsum(counts), anchor, side="right")
            doc = batch.column("doc").to_numpy()[owner] if len(anchor) else np.empty(0, np.int64)
            crc = batch.column("crc").to_numpy()[owner] if len(anchor) else np.empty(0, np.int64)
            place = anchor - begin[owner]
            order = np.argsort(hashes, kind="stable")
            runs = run_starts(hashes[order])
            sizes = np.diff(np.append(runs, len(order)))
            again = np.zeros(len(anchor), np.int64)  # 0: alone here, 1: spoken for, more: speaks for so many here
            again[order] = np.where(np.repeat(sizes, sizes) > 1, 1, 0)
            again[order[runs[sizes > 1]]] = sizes[sizes > 1]
            key = np.where(again == 1, mix(hashes + anchor.astype(np.uint64) + np.uint64(1)), hashes)
            yield pa.RecordBatch.from_pydict({"gram": pa.array(key.view(np.int64)), "doc": pa.array(doc), "tag": pa.array(crc << 32 | place), "again": pa.array(again)})

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("gram", "doc", "tag", "again")
        alone = [np.empty(0, np.int64)] * 4  # the last row, while its gram has no other
        open_gram, open_times, open_rows = 0, 0, 0  # the last gram, its occurrences and rows that are out

        def out(cols: list[np.ndarray]) -> pa.RecordBatch:
            nonlocal alone, open_gram, open_times, open_rows
            gram, doc, tag, again = cols
            runs = run_starts(gram)
            sizes, times = np.diff(np.append(runs, len(gram))), np.add.reduceat(np.maximum(again, 1), runs)
            before = 0
            if open_rows and gram[0] == open_gram:
                before = open_times
                times[0] += before
                sizes[0] += open_rows
            many = np.repeat(sizes > 1, np.diff(np.append(runs, len(gram))))
            keep = many | (again > 0)
            large = times > RECORDS
            large[0] &= before <= RECORDS  # told once
            alone = [c[:0] if keep[-1] else c[-1:] for c in cols]
            open_gram, open_times, open_rows = gram[-1], times[-1], sizes[-1] if keep[-1] else 0
            grams = gram[runs[large]]
            docs = pa.concat_arrays([pa.array(doc[keep]), pa.nulls(len(grams), pa.int64())])
            return pa.RecordBatch.from_pydict({"doc": docs, "crc": pa.array(np.append((tag[keep] >> 32) & _LOW32, grams)), "anchor": pa.array(np.append(tag[keep] & _LOW32, 0 * grams).astype(np.int32))})

        for batch in batches:
            cols = [np.concatenate((r, batch.column(c).to_numpy())) for r, c in zip(alone, names, strict=True)]
            if len(cols[0]):
                yield out(cols)

    found = source.select("doc", "crc", "text").mapInArrow(emit, "gram long, doc long, tag long, again long")
    met = found.repartition(partitions(source.sparkSession), "gram").sortWithinPartitions("gram").mapInArrow(meet, "doc long, crc long, anchor int")
    return met.groupBy("doc", "crc").agg(F.collect_list("anchor").alias("anchors"))


_RECORD = pa.schema([("gram", pa.int64()), ("doc", pa.int64()), ("crc", pa.int64()), ("start", pa.int32()), ("left", pa.int32()), ("opened", pa.int64()), ("removed", pa.int64()), ("words", pa.binary())])
_RECORD_SQL = "gram long, doc long, crc long, start int, left int, opened long, removed long, words binary"


def _records(source: DataFrame, anchors: DataFrame, window: int, prefix: int) -> DataFrame:
    """A record per repeated anchor, after the batch's own subtrees; those with nothing open carry no words.

    Of anchors that occur more than RECORDS times, a record per open window.
    """
    # At most a gram for every RECORDS anchors of the input.
    large = np.array([r["crc"] for r in anchors.where("doc IS NULL").select("crc").collect()], np.int64)

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lists = [t.split() for t in raw_texts(batch)]
            codes, counts = word_codes(batch.column("text"))
            begin = np.cumsum(counts) - counts
            first, many, anchor, hashes = picked(codes, counts, window, prefix)
            wanted = batch.column("anchors")
            parent = np.repeat(np.arange(batch.num_rows), np.diff(wanted.offsets.to_numpy()))
            chosen = np.isin(anchor, begin[parent] + wanted.flatten().to_numpy())
            first, many, anchor, hashes = first[chosen], many[chosen], anchor[chosen], hashes[chosen]
            owner = np.searchsorted(np.cumsum(counts), anchor, side="right")
            doc, crc = batch.column("doc").to_numpy()[owner] if len(owner) else owner, batch.column("crc").to_numpy()[owner] if len(owner) else owner
            start = first - begin[owner]
            words = [lists[o][s : s + m - 1 + window] for o, s, m in zip(owner.tolist(), start.tolist(), many.tolist(), strict=True)]
            opened = (np.int64(1) << many) - 1
            removed = Records(hashes, doc, start, anchor - first, opened, words).repeated(window)
            opened &= ~removed
            split = np.flatnonzero(np.isin(hashes.view(np.int64), large) & (opened > 0))
            if len(split):
                bit = np.arange(window - prefix + 1)
                who, j = np.nonzero((opened[split, None] >> bit) & 1)
                who = split[who]
                whole = mix(gram_hashes(codes, window)[first[who] + j] + np.uint64(prefix))
                sent = [b" ".join(words[w][b : b + window]) for w, b in zip(who.tolist(), j.tolist(), strict=True)]
                cols = [whole.view(np.int64), doc[who], crc[who], start[who] + j, anchor[who] - first[who] - j, np.ones(len(who), np.int64), np.zeros(len(who), np.int64), sent]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _RECORD, strict=True)], schema=_RECORD)
                opened[split] = 0
            key = np.where(opened > 0, hashes, mix(hashes + anchor.astype(np.uint64) + np.uint64(1)))
            sent = [b" ".join(w) if o else None for w, o in zip(words, opened.tolist(), strict=True)]
            cols = [key.view(np.int64), doc, crc, start, anchor - first, opened, removed, sent]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _RECORD, strict=True)], schema=_RECORD)

    return source.join(anchors, ["doc", "crc"]).select("doc", "crc", "text", "anchors").mapInArrow(emit, _RECORD_SQL)


def _marks(records: DataFrame, window: int) -> DataFrame:
    """doc, crc, marks: windows to remove, as start << 16 | bits."""

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(doc: np.ndarray, crc: np.ndarray, start: np.ndarray, removed: np.ndarray) -> pa.RecordBatch:
            k = removed > 0
            return pa.RecordBatch.from_pydict({"doc": pa.array(doc[k]), "crc": pa.array(crc[k]), "mark": pa.array(start[k].astype(np.int64) << 16 | removed[k])})

        held: list[pa.RecordBatch] = []
        rows = 0

        def grow(last: bool) -> Iterator[pa.RecordBatch]:
            """Judge the whole groups held; of a group too large to hold, keep only first occurrences."""
            nonlocal held, rows
            table = pa.Table.from_batches(held).combine_chunks()
            gram = table["gram"].to_numpy()
            cut = len(gram) if last else int(np.searchsorted(gram, gram[-1]))
            carry = not cut
            cut = cut or len(gram)
            now = table.slice(0, cut)
            cols = {c: now[c].to_numpy() for c in ("gram", "doc", "crc", "start", "left", "opened", "removed")}
            live = np.flatnonzero(cols["opened"])
            words = now["words"].take(pa.array(live)).to_pylist()
            bits = np.zeros(cut, np.int64)
            bits[live] = Records(cols["gram"][live].view(np.uint64), cols["doc"][live], cols["start"][live].astype(np.int64), cols["left"][live].astype(np.int64), cols["opened"][live], [w.split(b" ") for w in words]).repeated(window)
            yield out(cols["doc"], cols["crc"], cols["start"], cols["removed"] | bits)
            kept = []
            if carry:
                opened = cols["opened"] & ~bits
                first = np.flatnonzero(opened)
                again = now.take(pa.array(first))
                again = again.set_column(again.schema.get_field_index("opened"), _RECORD.field("opened"), pa.array(opened[first])).set_column(again.schema.get_field_index("removed"), _RECORD.field("removed"), pa.array(np.zeros(len(first), np.int64)))
                kept = again.cast(_RECORD).to_batches()
            held = [*kept, *table.slice(cut).to_batches()]
            rows = sum(b.num_rows for b in held)

        seen = 0
        for batch in slices(batches, "words"):
            held.append(batch.cast(_RECORD))
            rows += batch.num_rows
            seen += batch.num_rows
            if seen >= RECORDS:
                seen = 0
                yield from grow(False)
        if held:
            yield from grow(True)

    dealt = records.repartition(partitions(records.sparkSession), "gram").sortWithinPartitions("gram", "doc", "start")
    found = dealt.mapInArrow(judge, "doc long, crc long, mark long")
    return found.groupBy("doc", "crc").agg(F.collect_list("mark").alias("marks"))


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("spans", pa.list_(pa.int32()))])


def substring_dedup(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """doc_id, n_words, n_removed, kept, spans of every row.

    A word goes if a window of ``window`` words covers it whose words also
    start earlier: in a smaller doc_id, or before in the same document.
    Windows are judged on the input. kept is the other words joined by one
    space; spans lists begin and end of the removed runs in words, flat.

    Null and empty texts have no words; very long ones are cut whole. Null ids
    come before all others. Rows equal in id and text are one document and lose the same words; rows of one
    id with different texts are compared by place alone. An empty table gives
    no rows; further columns are ignored.
    """
    if not prefix < window <= prefix + 15:
        raise ValueError("a window has 1 to 15 words more than the prefix")
    source = _keyed(docs, text, doc_id)
    dealt = source.repartition(partitions(docs.sparkSession), "doc", "crc")
    anchors = settle(_repeated_anchors(source, window, prefix))
    marks = _marks(_records(dealt, anchors, window, prefix), window)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            cols: list[list] = [batch.column("doc_id").to_pylist(), [], [], [], []]
            for t, own in zip(raw_texts(batch), batch.column("marks").to_pylist(), strict=True):
                words = t.split()
                change = np.zeros(len(words) + 1, np.int32)
                for mark in own or ():
                    at, bits = mark >> 16, mark & 0xFFFF
                    while bits:
                        low = (bits & -bits).bit_length() - 1
                        change[at + low] += 1
                        change[at + low + window] -= 1
                        bits &= bits - 1
                gone = np.cumsum(change[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))).tolist()
                kept, begin = [], 0
                for a, b in zip(edges[::2], edges[1::2], strict=True):
                    kept += words[begin:a]
                    begin = b
                kept += words[begin:]
                for col, value in zip(cols[1:], (len(words), len(words) - len(kept), b" ".join(kept).decode(), edges), strict=True):
                    col.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _KEPT, strict=True)], schema=_KEPT)

    return dealt.join(marks, ["doc", "crc"], "left").select("doc_id", "text", "marks").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string, spans array<int>")
