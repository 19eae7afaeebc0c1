"""Exact dedup by content sort.

``repartitionByRange`` samples splitters over (normalised bytes, id) and deals
the rows; each task sorts externally (Spark spills), so equal texts are
adjacent; a streaming pass compares each text in full with its neighbour.
The id takes part in the splitters, so one group of copies with a third of all
rows is spread over as many range partitions as its rows need. What straddles
a partition boundary is stitched from two rows a partition: the first and the
last group of each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_long, keep_rows, partitions, raw_texts, settle, slices, small, text_code

_ROWS = "doc_id long, text_sha256 string, part int, run int, edge int, local_size long, local_keep long, code long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("text_sha256", pa.string()), ("part", pa.int32()), ("run", pa.int32()), ("edge", pa.int32()), ("local_size", pa.int64()), ("local_keep", pa.int64()), ("code", pa.int64())])

#: Characters of a text that take part in a splitter.
START = 32


def _comparing(pick: Callable) -> Callable:
    """A task that numbers the runs of equal neighbours of its sorted partition; ``pick`` chooses the id that stays.

    edge: 1 for the first run, 2 for the last, 3 for a run that is both.
    """

    def rows(runs: list[tuple[int, str, int, list]], last: int) -> pa.RecordBatch:
        part = TaskContext.get().partitionId()
        cols: list[list] = [[], [], [], [], [], [], [], []]
        for number, sha, code, members in runs:
            n = len(members)
            keep = pick((i for i in members if i is not None), default=None)
            edge = (1 if number == 0 else 0) | (2 if number == last else 0)
            for col, value in zip(cols, (members, [sha] * n, [part] * n, [number] * n, [edge] * n, [n] * n, [keep] * n, [code] * n), strict=True):
                col.extend(value)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW, strict=True)], schema=_ARROW)

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: bytes | None = None
        digest, hashed, run, ids = "", 0, -1, []
        done: list[tuple[int, str, int, list]] = []
        held = 0
        for batch in slices(batches):
            for text, doc, code in zip(raw_texts(batch), batch.column("doc_id").to_pylist(), batch.column("code").to_pylist(), strict=True):
                if text != before:
                    if run >= 0:
                        done.append((run, digest, hashed, ids))
                        held += len(ids)
                    before, digest, hashed, run, ids = text, hashlib.sha256(text).hexdigest(), code, run + 1, []
                    if held >= 8192:
                        yield rows(done, -1)
                        done, held = [], 0
                ids.append(doc)
        if run >= 0:
            done.append((run, digest, hashed, ids))
            yield rows(done, run)

    return compare


def exact_dedup(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", normalise: Column | None = None, keep: str = "smallest") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    ``normalise`` is the expression whose bytes are compared (the text itself
    by default); ``keep`` says whether the smallest or the largest id of a
    group stays.

    Null texts count as empty, and all empty texts form one group. A null id
    is never kept beside another id; in a group of null ids only, keep_id is
    null and every row is kept, as none can be told from the others. Rows
    repeated with the same id are all kept or all dropped together. Very long
    texts are compared whole. An empty table gives no rows; further columns
    are ignored, whatever their names.
    """
    return _marked(docs, text, doc_id, normalise, keep).drop("code")


def _marked(docs: DataFrame, text: str, doc_id: str, normalise: Column | None, keep: str) -> DataFrame:
    """exact_dedup() and a code of each row's compared text."""
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep!r}")
    own = F.coalesce(normalise if normalise is not None else F.col(text), F.lit(""))
    source = docs.select(as_long(doc_id).alias("doc_id"), own.alias("text")).withColumn("code", text_code())
    # Splitters are sampled through the driver, so they hold a text's start and hash, never a whole text.
    order = (F.substring("text", 1, START), F.col("code"), F.col("text"), F.col("doc_id"))
    dealt = source.repartitionByRange(partitions(docs.sparkSession), order[0], order[1], order[3]).sortWithinPartitions(*order)
    runs = settle(dealt.mapInArrow(_comparing(min if keep == "smallest" else max), _ROWS))
    # Two groups a partition can reach over its boundary: at most 2 rows for each range partition.
    edges = runs.where("edge > 0").groupBy("part", "run", "text_sha256").agg(F.first("local_size").alias("n"), F.first("local_keep").alias("k"))
    whole = (F.min if keep == "smallest" else F.max)("k").alias("whole_keep")
    straddling = settle(edges.groupBy("text_sha256").agg(F.count("*").alias("pieces"), F.sum("n").alias("whole_size"), whole).where("pieces > 1").drop("pieces"))
    joined = runs.join(small(straddling), "text_sha256", "left")
    best = F.coalesce("whole_keep", "local_keep")
    return joined.select("doc_id", best.alias("keep_id"), F.coalesce("whole_size", "local_size").alias("group_size"), F.col("doc_id").eqNullSafe(best).alias("kept"), "text_sha256", "code")


def drop_copies(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", normalise: Column | None = None, keep: str = "smallest") -> DataFrame:
    """The rows of ``docs``, columns unchanged, that exact_dedup() keeps; of rows equal in id and text, one."""
    own = F.coalesce(normalise if normalise is not None else F.col(text), F.lit(""))
    return keep_rows(docs, _marked(docs, text, doc_id, normalise, keep), doc_id, text_code(own))
