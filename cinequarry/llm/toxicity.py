"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding maps homoglyphs and digit substitutions to plain letters and
punctuation to blanks. The lexicon (word starts and whole words) and its
weights are learned as smoothed log odds from a bounded sample of labelled
rows, and so are phrases of two words in which a match is harmless; matches
inside exception phrases don't count. The weight found is normalised by the
text's length, and a logistic curve turns it into a score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .common import as_long, slices

# Characters that stand for another, and phrases that are harmless whatever is learned.
_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
_GLYPHS = dict(zip("аеорсухіјѕԁһԛԝνοαρτυικ", "aeopcyxijsdhqwvoaptuik", strict=True))
EXCEPTIONS = ("trash can", "trash bin", "clown fish")

_WIDE = {chr(0xFF41 + i): chr(97 + i) for i in range(26)} | {chr(0xFF10 + i): c for i, c in enumerate("oizeasbtbg")}
_BLANK = {chr(c): " " for c in range(128) if not chr(c).isalnum() and chr(c) not in _DIGITS}
_HIDDEN = {c: None for c in "­​‌‍﻿"}
_TABLE = str.maketrans(_BLANK | _DIGITS | _GLYPHS | _WIDE | _HIDDEN)

#: Labelled rows that the lexicon is learned from, at most.
TRAIN_ROWS = 20_000
STARTS = (4, 5, 6)


def fold(text: str) -> str:
    """Lower case, plain letters, words between blanks."""
    return f" {text.lower().translate(_TABLE)} "


def entries_of(folded: str) -> set[str]:
    """What a lexicon could hold of a text: ' word ' and ' start'."""
    words = set(folded.split())
    out = {f" {w} " for w in words if len(w) >= 3}
    for n in STARTS:
        out.update(f" {w[:n]}" for w in words if len(w) >= n)
    return out


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: Sequence[str] = EXCEPTIONS
    slope: float = 1.0
    shift: float = 0.0
    _automaton: object = field(default=None, repr=False, compare=False)

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for phrase in self.exceptions:
                self._automaton.add_word(fold(phrase), (len(fold(phrase)), None))
            for entry, w in self.weights.items():
                self._automaton.add_word(entry, (len(entry), w))
            if len(self._automaton):
                self._automaton.make_automaton()
        return self._automaton

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    def weight(self, text: str) -> float:
        """Weight of the matches, one a word, per the logarithm of the text's length in words."""
        found, safe = {}, []
        folded = fold(text)
        if len(self.automaton()):
            for end, (n, w) in self.automaton().iter(folded):
                if w is None:
                    safe.append((end - n + 1, end))
                elif w > found.get(end - n + 1, 0.0):
                    found[end - n + 1] = w
        total, reach, spans = 0.0, -1, iter(sorted(safe))
        span = next(spans, None)
        for at in sorted(found):  # one sweep over matches and safe spans
            while span and span[0] <= at:
                reach, span = max(reach, span[1]), next(spans, None)
            if at >= reach:
                total += found[at]
        return total / math.log2(16 + folded.count(" ")) if total else 0.0

    def phrases(self, text: str) -> set[str]:
        """The pairs of neighbouring words of which one has a match."""
        folded = fold(text)
        if not len(self.automaton()):
            return set()
        starts = {end - n + 2 for end, (n, w) in self.automaton().iter(folded) if w is not None}
        words = folded.split()
        out, at = set(), 0
        for i, word in enumerate(words):
            at = folded.index(word, at)
            if at in starts:
                out.update(" ".join(words[k : k + 2]) for k in (i - 1, i) if 0 <= k < len(words) - 1)
            at += len(word)
        return out

    def score(self, text: str) -> float:
        z = self.slope * self.weight(text) + self.shift
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _curve(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve by ridge Newton steps; n: rows behind each point."""
    theta = np.array([1.0, -1.0])
    design = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -40, 40)))
        gradient = design.T @ (n * (p - y)) + 1e-2 * theta
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        theta = theta - np.clip(np.linalg.solve(hessian, gradient), -2, 2)
    return float(max(theta[0], 0.0)), float(theta[1])


def train(docs: DataFrame, labels: DataFrame, usable: Column, *, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", exceptions: Sequence[str] = EXCEPTIONS, train_rows: int = TRAIN_ROWS, least_rows: int = 4, least_odds: float = 2.5) -> Lexicon:
    """Learn the lexicon from at most ``train_rows`` labelled rows for which ``usable`` (over doc_id) holds.

    The rows with the smallest id hashes are taken, a sample that doesn't
    depend on their order. Null labels and null texts are left out; a doc_id
    labelled more than once takes its highest label. Whole texts count, however
    long. Without labelled rows of both kinds the lexicon is empty and every
    score is low. Every word or start of a word that ``least_rows`` toxic rows
    have, with log odds of ``least_odds``, is an entry; every pair of words with
    a match that as many clean rows have and no toxic one is an exception.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(as_long(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).where(usable)
    chosen = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    # At most train_rows rows of two numbers.
    rows = docs.where(F.col(text).isNotNull()).select(as_long(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "y")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            bad, fine, n = Counter(), Counter(), [0, 0]
            for t, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                (bad if y else fine).update(entries_of(fold(t)))
                n[1 if y else 0] += 1
            names = [*dict.fromkeys([*bad, *fine]), ""]
            yield pa.RecordBatch.from_pydict({"entry": pa.array(names, pa.string()), "bad": pa.array([*(bad[e] for e in names[:-1]), n[1]], pa.int64()), "fine": pa.array([*(fine[e] for e in names[:-1]), n[0]], pa.int64())})

    counted = rows.mapInArrow(count, "entry string, bad long, fine long").groupBy("entry").agg(F.sum("bad").alias("bad"), F.sum("fine").alias("fine")).persist()
    try:
        totals = counted.where("entry = ''").first()
        if totals is None or not totals["bad"] or not totals["fine"]:
            return Lexicon({}, exceptions, 1.0, -4.0)
        odds = F.log((F.col("bad") + 0.5) / (totals["bad"] + 1.0)) - F.log((F.col("fine") + 0.5) / (totals["fine"] + 1.0))
        best = counted.where((F.col("entry") != "") & (F.col("bad") >= least_rows)).withColumn("w", odds).where(F.col("w") >= least_odds).orderBy("entry").collect()  # bounded by the sample's words
    finally:
        counted.unpersist()
    lexicon = Lexicon({r["entry"]: float(r["w"]) for r in best}, exceptions)

    def around(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            bad, fine = Counter(), Counter()
            for t, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                (bad if y else fine).update(lexicon.phrases(t))
            names = list(dict.fromkeys([*bad, *fine]))
            yield pa.RecordBatch.from_pydict({"phrase": pa.array(names, pa.string()), "bad": pa.array([bad[p] for p in names], pa.int64()), "fine": pa.array([fine[p] for p in names], pa.int64())})

    met = rows.mapInArrow(around, "phrase string, bad long, fine long").groupBy("phrase").agg(F.sum("bad").alias("bad"), F.sum("fine").alias("fine"))
    harmless = met.where((F.col("bad") == 0) & (F.col("fine") >= least_rows)).orderBy("phrase").collect()  # bounded by the sample's words
    lexicon = Lexicon(lexicon.weights, (*exceptions, *(r["phrase"] for r in harmless)))

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = [round(lexicon.weight(t), 2) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"x": pa.array(x, pa.float64()), "y": pa.array([1 if y else 0 for y in batch.column("y").to_pylist()], pa.int32())})

    # Rounded weights: no more points than rows of the bounded sample.
    points = rows.mapInArrow(weigh, "x double, y int").groupBy("x", "y").count().toPandas()
    lexicon.slope, lexicon.shift = _curve(points["x"].to_numpy(float), points["y"].to_numpy(float), points["count"].to_numpy(float))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, *, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with a score column (0 to 1) added or replaced.

    Null and empty texts get the score of no match; very long ones are scored
    whole. Repeated rows and null ids keep their rows, further columns stay as
    they are, and an empty table gives no rows.
    """
    source = docs.drop(column)
    names = source.columns

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            values = [lexicon.score(t or "") for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], names=[*names, column])

    return source.mapInArrow(scored, StructType([*source.schema.fields]).add(column, DoubleType()))
