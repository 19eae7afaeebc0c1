"""Text columns: tokens, normalised keys and hashed feature vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

#: Width of a hashed feature vector.
FEATURES = 64
#: Rows whose terms are hashed at once.
FEATURE_ROWS = 512
#: Bytes of a term up to which it is hashed together with others.
LONG_TERM = 64

# Scripts written without blanks, and words that stand for one concept.
CJK = r"぀-ゟ゠-ヿ㐀-鿿가-힯豈-﫿"
CONCEPTS = {
    "rain": ["rain", "rainy", "raining", "雨"],
    "city": ["city", "urban", "downtown", "城市", "城"],
    "night": ["night", "nighttime", "evening", "夜", "晚"],
    "street": ["street", "road", "alley", "街", "路"],
    "person": ["person", "people", "human", "pedestrian", "人", "行人"],
    "traffic": ["traffic", "car", "vehicle", "车", "车流"],
    "cinematic": ["cinematic", "film", "moody", "电影", "氛围"],
    "beach": ["beach", "ocean", "sea", "海", "沙滩"],
    "day": ["day", "daytime", "sunny", "白天", "晴"],
}


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_tokens(c: str | Column) -> Column:
    """Runs of a-z and 0-9 in lower case; null gives none."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit("([a-z0-9]+)"), 1)


def chunks(c: str | Column) -> Column:
    """Runs of text as arrays of tokens, one array a run.

    A word run is one token; a CJK run is its overlapping pairs of characters,
    so a query for it is a phrase. A word stops where CJK begins.
    """
    runs = F.regexp_extract_all(F.lower(F.trim(F.coalesce(_col(c), F.lit("")))), F.lit(rf"([{CJK}]+|[\p{{L}}\p{{Nd}}_&&[^{CJK}]]+)"), 1)
    pairs = lambda run: F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substr(run, i, F.lit(2)))
    return F.transform(runs, lambda run: F.when(run.rlike(f"^[{CJK}]"), pairs(run)).otherwise(F.array(run)))


def tokens(c: str | Column) -> Column:
    return F.flatten(chunks(c))


def tag_key(c: str | Column) -> Column:
    """Lower case with every run of other ASCII characters as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(_col(c))), r"[\x00-\x7F&&[^a-z0-9]]+", "_"), "^_+|_+$", "")


def closed_value(c: str | Column, allowed: Sequence[str], fallback: str) -> Column:
    """A value of a closed vocabulary; anything else is the fallback."""
    key = F.regexp_replace(F.lower(F.trim(F.coalesce(_col(c), F.lit("")))), r"[\s\-]+", "_")
    return F.when(key.isin(*allowed), key).otherwise(F.lit(fallback))


def clean_list(c: str | Column, longest: int = 80, most: int = 64) -> Column:
    """Lower-cased, trimmed, cut and distinct values in their order, without empty ones."""
    values = F.transform(_col(c), lambda x: F.trim(F.substring(F.lower(F.trim(x)), 1, longest)))
    return F.slice(F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x != ""))), 1, most)


def shortened(c: str | Column, most: int, suffix: str = "…") -> Column:
    return F.when(F.char_length(_col(c)) > most, F.concat(F.substring(_col(c), 1, most - len(suffix)), F.lit(suffix))).otherwise(_col(c))


def concepts(c: str | Column) -> Column:
    """Distinct concepts: those of CONCEPTS that the text names, then its other words of three letters or more."""
    families = [(name, [w for w in own if w.isascii()], [w for w in own if not w.isascii()]) for name, own in CONCEPTS.items()]
    listed = lambda words: F.array(*[F.lit(w) for w in words])
    word = rf"[a-z0-9_[\p{{L}}\p{{Nd}}&&[^{CJK}]]]"  # of a word run of chunks()

    def named(text: Column, plain: Column) -> Column:
        met = lambda own, wide: reduce(or_, [F.contains(text, F.lit(w)) for w in wide], F.arrays_overlap(plain, listed(own)))
        return F.array_compact(F.array(*[F.when(met(own, wide), F.lit(name)) for name, own, wide in families]))

    def told(text: Column) -> Column:
        plain = F.array_intersect(F.split(text, "[^a-z0-9]+"), listed([w for _, own, _ in families for w in own]))
        rest = F.array_except(F.regexp_extract_all(text, F.lit(f"({word}{word}{word}+)"), 1), listed([w for own in CONCEPTS.values() for w in own]))
        return F.concat(_once(plain, lambda words: named(text, words)), rest)  # a concept's name is one of its words, so it isn't in the rest

    return _once(F.lower(F.trim(F.coalesce(_col(c), F.lit("")))), told)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fnv1a(token: bytes) -> int:
    """32-bit FNV-1a."""
    h = 0x811C9DC5
    for b in token:
        h = ((h ^ b) * 0x01000193) & 0xFFFFFFFF
    return h


def pieces(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of ``rows`` rows at most."""
    return (batch.slice(lo, rows) for batch in batches for lo in range(0, batch.num_rows, rows))


def fnv1a_each(strings: pa.Array) -> np.ndarray:
    """fnv1a() of every string of an array without nulls, all strings a byte further at once."""
    strings = strings.cast(pa.large_string())
    at = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1] if len(strings) else np.zeros(1, np.int64)
    data = np.frombuffer(strings.buffers()[2] or b"", np.uint8)
    starts, lengths = at[:-1], np.diff(at)
    out = np.full(len(strings), 0x811C9DC5, np.uint32)
    order = np.argsort(-np.where(lengths > LONG_TERM, 0, lengths), kind="stable")
    own, first = out[order], starts[order]
    left = np.cumsum(np.bincount(lengths[lengths <= LONG_TERM], minlength=1)[::-1])[::-1]  # strings of a length or more
    for place, n in enumerate(left[1:].tolist()):
        own[:n] ^= data[first[:n] + place]
        own[:n] *= np.uint32(0x01000193)
    out[order] = own
    for i in np.flatnonzero(lengths > LONG_TERM).tolist():
        out[i] = fnv1a(data[starts[i] : at[i + 1]].tobytes())
    return out


def with_features(rows: DataFrame, terms: str, out: str = "vector", *, keep: Sequence[str] | None = None) -> DataFrame:
    """``rows`` (its columns ``keep``, by default all) with the unit vector of an array column's signed hashed terms; zeros without terms.

    Spark has no FNV-1a, so this step is in Arrow batches.
    """
    rows = rows.drop(out)
    names = list(rows.columns if keep is None else keep)

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, FEATURE_ROWS):
            lists = batch.column(terms)
            own = pc.list_flatten(lists)
            there = np.asarray(own.is_valid())
            hashes = fnv1a_each(own.drop_null())
            places = pc.list_parent_indices(lists).to_numpy()[there] * FEATURES + hashes % FEATURES
            vectors = np.bincount(places, np.where(hashes % 2 == 0, 1.0, -1.0), batch.num_rows * FEATURES).reshape(-1, FEATURES)
            lengths = np.sqrt((vectors * vectors).sum(1, keepdims=True))
            vectors = vectors / np.where(lengths > 0, lengths, 1)
            ends = pa.array(np.arange(0, vectors.size + 1, FEATURES, np.int32))
            yield pa.RecordBatch.from_arrays([*[batch.column(name) for name in names], pa.ListArray.from_arrays(ends, pa.array(vectors.ravel()))], names=[*names, out])

    return rows.mapInArrow(hashed, StructType([rows.schema[name] for name in names]).add(out, ArrayType(DoubleType())))
