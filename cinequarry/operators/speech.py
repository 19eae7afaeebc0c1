"""Spoken words: which source counts, phrases within shots, spans of requests, transcripts of windows."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinequarry.functions.intervals import related
from cinequarry.functions.text import CJK
from cinequarry.operators.timeline import PHRASE_GAP_MS, transcript_score
from cinequarry.plans.broadcasts import checked, shuffled

_RUNS = rf"([{CJK}]+|[\p{{L}}\p{{Nd}}_&&[^{CJK}]]+)"


def components(text: Column) -> Column:
    """A phrase's parts in order: runs of a script without blanks, and words."""
    return F.regexp_extract_all(F.lower(F.trim(F.coalesce(text, F.lit("")))), F.lit(_RUNS), 1)


def expanded(segments: DataFrame) -> DataFrame:
    """asset, ordinal, start_ms, end_ms, text of recognised segments (same columns) as single tokens with their segment's time.

    A run of a script without blanks is its characters, a word stays whole;
    ordinals count through an asset's segments in order.
    """
    run = lambda r: F.when(r.rlike(f"^[{CJK}]"), F.filter(F.split(r, ""), lambda c: c != "")).otherwise(F.array(r))
    tokens = F.flatten(F.transform(components(F.col("text")), run))
    rows = segments.select("asset", F.col("ordinal").alias("segment"), "start_ms", "end_ms", F.posexplode(tokens).alias("place", "text"))
    return rows.select("asset", (F.col("segment") * 100_000 + F.col("place")).alias("ordinal"), "start_ms", "end_ms", "text")


def spoken(aligned: DataFrame, recognised: DataFrame) -> DataFrame:
    """asset, ordinal, start_ms, end_ms, text, confidence: aligned words, and recognised ones of assets that have none."""
    with_confidence = lambda d: d if "confidence" in d.columns else d.withColumn("confidence", F.lit(None).cast("double"))
    own = [c for c in ("asset", "ordinal", "start_ms", "end_ms", "text", "confidence")]
    rest = with_confidence(recognised).join(aligned.select("asset").distinct(), "asset", "left_anti")
    return with_confidence(aligned).select(*own).unionByName(rest.select(*own))


def follows(parts: Sequence[str], spans: Sequence[tuple[str, int, int]], gap_ms: int = PHRASE_GAP_MS) -> bool:
    """Whether spans (text, start_ms, end_ms) say the parts of a phrase, from some span on.

    The spans of a part without blanks must be its text put together; a word
    is the next span equal to it. No span that is looked at may start more
    than the gap after the last one that matched.
    """
    wide = [not p.isascii() and not p[0].isalpha() or "぀" <= p[0] <= "￿" for p in parts]

    def at(place: int) -> bool:
        last = None
        for part, joins in zip(parts, wide, strict=True):
            said = ""
            while place < len(spans):
                text, start, end = spans[place]
                if last is not None and start - last > gap_ms:
                    return False
                place += 1
                if joins:
                    said += text.lower()
                    last = end
                    if said == part:
                        break
                    if not part.startswith(said):
                        return False
                elif text.lower() == part:
                    said, last = part, end
                    break
            if said != part:
                return False
        return True

    return any(at(i) for i in range(len(spans)))


def words_on_shots(words: DataFrame, shots: DataFrame) -> DataFrame:
    """shot, asset and the words (asset, ordinal, start_ms, end_ms, text, confidence) that overlap each shot."""
    own = shots.select("asset", F.col("id").alias("shot"), "start_ms", "end_ms")
    met = related(words, shuffled(own), "asset", "simultaneous")
    return met.withColumnsRenamed({"left_start_ms": "start_ms", "left_end_ms": "end_ms"}).drop("right_start_ms", "right_end_ms")


def transcript_channel(queries: DataFrame, placed: DataFrame, gap_ms: int = PHRASE_GAP_MS) -> DataFrame:
    """query_id, id, score of shots in which a query's phrase (query_id, phrase) is spoken exactly.

    ``placed`` are words_on_shots(). Only words that a part of the phrase holds
    are joined; a shot that has them all is then checked in order, over all of
    its words. A phrase of one part scores by its words' confidence, longer
    ones 1.
    """
    parts = queries.select("query_id", components(F.col("phrase")).alias("parts")).where("size(parts) > 0")
    wanted = parts.select("query_id", "parts", F.explode(F.array_distinct("parts")).alias("part"))
    words = placed.withColumn("word", F.lower("text"))
    plain = words.join(checked(wanted.where(~F.col("part").rlike(f"^[{CJK}]"))), F.col("word") == F.col("part"))
    # A part of a script without blanks is written as its pieces no longer than the longest word: words meet them by equality.
    letters = words.where(F.col("word").rlike(f"[{CJK}]"))
    longest = letters.agg(F.max(F.char_length("word"))).first()[0] or 0
    size, at = F.char_length("part"), F.sequence(F.lit(1), F.char_length("part"))
    pieces = F.array_distinct(F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(max(longest, 1)), size - i + 1)), lambda n: F.substring("part", i, n)))))
    held = wanted.where(F.col("part").rlike(f"^[{CJK}]")).withColumn("word", F.explode(pieces))
    wide = letters.join(checked(held), "word")
    columns = ("query_id", "parts", "part", "shot", "confidence")
    hits = plain.select(*columns).unionByName(wide.select(*columns))
    likely = hits.groupBy("query_id", "parts", "shot").agg(F.count_distinct("part").alias("n"), transcript_score(F.col("confidence")).alias("said")).where("n = size(array_distinct(parts))")
    shots = shuffled(likely.select("shot").distinct())
    lists = placed.join(shots, "shot", "left_semi").groupBy("shot").agg(F.array_sort(F.collect_list(F.struct("ordinal", "start_ms", "end_ms", F.lower("text").alias("text")))).alias("spans"))  # as long as a shot

    @F.pandas_udf("boolean")
    def exact(own: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([follows(list(p), [(s["text"], s["start_ms"], s["end_ms"]) for s in rows], gap_ms) for p, rows in zip(own, spans, strict=True)])

    spoken = likely.join(shuffled(lists), "shot").where(exact("parts", "spans"))
    return spoken.select("query_id", F.col("shot").alias("id"), F.when(F.size("parts") == 1, F.col("said")).otherwise(F.lit(1.0)).alias("score"))


def request_spans(requests: DataFrame, words: DataFrame) -> DataFrame:
    """request, ordinal, text, start_ms, end_ms of the words that overlap each request (request, asset, start_ms, end_ms)."""
    met = related(words.select("asset", "ordinal", "text", "start_ms", "end_ms"), requests.select("asset", "request", "start_ms", "end_ms"), "asset", "simultaneous")
    return met.select("request", "ordinal", "text", F.col("left_start_ms").alias("start_ms"), F.col("left_end_ms").alias("end_ms"))


def sliced(segments: DataFrame, windows: DataFrame) -> DataFrame:
    """window, ordinal, start_ms, end_ms, text: segments (asset, ordinal, ...) within windows (asset, window, start_ms, end_ms), from the window's start on.

    Segments without length are left out; what reaches over a window is cut.
    """
    real = segments.where("end_ms > start_ms").select("asset", "ordinal", "text", "start_ms", "end_ms")
    met = related(real, windows.select("asset", "window", "start_ms", "end_ms"), "asset", "simultaneous")
    begin = F.greatest(F.col("left_start_ms") - F.col("right_start_ms"), F.lit(0))
    return met.select("window", "ordinal", begin.alias("start_ms"), (F.least("left_end_ms", "right_end_ms") - F.col("right_start_ms")).alias("end_ms"), "text")


def aligned_transcript(words: DataFrame) -> DataFrame:
    """asset, text: the words (asset, ordinal, start_ms, end_ms, text) with length and text, in order; a recording is one row."""
    real = words.where("end_ms > start_ms AND trim(text) <> ''")
    return real.groupBy("asset").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.trim("text").alias("t")))), lambda w: w["t"]), " ").alias("text"))
