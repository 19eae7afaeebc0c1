"""Timed observations: conditions and predicates, spoken phrases, coverage, planning of windows."""

from __future__ import annotations

from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinequarry.functions.intervals import related

PHRASE_GAP_MS = 1500


def matching_assets(windows: DataFrame, predicates: list[tuple[str, str, str, int]], conditions: list[str]) -> DataFrame:
    """Assets with windows (asset, condition, start_ms, end_ms) for every condition and a pair for every predicate.

    A predicate is (left condition, relation, right condition, largest gap).
    """
    have = windows.where(F.col("condition").isin(*conditions)).groupBy("asset").agg(F.count_distinct("condition").alias("n")).where(F.col("n") == len(set(conditions))).select("asset")
    for left, relation, right, gap in predicates:
        own = lambda c: windows.where(F.col("condition") == c).select("asset", "start_ms", "end_ms")
        pairs = related(own(left), own(right), "asset", relation, max_gap_ms=gap)
        have = have.join(pairs.select("asset").distinct(), "asset", "left_semi")
    return have


def coverage_state(states: Column) -> Column:
    """One state of several: the only one, or partial where they differ."""
    kinds = F.array_distinct(states)
    return F.when(F.size(kinds) == 1, F.element_at(kinds, 1)).otherwise(F.lit("partial"))


def transcript_score(confidence: Column) -> Column:
    """Summed word confidence, null as 1, capped at 5 words' worth; an aggregate."""
    return F.least(F.sum(F.coalesce(confidence, F.lit(1.0))), F.lit(5.0)) / 5


def phrase_hits(words: DataFrame, keys: list[str], phrase: list[str], gap_ms: int = PHRASE_GAP_MS) -> DataFrame:
    """keys, start_ms, end_ms of every exact run of the phrase in words (keys, ordinal, text, start_ms, end_ms).

    Consecutive words must follow within the gap. The words of the phrase are
    looked up by lead(), so each group is sorted once, whatever the length.
    """
    order = Window.partitionBy(*keys).orderBy("ordinal")
    rows = words.withColumn("__text", F.lower("text"))
    ok, end = F.col("__text") == phrase[0].lower(), F.col("end_ms")
    for i, word in enumerate(phrase[1:], 1):
        start = F.lead("start_ms", i).over(order)
        ok = ok & (F.lead("__text", i).over(order) == word.lower()) & (start - end <= gap_ms)
        end = F.lead("end_ms", i).over(order)
    return rows.select(*keys, "start_ms", end.alias("end_ms"), ok.alias("__ok")).where("__ok").drop("__ok")


def plan_windows(duration_ms: Column, proxy_bytes: Column, budget_bytes: int, longest_ms: int = 480_000, least_ms: int = 30_000, overlap_ms: int = 5_000) -> Column:
    """Windows of a recording as an array of (start_ms, end_ms): as long as the byte budget and ``longest_ms`` allow.

    Windows of one length overlap, the last is cut at the end. A recording
    within both limits, or without a known size or duration, is one window. A
    window is not made shorter than ``least_ms`` for the budget's sake.
    """
    long = lambda c: c.cast("long")
    size = F.greatest(F.least(F.floor(duration_ms * F.lit(budget_bytes) / proxy_bytes), F.lit(longest_ms)), F.lit(least_ms))
    whole = (F.coalesce(duration_ms, F.lit(0)) <= 0) | (F.coalesce(proxy_bytes, F.lit(0)) <= 0) | F.lit(budget_bytes <= 0) | ((proxy_bytes <= budget_bytes) & (duration_ms <= longest_ms)) | (size >= duration_ms)
    step = F.when(size > overlap_ms, size - max(overlap_ms, 0)).otherwise(size)
    last = F.ceil((duration_ms - size) / step)
    span = lambda s, e: F.struct(long(s).alias("start_ms"), long(e).alias("end_ms"))
    split = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(long(last), F.lit(0).cast("long"))), lambda i: span(i * step, F.least(i * step + size, duration_ms)))
    return F.when(whole, F.array(span(F.lit(0), F.coalesce(duration_ms, F.lit(0))))).otherwise(split)


# Where in a shot its sample frames lie, for short, usual and long shots.
FRAME_RATIOS = ((0.2, 0.7), (0.10, 0.35, 0.65, 0.90), (0.05, 0.20, 0.40, 0.60, 0.80, 0.95))


def plan_frames(start_ms: Column, end_ms: Column, mode: str = "boundary_aware") -> Column:
    """Times of a shot's sample frames: 2 below two seconds, 6 above thirty, else 4, rounded and distinct.

    In the mode uniform they stand evenly, else off the shot's boundaries. A
    shot without length has none.
    """
    span = end_ms - start_ms

    def at(ratios: tuple[float, ...]) -> Column:
        if mode == "uniform":
            ratios = tuple((i + 0.5) / len(ratios) for i in range(len(ratios)))
        return F.array(*[(start_ms + F.floor(span * F.lit(r) + 0.5)).cast("long") for r in ratios])

    times = F.when(span < 2000, at(FRAME_RATIOS[0])).when(span > 30_000, at(FRAME_RATIOS[2])).otherwise(at(FRAME_RATIOS[1]))
    return F.when(span > 0, F.array_distinct(times)).otherwise(F.array().cast("array<long>"))


def pyramid(samples: DataFrame, keys: list[str], level: int) -> DataFrame:
    """keys, bucket, low, high of samples (keys, index, low, high) coarsened by 2 ** level."""
    return samples.groupBy(*keys, F.shiftright("index", level).alias("bucket")).agg(F.min("low").alias("low"), F.max("high").alias("high"))


def patch_cells(patches: DataFrame, keys: list[str], durations: DataFrame, on: str, *, hop_ms: int = 480, patch_ms: int = 960, cell_ms: int = 100) -> DataFrame:
    """keys, cell, score: the mean of the patches over each cell, weighted by what they share; 0 where there is none.

    From patches (keys, patch, score) of overlapping stretches and durations
    (``on``, duration_ms). A recording's last cell and patches end with it.
    """
    begin = F.col("patch") * hop_ms
    rows = patches.join(durations, on).withColumn("__end", F.least(begin + patch_ms, F.col("duration_ms"))).where(F.col("__end") > begin)
    rows = rows.withColumn("cell", F.explode(F.sequence(F.floor(begin / cell_ms), F.floor((F.col("__end") - 1) / cell_ms))))
    shared = F.least(F.least((F.col("cell") + 1) * cell_ms, F.col("duration_ms")), F.col("__end")) - F.greatest(F.col("cell") * cell_ms, begin)
    sums = rows.withColumn("__w", shared).groupBy(*keys, "cell").agg((F.sum(F.col("__w") * F.col("score")) / F.sum("__w")).alias("score"))
    cells = F.explode(F.sequence(F.lit(0).cast("long"), (F.ceil(F.col("duration_ms") / cell_ms) - 1).cast("long")))
    every = patches.select(*keys).distinct().join(durations.where("duration_ms > 0"), on).select(*keys, cells.alias("cell"))
    return every.join(sums, [*keys, "cell"], "left").select(*keys, "cell", F.coalesce("score", F.lit(0.0)).alias("score"))


def sound_events(cells: DataFrame, keys: list[str], *, cell_ms: int = 100, on: float = 0.35, off: float = 0.20, gap_ms: int = 300, least_ms: int = 200, duration_ms: Column | None = None) -> DataFrame:
    """keys, start_ms, end_ms, raw_score of events in scored cells (keys, cell, score), one cell each from 0.

    Scores are smoothed by a median of three (the mean of two at the ends); an
    event opens at ``on`` and closes where the first of two cells in a row
    under ``off`` begins, or with the recording; events closer than the gap
    merge and short ones go. ``duration_ms`` is the recording's length, the
    last cell's end by default.

    A second low cell in a row closes whatever is open, so tracks fall into
    blocks between such cells and no state has to be carried.
    """
    order = Window.partitionBy(*keys).orderBy("cell")
    side = lambda n: F.lag("score", n).over(order)
    three = F.array_sort(F.array_compact(F.array(side(1), F.col("score"), side(-1))))
    value = F.when(F.size(three) == 3, F.element_at(three, 2)).when(F.size(three) == 2, (F.element_at(three, 1) + F.element_at(three, 2)) / 2).otherwise(F.element_at(three, 1))
    length = duration_ms if duration_ms is not None else (F.max("cell").over(Window.partitionBy(*keys)) + 1) * cell_ms
    rows = cells.withColumns({"__length": length, "__value": value}).withColumn("__low", F.col("__value") < off)
    rows = rows.withColumn("__second", F.col("__low") & F.coalesce(F.lag("__low").over(order), F.lit(False)))
    rows = rows.withColumn("__block", F.count_if("__second").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    opened = F.min(F.when(F.col("__value") >= on, F.col("cell"))).over(Window.partitionBy(*keys, "__block"))
    blocks = rows.withColumn("__from", opened).groupBy(*keys, "__block").agg(F.min("cell").alias("__first"), F.min("__from").alias("__from"), F.max(F.when(F.col("cell") >= F.col("__from"), F.col("__value"))).alias("__best"), F.max("__length").alias("__length"))
    by_block = Window.partitionBy(*keys).orderBy("__block")
    closes = F.coalesce((F.lead("__first").over(by_block) - 1) * cell_ms, F.col("__length"))
    spans = blocks.withColumn("end_ms", closes.cast("long")).where("__from IS NOT NULL").select(*keys, (F.col("__from") * cell_ms).cast("long").alias("start_ms"), "end_ms", F.col("__best").alias("raw_score")).where("end_ms > start_ms")
    in_time = Window.partitionBy(*keys).orderBy("start_ms", "end_ms")
    reach = F.max("end_ms").over(in_time.rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.withColumn("__new", F.when(F.col("start_ms") - reach <= gap_ms, 0).otherwise(1)).withColumn("__event", F.sum("__new").over(in_time.rowsBetween(Window.unboundedPreceding, 0)))
    merged = fresh.groupBy(*keys, "__event").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.max("raw_score").alias("raw_score"))
    return merged.where(F.col("end_ms") - F.col("start_ms") >= least_ms).drop("__event")


def _same_text(text: str) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def _greedy(rows: list[dict], lists: list[str], widen: bool) -> list[dict]:
    """Each row in order goes to the first kept one that it overlaps by half of the shorter, or is kept."""
    kept: list[dict] = []
    open_: list[dict] = []  # kept ones that a later row can still overlap
    for r in rows:
        open_ = [k for k in open_ if k["end_ms"] > r["start_ms"]]
        length = r["end_ms"] - r["start_ms"]
        for k in open_:
            shared = min(k["end_ms"], r["end_ms"]) - max(k["start_ms"], r["start_ms"])
            shorter = min(k["end_ms"] - k["start_ms"], length)
            if shared > 0 and shorter > 0 and 2 * shared >= shorter:
                if widen and length > k["end_ms"] - k["start_ms"]:
                    k["start_ms"], k["end_ms"] = r["start_ms"], r["end_ms"]
                for c in lists:
                    k[c] = list(dict.fromkeys([*(k[c] or ()), *(v for v in r[c] or () if v)]))
                if "confidence" in k:
                    k["confidence"] = max((c for c in (k["confidence"], r["confidence"]) if c is not None), default=None)
                break
        else:
            kept.append(r)
            open_.append(r)
    return kept


def _merge_repeats(rows: DataFrame, widen: bool) -> DataFrame:
    """Rows (asset, start_ms, end_ms, text, ...) of which overlapping ones of one text are one.

    What a row joins depends on the order of those before it, but only within
    a run of overlapping spans of one text: runs are cut by time first, single
    rows pass by, and each run is walked in a task, ties by all other columns.
    """
    columns, lists = rows.columns, [c for c, t in rows.dtypes if t == "array<string>"]
    in_time = Window.partitionBy("asset", "__key").orderBy("start_ms", "end_ms")
    reach = F.max("end_ms").over(in_time.rowsBetween(Window.unboundedPreceding, -1))
    cut = rows.withColumn("__key", _same_text("text")).withColumn("__new", F.when(F.col("start_ms") < reach, 0).otherwise(1))
    cut = cut.withColumn("__run", F.sum("__new").over(in_time.rowsBetween(Window.unboundedPreceding, 0)))
    counted = cut.withColumn("__n", F.count("*").over(Window.partitionBy("asset", "__key", "__run")))
    schema = rows.schema

    def walk(keys: tuple, table: pa.Table) -> pa.Table:
        own = table.select(columns)
        ordered = sorted(own.to_pylist(), key=lambda r: (r["start_ms"], r["end_ms"], r["text"] or "", str([r[c] for c in sorted(r)])))
        return pa.Table.from_pylist(_greedy(ordered, lists, widen), schema=own.schema)

    runs = counted.where("__n > 1").groupBy("asset", "__key", "__run").applyInArrow(walk, schema)
    return counted.where("__n = 1").select(*columns).unionByName(runs)


def merge_window_shots(shots: DataFrame) -> DataFrame:
    """Shots (asset, start_ms, end_ms, text[, confidence, lists of strings]) of overlapping windows, the same one once.

    In order of time, a shot joins the first kept one of its text that it
    overlaps by half of the shorter of both: the wider span stays, lists
    (tags, objects, actions, mood) are united in order of first mention and
    the higher confidence counts; the text is the first one's.
    """
    return _merge_repeats(shots, widen=True)


def merge_window_scenes(scenes: DataFrame) -> DataFrame:
    """Scenes as merge_window_shots() merges shots, but with the first one's span."""
    return _merge_repeats(scenes, widen=False)


def assemble(tracks: Mapping[str, DataFrame], coverage: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """track, record, start_ms, end_ms, label, state of what each track (record, start_ms, end_ms, label) has within a viewport.

    Every track comes back: one with nothing there has a row without a record.
    state is that of its coverage (track, state); a track without any is absent.
    """
    rows = None
    for name, own in tracks.items():
        one = own.where((F.col("start_ms") < end_ms) & (F.col("end_ms") > start_ms)).select(F.lit(name).alias("track"), "record", "start_ms", "end_ms", "label")
        rows = one if rows is None else rows.unionByName(one)
    every = coverage.sparkSession.createDataFrame([(name,) for name in tracks], "track string").join(coverage.select("track", "state"), "track", "left").select("track", F.coalesce("state", F.lit("absent")).alias("state"))
    return F.broadcast(every).join(rows, "track", "left").select("track", "record", "start_ms", "end_ms", "label", "state")


def on_recording(shots: DataFrame, windows: DataFrame) -> DataFrame:
    """Shots of windows (asset, window, start_ms, end_ms, ...) on the time of their recording, cut to their window; empty ones go."""
    own = windows.select("asset", "window", F.col("start_ms").alias("__begin"), F.col("end_ms").alias("__stop"))
    rows = shots.join(own, ["asset", "window"])
    cut = lambda c: F.least(F.greatest(F.col(c) + F.col("__begin"), F.col("__begin")), F.col("__stop"))
    return rows.withColumns({"start_ms": cut("start_ms"), "end_ms": cut("end_ms")}).where("end_ms > start_ms").drop("__begin", "__stop")


def merge_window_analyses(windows: DataFrame, lists: list[str]) -> DataFrame:
    """asset, summary, confidence, people and the given lists of windows' analyses (asset, window, same columns) as one.

    Lists are united in order of first mention, the summary is the first that
    isn't empty, confidence the mean of those over 0 (0 if none is), people
    the most seen.
    """
    joined = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("window", F.coalesce(F.col(c), F.array().cast("array<string>")).alias("v")))), lambda x: x["v"])))
    summary = F.min_by(F.when(F.trim("summary") != "", F.col("summary")), F.when(F.trim("summary") != "", F.col("window")))
    return windows.groupBy("asset").agg(summary.alias("summary"), F.coalesce(F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))), F.lit(0.0)).alias("confidence"), F.max("people").alias("people"), *[joined(c).alias(c) for c in lists])


def merge_named(windows: DataFrame, column: str) -> DataFrame:
    """asset, place, name, count, confidence of the things that windows (asset, window, column: name, count, confidence) name.

    One a normalised name: the first mention's spelling, the largest count and
    confidence; in order of first mention.
    """
    things = windows.select("asset", "window", F.posexplode(column).alias("at", "x")).select("asset", "window", "at", "x.*").where(F.trim("name") != "")
    first = F.struct("window", "at")
    merged = things.withColumn("__key", _same_text("name")).groupBy("asset", "__key").agg(F.min(first).alias("first"), F.min_by("name", first).alias("name"), F.max("count").alias("count"), F.max("confidence").alias("confidence"))
    return merged.select("asset", F.row_number().over(Window.partitionBy("asset").orderBy("first")).cast("long").alias("place"), "name", "count", "confidence")


def read_pyramid(level: DataFrame, width_ms: int, start_ms: int, end_ms: int, most: int = 0) -> DataFrame:
    """Buckets of a level (bucket, low, high) that a viewport touches, with start_ms, at most so many from its start."""
    if start_ms < 0 or end_ms <= start_ms or width_ms <= 0:
        raise ValueError("a viewport must have a length and a bucket a width")
    first, last = start_ms // width_ms, (end_ms - 1) // width_ms
    if most > 0:
        last = min(last, first + most - 1)
    return level.where(F.col("bucket").between(first, last)).withColumn("start_ms", F.col("bucket") * width_ms)


def silent_share(silences: DataFrame, key: str, durations: DataFrame, mostly: float = 0.8) -> DataFrame:
    """key, share, speech, kind: the union of silences over the duration, and 1 - share but at least 0.05.

    Silences are cut at the recording's ends; from ``mostly`` on a recording
    is mostly_silent, else a speech_candidate.
    """
    from cinequarry.functions.intervals import islands

    quiet = islands(silences, [key]).groupBy(key).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("quiet"))
    share = F.coalesce(F.col("quiet") / F.col("duration_ms"), F.lit(0.0))
    share = F.greatest(F.least(share, F.lit(1.0)), F.lit(0.0))
    kind = F.when(share >= mostly, "mostly_silent").otherwise("speech_candidate")
    return durations.join(quiet, key, "left").select(key, share.alias("share"), F.greatest(1 - share, F.lit(0.05)).alias("speech"), kind.alias("kind"))


def validate_predicates(conditions: Mapping[str, str], predicates: list[tuple[str, str, str, int]]) -> None:
    """At most 8 conditions and 16 predicates over known conditions; before and after need a gap."""
    from cinequarry.functions.intervals import RELATIONS

    if len(conditions) > 8 or len(predicates) > 16:
        raise ValueError("at most 8 conditions and 16 predicates")
    for left, relation, right, gap in predicates:
        if left not in conditions or right not in conditions:
            raise ValueError(f"unknown condition in {(left, relation, right)}")
        if relation not in RELATIONS or (relation in ("before", "after") and gap <= 0):
            raise ValueError(f"relation {relation!r} is unknown or lacks a gap")
