"""Intervals, sessions, phrases and media-derived series over events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinequarry.functions.intervals import RELATIONS, islands, iou, overlap_ms, related
from cinequarry.functions.text import ascii_tokens
from cinequarry.functions.timecode import frames_of_ms, in_clock_window, timecode
from cinequarry.operators.library import session_spans, sessions
from cinequarry.operators.timeline import matching_assets, merge_window_scenes, merge_window_shots, patch_cells, phrase_hits, plan_frames, plan_windows, pyramid, silent_share, sound_events, transcript_score

from .common import registry, table

QUERIES, ORACLES, register = registry()

#: Events stand for observations of their user, this long.
SPAN_MS, GAP_MS = 1_800_000, 3_600_000
_EV = f"ev AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000 AS s, epoch_us(ts) // 1000 + {SPAN_MS} AS e FROM events)"
_HOLDS = {
    "simultaneous": "l.s < r.e AND l.e > r.s",
    "before": f"l.e <= r.s AND r.s - l.e <= {GAP_MS}",
    "after": f"r.e <= l.s AND l.s - r.e <= {GAP_MS}",
    "during": "r.s <= l.s AND l.e <= r.e",
    "starts_within": "r.s <= l.s AND l.s < r.e",
    "ends_within": "r.s < l.e AND l.e <= r.e",
}


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", at.alias("start_ms"), (at + SPAN_MS).alias("end_ms"))


def _relation(relation: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _events(spark, sf_dir)
        left = rows.where("event_type = 'click'").select("user_id", F.col("event_id").alias("left_id"), "start_ms", "end_ms")
        right = rows.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("right_id"), "start_ms", F.when(F.col("event_id") % 2 == 0, F.col("end_ms") + SPAN_MS).otherwise(F.col("end_ms")).alias("end_ms"))
        return related(left, right, "user_id", relation, max_gap_ms=GAP_MS).select("left_id", "right_id")

    query.__name__ = f"temporal_{relation}"
    query.__doc__ = f"Pairs of a click and a purchase of one user: the click stands {relation.replace('_', ' ')} the purchase."
    return query


for _name in RELATIONS:
    register(f"WITH {_EV}, l AS (SELECT * FROM ev WHERE event_type = 'click'), r AS (SELECT event_id, user_id, s, CASE WHEN event_id % 2 = 0 THEN e + {SPAN_MS} ELSE e END AS e FROM ev WHERE event_type = 'purchase') SELECT l.event_id AS left_id, r.event_id AS right_id FROM l JOIN r ON l.user_id = r.user_id AND {_HOLDS[_name]}")(_relation(_name))


@register(f"WITH {_EV} SELECT l.event_id AS left_id, r.event_id AS right_id, least(l.e, r.e) - greatest(l.s, r.s) AS overlap, round((least(l.e, r.e) - greatest(l.s, r.s)) / (greatest(l.e, r.e) - least(l.s, r.s))::DOUBLE, 6) AS iou FROM ev l JOIN ev r ON l.user_id = r.user_id AND l.event_id < r.event_id AND l.s < r.e AND l.e > r.s")
def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    pairs = related(rows.select("user_id", F.col("event_id").alias("left_id"), "start_ms", "end_ms"), rows.select("user_id", F.col("event_id").alias("right_id"), "start_ms", "end_ms"), "user_id", "simultaneous").where("left_id < right_id")
    left, right = (F.col("left_start_ms"), F.col("left_end_ms")), (F.col("right_start_ms"), F.col("right_end_ms"))
    return pairs.select("left_id", "right_id", overlap_ms(left, right).alias("overlap"), F.round(iou(left, right), 6).alias("iou"))


@register(f"WITH {_EV}, p AS (SELECT DISTINCT l.user_id FROM ev l JOIN ev r ON l.user_id = r.user_id AND l.event_type = 'view' AND r.event_type = 'purchase' AND {_HOLDS['before']}) SELECT user_id AS asset FROM p WHERE user_id IN (SELECT user_id FROM ev WHERE event_type = 'click')")
def conjunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = _events(spark, sf_dir).select(F.col("user_id").alias("asset"), F.col("event_type").alias("condition"), "start_ms", "end_ms")
    return matching_assets(windows, [("view", "before", "purchase", GAP_MS)], ["view", "purchase", "click"])


_ISLANDS = f"""WITH {_EV}, n AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {{gap}} THEN 0 ELSE 1 END AS fresh FROM ev),
    i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM n)
    SELECT user_id, min(s) AS start_ms, max(e) AS end_ms, count(*) AS parts FROM i GROUP BY user_id, island"""


@register(_ISLANDS.format(gap=0))
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands(_events(spark, sf_dir), ["user_id"])


@register(f"SELECT user_id, count(*) AS islands, sum(end_ms - start_ms)::BIGINT AS covered_ms FROM ({_ISLANDS.format(gap=0)}) GROUP BY user_id")
def coverage_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands(_events(spark, sf_dir), ["user_id"]).groupBy("user_id").agg(F.count("*").alias("islands"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("covered_ms"))


@register(_ISLANDS.format(gap=GAP_MS))
def sessionize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands(_events(spark, sf_dir), ["user_id"], gap_ms=GAP_MS)


@register(f"WITH {_EV}, n AS (SELECT event_id, user_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) <= 1800000 THEN 0 ELSE 1 END AS fresh FROM ev WHERE event_type NOT IN ('error', 'signup')), i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS island FROM n) SELECT event_id AS id, min(event_id) OVER (PARTITION BY user_id, island) AS session FROM i")
def capture_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as captures of their user; errors and signups stand for proxies and sidecars, which join no session."""
    return sessions(_captures(spark, sf_dir), ["device"], [])


def _captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.when(F.col("event_type") == "error", "proxy").when(F.col("event_type") == "signup", " Sidecar").otherwise("camera")
    return _events(spark, sf_dir).select(F.col("event_id").alias("id"), "start_ms", "end_ms", F.concat(F.lit(" U"), F.col("user_id").cast("string")).alias("device"), source.alias("source"))


@register(f"WITH {_EV}, n AS (SELECT event_id, user_id, s, e, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) <= 1800000 THEN 0 ELSE 1 END AS fresh FROM ev WHERE event_type NOT IN ('error', 'signup')), i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS island FROM n) SELECT min(event_id) AS session, min(s) AS start_ms, max(e) AS end_ms, count(*) AS captures FROM i GROUP BY user_id, island")
def shoot_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = _captures(spark, sf_dir)
    return session_spans(captures, sessions(captures, ["device"], []))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(ascii_tokens("text")).alias("ordinal", "text"))
    return turns.withColumn("start_ms", (F.col("ordinal") * 300).cast("long")).withColumn("end_ms", F.col("start_ms") + 250)


_WORDS = "w AS (SELECT conv_id, turn, unnest(range(len(t))) AS i, unnest(t) AS word FROM (SELECT conv_id, turn, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS t FROM conversations))"


@register(f"WITH {_WORDS} SELECT a.conv_id, a.turn, (a.i * 300)::BIGINT AS start_ms, (b.i * 300 + 250)::BIGINT AS end_ms FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.turn = b.turn AND b.i = a.i + 1 WHERE a.word = 'of' AND b.word = 'the'")
def phrase_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_hits(_words(spark, sf_dir), ["conv_id", "turn"], ["of", "the"])


@register("SELECT user_id, event_type, round(least(sum(coalesce(value / 200, 1)), 5) / 5, 6) AS score FROM events WHERE event_type IN ('click', 'view') GROUP BY user_id, event_type")
def transcript_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view"))
    return rows.groupBy("user_id", "event_type").agg(F.round(transcript_score(F.col("value") / 200), 6).alias("score"))


@register("""WITH d AS (SELECT doc_id, n_chars * 400 AS ms, n_chars * 900 AS bytes FROM documents),
    w AS (SELECT *, greatest(least(ms * 1000000 // nullif(bytes, 0), 480000), 30000) AS size FROM d),
    p AS (SELECT *, ms <= 0 OR bytes <= 0 OR (bytes <= 1000000 AND ms <= 480000) OR size >= ms AS whole FROM w)
    SELECT doc_id, 0::BIGINT AS start_ms, ms AS end_ms FROM p WHERE whole
    UNION ALL SELECT doc_id, i * (size - 5000), least(i * (size - 5000) + size, ms) FROM (SELECT *, unnest(range(ceil((ms - size) / (size - 5000)::DOUBLE)::BIGINT + 1)) AS i FROM p WHERE NOT whole)""")
def window_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stand for recordings of 0.4 s a character whose proxies have 900 bytes a character, in calls of a megabyte."""
    planned = plan_windows((F.col("n_chars") * 400).cast("long"), (F.col("n_chars") * 900).cast("long"), 1_000_000)
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(planned).alias("w")).select("doc_id", "w.start_ms", "w.end_ms")


_RATIOS = "CASE WHEN ms < 2000 THEN [0.2, 0.7] WHEN ms > 30000 THEN [0.05, 0.20, 0.40, 0.60, 0.80, 0.95] ELSE [0.10, 0.35, 0.65, 0.90] END::DOUBLE[]"


@register(f"SELECT DISTINCT doc_id, 500 + floor(ms * unnest({_RATIOS}) + 0.5)::BIGINT AS at_ms FROM (SELECT doc_id, (n_chars - 20) * 7 AS ms FROM documents) WHERE ms > 0")
def frame_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as shots of 7 ms a character beyond the twentieth, from 0.5 s on."""
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(plan_frames(F.lit(500).cast("long"), 500 + ((F.col("n_chars") - 20) * 7).cast("long"))).alias("at_ms"))


@register("WITH d AS (SELECT doc_id, n_chars * 7 AS ms, CASE WHEN n_chars * 7 < 2000 THEN 2 WHEN n_chars * 7 > 30000 THEN 6 ELSE 4 END AS n FROM documents) SELECT DISTINCT doc_id, floor(ms * ((i + 0.5::DOUBLE) / n) + 0.5)::BIGINT AS at_ms FROM (SELECT doc_id, ms, n, unnest(range(n)) AS i FROM d WHERE ms > 0)")
def frame_plan_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(plan_frames(F.lit(0).cast("long"), (F.col("n_chars") * 7).cast("long"), "uniform")).alias("at_ms"))


@register("SELECT user_id, i >> 3 AS bucket, min(value) AS low, max(value) AS high FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events) GROUP BY 1, 2")
def waveform_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    samples = table(spark, sf_dir, "events").select("user_id", (F.row_number().over(order) - 1).cast("long").alias("index"), F.col("value").alias("low"), F.col("value").alias("high"))
    return pyramid(samples, ["user_id"], 3)


@register("""SELECT event_id, CAST(floor((2 * ms * 25 + 1000) / 2000.0) AS BIGINT) AS frame, printf('%02d:%02d:%02d:%02d', (f // 90000)::INT, ((f // 1500) % 60)::INT, ((f // 25) % 60)::INT, (f % 25)::INT) AS timecode
    FROM (SELECT event_id, ms, CAST(floor((2 * ms * 25 + 1000) / 2000.0) AS BIGINT) AS f FROM (SELECT event_id, (epoch_us(ts) // 1000) % 86400000 AS ms FROM events))""")
def timecodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = frames_of_ms(F.col("start_ms") % 86_400_000, 25, 1)
    return _events(spark, sf_dir).select("event_id", frame.alias("frame"), timecode(frame, 25).alias("timecode"))


@register("SELECT event_id FROM events WHERE hour(ts) * 60 + minute(ts) >= 1320 OR hour(ts) * 60 + minute(ts) < 390")
def off_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(in_clock_window(F.col("ts"), "22:00", "06:30")).select("event_id")


@register(f"SELECT user_id, round(share, 6) AS share, round(greatest(1 - share, 0.05), 6) AS speech FROM (SELECT user_id, sum(end_ms - start_ms) / (max(end_ms) - min(start_ms))::DOUBLE AS share FROM ({_ISLANDS.format(gap=0)}) GROUP BY user_id)")
def speech_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    durations = rows.groupBy("user_id").agg((F.max("end_ms") - F.min("start_ms")).alias("duration_ms"))
    return silent_share(rows, "user_id", durations).select("user_id", F.round("share", 6).alias("share"), F.round("speech", 6).alias("speech"))


_CELLS = """c AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS cell, coalesce(value, 0) / 100 AS score FROM events)"""
_TRACKS = """l AS (SELECT *, lag(score) OVER w AS a, lead(score) OVER w AS b, (max(cell) OVER (PARTITION BY user_id, event_type) + 1) * 100 AS length FROM c WINDOW w AS (PARTITION BY user_id, event_type ORDER BY cell)),
    m AS (SELECT *, list_median(list_filter([a, score, b], lambda x: x IS NOT NULL)) AS v FROM (SELECT * FROM l)),
    s AS (SELECT *, v < 0.2 AND coalesce(lag(v) OVER (PARTITION BY user_id, event_type ORDER BY cell) < 0.2, false) AS second FROM m),
    k AS (SELECT *, count(*) FILTER (WHERE second) OVER (PARTITION BY user_id, event_type ORDER BY cell ROWS UNBOUNDED PRECEDING) AS block FROM s),
    o AS (SELECT *, min(cell) FILTER (WHERE v >= 0.35) OVER (PARTITION BY user_id, event_type, block) AS opened FROM k),
    g AS (SELECT user_id, event_type, block, min(cell) AS first, min(opened) AS opened, max(v) FILTER (WHERE cell >= opened) AS best, max(length) AS length FROM o GROUP BY ALL),
    e AS (SELECT user_id, event_type, opened * 100 AS s, coalesce((lead(first) OVER (PARTITION BY user_id, event_type ORDER BY block) - 1) * 100, length) AS e, best, opened FROM g),
    r AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY user_id, event_type ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 300 THEN 0 ELSE 1 END AS fresh FROM e WHERE opened IS NOT NULL AND e > s),
    i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id, event_type ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS n FROM r)
    SELECT user_id, event_type, min(s)::BIGINT AS start_ms, max(e)::BIGINT AS end_ms, max(best) AS raw_score FROM i GROUP BY user_id, event_type, n HAVING max(e) - min(s) >= 200"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", "event_type", (F.row_number().over(order) - 1).cast("long").alias("cell"), (F.coalesce("value", F.lit(0.0)) / 100).alias("score"))


@register(f"WITH {_CELLS}, {_TRACKS}".replace("list_median(", "list_aggregate(").replace("lambda x: x IS NOT NULL))", "lambda x: x IS NOT NULL), 'median')"))
def sound_event_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sound events in each user's values of a type, a cell each."""
    return sound_events(_cells(spark, sf_dir), ["user_id", "event_type"])


@register(f"""WITH {_CELLS}, p AS (SELECT *, cell * 480 AS s, least(cell * 480 + 960, length) AS e FROM (SELECT *, max(cell) OVER (PARTITION BY user_id) * 480 + 700 AS length FROM c)),
    x AS (SELECT user_id, event_type, k AS cell, least(least((k + 1) * 100, length), e) - greatest(k * 100, s) AS w, score FROM (SELECT *, unnest(range(s // 100, (e - 1) // 100 + 1)) AS k FROM p))
    SELECT user_id, event_type, cell, round(sum(w * score) / sum(w) + 1e-9, 6) AS score FROM x GROUP BY ALL
    UNION ALL SELECT user_id, event_type, cell, 0 FROM (SELECT user_id, event_type, unnest(range((length + 99) // 100)) AS cell FROM (SELECT DISTINCT user_id, event_type, length FROM p)) ANTI JOIN x USING (user_id, event_type, cell)""")
def sound_patch_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each value as the score of a patch of 960 ms, hop 480 ms; recordings end 700 ms into the last one."""
    patches = _cells(spark, sf_dir).withColumnRenamed("cell", "patch")
    durations = patches.groupBy("user_id").agg((F.max("patch") * 480 + 700).alias("duration_ms"))
    return patch_cells(patches, ["user_id", "event_type"], durations, "user_id").withColumn("score", F.when(F.col("score") > 0, F.round(F.col("score") + 1e-9, 6)).otherwise(0.0))


def _greedy_sql(wider: str) -> str:
    """Shots in order, each to the first kept one of its text that it overlaps by half of the shorter: a recursion over their places."""
    return f"""WITH RECURSIVE {_EV}, o AS (SELECT user_id AS asset, event_type AS text, event_id % 2 AS odd, coalesce(value, 0.0) AS c, s, CASE WHEN event_id % 3 = 0 THEN e + 3 * {SPAN_MS} ELSE e END AS e FROM ev),
    p AS (SELECT *, row_number() OVER (PARTITION BY asset, text ORDER BY s, e, odd, c) AS n FROM o),
    k(asset, text, n, kept) AS (
        SELECT asset, text, 1::BIGINT, [{{'s': s, 'e': e, 'c': c, 'tags': ['t' || odd]}}] FROM p WHERE n = 1
        UNION ALL SELECT asset, text, n, CASE WHEN i IS NULL OR i = 0 THEN list_append(kept, {{'s': s, 'e': e, 'c': c, 'tags': ['t' || odd]}}) ELSE list_transform(kept, lambda x, j: CASE WHEN j = i THEN
            {{'s': CASE WHEN {wider} THEN s ELSE x.s END, 'e': CASE WHEN {wider} THEN e ELSE x.e END, 'c': greatest(x.c, c), 'tags': CASE WHEN list_contains(x.tags, 't' || odd) THEN x.tags ELSE list_append(x.tags, 't' || odd) END}} ELSE x END) END
        FROM (SELECT k.asset, k.text, p.n, k.kept, p.s, p.e, p.c, p.odd, list_position(list_transform(k.kept, lambda x: least(x.e, p.e) > greatest(x.s, p.s) AND 2 * (least(x.e, p.e) - greatest(x.s, p.s)) >= least(x.e - x.s, p.e - p.s)), true) AS i FROM k JOIN p ON p.asset = k.asset AND p.text = k.text AND p.n = k.n + 1))
    SELECT asset, text, x.s AS start_ms, x.e AS end_ms, x.c AS confidence, array_to_string(x.tags, ',') AS tags
    FROM (SELECT asset, text, unnest(kept) AS x FROM k QUALIFY row_number() OVER (PARTITION BY asset, text ORDER BY n DESC) = 1)"""


def _window_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one type as shots of overlapping windows; every third is longer."""
    n = F.col("event_id")
    end = F.when(n % 3 == 0, F.col("end_ms") + 3 * SPAN_MS).otherwise(F.col("end_ms"))
    return _events(spark, sf_dir).select(F.col("user_id").alias("asset"), "start_ms", end.alias("end_ms"), F.col("event_type").alias("text"), F.array(F.concat(F.lit("t"), (n % 2).cast("string"))).alias("tags"), F.coalesce("value", F.lit(0.0)).alias("confidence"))


def _merged(rows: DataFrame) -> DataFrame:
    return rows.select("asset", "text", "start_ms", "end_ms", "confidence", F.array_join("tags", ",").alias("tags"))


@register(_greedy_sql("e - s > x.e - x.s"))
def window_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(merge_window_shots(_window_shots(spark, sf_dir)))


@register(_greedy_sql("false"))
def window_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as scenes: the first one's span stays."""
    return _merged(merge_window_scenes(_window_shots(spark, sf_dir)))


@register("SELECT event_type AS track, count(*) AS n, min(event_id) AS first FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' GROUP BY event_type")
def timeline_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = (F.col("ts") >= F.lit("2024-01-05").cast("timestamp")) & (F.col("ts") < F.lit("2024-01-12").cast("timestamp"))
    return table(spark, sf_dir, "events").where(inside).groupBy(F.col("event_type").alias("track")).agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
