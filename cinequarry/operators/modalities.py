"""Timed channels beside text: visual and audio vectors, sound events, speakers; their windows, matches and coverage.

A window is a row (query_id, asset, shot, record, modality, start_ms, end_ms,
score, ...); rows of a channel belong to a generation, and only the active
head of an asset and modality is searched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinequarry.functions.intervals import islands, related
from cinequarry.functions.vectors import nearest
from cinequarry.operators.library import facets
from cinequarry.operators.timeline import coverage_state
from cinequarry.plans.broadcasts import checked

# Sound classes and the words that name them.
SOUNDS = {
    "/m/06mb1": ["rain", "rainfall", "raining", "下雨", "雨声", "雨"],
    "/m/0ngt1": ["thunder", "thunderstorm", "雷声", "打雷", "雷"],
    "/m/0912c9": ["vehicle horn", "car horn", "horn", "honking", "鸣笛", "喇叭", "汽车喇叭"],
    "/m/03kmc9": ["siren", "police siren", "ambulance siren", "警笛", "警报器", "救护车警笛"],
    "/m/09x0r": ["speech", "speaking", "talking", "conversation", "人声", "说话", "讲话", "对话", "语音"],
    "/m/04rlf": ["music", "song", "musical", "音乐", "歌曲", "歌声"],
    "/m/0bt9lr": ["dog", "dogs", "bark", "barking", "狗", "犬", "狗叫"],
    "/m/039jq": ["glass", "玻璃"],
    "/m/07rn7sz": ["breaking glass", "glass break", "shattering glass", "glass shatter", "玻璃破碎", "玻璃碎裂"],
    "/m/07pbtc8": ["footstep", "footsteps", "walking", "walk", "steps", "脚步声", "脚步", "走路"],
    "/m/03m9d0z": ["wind", "windy", "breeze", "风声", "风"],
    "/m/0838f": ["water", "flowing water", "流水", "水声", "水"],
    "/m/02mk9": ["engine", "motor", "idling", "revving", "发动机", "引擎", "马达"],
}
WINDOW_ORDER = ("start_ms", "end_ms", "record", "asset", "modality")
MATCH_ORDER = ("start_ms", "end_ms", "condition", "record", "modality", "asset")


def sound_labels(spark: SparkSession, queries: DataFrame) -> DataFrame:
    """query_id, label: the sound classes that each query (query_id, text) names, plain words whole, others anywhere."""
    rows = [(label, a, not a.isascii()) for label, names in SOUNDS.items() for a in names]
    table = F.broadcast(spark.createDataFrame(rows, "label string, alias string, wide boolean"))
    text = F.lower(F.trim(F.coalesce(F.col("text"), F.lit(""))))
    whole = F.expr(r"regexp_instr(text, concat('(?<![\\p{L}\\p{Nd}])', alias, '(?![\\p{L}\\p{Nd}])')) > 0")
    found = queries.select("query_id", text.alias("text")).join(table, F.when(F.col("wide"), F.expr("contains(text, alias)")).otherwise(whole))
    return found.select("query_id", "label").distinct()


def active(rows: DataFrame, heads: DataFrame, modality: str) -> DataFrame:
    """Rows whose (asset, generation) is the active head (asset, modality, generation) of the modality."""
    own = heads.where(F.col("modality") == modality).select("asset", "generation").distinct()
    return rows.join(own, ["asset", "generation"], "left_semi")


def has_head(assets: DataFrame, heads: DataFrame, modality: str) -> DataFrame:
    """asset, ready: whether an asset has an active head of the modality."""
    own = heads.where(F.col("modality") == modality).select("asset", F.lit(True).alias("ready")).distinct()
    return assets.select("asset").join(own, "asset", "left").select("asset", F.coalesce("ready", F.lit(False)).alias("ready"))


def universe(shots: DataFrame, assets: DataFrame, wanted: dict[str, Sequence] | None = None, any_of: dict[str, Sequence] | None = None, context: Column | None = None, ids: DataFrame | None = None) -> DataFrame:
    """shot, asset of every shot whose asset passes the facets, the context and the id restriction; no vector is required.

    ``ids`` (asset) restricts where it is given; None asks nothing.
    """
    kept = facets(assets, wanted or {}, any_of)
    if context is not None:
        kept = kept.where(context)
    if ids is not None:
        kept = kept.join(ids.select("asset").distinct(), "asset", "left_semi")
    return shots.join(kept.select("asset").distinct(), "asset", "left_semi").select("shot", "asset")


def within(rows: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """Rows of the universe: by shot where they have one, else by its assets; None allows all."""
    if allowed is None:
        return rows
    if "shot" in rows.columns:
        return rows.join(allowed.select("shot").distinct(), "shot", "left_semi")
    return rows.join(allowed.select("asset").distinct(), "asset", "left_semi")


def vector_channel(records: DataFrame, heads: DataFrame, queries: DataFrame, modality: str, *, limit: int, allowed: DataFrame | None = None) -> DataFrame:
    """Windows of the nearest records (record, asset, generation, space, start_ms, end_ms, vector[, shot]) of each query.

    Queries are (query_id, space, vector); only records of the active head, of
    the query's space and width, and within the universe are compared. Ties go
    by start, then record.
    """
    rows = within(active(records, heads, modality), allowed)
    spaces = [r["space"] for r in queries.select("space").distinct().collect()]  # embedding spaces are a handful
    found = None
    for space in spaces:
        own = nearest(rows.where(F.col("space") == space).select(F.col("record").alias("id"), "vector"), queries.where(F.col("space") == space).select(F.col("query_id").alias("id"), "vector"), k=limit, exclude_self=False)
        found = own if found is None else found.unionByName(own)
    if found is None:
        found = queries.sparkSession.createDataFrame([], f"query_id {dict(queries.dtypes)['query_id']}, id {dict(records.dtypes)['record']}, score double, rank long")
    return found.withColumnRenamed("id", "record").join(rows.drop("vector", "space"), "record").withColumn("modality", F.lit(modality)).drop("rank")


def sound_channel(events: DataFrame, heads: DataFrame, labels: DataFrame, *, limit: int, allowed: DataFrame | None = None) -> DataFrame:
    """Windows of sound events (record, asset, generation, label, start_ms, end_ms, raw_score) of the queries' labels, best first."""
    rows = within(active(events, heads, "sound_event"), allowed).join(checked(labels), "label")
    order = Window.partitionBy("query_id").orderBy(F.desc("raw_score"), "asset", "start_ms", "record")
    ranked = rows.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= limit).drop("__n")
    return ranked.withColumns({"score": F.col("raw_score"), "modality": F.lit("sound_event")}).drop("raw_score")


def speaker_channel(turns: DataFrame, heads: DataFrame, filters: DataFrame, *, allowed: DataFrame | None = None) -> DataFrame:
    """Windows, score 1, of the turns (record, asset, generation, speaker, start_ms, end_ms) that filters (query_id, asset, generation, speaker) name."""
    rows = within(active(turns, heads, "speaker"), allowed)
    return rows.join(checked(filters), ["asset", "generation", "speaker"]).withColumns({"score": F.lit(1.0), "modality": F.lit("speaker")})


def place_on_shots(windows: DataFrame, shots: DataFrame) -> DataFrame:
    """Windows without a shot (asset, start_ms, end_ms, ...) with every shot (shot, asset, start_ms, end_ms) that they overlap."""
    met = related(windows.drop("shot"), shots.select("asset", "shot", "start_ms", "end_ms"), "asset", "simultaneous")
    return met.withColumnsRenamed({"left_start_ms": "start_ms", "left_end_ms": "end_ms"}).drop("right_start_ms", "right_end_ms")


def best_windows(windows: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(candidates: query_id, shot, asset, start_ms, end_ms, score; windows of theirs) with a candidate a query and shot.

    A shot has its best window, ties by time, record and asset; windows
    without a shot give no candidate. ``limit`` keeps the best shots a query.
    """
    named = windows.where("shot IS NOT NULL AND shot <> ''") if dict(windows.dtypes)["shot"] == "string" else windows.where("shot IS NOT NULL")
    order = F.struct((-F.col("score")).alias("s"), *WINDOW_ORDER)
    best = named.groupBy("query_id", "shot").agg(F.min_by(F.struct("asset", "start_ms", "end_ms", "score"), order).alias("b")).select("query_id", "shot", "b.*")
    if limit is not None:
        rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "shot")
        best = best.withColumn("__n", F.row_number().over(rank)).where(F.col("__n") <= limit).drop("__n")
    return best, named.join(best.select("query_id", "shot"), ["query_id", "shot"], "left_semi")


def _first(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    if "query_id" in rows.columns:  # of many queries, each its own
        keys = ("query_id", *keys)
    order = F.struct((-F.col("score")).alias("s"), *MATCH_ORDER)
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("b")).select(*keys, "b.*").select(*rows.columns)


def build_matches(windows: DataFrame) -> DataFrame:
    """One match a condition, modality and record of windows (condition, ...): the best-scored, ties by time and provenance."""
    return _first(windows, ("condition", "modality", "record"))


def distinct_matches(matches: DataFrame) -> DataFrame:
    """One match a condition, asset and interval, so that a frame and its shot aren't two claims."""
    return _first(matches, ("condition", "asset", "start_ms", "end_ms"))


def evidence_class(left: tuple[Column, Column], right: tuple[Column, Column]) -> Column:
    """confirmed where both (canonical timed, status) observations are canonical and confirmed, else possible."""
    sure = [timed & (status == "confirmed") for timed, status in (left, right)]
    return F.when(sure[0] & sure[1], "confirmed").otherwise("possible")


# Where an observation of a modality comes from, if it doesn't say.
SOURCES = {"lexical": "lexical", "transcript": "transcript", "sound_event": "sound_event", "speaker": "speaker", "visual": "visual"}


def evidence_sources(left: tuple[Column, Column], right: tuple[Column, Column]) -> Column:
    """Distinct sources of two (source, modality) observations, left first; the first is the primary one."""
    by_modality = F.create_map(*[F.lit(x) for pair in SOURCES.items() for x in pair])
    own = [F.coalesce(F.nullif(source, F.lit("")), by_modality[modality]) for source, modality in (left, right)]
    return F.array_distinct(F.array_compact(F.array(*own)))


def merge_coverage(coverage: DataFrame, keys: Sequence[str] = ("modality",)) -> DataFrame:
    """keys, state, start_ms, end_ms: the union of the intervals; states that differ are partial, empty ones don't count."""
    states = coverage.groupBy(*keys).agg(coverage_state(F.collect_set(F.nullif("state", F.lit("")))).alias("state"))
    return islands(coverage, list(keys)).drop("parts").join(states, list(keys)).select(*keys, "state", "start_ms", "end_ms")


def speaker_matches(embeddings: DataFrame, consent: bool, *, profile: int, limit: int = 10) -> DataFrame:
    """other, similarity, state of the profiles most like ``profile``, from (profile, space, vector, duration_ms).

    Profiles meet in the space of the profile's own vectors, as unit means
    weighted by duration. Matching people needs their consent, and a match
    stays unknown until someone confirms it.
    """
    from cinequarry.functions.vectors import unit
    from cinequarry.operators.quality import centroid

    if not consent:
        raise PermissionError("speaker matching needs consent")
    space = embeddings.where(F.col("profile") == profile).agg(F.min("space")).first()[0]
    own = embeddings.where((F.col("space") == space) & (F.size("vector") > 0)).select("profile", unit(F.transform("vector", lambda x: x.cast("double"))).alias("vector"), "duration_ms")
    parts = centroid(own, "profile")
    mine = F.broadcast(parts.where(F.col("profile") == profile).select("position", F.col("value").alias("mine")))
    scored = parts.where(F.col("profile") != profile).join(mine, "position").groupBy(F.col("profile").alias("other")).agg(F.sum(F.col("value") * F.col("mine")).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), "other").limit(limit if 0 < limit <= 50 else 10).withColumn("state", F.lit("unknown"))
