"""Speech and queries over conversations: a turn is a recording, a word 250 ms long."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinequarry.operators import search, speech
from cinequarry.operators.timeline import pyramid, read_pyramid

from .common import registry, table
from .retrieval import _shots
from .timeline import _WORDS, _words

QUERIES, ORACLES, register = registry()

_SPANS = f"{_WORDS}, a AS (SELECT conv_id * 1000 + turn AS asset, i AS ordinal, i * 300 AS s, i * 300 + CASE WHEN i % 11 = 0 THEN 0 ELSE 250 END AS e, word AS text FROM w)"


def _spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("ordinal")
    return _words(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("asset"), n.cast("long").alias("ordinal"), "text", "start_ms", (F.col("start_ms") + F.when(n % 11 == 0, 0).otherwise(250)).alias("end_ms"))


@register(f"WITH {_SPANS} SELECT asset, string_agg(text, ' ' ORDER BY ordinal) AS text FROM a WHERE e > s GROUP BY asset")
def aligned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speech.aligned_transcript(_spoken(spark, sf_dir))


@register(f"WITH {_SPANS}, win AS (SELECT DISTINCT asset, asset * 10 + k AS wid, k * 4000 AS ws, k * 4000 + 5000 AS we FROM a, (VALUES (0), (1), (2)) v(k)) SELECT wid AS \"window\", ordinal, greatest(s - ws, 0)::BIGINT AS start_ms, (least(e, we) - ws)::BIGINT AS end_ms, text FROM a JOIN win USING (asset) WHERE e > s AND s < we AND e > ws")
def window_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each recording within windows of 5 s that overlap by one."""
    words = _spoken(spark, sf_dir)
    k = F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)]))
    windows = words.select("asset").distinct().select("asset", k.alias("k")).select("asset", (F.col("asset") * 10 + F.col("k")).alias("window"), (F.col("k") * 4000).alias("start_ms"), (F.col("k") * 4000 + 5000).alias("end_ms"))
    return speech.sliced(words, windows)


@register(f"WITH {_SPANS} SELECT asset AS request, ordinal, text, s::BIGINT AS start_ms, e::BIGINT AS end_ms FROM a WHERE asset % 3 = 0 AND s < 2500 AND e > 1000")
def request_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every third recording between 1 and 2.5 s."""
    words = _spoken(spark, sf_dir)
    requests = words.where("asset % 3 = 0").select("asset").distinct().select(F.col("asset").alias("request"), "asset", F.lit(1000).cast("long").alias("start_ms"), F.lit(2500).cast("long").alias("end_ms"))
    return speech.request_spans(requests, words)


@register(r"WITH s AS (SELECT conv_id AS asset, turn, coalesce(text, '') AS text FROM conversations WHERE conv_id % 2 = 1), t AS (SELECT asset, turn, unnest(regexp_extract_all(lower(text), '[\p{L}\p{Nd}_]+')) AS word, generate_subscripts(regexp_extract_all(lower(text), '[\p{L}\p{Nd}_]+'), 1) - 1 AS i FROM s) SELECT asset, turn * 100000 + i AS ordinal, word AS text FROM t WHERE asset NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')")
def recognised_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd conversations as recognised segments; those with a system turn have aligned words, which win."""
    turns = table(spark, sf_dir, "conversations")
    segments = turns.where("conv_id % 2 = 1").select(F.col("conv_id").alias("asset"), F.col("turn").alias("ordinal"), (F.col("turn") * 1000).alias("start_ms"), (F.col("turn") * 1000 + 900).alias("end_ms"), "text")
    aligned = turns.where("role = 'system'").select(F.col("conv_id").alias("asset"), F.col("turn").alias("ordinal"), F.lit(0).cast("long").alias("start_ms"), F.lit(1).cast("long").alias("end_ms"), "text")
    return speech.spoken(aligned, speech.expanded(segments)).where("confidence IS NULL").join(aligned.select("asset"), "asset", "left_anti").select("asset", "ordinal", "text")


_FORM = "CASE p_size % 5 WHEN 0 THEN p_name || ' before ' || p_type WHEN 1 THEN p_name || ' while ' || p_type WHEN 2 THEN p_name || ' AND ' || p_type || ' at the same time' WHEN 3 THEN p_name || '  after ' || p_type ELSE p_name END"


@register("SELECT p_partkey AS query_id, p_name AS \"left\", CASE p_size % 5 WHEN 0 THEN 'before' WHEN 3 THEN 'after' ELSE 'simultaneous' END AS relation, p_type AS \"right\", CASE WHEN p_size % 5 IN (0, 3) THEN 5000 ELSE 0 END::BIGINT AS max_gap_ms FROM part WHERE p_size % 5 <> 4")
def temporal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and types of parts put into the known forms of temporal queries, and plain ones."""
    return search.temporal_queries(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), F.expr(_FORM).alias("text")))


@register("SELECT conv_id, turn, left(sha256('v1|' || role || '|' || coalesce(text, '')), 16) AS fingerprint FROM conversations")
def query_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", search.fingerprint(F.col("text"), F.col("role"), "v1").alias("fingerprint"))


@register("SELECT user_id, i >> 2 AS bucket, (i >> 2) * 40 AS start_ms, min(value) AS low, max(value) AS high FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events) WHERE i >> 2 BETWEEN 2 AND 6 GROUP BY ALL")
def waveform_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five buckets of 40 ms from 95 ms on, of every user's values at 10 ms."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    samples = table(spark, sf_dir, "events").select("user_id", (F.row_number().over(order) - 1).cast("long").alias("index"), F.col("value").alias("low"), F.col("value").alias("high"))
    return read_pyramid(pyramid(samples, ["user_id"], 2), 40, 95, 1_000, most=5)


@register()
def search_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search over the parts as shots, with conversations as speech; tests hold it against a library of known answers."""
    parts = _shots(spark, sf_dir)
    n = F.col("id")
    shots = parts.select("id", F.floor(n / 10).alias("asset"), F.floor(n / 50).alias("session"), (n % 10).alias("ordinal"), (n % 10 * 9000).alias("start_ms"), (n % 10 * 9000 + 9000).alias("end_ms"), "description", "tags", "objects", "actions", "mood")
    words = _words(spark, sf_dir).select(F.col("conv_id").alias("asset"), (F.col("turn") * 10_000 + F.col("ordinal")).cast("long").alias("ordinal"), (F.col("turn") * 9000 + F.col("start_ms")).alias("start_ms"), (F.col("turn") * 9000 + F.col("end_ms")).alias("end_ms"), "text", F.lit(None).cast("double").alias("confidence"))
    paths = shots.select("asset").distinct().select("asset", F.format_string("/media/reel_%d.mov", "asset").alias("path"))
    queries = spark.createDataFrame([(1, "red ring"), (2, "gear without red"), (3, "“of the”"), (4, "找点 small bolt"), (5, "reel_7"), (6, "economy widget at night")], "query_id long, text string")
    return search.search(queries, search.build_library(shots, words, paths))
