"""Timed channels over events and embeddings: users are assets, event types labels, an hour of a user a shot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinequarry.operators.modalities import active, best_windows, build_matches, distinct_matches, evidence_class, evidence_sources, has_head, merge_coverage, place_on_shots, sound_channel, speaker_channel, speaker_matches, universe, vector_channel
from cinequarry.operators.temporal import Evaluation, Recordings, Requests

from .common import registry, table

QUERIES, ORACLES, register = registry()

#: Generations are the days' remainders; the head of an asset is that of its id.
_RECORDS = "rec AS (SELECT event_id AS record, user_id AS asset, event_id % 3 AS generation, event_type AS label, coalesce(value, 0) AS raw_score, epoch_us(ts) // 1000 AS start_ms, epoch_us(ts) // 1000 + 1800000 AS end_ms FROM events)"
_SHOTS = "shots AS (SELECT user_id * 100000 + h AS shot, user_id AS asset, h * 3600000 AS start_ms, (h + 1) * 3600000 AS end_ms FROM (SELECT DISTINCT user_id, epoch_us(ts) // 3600000000 AS h FROM events) WHERE h % 2 = 0)"
_ACTIVE = f"{_RECORDS}, act AS (SELECT * FROM rec WHERE generation = asset % 3)"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("record"), F.col("user_id").alias("asset"), (F.col("event_id") % 3).alias("generation"), F.col("event_type").alias("label"), F.coalesce("value", F.lit(0.0)).alias("raw_score"), at.alias("start_ms"), (at + 1_800_000).alias("end_ms"))


def _heads(records: DataFrame, modality: str) -> DataFrame:
    return records.select("asset", F.lit(modality).alias("modality"), (F.col("asset") % 3).alias("generation")).distinct()


def _shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 3_600_000)
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("asset"), hour.alias("h")).distinct().where("h % 2 = 0")
    return rows.select((F.col("asset") * 100_000 + F.col("h")).alias("shot"), "asset", (F.col("h") * 3_600_000).alias("start_ms"), ((F.col("h") + 1) * 3_600_000).alias("end_ms"))


@register(f"WITH {_ACTIVE} SELECT record FROM act")
def active_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir)
    return active(rows, _heads(rows, "sound_event"), "sound_event").select("record")


@register("SELECT c_custkey AS asset, count(o_orderkey) > 0 AS ready FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY c_custkey")
def modality_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("asset"), F.lit("visual").alias("modality"))
    return has_head(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("asset")), heads, "visual")


@register("SELECT o_orderkey AS shot, o_custkey AS asset FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal BETWEEN 0 AND 5000 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def shot_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as shots of their customers."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("shot"), F.col("o_custkey").alias("asset"), "o_orderpriority")
    assets = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "asset")
    return universe(orders, assets, {"c_mktsegment": ["BUILDING", "MACHINERY"]}, context=F.col("c_acctbal").between(0, 5000), ids=orders.where("o_orderpriority = '1-URGENT'"))


_VECTORS = "vec AS (SELECT vec_id AS record, label AS asset, vec_id % 2 AS generation, CASE WHEN vec_id % 5 = 0 THEN 'b' ELSE 'a' END AS space, vec_id * 40 AS start_ms, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL), act AS (SELECT * FROM vec WHERE generation = asset % 2)"


@register(f"""WITH {_VECTORS}, uni AS (SELECT DISTINCT asset FROM vec WHERE asset % 4 <> 1), cos AS (SELECT q.record AS query_id, c.record, c.asset, c.start_ms, round(list_cosine_similarity(q.v, c.v), 6) AS score FROM vec q JOIN act c ON q.space = c.space WHERE q.record % 20 = 0 AND c.asset IN (SELECT asset FROM uni))
    SELECT query_id, record, asset, start_ms, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record) AS r FROM cos WHERE score > 0) WHERE r <= 10""")
def visual_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as frames of their label: those of the active generation, the query's space and the universe."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("record"), F.col("label").alias("asset"), (F.col("vec_id") % 2).alias("generation"), F.when(F.col("vec_id") % 5 == 0, "b").otherwise("a").alias("space"), (F.col("vec_id") * 40).alias("start_ms"), (F.col("vec_id") * 40 + 40).alias("end_ms"), F.col("embedding").alias("vector"))
    heads = rows.select("asset", F.lit("visual").alias("modality"), (F.col("asset") % 2).cast("long").alias("generation")).distinct()
    queries = rows.where("record % 20 = 0 AND vector IS NOT NULL").select(F.col("record").alias("query_id"), "space", "vector")
    allowed = rows.where("asset % 4 <> 1").select("asset").distinct()
    return vector_channel(rows, heads, queries, "visual", limit=10, allowed=allowed).select("query_id", "record", "asset", "start_ms", "score")


_LABELS = "lab(query_id, label) AS (VALUES (1::BIGINT, 'click'), (1::BIGINT, 'view'), (2::BIGINT, 'purchase'))"
_SOUND = f"{_ACTIVE}, {_LABELS}, snd AS (SELECT query_id, record, asset, start_ms, end_ms, raw_score AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw_score DESC, asset, start_ms, record) AS r FROM act JOIN lab USING (label)) WHERE r <= 200)"


def _sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir)
    labels = spark.createDataFrame([(1, "click"), (1, "view"), (2, "purchase")], "query_id long, label string")
    return sound_channel(rows, _heads(rows, "sound_event"), labels, limit=200)


@register(f"WITH {_SOUND} SELECT * FROM snd")
def sound_event_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sound(spark, sf_dir).select("query_id", "record", "asset", "start_ms", "end_ms", "score")


_PLACED = f"{_SOUND}, {_SHOTS}, pl AS (SELECT s.*, h.shot FROM snd s JOIN shots h ON h.asset = s.asset AND s.start_ms < h.end_ms AND s.end_ms > h.start_ms)"


@register(f"WITH {_PLACED}, b AS (SELECT *, row_number() OVER (PARTITION BY query_id, shot ORDER BY score DESC, start_ms, end_ms, record, asset) AS r FROM pl) SELECT query_id, shot, asset, start_ms, end_ms, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, shot) AS k FROM b WHERE r = 1) WHERE k <= 20")
def modality_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sound windows on the shots that they overlap, one candidate a shot."""
    return best_windows(place_on_shots(_sound(spark, sf_dir), _shots(spark, sf_dir)), 20)[0].select("query_id", "shot", "asset", "start_ms", "end_ms", "score")


@register(f"WITH {_ACTIVE} SELECT 1::BIGINT AS query_id, record, asset, start_ms, 1.0::DOUBLE AS score FROM act WHERE asset = 3 AND label = 'view' UNION ALL SELECT 2, record, asset, start_ms, 1.0 FROM act WHERE asset = 5 AND label = 'click'")
def speaker_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir).withColumnRenamed("label", "speaker")
    filters = spark.createDataFrame([(1, 3, 0, "view"), (2, 5, 2, "click"), (3, 4, 0, "click")], "query_id long, asset long, generation long, speaker string")
    return speaker_channel(rows, _heads(rows, "speaker"), filters).select("query_id", "record", "asset", "start_ms", "score")


_MATCHED = "win AS (SELECT event_type AS condition, CASE WHEN event_id % 2 = 0 THEN 'visual' ELSE 'audio' END AS modality, event_id // 7 AS record, user_id AS asset, (epoch_us(ts) // 86400000000) * 86400000 AS start_ms, (epoch_us(ts) // 86400000000) * 86400000 + 1000 AS end_ms, round(coalesce(value, 0), 1) AS score FROM events), bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY condition, modality, record ORDER BY score DESC, start_ms, end_ms, asset) AS r FROM win) WHERE r = 1)"


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 86_400_000) * 86_400_000
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("condition"), F.when(F.col("event_id") % 2 == 0, "visual").otherwise("audio").alias("modality"), F.floor(F.col("event_id") / 7).alias("record"), F.col("user_id").alias("asset"), day.alias("start_ms"), (day + 1000).alias("end_ms"), F.round(F.coalesce("value", F.lit(0.0)), 1).alias("score"))


@register(f"WITH {_MATCHED} SELECT condition, modality, record, asset, start_ms, end_ms, score FROM bm")
def condition_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_matches(_windows(spark, sf_dir))


@register(f"WITH {_MATCHED} SELECT condition, modality, record, asset, start_ms, end_ms, score FROM (SELECT *, row_number() OVER (PARTITION BY condition, asset, start_ms, end_ms ORDER BY score DESC, record, modality) AS k FROM bm) WHERE k = 1")
def interval_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_matches(build_matches(_windows(spark, sf_dir)))


@register("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'confirmed' ELSE 'possible' END AS state,
    CASE WHEN o_orderpriority LIKE '5%' THEN 'speaker' ELSE 'visual' END || CASE WHEN o_orderstatus = 'P' THEN ',asr' ELSE '' END AS sources FROM orders""")
def observed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pairs of observations, timed by status and confirmed by priority."""
    high = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    status = F.when(high, "confirmed").otherwise("possible")
    timed = F.col("o_orderstatus") == "F"
    modality = F.when(F.col("o_orderpriority").startswith("5"), "speaker").otherwise("visual")
    right = F.when(F.col("o_orderstatus") == "P", "asr").otherwise("")
    sources = evidence_sources((F.lit(""), modality), (right, modality))
    return table(spark, sf_dir, "orders").select("o_orderkey", evidence_class((timed, status), (timed, status)).alias("state"), F.concat_ws(",", sources).alias("sources"))


@register(f"""WITH {_RECORDS}, c AS (SELECT asset, label AS modality, CASE WHEN raw_score > 90 THEN 'partial' WHEN raw_score < 5 THEN '' ELSE 'complete' END AS state, start_ms, end_ms FROM rec),
    st AS (SELECT asset, modality, CASE WHEN count(DISTINCT nullif(state, '')) = 1 THEN max(nullif(state, '')) ELSE 'partial' END AS state FROM c GROUP BY ALL),
    n AS (SELECT *, CASE WHEN start_ms <= max(end_ms) OVER (PARTITION BY asset, modality ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM c),
    i AS (SELECT *, sum(fresh) OVER (PARTITION BY asset, modality ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS k FROM n)
    SELECT asset, modality, st.state, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM i JOIN st USING (asset, modality) GROUP BY asset, modality, st.state, k""")
def coverage_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("raw_score") > 90, "partial").when(F.col("raw_score") < 5, "").otherwise("complete")
    return merge_coverage(_records(spark, sf_dir).select("asset", F.col("label").alias("modality"), state.alias("state"), "start_ms", "end_ms"), ("asset", "modality"))


@register("""WITH v AS (SELECT label AS profile, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS x, vec_id % 7 + 1 AS w FROM embeddings WHERE embedding IS NOT NULL AND vec_id % 3 <> 0),
    s AS (SELECT profile, i, sum(w * x) AS s FROM v GROUP BY ALL), c AS (SELECT *, s / sqrt(sum(s * s) OVER (PARTITION BY profile)) AS u FROM s)
    SELECT a.profile AS other, round(sum(a.u * b.u), 6) AS similarity, 'unknown' AS state FROM c a JOIN c b USING (i) WHERE b.profile = 1 AND a.profile <> 1 GROUP BY a.profile ORDER BY sum(a.u * b.u) DESC, other LIMIT 5""")
def speaker_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL").select(F.col("label").alias("profile"), F.when(F.col("vec_id") % 3 == 0, "other").otherwise("main").alias("space"), F.col("embedding").alias("vector"), (F.col("vec_id") % 7 + 1).alias("duration_ms"))
    return speaker_matches(rows, True, profile=1, limit=5).withColumn("similarity", F.round("similarity", 6))


# Requests of every supplier over timed channels: a siren or music in some relation to rain or thunder, every third with a picture too.
_CLASSES = {"view": "/m/06mb1", "click": "/m/0ngt1", "purchase": "/m/03kmc9"}
_ASKED = {"view": "rain", "click": "thunder", "purchase": "a police siren"}
_FRAMES = 1_704_067_200_000
_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _CLASSES.items()) + " ELSE '/m/04rlf' END"
_REQUESTS = f"""{_RECORDS.replace('event_type AS label', _CASE + ' AS label')}, act AS (SELECT * FROM rec WHERE generation = asset % 3), {_SHOTS},
    frames AS (SELECT 100000000 + vec_id AS record, vec_id % 50 + 1 AS asset, {_FRAMES} + (vec_id * 7919 % 700) * 3600000 AS start_ms, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
    cond AS (SELECT s_suppkey AS query_id, 'a' AS condition, CASE WHEN s_suppkey % 2 = 0 THEN '{_CLASSES["purchase"]}' ELSE '/m/04rlf' END AS label FROM supplier
             UNION ALL SELECT s_suppkey, 'b', CASE WHEN s_suppkey % 4 < 2 THEN '{_CLASSES["view"]}' ELSE '{_CLASSES["click"]}' END FROM supplier),
    pred AS (SELECT s_suppkey AS query_id, 'p' AS predicate, 'a' AS l, 'b' AS r, (['simultaneous', 'before', 'after', 'during', 'starts_within', 'ends_within'])[s_suppkey % 6 + 1] AS relation, 900000 * (1 + s_suppkey % 5) AS gap FROM supplier
             UNION ALL SELECT s_suppkey, 'q', 'c', 'a', 'during', 0 FROM supplier WHERE s_suppkey % 3 = 0),
    heard AS (SELECT query_id, condition, asset, record, start_ms, end_ms, raw_score AS score, CASE WHEN record % 2 = 0 THEN 'confirmed' ELSE 'possible' END AS status FROM cond JOIN act USING (label)
              UNION ALL SELECT s_suppkey, 'c', f.asset, f.record, f.start_ms, f.start_ms + 600000, round(list_cosine_similarity(f.v, q.v), 6), 'possible' FROM supplier JOIN frames q ON q.record = 100000000 + s_suppkey JOIN frames f ON list_cosine_similarity(f.v, q.v) > 0 WHERE s_suppkey % 3 = 0),
    win AS (SELECT * FROM heard h WHERE EXISTS (SELECT 1 FROM shots x WHERE x.asset = h.asset AND x.start_ms < h.end_ms AND x.end_ms > h.start_ms)),
    sup AS (SELECT p.query_id, p.predicate, l.asset, p.relation, l.record AS left_record, r.record AS right_record, CASE WHEN l.status = 'confirmed' AND r.status = 'confirmed' THEN 'confirmed' ELSE 'possible' END AS evidence,
                CASE WHEN relation IN ('before', 'after') THEN l.start_ms || '-' || l.end_ms || ',' || r.start_ms || '-' || r.end_ms ELSE greatest(l.start_ms, r.start_ms) || '-' || least(l.end_ms, r.end_ms) END AS supports
            FROM pred p JOIN win l ON l.query_id = p.query_id AND l.condition = p.l JOIN win r ON r.query_id = p.query_id AND r.condition = p.r AND r.asset = l.asset
            WHERE CASE relation WHEN 'simultaneous' THEN l.start_ms < r.end_ms AND l.end_ms > r.start_ms WHEN 'before' THEN l.end_ms <= r.start_ms AND r.start_ms - l.end_ms <= gap WHEN 'after' THEN r.end_ms <= l.start_ms AND l.start_ms - r.end_ms <= gap
                WHEN 'during' THEN r.start_ms <= l.start_ms AND l.end_ms <= r.end_ms WHEN 'starts_within' THEN r.start_ms <= l.start_ms AND l.start_ms < r.end_ms ELSE r.start_ms < l.end_ms AND l.end_ms <= r.end_ms END),
    ans AS (SELECT query_id, asset FROM (SELECT query_id, asset, count(DISTINCT condition) AS n FROM win GROUP BY ALL) JOIN (SELECT query_id, count(*) AS cs FROM (SELECT query_id FROM cond UNION ALL SELECT query_id FROM pred WHERE predicate = 'q') GROUP BY ALL) USING (query_id)
            JOIN (SELECT query_id, asset, count(DISTINCT predicate) AS held FROM sup GROUP BY ALL) USING (query_id, asset) JOIN (SELECT query_id, count(*) AS ps FROM pred GROUP BY ALL) USING (query_id) WHERE n = cs AND held = ps)"""


def _requests(spark: SparkSession, sf_dir: str) -> tuple[Requests, Recordings, DataFrame]:
    kind = F.coalesce(F.create_map(*[F.lit(x) for pair in _CLASSES.items() for x in pair])[F.col("label")], F.lit("/m/04rlf"))
    events = _records(spark, sf_dir).withColumn("label", kind).withColumn("status", F.when(F.col("record") % 2 == 0, "confirmed").otherwise("possible"))
    vectors = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL")
    frame = F.lit(_FRAMES) + (F.col("vec_id") * 7919 % 700) * 3_600_000
    frames = vectors.select((F.col("vec_id") + 100_000_000).alias("record"), (F.col("vec_id") % 50 + 1).alias("asset"), F.lit(1).cast("long").alias("generation"), F.lit("s").alias("space"), frame.alias("start_ms"), (frame + 600_000).alias("end_ms"), F.col("embedding").alias("vector"))
    heads = _heads(events, "sound_event").unionByName(frames.select("asset", F.lit("visual").alias("modality"), F.lit(1).cast("long").alias("generation")).distinct())
    key = F.col("s_suppkey")
    ask = table(spark, sf_dir, "supplier").select(key.cast("long").alias("query_id"), "s_suppkey")
    none = F.lit(None).cast("string"), F.lit(None).cast("array<float>")
    heard = lambda name, text: ask.select("query_id", F.lit(name).alias("condition"), F.lit("sound_event").alias("modality"), text.alias("text"), none[0].alias("space"), none[1].alias("vector"))
    seen = ask.where(key % 3 == 0).join(vectors.select(F.col("vec_id").alias("s_suppkey"), "embedding"), "s_suppkey").select("query_id", F.lit("c").alias("condition"), F.lit("visual").alias("modality"), F.lit("a picture").alias("text"), F.lit("s").alias("space"), F.col("embedding").alias("vector"))
    conditions = heard("a", F.when(key % 2 == 0, _ASKED["purchase"]).otherwise("loud music")).unionByName(heard("b", F.when(key % 4 < 2, _ASKED["view"]).otherwise(_ASKED["click"]))).unionByName(seen)
    relation = F.element_at(F.array(*[F.lit(r) for r in ("simultaneous", "before", "after", "during", "starts_within", "ends_within")]), (key % 6 + 1).cast("int"))
    rule = lambda name, left, right, relation, gap: (F.lit(name).alias("predicate"), F.lit(left).alias("left"), relation.alias("relation"), F.lit(right).alias("right"), gap.cast("long").alias("max_gap_ms"))
    predicates = ask.select("query_id", *rule("p", "a", "b", relation, 900_000 * (1 + key % 5))).unionByName(ask.where(key % 3 == 0).select("query_id", *rule("q", "c", "a", F.lit("during"), F.lit(0))))
    return Requests(conditions=conditions, predicates=predicates), Recordings(heads, {"visual": frames}, events), _shots(spark, sf_dir)


@register(f"WITH {_REQUESTS} SELECT query_id, asset FROM ans")
def request_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users in whose events every condition and predicate of a supplier's request holds."""
    return Evaluation(*_requests(spark, sf_dir)).assets().select("query_id", "asset")


@register(f"""WITH {_REQUESTS}, m AS (SELECT w.* FROM win w JOIN ans USING (query_id, asset))
    SELECT query_id, condition, asset, start_ms, end_ms, record, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, condition, asset, start_ms, end_ms ORDER BY score DESC, record) AS r FROM m) WHERE r = 1""")
def request_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a request's answer shows: its windows, one a condition and interval."""
    return Evaluation(*_requests(spark, sf_dir)).matches().select("query_id", "condition", "asset", "start_ms", "end_ms", "record", "score")


@register(f"WITH {_REQUESTS} SELECT s.* FROM sup s JOIN ans USING (query_id, asset)")
def request_supports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair that shows a predicate of a request, the intervals that show it, and how sure it is."""
    held = Evaluation(*_requests(spark, sf_dir)).supports()
    told = F.array_join(F.transform("supports", lambda s: F.concat_ws("-", s.start_ms.cast("string"), s.end_ms.cast("string"))), ",")
    return held.withColumn("supports", told)
