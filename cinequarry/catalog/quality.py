"""Quality metrics over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinequarry.functions.vectors import nearest, unit
from cinequarry.operators.quality import by_intent, centroid, diarization_error, equal_error, event_scores, expected_shots, false_positives, interval_ranking, match_events, mean_over, ranking, relevance_suite, threshold_sweep

from .common import registry, table
from .timeline import _events

QUERIES, ORACLES, register = registry()


@register("""WITH r AS (SELECT c_nationkey AS query_id, c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer),
    g AS (SELECT c_nationkey AS query_id, c_custkey AS id, CASE c_mktsegment WHEN 'BUILDING' THEN 2 WHEN 'MACHINERY' THEN 1 ELSE 0 END AS grade FROM customer),
    good AS (SELECT * FROM g WHERE grade > 0),
    h AS (SELECT query_id, count(*) AS hits, sum((2.0 ** grade - 1) / log2(rank + 1)) AS dcg FROM r JOIN good USING (query_id, id) WHERE rank <= 10 GROUP BY query_id),
    i AS (SELECT query_id, count(*) AS relevant, sum(CASE WHEN k <= 10 THEN (2.0 ** grade - 1) / log2(k + 1) ELSE 0 END) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, id) AS k FROM good) GROUP BY query_id)
    SELECT query_id, round(coalesce(hits, 0) / 10, 6) AS precision, round(coalesce(hits, 0) / relevant, 6) AS recall, round(coalesce(dcg, 0) / ideal, 6) AS ndcg FROM i LEFT JOIN h USING (query_id)""")
def ranking_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers ranked by balance within their nation, graded by segment."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("query_id"), F.col("c_custkey").alias("id"), "c_acctbal", F.when(F.col("c_mktsegment") == "BUILDING", 2).when(F.col("c_mktsegment") == "MACHINERY", 1).otherwise(0).alias("grade"))
    order = Window.partitionBy("query_id").orderBy(F.desc("c_acctbal"), "id")
    found = rows.select("query_id", "id", F.row_number().over(order).alias("rank"))
    scored = ranking(found, rows.select("query_id", "id", "grade"))
    return scored.select("query_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "ndcg")])


@register("""WITH t AS (SELECT round(value / 500, 4) AS threshold, event_type = 'purchase' AS same FROM events WHERE value IS NOT NULL), c AS (SELECT threshold, count(*) FILTER (WHERE same) AS s, count(*) FILTER (WHERE NOT same) AS d FROM t GROUP BY threshold)
    SELECT threshold, round(sum(d) OVER (ORDER BY threshold ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / (SELECT sum(d) FROM c), 6) AS far, round(coalesce(sum(s) OVER (ORDER BY threshold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / (SELECT sum(s) FROM c), 6) AS frr FROM c""")
def far_frr(spark: SparkSession, sf_dir: str) -> DataFrame:
    trials = table(spark, sf_dir, "events").where("value IS NOT NULL").select((F.col("value") / 500).alias("score"), (F.col("event_type") == "purchase").alias("same"))
    return threshold_sweep(trials).select("threshold", F.round("far", 6).alias("far"), F.round("frr", 6).alias("frr"))


@register("""WITH t AS (SELECT round(value / 500, 4) AS threshold, event_type = 'purchase' AS same FROM events WHERE value IS NOT NULL), c AS (SELECT threshold, count(*) FILTER (WHERE same) AS s, count(*) FILTER (WHERE NOT same) AS d FROM t GROUP BY threshold),
    w AS (SELECT threshold, sum(d) OVER (ORDER BY threshold ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / (SELECT sum(d) FROM c) AS far, coalesce(sum(s) OVER (ORDER BY threshold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / (SELECT sum(s) FROM c) AS frr FROM c)
    SELECT threshold, (far + frr) / 2 AS eer FROM w ORDER BY abs(far - frr), threshold LIMIT 1""")
def speaker_eer(spark: SparkSession, sf_dir: str) -> DataFrame:
    trials = table(spark, sf_dir, "events").where("value IS NOT NULL").select((F.col("value") / 500).alias("score"), (F.col("event_type") == "purchase").alias("same"))
    return equal_error(threshold_sweep(trials))


@register("""WITH e AS (SELECT label, unnest(range(len(embedding))) AS position, unnest(embedding)::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS x, vec_id % 7 + 1 AS w FROM embeddings WHERE embedding IS NOT NULL),
    s AS (SELECT label, position, sum(w * x) AS s FROM e GROUP BY label, position)
    SELECT label, position::INT AS position, round(s / sqrt(sum(s * s) OVER (PARTITION BY label)), 6) AS value FROM s""")
def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL").select("label", F.transform("embedding", lambda x: x.cast("double")).alias("v"), (F.col("vec_id") % 7 + 1).alias("duration_ms"))
    return centroid(rows.select("label", unit("v").alias("vector"), "duration_ms"), "label").withColumn("value", F.round("value", 6))


@register("""WITH v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
    c AS (SELECT q.id AS query_id, c.id, round(list_cosine_similarity(q.v, c.v), 6) AS score, q.label = c.label AS good FROM v q, v c WHERE q.id % 20 = 0 AND q.id <> c.id),
    t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM c WHERE score > 0)
    SELECT query_id, count(*) FILTER (WHERE good) / 10 AS precision FROM t WHERE rank <= 10 GROUP BY query_id""")
def neighbour_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P@10 of nearest neighbours, with the label as relevance, for ids divisible by 20."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    found = nearest(rows, rows.where("id % 20 = 0"), k=10)
    named = rows.select("id", "label")
    good = found.join(named, "id").join(named.select(F.col("id").alias("query_id"), F.col("label").alias("own")), "query_id")
    return good.groupBy("query_id").agg((F.count_if(F.col("label") == F.col("own")) / 10).alias("precision"))


@register()
def event_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as predictions of views, matched one to one a user."""
    rows = _events(spark, sf_dir)
    own = lambda t: rows.where(F.col("event_type") == t).select("user_id", F.col("event_id").alias("id"), "start_ms", "end_ms")
    return match_events(own("click"), own("view"), ["user_id"])


@register()
def diarization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as speaker turns by role, against turns that alternate; tests hold this query against single frames."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("asset"), F.col("role").alias("speaker"), (F.col("turn") * 1000).alias("start_ms"), (F.col("turn") * 1000 + F.least(F.length("text"), F.lit(900))).alias("end_ms"), "turn")
    guess = turns.select("asset", (F.col("turn") % 2).cast("string").alias("speaker"), "start_ms", (F.col("end_ms") - 50).alias("end_ms"))
    durations = turns.groupBy("asset").agg(F.max("end_ms").alias("duration_ms"))
    return diarization_error(turns.drop("turn"), guess, durations)


_RANKED = "r AS (SELECT c_nationkey AS query_id, c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer), good AS (SELECT c_nationkey AS query_id, c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING')"


def _ranked(spark: SparkSession, sf_dir: str, *order) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("query_id"), F.col("c_custkey").alias("id"), "c_acctbal", "c_mktsegment")
    by = Window.partitionBy("query_id").orderBy(*(order or (F.desc("c_acctbal"), F.asc("id"))))
    return rows.withColumn("rank", F.row_number().over(by))


@register(f"""WITH {_RANKED}, s AS (SELECT c_nationkey AS query_id, c_custkey AS id FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 97, c_custkey) AS k FROM customer) WHERE k <= 10), l AS (SELECT c_nationkey AS query_id, c_custkey AS id FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 89, c_custkey) AS k FROM customer) WHERE k <= 10)
    SELECT query_id, id, CASE WHEN (query_id, id) IN (SELECT query_id, id FROM s) THEN 'semantic' WHEN (query_id, id) IN (SELECT query_id, id FROM l) THEN 'lexical' ELSE 'blend' END AS cause FROM r WHERE rank <= 10 AND (query_id, id) NOT IN (SELECT query_id, id FROM good)""")
def wrong_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrong customers among a nation's richest, by the signal that alone would have brought them up."""
    found = _ranked(spark, sf_dir)
    own = lambda m: _ranked(spark, sf_dir, F.col("id") % m, F.col("id"))
    return false_positives(found.select("query_id", "id", "rank"), found.where("c_mktsegment = 'BUILDING'").select("query_id", "id"), own(97), own(89))


_P10 = f"{_RANKED}, p AS (SELECT query_id, count(*) / 10 AS precision FROM r JOIN good USING (query_id, id) WHERE rank <= 10 GROUP BY query_id), q AS (SELECT n_nationkey AS query_id, CASE n_regionkey WHEN 0 THEN '' WHEN 1 THEN 'fact' ELSE 'speech' END AS intent FROM nation)"


def _precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _ranked(spark, sf_dir)
    return ranking(found, found.select("query_id", "id", (F.col("c_mktsegment") == "BUILDING").cast("int").alias("grade")))


@register(f"WITH {_P10} SELECT coalesce(nullif(intent, ''), 'auto') AS intent, count(*) AS queries, round(avg(coalesce(precision, 0)), 6) AS precision FROM q LEFT JOIN p USING (query_id) GROUP BY 1")
def intent_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    intents = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query_id"), F.when(F.col("n_regionkey") == 0, "").when(F.col("n_regionkey") == 1, "fact").otherwise("speech").alias("intent"))
    return by_intent(_precision(spark, sf_dir), intents, ["precision"]).withColumn("precision", F.round("precision", 6))


@register(f"WITH {_P10} SELECT round(avg(coalesce(precision, 0)), 6) AS precision FROM q LEFT JOIN p USING (query_id)")
def mean_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query_id"))
    return mean_over(_precision(spark, sf_dir), queries, ["precision"]).select(F.round("precision", 6).alias("precision"))


_EVENTS = "e AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000 AS s, epoch_us(ts) // 1000 + 1800000 AS e FROM events)"


@register(f"""WITH {_EVENTS}, o AS (SELECT l.event_id AS span, r.event_id AS shot, least(l.e, r.e) - greatest(l.s, r.s) AS shared, r.s FROM e l JOIN e r ON l.user_id = r.user_id AND l.event_type = 'click' AND r.event_type <> 'click' AND l.s < r.e AND l.e > r.s),
    b AS (SELECT span, shot FROM (SELECT *, row_number() OVER (PARTITION BY span ORDER BY shared DESC, s, shot) AS k FROM o WHERE shared >= 900000) WHERE k = 1) SELECT event_id AS span, shot FROM e LEFT JOIN b ON span = event_id WHERE event_type = 'click'""")
def expected_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as expected spans of other events of their user."""
    rows = _events(spark, sf_dir).withColumn("asset", F.col("user_id"))
    expected = rows.where("event_type = 'click'").select(F.col("event_id").alias("span"), "asset", "start_ms", "end_ms")
    return expected_shots(expected, rows.where("event_type <> 'click'").select(F.col("event_id").alias("id"), "asset", "start_ms", "end_ms"))


def _results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _events(spark, sf_dir)
    order = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    found = rows.where("event_type = 'click'").withColumn("rank", F.row_number().over(order)).select(F.col("user_id").alias("query_id"), "rank", F.col("user_id").alias("asset"), "start_ms", "end_ms")
    good = rows.where("event_type IN ('view', 'purchase')").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("id"), F.col("user_id").alias("asset"), "start_ms", "end_ms", F.when(F.col("event_type") == "purchase", 2).otherwise(0).alias("grade"))
    return found, good


@register()
def interval_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's clicks as results for their views and purchases; tests restate it."""
    return interval_ranking(*_results(spark, sf_dir))


@register()
def event_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as predictions of views, scored; tests restate the matching."""
    rows = _events(spark, sf_dir)
    own = lambda t: rows.where(F.col("event_type") == t).select("user_id", F.col("event_id").alias("id"), "start_ms", "end_ms")
    return event_scores(own("click"), own("view"), match_events(own("click"), own("view"), ["user_id"]), ["user_id"])


@register("""WITH r AS (SELECT c_nationkey AS query_id, c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer WHERE c_nationkey % 6 <> 0), j AS (SELECT c_nationkey AS query_id, c_custkey AS id, CASE c_mktsegment WHEN 'BUILDING' THEN 2 WHEN 'MACHINERY' THEN 0 END AS grade FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')),
    q AS (SELECT n_nationkey AS query_id, n_regionkey % 2 = 0 AS expected_empty, CASE n_regionkey WHEN 0 THEN 'fact' ELSE 'speech' END AS expected, CASE WHEN n_nationkey % 3 = 0 THEN 'fact' ELSE 'speech' END AS intent FROM nation),
    g AS (SELECT query_id, count(*) AS relevant FROM j WHERE grade > 0 GROUP BY query_id), h AS (SELECT query_id, count(*) AS h20, count(*) FILTER (WHERE rank <= 10) AS h10, sum(CASE WHEN rank <= 10 THEN 3 / log2(rank + 1) ELSE 0 END) AS dcg FROM r JOIN j USING (query_id, id) WHERE rank <= 20 AND grade > 0 GROUP BY query_id),
    i AS (SELECT query_id, list_sum(list_transform(range(1, least(relevant, 10) + 1), lambda k: 3 / log2(k + 1))) AS ideal FROM g), f AS (SELECT DISTINCT query_id, true AS met FROM r)
    SELECT round(avg(CASE WHEN relevant IS NOT NULL THEN coalesce(h20, 0) / relevant END), 6) AS recall, round(avg(coalesce(h10, 0) / 10), 6) AS precision, round(avg(CASE WHEN relevant IS NOT NULL THEN coalesce(dcg, 0) / ideal END), 6) AS ndcg, round(avg((met IS NULL)::INT), 6) AS empty_rate, round(avg(((met IS NULL) = expected_empty)::INT), 6) AS empty_accuracy, round(avg((intent = expected)::INT), 6) AS intent_accuracy,
        (SELECT count(*) FROM r JOIN j USING (query_id, id) WHERE rank <= 20 AND grade = 0) AS not_relevant_hits FROM q LEFT JOIN g USING (query_id) LEFT JOIN h USING (query_id) LEFT JOIN i USING (query_id) LEFT JOIN f USING (query_id)""")
def suite_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as queries for their richest customers; every sixth finds nothing."""
    found = _ranked(spark, sf_dir)
    judged = found.where("c_mktsegment IN ('BUILDING', 'MACHINERY')").select("query_id", "id", F.when(F.col("c_mktsegment") == "BUILDING", 2).otherwise(0).alias("grade"))
    queries = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query_id"), (F.col("n_regionkey") % 2 == 0).alias("expected_empty"), F.when(F.col("n_regionkey") == 0, "fact").otherwise("speech").alias("expected_intent"), F.when(F.col("n_nationkey") % 3 == 0, "fact").otherwise("speech").alias("intent"))
    row = relevance_suite(found.where("query_id % 6 <> 0").select("query_id", "id", "rank"), judged, queries)
    return row.select(*[F.round(c, 6).alias(c) for c in ("recall", "precision", "ndcg", "empty_rate", "empty_accuracy", "intent_accuracy")], "not_relevant_hits")
