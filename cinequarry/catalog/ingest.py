"""Ingest and index upkeep: scans, JSON segments, stale vectors, index rebuilds, timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinequarry.functions.text import ascii_tokens
from cinequarry.operators import scans, fusion, lexical
from cinequarry.operators.library import primary_session, scan_changes
from cinequarry.operators.modalities import within
from cinequarry.operators.timeline import assemble, merge_window_analyses, on_recording
from cinequarry.plans.scratch import scratch_path, settle
from cinequarry.sources.ingest import asset_key, segments, stale_embeddings

from .common import registry, table
from .retrieval import _CHANNELS, _TOK, _channels
from .timeline import _events, _words

QUERIES, ORACLES, register = registry()


@register("""WITH o AS (SELECT o_orderkey, o_custkey % 40 AS f, o_orderkey % 3 AS size FROM orders), known AS (SELECT 'p' || o_orderkey AS path, f, size, f * 10 + size AS asset, o_orderkey % 7 = 0 AS missing FROM o WHERE o_orderkey % 4 <> 0 AND f < 30),
    scan AS (SELECT 'p' || (o_orderkey + CASE WHEN o_orderkey % 11 = 0 THEN 1000000 ELSE 0 END) AS path, CASE WHEN o_orderkey % 13 = 0 THEN f + 1 ELSE f END AS f, size FROM o WHERE o_orderkey % 5 <> 0),
    own AS (SELECT f, size, min(asset) AS owner FROM known GROUP BY ALL), still AS (SELECT DISTINCT f, size FROM known JOIN scan USING (path, f, size))
    SELECT coalesce(s.path, k.path) AS path, CASE WHEN s.path IS NULL THEN k.asset ELSE owner END AS asset, CASE WHEN s.path IS NULL THEN 'missing' WHEN k.path IS NOT NULL AND s.f = k.f AND s.size = k.size AND k.missing THEN 'reappeared' WHEN k.path IS NOT NULL AND s.f = k.f AND s.size = k.size THEN 'unchanged' WHEN k.path IS NOT NULL THEN 'changed' WHEN owner IS NULL THEN 'created' WHEN still.f IS NOT NULL THEN 'linked' ELSE 'moved' END AS change
    FROM scan s LEFT JOIN own ON own.f = s.f AND own.size = s.size LEFT JOIN still ON still.f = s.f AND still.size = s.size FULL JOIN known k ON k.path = s.path""")
def library_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files, a customer's remainder as their content: some scanned under another path, some with other content."""
    key = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(key, (F.col("o_custkey") % 40).alias("fingerprint"), (key % 3).alias("size"))
    path = lambda n: F.concat(F.lit("p"), n.cast("string"))
    known = o.where("o_orderkey % 4 <> 0 AND fingerprint < 30").select(path(key).alias("path"), "fingerprint", "size", (F.col("fingerprint") * 10 + F.col("size")).alias("asset"), (key % 7 == 0).alias("missing"))
    scan = o.where("o_orderkey % 5 <> 0").select(path(key + F.when(key % 11 == 0, 1_000_000).otherwise(0)).alias("path"), F.when(key % 13 == 0, F.col("fingerprint") + 1).otherwise(F.col("fingerprint")).alias("fingerprint"), "size")
    return scan_changes(known, scan).select("path", "asset", "change")


@register("SELECT o_custkey AS asset, o_orderkey AS session FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'P') DESC, o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def primary_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return primary_session(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("asset"), F.col("o_orderkey").alias("session"), (F.col("o_orderstatus") == "P").alias("is_primary"), F.col("o_orderdate").alias("created")))


@register("SELECT o_orderkey, sha256(sha256(o_orderpriority) || chr(0) || o_custkey || chr(0) || (o_orderkey * 1000)) AS key FROM orders")
def asset_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", asset_key(F.sha2("o_orderpriority", 256), F.col("o_custkey"), F.col("o_orderkey") * 1000).alias("key"))


@register("SELECT conv_id, turn - first AS ordinal, turn * 1000 AS start_ms, turn * 1000 + 100 * (turn % 3) AS end_ms, text FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS first FROM conversations) WHERE turn % 3 <> 0 AND text IS NOT NULL AND conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')")
def json_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of a conversation as one JSON list, taken apart again; every third has no length, and aligned words win."""
    turns = table(spark, sf_dir, "conversations")
    one = F.struct("turn", (F.col("turn") * 1000).alias("start_ms"), (F.col("turn") * 1000 + 100 * (F.col("turn") % 3)).alias("end_ms"), "text")
    lists = turns.groupBy("conv_id").agg(F.to_json(F.array_sort(F.collect_list(one))).alias("js"))
    return segments(lists, "conv_id", "js", turns.where("role = 'system'")).withColumn("ordinal", F.col("ordinal").cast("long"))


_SCANS = """f AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'b' ELSE 'a' END AS root FROM orders),
    s AS (SELECT 1 AS v, root, 'p' || k AS path, '/' || root || '/p' || k AS absolute, 'f' || (k % 997) AS fp, 1 + k % 2 AS size, 1 AS m FROM f WHERE root = 'a' AND k % 5 <> 0
          UNION ALL SELECT 2, root, CASE WHEN k % 11 = 0 THEN 'q' ELSE 'p' END || k, '/' || root || '/p' || k, CASE WHEN k % 17 = 0 THEN 'g' || k ELSE 'f' || (k % 997) END, 1 + k % 2, 1 + (k % 13 = 0)::INT FROM f WHERE root = 'a' AND k % 7 <> 0 OR root = 'b' AND k % 5 <> 1
          UNION ALL SELECT 3, root, 'p' || k, CASE WHEN k % 19 = 0 THEN '/new/p' ELSE '/a/p' END || k, 'f' || (k % 997), 1 + k % 2, 1 FROM f WHERE root = 'a' AND k % 4 <> 1)"""


@register(f"""WITH {_SCANS}, grid AS (SELECT DISTINCT s.root, path, x.v FROM s JOIN (VALUES (1, 'a'), (2, 'a'), (2, 'b'), (3, 'a')) x(v, root) ON x.root = s.root),
    st AS (SELECT g.root, g.path, g.v, s.absolute IS NOT NULL AS present, last_value(s.absolute IGNORE NULLS) OVER w AS absolute, last_value(fp || ':' || size IGNORE NULLS) OVER w AS asset, last_value(m IGNORE NULLS) OVER w AS m FROM grid g LEFT JOIN s ON s.root = g.root AND s.path = g.path AND s.v = g.v WINDOW w AS (PARTITION BY g.root, g.path ORDER BY g.v)),
    d AS (SELECT *, lag((present, absolute, asset, m)) OVER (PARTITION BY root, path ORDER BY v) AS before FROM st WHERE absolute IS NOT NULL)
    SELECT root, path, absolute, asset, m::BIGINT AS modified_ns, present, v::BIGINT AS since, (lead(v) OVER (PARTITION BY root, path ORDER BY v))::BIGINT AS until FROM d WHERE before IS NULL OR before <> (present, absolute, asset, m)""")
def scan_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as files of two roots over three scans, of which the second alone sees both: every state of each location and when it held."""
    k = F.col("o_orderkey")
    files = table(spark, sf_dir, "orders").select(k, F.when(k % 3 == 0, "b").otherwise("a").alias("root"))
    named = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    own, size = named("f", k % 997), (1 + k % 2).cast("long")
    row = lambda rows, path, absolute, fingerprint, modified: rows.select("root", path.alias("path"), absolute.alias("absolute"), fingerprint.alias("fingerprint"), size.alias("size"), modified.cast("long").alias("modified_ns"))
    plain = named("/", F.col("root"), "/p", k)
    seen = [
        row(files.where("root = 'a' AND o_orderkey % 5 <> 0"), named("p", k), plain, own, F.lit(1)),
        row(files.where("root = 'a' AND o_orderkey % 7 <> 0 OR root = 'b' AND o_orderkey % 5 <> 1"), named(F.when(k % 11 == 0, "q").otherwise("p"), k), plain, F.when(k % 17 == 0, named("g", k)).otherwise(own), 1 + (k % 13 == 0).cast("int")),
        row(files.where("root = 'a' AND o_orderkey % 4 <> 1"), named("p", k), named(F.when(k % 19 == 0, "/new/p").otherwise("/a/p"), k), own, F.lit(1)),
    ]
    state = scans.empty_state(spark)
    for version, (scan, roots) in enumerate(zip(seen, ("a", "ab", "a"), strict=True), 1):
        state = settle(scans.apply_scan(state, scan, spark.createDataFrame([(r,) for r in roots], "root string"), version)[0])
    return state.drop("fingerprint", "size")


@register("SELECT doc_id, substr(sha256(coalesce(text, '')), 1, 32) AS text_hash FROM documents WHERE NOT (doc_id % 3 = 0) OR doc_id % 6 = 0")
def stale_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document's vector is stored, every sixth one's under another text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hashed = F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 32)
    stored = docs.where("doc_id % 3 = 0").select("doc_id", F.when(F.col("doc_id") % 6 == 0, F.lit("other")).otherwise(hashed).alias("text_hash"), F.lit("m1").alias("model"))
    return stale_embeddings(docs, stored, "doc_id", "m1").select("doc_id", "text_hash")


@register(f"SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK.format('text')}) AS token FROM documents WHERE doc_id % 4 <> 3 OR doc_id % 3 <> 0) GROUP BY ALL")
def index_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of all documents, half of them with a wrong text and some too many at first, after these are refreshed and removed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fields = {"body": ascii_tokens("text")}
    first = lexical.write_index(docs.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.lit("wrong words")).otherwise(F.col("text"))), "doc_id", fields, scratch_path(spark))
    gone = docs.where("doc_id % 4 = 3 AND doc_id % 3 = 0").select("doc_id")
    fresh = lexical.refresh_index(first, docs.where("doc_id % 2 = 0"), fields, removed=gone)
    return fresh.postings.select("doc_id", "token", "tf")


@register(r"SELECT query_id, phrase, token FROM (SELECT item_id AS query_id, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS phrase FROM (SELECT item_id, regexp_extract_all(lower(trim(text)), '[\p{L}\p{Nd}_]+') AS t FROM benchmark))")
def query_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.phrases(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")).select("query_id", F.col("phrase").cast("long").alias("phrase"), "token")


@register(r"SELECT doc_id, 'filename' AS field, token, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(source), '[\p{L}\p{Nd}_]+')) AS token FROM documents) GROUP BY ALL UNION ALL SELECT doc_id, 'extra_tags', lang, 1 FROM documents")
def asset_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as assets: source as name and location, of which the latter is never indexed, and language as tag."""
    fields = lexical.asset_fields({"filename": F.col("source"), "location": F.col("source"), "extra_tags": F.col("lang")})
    return lexical.postings(table(spark, sf_dir, "documents"), "doc_id", fields).select("doc_id", "field", "token", "tf")


@register(f"WITH {_CHANNELS} SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, signal ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, signal, round(score - 0.3, 6) AS score FROM ch) WHERE score > 0) GROUP BY query_id, id")
def positive_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain rank fusion of what scores over 0.3 in its channel."""
    return fusion.legacy_rrf(_channels(spark, sf_dir).withColumn("score", F.round(F.col("score") - 0.3, 6))).withColumn("score", F.round("score", 9))


@register("SELECT l_orderkey AS asset, l_partkey AS record FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def universe_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a shot are kept by the assets of the eligible ones."""
    allowed = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("asset"), F.col("o_custkey").alias("shot"))
    return within(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("asset"), F.col("l_partkey").alias("record")), allowed)


_VIEW = (1_704_500_000_000, 1_704_900_000_000)


@register(f"""WITH e AS (SELECT event_type AS track, event_id AS record, epoch_us(ts) // 1000 AS start_ms, epoch_us(ts) // 1000 + 1800000 AS end_ms FROM events), t(track, state) AS (VALUES ('click', 'complete'), ('view', 'partial'), ('purchase', 'absent'), ('none', 'complete'))
    SELECT track, record, start_ms, end_ms, state FROM t LEFT JOIN (SELECT * FROM e WHERE start_ms < {_VIEW[1]} AND end_ms > {_VIEW[0]}) USING (track)""")
def timeline_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four tracks of events in a viewport: one without coverage, one without events."""
    rows = _events(spark, sf_dir)
    own = lambda t: rows.where(F.col("event_type") == t).select(F.col("event_id").alias("record"), "start_ms", "end_ms", F.col("event_type").alias("label"))
    coverage = spark.createDataFrame([("click", "complete"), ("view", "partial"), ("none", "complete")], "track string, state string")
    return assemble({t: own(t) for t in ("click", "view", "purchase", "none")}, coverage, *_VIEW).drop("label")


@register("""SELECT user_id AS asset, first(t ORDER BY w) FILTER (WHERE t <> '') AS summary, round(coalesce(avg(value) FILTER (WHERE value > 0), 0), 6) AS confidence, max(p) AS people, array_to_string(list_distinct(list(event_type)).list_sort(), ',') AS tags
    FROM (SELECT user_id, event_id AS w, value, event_id % 9 AS p, event_type, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type || event_id END AS t FROM events) GROUP BY user_id""")
def window_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as windows of their user."""
    n = F.col("event_id")
    windows = table(spark, sf_dir, "events").select(F.col("user_id").alias("asset"), n.alias("window"), F.when(n % 3 == 0, "").otherwise(F.concat("event_type", n.cast("string"))).alias("summary"), F.col("value").alias("confidence"), (n % 9).alias("people"), F.array("event_type").alias("tags"))
    merged = merge_window_analyses(windows, ["tags"])
    return merged.select("asset", "summary", F.round("confidence", 6).alias("confidence"), "people", F.array_join(F.array_sort("tags"), ",").alias("tags"))


@register("""WITH s AS (SELECT l_orderkey AS asset, l_linenumber AS "window", l_partkey AS shot, l_quantity::BIGINT - 25 AS a, l_quantity::BIGINT AS b FROM lineitem), w AS (SELECT DISTINCT l_orderkey AS asset, l_linenumber AS "window", l_linenumber * 20 AS s, l_linenumber * 20 + 30 AS e FROM lineitem)
    SELECT asset, "window", shot, x AS start_ms, y AS end_ms FROM (SELECT asset, "window", shot, least(greatest(a + w.s, w.s), w.e) AS x, least(greatest(b + w.s, w.s), w.e) AS y FROM s JOIN w USING (asset, "window")) WHERE y > x""")
def shifted_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as shots on the time of their window, some beyond its ends."""
    lines = table(spark, sf_dir, "lineitem")
    begin = F.col("l_linenumber").cast("long") * 20
    size = F.col("l_quantity").cast("long")
    shots = lines.select(F.col("l_orderkey").alias("asset"), F.col("l_linenumber").alias("window"), F.col("l_partkey").alias("shot"), (size - 25).alias("start_ms"), size.alias("end_ms"))
    windows = lines.select(F.col("l_orderkey").alias("asset"), F.col("l_linenumber").alias("window"), begin.alias("start_ms"), (begin + 30).alias("end_ms")).distinct()
    return on_recording(shots, windows)


@register("""WITH w AS (SELECT conv_id, turn, unnest(range(len(t))) AS i FROM (SELECT conv_id, turn, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS t FROM conversations)), a AS (SELECT conv_id, turn * 9000 + i * 300 AS s, turn * 9000 + i * 300 + 250 AS e FROM w), t AS (SELECT conv_id, turn, role, turn * 9000 AS s, turn * 9000 + 4000 AS e FROM conversations)
    SELECT t.conv_id, t.turn, count(*) AS words, sum(least(a.e, t.e) - greatest(a.s, t.s))::BIGINT AS overlap_ms FROM t JOIN a ON a.conv_id = t.conv_id AND a.s < t.e AND a.e > t.s GROUP BY ALL""")
def turn_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a conversation that lie in each speaker's first four seconds, and for how long."""
    from cinequarry.functions.intervals import overlap_ms, related

    words = _words(spark, sf_dir).select("conv_id", (F.col("turn") * 9000 + F.col("start_ms")).alias("start_ms"), (F.col("turn") * 9000 + F.col("end_ms")).alias("end_ms"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") * 9000).alias("start_ms"), (F.col("turn") * 9000 + 4000).alias("end_ms"))
    met = related(words, turns, "conv_id", "simultaneous")
    shared = overlap_ms((F.col("left_start_ms"), F.col("left_end_ms")), (F.col("right_start_ms"), F.col("right_end_ms")))
    return met.groupBy("conv_id", "turn").agg(F.count("*").alias("words"), F.sum(shared).alias("overlap_ms"))


