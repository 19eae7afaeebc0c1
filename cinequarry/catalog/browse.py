"""Browsing over the relational tables: orders are assets of their customers, line items their shots, parts their tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinequarry.functions.text import ascii_tokens
from cinequarry.operators import browse, lexical
from cinequarry.plans.broadcasts import shuffled
from cinequarry.plans.scratch import shares

from .common import registry, table

QUERIES, ORACLES, register = registry()


def _day(text: str):
    return F.lit(text).cast("timestamp")


@register("SELECT p_partkey FROM part WHERE CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_retailprice END BETWEEN 905 AND 1500")
def asset_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices as durations, unknown for every ninth part."""
    parts = table(spark, sf_dir, "part").withColumn("duration", F.when(F.col("p_partkey") % 9 != 0, F.col("p_retailprice")))
    return parts.where(browse.duration_between(F.col("duration"), 905, 1500)).select("p_partkey")


@register("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity - l_linenumber BETWEEN 5 AND 20")
def shot_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    shots = table(spark, sf_dir, "lineitem").withColumns({"start_ms": F.col("l_linenumber"), "end_ms": F.col("l_quantity")})
    return browse.shots_between(shots, 5, 20).select("l_orderkey", "l_linenumber", "l_partkey")


@register("SELECT o_orderkey FROM orders WHERE coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END, o_orderdate - INTERVAL 1 YEAR) >= TIMESTAMP '1994-01-01' AND coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END, o_orderdate - INTERVAL 1 YEAR) < TIMESTAMP '1997-01-01' AND o_orderstatus = 'F' AND lower(o_orderpriority) = '2-high' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def asset_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as assets: every third lacks a capture time and has its media's, a year before."""
    members = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("customer"))
    orders = table(spark, sf_dir, "orders")
    session = orders.join(members, F.col("o_custkey") == F.col("customer"), "left_semi").select(F.col("o_orderkey").alias("asset"))
    assets = orders.select(F.col("o_orderkey").alias("asset"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate")).alias("captured"), (F.col("o_orderdate") - F.expr("INTERVAL 1 YEAR")).alias("media_time"), F.col("o_orderstatus").alias("region"), F.col("o_orderpriority").alias("camera"))
    return browse.in_context(assets, since=_day("1994-01-01"), until=_day("1997-01-01"), region="F", camera="2-High", session=session).select(F.col("asset").alias("o_orderkey"))


@register("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-01-01' AND o_orderdate + INTERVAL 30 DAY <= TIMESTAMP '1995-12-01'")
def session_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("state"), F.col("o_orderdate").alias("start"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAY")).alias("end"))
    return browse.sessions_where(rows, {"state": "O", "region": ""}, start=(_day("1995-01-01"), _day("1996-01-01")), end=(None, _day("1995-12-01"))).select("o_orderkey")


@register("SELECT c_custkey AS id, min(o_orderkey) AS position FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'P' GROUP BY c_custkey")
def ordered_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("position"))
    return browse.only_ids(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), ids, "id")


@register("SELECT p_partkey AS asset FROM part WHERE p_size % 5 <> 0 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 47) ORDER BY p_partkey LIMIT 25")
def unprobed_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that no large returned line item has probed; every fifth size is missing."""
    assets = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("asset"), F.when(F.col("p_size") % 5 == 0, 1).alias("missing_since"))
    jobs = table(spark, sf_dir, "lineitem").where("l_quantity > 47").select(F.col("l_partkey").alias("asset"), F.col("l_returnflag").alias("kind"))
    return browse.without_job(assets, jobs, "R", 25).select("asset")


@register("SELECT l_partkey AS asset, l_orderkey AS line FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey || '/' || l_linenumber || '/' || l_suppkey) AS r FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag <> 'A' AND l_quantity > 10) WHERE r = 1")
def read_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as locations of their part."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("asset"), F.concat_ws("/", "l_orderkey", "l_linenumber", "l_suppkey").alias("path"), (F.col("l_linestatus") == "O").alias("is_primary"), (F.col("l_quantity") > 10).alias("exists"), F.when(F.col("l_returnflag") == "A", "unavailable").otherwise("healthy").alias("root_state"), F.col("l_shipdate").alias("seen"))
    return browse.read_paths(rows).select("asset", F.split("path", "/")[0].cast("long").alias("line"))


@register("""SELECT l_partkey AS asset, l_orderkey AS line FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN 0 WHEN l_linestatus = 'O' AND l_returnflag = 'A' THEN 1 WHEN l_linestatus <> 'O' AND l_returnflag = 'N' THEN 2 WHEN l_linestatus = 'O' AND l_returnflag = 'R' THEN 3 WHEN l_linestatus <> 'O' AND l_returnflag = 'A' THEN 4 WHEN l_linestatus <> 'O' AND l_returnflag = 'R' THEN 5 ELSE 6 END,
    l_shipdate DESC, l_suppkey % 7, l_suppkey, l_orderkey::VARCHAR, l_linenumber) AS r FROM lineitem) WHERE r = 1""")
def location_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("l_returnflag") == "N", "healthy").when(F.col("l_returnflag") == "A", "unknown").otherwise("unavailable")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("asset"), F.col("l_linenumber").alias("id"), F.col("l_orderkey").cast("string").alias("path"), (F.col("l_linestatus") == "O").alias("exists"), F.col("l_shipdate").alias("seen"), F.col("l_suppkey").alias("root"), state.alias("root_state"), (F.col("l_suppkey") % 7).alias("root_created"))
    return browse.primary_locations(rows).select("asset", F.col("path").cast("long").alias("line"))


_JOBS = """jobs AS (SELECT event_id AS id, user_id AS asset, CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'succeeded' ELSE 'pending' END AS state, coalesce(value, 0) > 90 AND event_type = 'error' AS terminal,
    CASE WHEN event_id % 3 = 0 THEN 'disk_low' WHEN event_id % 3 = 1 THEN ' ' ELSE 'timeout' END AS code, ts AS created, ts + INTERVAL 2 DAY AS run_after, event_id % 4 AS priority, event_id % 5 AS attempts, CASE WHEN event_id % 2 = 0 THEN ts + INTERVAL 1 DAY END AS lease_expires, CASE WHEN event_id % 11 = 0 THEN 'w1' END AS assigned, event_type AS kind, CASE WHEN event_id % 2 = 0 THEN 'local-' || (user_id % 4) ELSE 'remote' END AS owner FROM events)"""
_NOW = "1704800000"


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    kind, n = F.col("event_type"), F.col("event_id")
    state = F.when(kind == "view", "running").when(kind == "error", "failed").when(kind == "purchase", "succeeded").otherwise("pending")
    code = F.when(n % 3 == 0, "disk_low").when(n % 3 == 1, " ").otherwise("timeout")
    return e.select(n.alias("id"), F.col("user_id").alias("asset"), state.alias("state"), ((F.coalesce("value", F.lit(0.0)) > 90) & (kind == "error")).alias("terminal"), code.alias("code"), F.col("ts").alias("created"), (F.col("ts") + F.expr("INTERVAL 2 DAY")).alias("run_after"), (n % 4).alias("priority"), (n % 5).alias("attempts"), F.lit(4).alias("max_attempts"), F.when(n % 2 == 0, F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("lease_expires"), F.when(n % 11 == 0, "w1").alias("assigned"), kind.alias("kind"), F.when(n % 2 == 0, F.concat(F.lit("local-"), (F.col("user_id") % 4).cast("string"))).otherwise("remote").alias("owner"))


def _now():
    return F.timestamp_seconds(F.lit(int(_NOW)))


@register(f"WITH {_JOBS}, d AS (SELECT *, state = 'pending' AND code = 'disk_low' AND run_after > make_timestamp({_NOW}000000) AS later FROM jobs) SELECT count(*) AS total, count(*) FILTER (WHERE state = 'pending' AND NOT later) AS pending, count(*) FILTER (WHERE state = 'running') AS running, count(*) FILTER (WHERE state = 'succeeded') AS succeeded, count(*) FILTER (WHERE state = 'failed' AND NOT terminal) AS failed, count(*) FILTER (WHERE terminal) AS terminal, count(*) FILTER (WHERE later) AS deferred FROM d")
def job_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.job_summary(_jobs(spark, sf_dir), _now(), ("disk_low",))


@register(f"WITH {_JOBS} SELECT coalesce(nullif(code, ''), 'unknown') AS code, count(*) AS n, count(DISTINCT asset) AS assets, count(*) FILTER (WHERE terminal) AS terminal, min(created) AS first_at, min(run_after) FILTER (WHERE state = 'pending') AS next_retry, min(asset) AS sample FROM jobs WHERE state = 'failed' OR state = 'pending' AND run_after > make_timestamp({_NOW}000000) AND code IN ('disk_low', 'timeout') GROUP BY 1")
def job_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = browse.job_issues(_jobs(spark, sf_dir), _now(), ("disk_low", "timeout"))
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_at", "next_retry")})


@register(f"WITH {_JOBS} SELECT id FROM jobs WHERE state IN ('pending', 'failed', 'running') AND NOT terminal AND attempts < 4 AND run_after <= make_timestamp({_NOW}000000) AND (lease_expires IS NULL OR lease_expires <= make_timestamp({_NOW}000000)) AND assigned IS NULL AND kind <> 'signup' AND asset NOT IN (SELECT user_id FROM events GROUP BY user_id HAVING count(*) > 80) ORDER BY priority DESC, created, id LIMIT 20")
def leasable_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("asset")).agg(F.count("*").alias("size"))
    return browse.next_jobs(_jobs(spark, sf_dir), _now(), 20, apart=("signup",), sizes=sizes, largest=80).select("id")


@register(f"WITH {_JOBS} SELECT id, CASE WHEN attempts < 4 THEN 'released' ELSE 'terminal' END AS healed FROM jobs WHERE state = 'running' AND NOT terminal AND (coalesce(lease_expires <= make_timestamp({_NOW}000000), false) OR owner IN ('local-0', 'local-1', 'local-3'))")
def stale_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    executors = spark.createDataFrame([("local-1", 5), ("local-2", 50)], "executor string, s long").select("executor", F.timestamp_seconds("s").alias("last_seen"))
    return browse.heal_stale(_jobs(spark, sf_dir), executors, _now(), F.timestamp_seconds(F.lit(20))).select("id", "healed")


@register("SELECT o_orderkey AS id, r AS place, true AS has_more, 60::BIGINT AS next_offset, false AS window_exhausted FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r > 40 AND r <= 60")
def result_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice")
    return browse.page(rows, [F.desc("o_totalprice"), F.asc("id")], 20, 40).select("id", "place", "has_more", F.col("next_offset").cast("long").alias("next_offset"), "window_exhausted")


@register("SELECT id, score FROM (SELECT o_orderkey AS id, o_totalprice AS score FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P') ORDER BY score DESC, id LIMIT 50")
def merged_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = lambda s: table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == s).select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"))
    return browse.merged(pool("O"), pool("P"), 50)


_KEY = r"trim(regexp_replace(lower(trim({0})), '[\x00-/:-`{{-\x7F]+', '_', 'g'), '_')"
_CANDIDATES = f"cand AS (SELECT DISTINCT query_id, tag FROM (SELECT p_partkey AS query_id, {_KEY.format('p_name')} AS tag FROM part WHERE p_partkey < 60 UNION ALL SELECT p_partkey, {_KEY.format('w')} FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part WHERE p_partkey < 60)) WHERE tag <> '')"


def _tag_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_partkey < 60").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("text"))


@register(f"WITH {_CANDIDATES} SELECT * FROM cand")
def tag_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.normalised_tag_candidates(_tag_queries(spark, sf_dir)).select("query_id", "tag")


_TAGS = "links AS (SELECT p_partkey AS asset, split_part(p_name, ' ', 1) AS raw, p_size % 6 AS tag_id FROM part), cat AS (SELECT DISTINCT p_size % 6 AS tag_id, ['ring', 'gear', 'bolt', 'cog', 'gizmo', 'widget'][p_size % 6 + 1] AS name FROM part), ali AS (SELECT 2 AS tag_id, 'hot' AS alias UNION ALL SELECT 4, 'cold')"
_TAGGED = f"{_CANDIDATES}, {_TAGS}, tagged AS (SELECT query_id, asset FROM cand JOIN links ON raw = tag UNION SELECT query_id, asset FROM cand JOIN cat ON name = tag JOIN links USING (tag_id) UNION SELECT query_id, asset FROM cand JOIN ali ON alias = tag JOIN links USING (tag_id))"


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    tag = (F.col("p_size") % 6).cast("int")
    links = parts.select(F.col("p_partkey").alias("asset"), F.split("p_name", " ")[0].alias("raw"), tag.alias("tag_id"))
    names = F.array(*[F.lit(n) for n in ("ring", "gear", "bolt", "cog", "gizmo", "widget")])
    catalog = parts.select(tag.alias("tag_id"), F.get(names, tag).alias("name")).distinct()
    aliases = spark.createDataFrame([(2, "hot"), (4, "cold")], "tag_id int, alias string")
    return browse.tagged_assets(browse.normalised_tag_candidates(_tag_queries(spark, sf_dir)), links, catalog, aliases)


@register(f"WITH {_TAGGED} SELECT * FROM tagged")
def assets_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(spark, sf_dir)


@register(f"""WITH {_TAGGED}, toks AS (SELECT p_partkey AS asset, string_split(lower(p_name), ' ') AS t FROM part), q AS (SELECT asset AS query_id, t AS terms FROM toks WHERE asset < 60), st AS (SELECT count(*) AS n FROM toks),
    pair AS (SELECT q.query_id, x.asset, unnest(q.terms) AS term, x.t FROM q JOIN toks x ON list_has_all(x.t, q.terms)), df AS (SELECT term, count(DISTINCT asset) AS df FROM (SELECT asset, unnest(t) AS term FROM toks) GROUP BY term),
    lex AS (SELECT query_id, asset, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 0) + CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN 0 ELSE 1e-6 END) AS score FROM pair JOIN df USING (term), st GROUP BY ALL),
    allp AS (SELECT query_id, asset, 0 AS branch, 0.0 AS score FROM tagged UNION ALL SELECT query_id, asset, 1, score FROM lex), ok AS (SELECT * FROM allp WHERE asset IN (SELECT p_partkey FROM part WHERE p_brand <> 'Brand#1')),
    best AS (SELECT query_id, asset, min(branch) AS branch FROM ok GROUP BY ALL)
    SELECT query_id, asset, branch FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY branch, s, asset) AS r FROM (SELECT b.*, CASE WHEN branch = 0 THEN 0 ELSE -round((SELECT max(score) FROM ok WHERE ok.query_id = b.query_id AND ok.asset = b.asset AND ok.branch = b.branch), 6) END AS s FROM best b)) WHERE r <= 400""")
def keyword_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts found by tag, then by all the words of a name; one brand is outside the facets."""
    parts = table(spark, sf_dir, "part")
    words = ascii_tokens("p_name")
    queries = _tag_queries(spark, sf_dir)
    terms = queries.select("query_id", F.explode(ascii_tokens("text")).alias("term"))
    lex = lexical.bm25(parts, "p_partkey", {"name": words}, terms).select("query_id", F.col("p_partkey").alias("asset"), F.round("score", 6).alias("score"))
    allowed = parts.where("p_brand <> 'Brand#1'").select(F.col("p_partkey").alias("asset"))
    return browse.asset_search(_tagged(spark, sf_dir), lex, 400, allowed).select("query_id", "asset", "branch")


@register(f"""WITH u AS (SELECT p_name AS tag, count(*) AS usage, count(DISTINCT p_brand) AS assets FROM part GROUP BY p_name), k AS (SELECT *, {_KEY.format('tag')} AS n FROM u), s AS (SELECT *, CASE WHEN n LIKE '%s' AND n NOT LIKE '%ss' AND length(n) > 4 THEN substr(n, 1, length(n) - 1) ELSE n END AS key FROM k),
    g AS (SELECT key, list_sort(list(tag)) AS tags, count(*) AS c, sum(assets)::BIGINT AS affected FROM s GROUP BY key), f AS (SELECT *, list_filter(tags, lambda t: t <> key) AS aliases, key IN (SELECT {_KEY.format('p_name')} FROM part WHERE p_partkey < 20) AS known FROM g)
    SELECT CASE WHEN known THEN 'add_aliases' WHEN len(aliases) > 0 THEN 'create_canonical_with_aliases' ELSE 'create_canonical' END AS kind, key AS name, array_to_string(aliases, '|') AS aliases, CASE c WHEN 1 THEN 0.72 WHEN 2 THEN 0.86 ELSE 0.93 END::DOUBLE AS confidence, affected FROM f WHERE NOT known OR len(aliases) > 0""")
def proposed_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    unresolved = parts.groupBy(F.col("p_name").alias("tag")).agg(F.count("*").alias("usage"), F.count_distinct("p_brand").alias("assets"))
    found = browse.tag_proposals(unresolved, parts.where("p_partkey < 20").select(F.col("p_name").alias("name")))
    return found.withColumn("aliases", F.array_join("aliases", "|"))


@register("SELECT o_custkey AS collection, o_orderkey AS shot, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'P' THEN 0 ELSE p END, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END, p, o_orderkey) - 1 AS position FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS p FROM orders)")
def reordered_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer by date, partly shipped ones moved to the front."""
    return browse.reordered(_items(spark, sf_dir), _items(spark, sf_dir, "o_orderstatus = 'P'").select("collection", "shot", F.lit(0).cast("long").alias("target")))


def _items(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, sf_dir, "orders").withColumn("position", (F.row_number().over(order) - 1).cast("long"))
    return rows.where(where).select(F.col("o_custkey").alias("collection"), F.col("o_orderkey").alias("shot"), "position")


@register("SELECT o_custkey AS collection, o_orderkey AS shot, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END, CASE WHEN o_orderpriority LIKE '1%' THEN o_orderkey % 10 ELSE p END, o_orderkey) - 1 AS position FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS p FROM orders) WHERE o_orderpriority LIKE '1%' OR NOT (o_orderstatus = 'P')")
def changed_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent orders are added to the others of a customer, partly shipped ones removed."""
    rest = _items(spark, sf_dir, "o_orderpriority NOT LIKE '1%'")
    urgent = _items(spark, sf_dir, "o_orderpriority LIKE '1%'").select("collection", "shot", (F.col("shot") % 10).alias("place"))
    return browse.added_and_removed(rest, urgent, _items(spark, sf_dir, "o_orderstatus = 'P' AND o_orderpriority NOT LIKE '1%'").select("collection", "shot"))


@register("""WITH o AS (SELECT o_orderkey AS id, o_totalprice AS width, o_orderstatus AS codec, o_orderdate AS captured, CASE o_orderkey % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'embedded_probe' ELSE 'odd' END AS source FROM orders WHERE o_orderkey % 5 <> 0),
    n AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE o_totalprice + 1 END AS width, CASE WHEN o_orderstatus = 'O' THEN '' ELSE 'X' END AS codec, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate + INTERVAL 1 DAY END AS captured, 'embedded_exif' AS source FROM orders WHERE o_orderkey % 4 <> 0)
    SELECT id, CASE WHEN coalesce(n.width, 0) = 0 THEN o.width ELSE n.width END AS width, CASE WHEN coalesce(n.codec, '') = '' THEN o.codec ELSE n.codec END AS codec, CASE WHEN n.captured IS NULL OR (o.captured IS NOT NULL AND coalesce(o.source, '') = 'manual') THEN o.captured ELSE n.captured END AS captured, CASE WHEN n.captured IS NULL OR (o.captured IS NOT NULL AND coalesce(o.source, '') = 'manual') THEN o.source ELSE n.source END AS time_source
    FROM n FULL JOIN o USING (id)""")
def metadata_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    old = orders.where("o_orderkey % 5 <> 0").select(key.alias("id"), F.col("o_totalprice").alias("width"), F.col("o_orderstatus").alias("codec"), F.col("o_orderdate").alias("captured"), F.when(key % 3 == 0, "manual").when(key % 3 == 1, "embedded_probe").otherwise("odd").alias("time_source"))
    new = orders.where("o_orderkey % 4 <> 0").select(key.alias("id"), F.when(key % 2 == 0, 0.0).otherwise(F.col("o_totalprice") + 1).alias("width"), F.when(F.col("o_orderstatus") == "O", "").otherwise("X").alias("codec"), F.when(key % 7 != 0, F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("captured"), F.lit("embedded_exif").alias("time_source"))
    return browse.merge_metadata(old, new, "id")


@register("""WITH old AS (SELECT l_orderkey AS asset, l_partkey + 1000000 * l_linenumber AS id, l_linenumber AS s, l_linenumber + l_quantity::BIGINT AS e FROM lineitem), keep AS (SELECT asset, s, e, min(id) AS old_id FROM old WHERE asset IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY ALL),
    new AS (SELECT l_orderkey AS asset, l_linenumber AS s, max(l_linenumber + l_quantity::BIGINT + CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS e FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY ALL),
    b AS (SELECT asset, coalesce(old_id, -s) AS id, s AS start_ms, e AS end_ms, CASE WHEN old_id IS NULL THEN 'created' WHEN new.asset IS NULL THEN 'removed' ELSE 'kept' END AS change FROM (SELECT *, asset AS na FROM new) new FULL JOIN keep USING (asset, s, e))
    SELECT asset, id, start_ms, end_ms, change FROM b""".replace("new.asset IS NULL", "na IS NULL"))
def shot_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as shots of finished orders, found again with longer spans where they were returned."""
    lines = table(spark, sf_dir, "lineitem")
    begin, end = F.col("l_linenumber").cast("long"), F.col("l_linenumber").cast("long") + F.round("l_quantity").cast("long")
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    stored = lines.select(F.col("l_orderkey").alias("asset"), (F.col("l_partkey") + 1_000_000 * begin).alias("id"), begin.alias("start_ms"), end.alias("end_ms"))
    longer = end + F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    parts = shares(spark, lines.count())
    own = lines.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag").repartition(parts, "l_orderkey")
    fresh = own.join(shuffled(done.select("o_orderkey").repartition(parts, "o_orderkey")), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").groupBy(F.col("l_orderkey").alias("asset"), begin.alias("start_ms")).agg(F.max(longer).alias("end_ms")).withColumn("new_id", -F.col("start_ms"))
    return browse.replace_shots(stored, fresh).select("asset", "id", "start_ms", "end_ms", "change")


@register("SELECT count(*) FILTER (WHERE live) AS assets, count(*) FILTER (WHERE live AND p_type = 'ECONOMY') AS analysed, sum(p_size) FILTER (WHERE live)::BIGINT AS bytes, (SELECT array_to_string(list(tag ORDER BY n DESC, tag), ',') FROM (SELECT p_brand AS tag, count(*) AS n FROM part WHERE p_size % 5 <> 0 GROUP BY p_brand ORDER BY n DESC, tag LIMIT 20)) AS top_tags FROM (SELECT *, p_size % 5 <> 0 AS live FROM part)")
def library_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    assets = parts.select(F.col("p_partkey").alias("asset"), F.when(F.col("p_size") % 5 == 0, 1).alias("missing_since"), (F.col("p_type") == "ECONOMY").alias("analysed"), F.col("p_size").alias("size"))
    tags = parts.select(F.col("p_partkey").alias("asset"), F.col("p_brand").alias("tag"))
    return browse.library_summary(assets, tags).withColumn("top_tags", F.array_join("top_tags", ","))


@register()
def section_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan a region with a section a nation, filled with the nation's customers and, where they run out, the region's; tests restate it."""
    nations = table(spark, sf_dir, "nation")
    sections = nations.select(F.col("n_regionkey").alias("plan"), F.col("n_nationkey").alias("section"), F.concat(F.lit("q"), (F.col("n_nationkey") % 10).cast("string")).alias("query"), (F.col("n_nationkey") % 2 == 0).alias("required"))
    hits = table(spark, sf_dir, "customer").select(F.concat(F.lit("q"), (F.col("c_nationkey") % 7).cast("string")).alias("query"), F.col("c_custkey").alias("shot"), F.round("c_acctbal", -3).alias("score"))
    return browse.compose_plan(sections, hits)
