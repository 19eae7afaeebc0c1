"""Facets, joins, rollups and ingest bookkeeping over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinequarry.functions.text import ascii_tokens, clean_list, closed_value, shortened
from cinequarry.operators import reports
from cinequarry.operators.library import facets, first_of, mark_missing, merge_fields, rare, status, tag_clusters, upsert, zero_filled

from .common import registry, table

QUERIES, ORACLES, register = registry()


def _n(name: str):
    return F.count("*").alias(name)


@register("SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE p_brand IN ('Brand#11', 'Brand#23', 'Brand#1', 'Brand#2') AND p_size IN (1, 2, 3, 5, 8, 13, 21)")
def facet_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets(table(spark, sf_dir, "part"), {"p_brand": ["Brand#11", "Brand#23", "Brand#1", "Brand#2"], "p_size": [1, 2, 3, 5, 8, 13, 21], "p_type": []}).select("p_partkey", "p_name", "p_brand", "p_type")


@register("SELECT p_partkey FROM part WHERE list_has_any(string_split(upper(p_type), ' '), ['STEEL', 'SMALL'])")
def usable_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").withColumn("kinds", F.split(F.upper("p_type"), " "))
    return facets(parts, {}, {"kinds": ["STEEL", "SMALL"]}).select("p_partkey")


@register("SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= TIMESTAMP '1994-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' AND lower(c_mktsegment) = 'building' AND n_regionkey = 1 AND o_totalprice BETWEEN 1000 AND 200000")
def context_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where((F.col("o_orderdate") >= F.lit("1994-01-01").cast("timestamp")) & (F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp")) & F.col("o_totalprice").between(1000, 200000))
    nations = table(spark, sf_dir, "nation").where("n_regionkey = 1")
    own = table(spark, sf_dir, "customer").where(F.lower("c_mktsegment") == "building").join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    return orders.join(own, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


_STATUS = """SELECT o_orderkey, CASE WHEN max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) = 1 THEN 'failed' WHEN max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) = 1 THEN 'queued' WHEN max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) = 1 THEN 'ready' ELSE 'discovered' END AS status FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"""


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.explode(F.array(F.when(F.col("l_returnflag") == "R", "failed"), F.when(F.col("l_linestatus") == "O", "queued"), F.when(F.col("l_returnflag") == "A", "ready"))).alias("state"))
    return status(table(spark, sf_dir, "orders"), "o_orderkey", facts, ["failed", "queued", "ready"], "discovered")


@register(_STATUS)
def processing_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _status(spark, sf_dir)


@register(f"SELECT s.status, count(o_orderkey) AS n FROM (VALUES ('missing'), ('processing'), ('queued'), ('failed'), ('ready'), ('discovered')) s(status) LEFT JOIN ({_STATUS}) x USING (status) GROUP BY s.status")
def processing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zero_filled(_status(spark, sf_dir).groupBy("status").agg(_n("n")), "status", ["missing", "processing", "queued", "failed", "ready", "discovered"])


@register("SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'O') AS pending, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) FILTER (WHERE o_orderstatus = 'P') AS running, count(*) FILTER (WHERE o_orderstatus = 'O' AND o_orderpriority LIKE '1%' AND o_orderdate > TIMESTAMP '1997-01-01') AS deferred FROM orders")
def job_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_ = lambda s: F.col("o_orderstatus") == s
    deferred = is_("O") & F.col("o_orderpriority").startswith("1") & (F.col("o_orderdate") > F.lit("1997-01-01").cast("timestamp"))
    return table(spark, sf_dir, "orders").agg(_n("total"), F.count_if(is_("O")).alias("pending"), F.count_if(is_("F")).alias("done"), F.count_if(is_("P")).alias("running"), F.count_if(deferred).alias("deferred"))


@register("SELECT coalesce(nullif(event_type, 'click'), 'unknown') AS code, count(*) AS n, count(DISTINCT user_id) AS assets, count(*) FILTER (WHERE value > 50) AS terminal, min(ts) AS first_at, min(user_id) AS sample FROM events GROUP BY 1")
def job_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.coalesce(F.nullif(F.col("event_type"), F.lit("click")), F.lit("unknown"))
    return table(spark, sf_dir, "events").groupBy(code.alias("code")).agg(_n("n"), F.count_distinct("user_id").alias("assets"), F.count_if(F.col("value") > 50).alias("terminal"), F.min("ts").alias("first_at"), F.min("user_id").alias("sample"))


@register("SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN 0 WHEN l_linestatus = 'O' THEN 1 WHEN l_returnflag = 'A' THEN 2 ELSE 3 END, l_shipdate DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def primary_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    health = F.when((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N"), 0).when(F.col("l_linestatus") == "O", 1).when(F.col("l_returnflag") == "A", 2).otherwise(3)
    return first_of(table(spark, sf_dir, "lineitem"), ["l_partkey"], [health, F.desc("l_shipdate"), F.asc("l_orderkey"), F.asc("l_linenumber")]).select("l_partkey", "l_orderkey", "l_linenumber")


@register("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_orderkey % 2 = 0)")
def unseen_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "orders").where("o_orderstatus = 'P' AND o_orderkey % 2 = 0")
    return table(spark, sf_dir, "customer").join(seen, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@register("SELECT change, count(*) AS n, count(missing_since) AS dated FROM (SELECT CASE WHEN s.k IS NULL THEN 'missing' WHEN o.k IS NULL THEN 'created' WHEN s.v = o.v THEN 'unchanged' ELSE 'changed' END AS change, CASE WHEN s.k IS NULL THEN 1 END AS missing_since FROM (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 7 <> 0) o FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS v FROM orders WHERE o_orderstatus <> 'P') s ON o.k = s.k) GROUP BY change")
def scan_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as two states of a library: which rows a new scan creates, changes and misses."""
    orders = table(spark, sf_dir, "orders")
    known = orders.where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    scan = orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("v"))
    return mark_missing(upsert(known, scan, ["k"], ["v"]), F.lit("2026-01-01").cast("timestamp")).groupBy("change").agg(_n("n"), F.count("missing_since").alias("dated"))


@register("SELECT user_id, event_id, 'purchase' AS origin FROM events WHERE event_type = 'purchase' UNION ALL SELECT user_id, event_id, 'view' FROM events WHERE event_type = 'view' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 150)")
def aligned_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    best = events.where("event_type = 'purchase'")
    rest = events.where("event_type = 'view'").join(best.where("value > 150"), "user_id", "left_anti")
    return best.select("user_id", "event_id", F.lit("purchase").alias("origin")).unionByName(rest.select("user_id", "event_id", F.lit("view").alias("origin")))


@register("SELECT user_id, max((event_type = 'click')::INT) = 1 AS has_click, max((event_type = 'purchase')::INT) = 1 AS has_purchase, max((event_type = 'view')::INT) = 1 AS has_view FROM events GROUP BY user_id")
def artifact_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.artifact_presence(table(spark, sf_dir, "events"), "user_id", "event_type", ("click", "purchase", "view"))


@register("SELECT c_custkey, c_name, n_name, r_name, o.o_orderkey AS last_order, coalesce(t.n, 0) AS orders, round(coalesce(t.total, 0), 2) AS total FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1) o ON o.o_custkey = c_custkey LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey) t ON t.o_custkey = c_custkey")
def asset_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    cards = reports.asset_cards(table(spark, sf_dir, "customer"), "c_custkey", table(spark, sf_dir, "orders"), "o_custkey", latest=("o_orderkey", ("o_orderdate", "o_orderkey")), totals={"total": F.sum("o_totalprice")}, places=places, on=F.col("c_nationkey") == F.col("n_nationkey"))
    return cards.select("c_custkey", "c_name", "n_name", "r_name", F.col("latest").alias("last_order"), F.col("items").alias("orders"), F.round("total", 2).alias("total"))


@register("SELECT l_orderkey, l_linenumber, lag(l_partkey) OVER w AS previous, lead(l_partkey) OVER w AS next FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)")
def prev_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lag("l_partkey").over(w).alias("previous"), F.lead("l_partkey").over(w).alias("next"))


@register("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS position FROM orders")
def dense_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.row_number().over(w) - 1).cast("long").alias("position"))


@register("SELECT o_orderkey, o_orderdate FROM orders WHERE (o_orderdate, o_orderkey) > (TIMESTAMP '1995-06-01', 100) ORDER BY o_orderdate, o_orderkey LIMIT 51")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of 50 and one row that says whether more follow."""
    at = F.lit("1995-06-01").cast("timestamp")
    after = (F.col("o_orderdate") > at) | ((F.col("o_orderdate") == at) & (F.col("o_orderkey") > 100))
    return table(spark, sf_dir, "orders").where(after).orderBy("o_orderdate", "o_orderkey").limit(51).select("o_orderkey", "o_orderdate")


@register("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100 OFFSET 100")
def browse_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).offset(100).limit(100).select("o_orderkey", "o_orderdate")


@register("SELECT p_partkey AS id, min(branch) AS branch FROM (SELECT p_partkey, 1 AS branch FROM part WHERE lower(p_brand) = 'brand#11' UNION SELECT p_partkey, 2 FROM part WHERE p_type LIKE '%STEEL%' UNION SELECT l_partkey, 3 FROM lineitem WHERE l_quantity = 50) GROUP BY 1")
def tag_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    literal = parts.where(F.lower("p_brand") == "brand#11").select(F.col("p_partkey").alias("id"), F.lit(1).alias("branch"))
    canonical = parts.where(F.col("p_type").contains("STEEL")).select(F.col("p_partkey").alias("id"), F.lit(2).alias("branch"))
    alias = table(spark, sf_dir, "lineitem").where("l_quantity = 50").select(F.col("l_partkey").alias("id"), F.lit(3).alias("branch"))
    return literal.unionByName(canonical).unionByName(alias).groupBy("id").agg(F.min("branch").alias("branch"))


@register("SELECT tag, coalesce(assets, 0) AS assets, coalesce(aliases, 0) AS aliases FROM (SELECT DISTINCT p_type AS tag FROM part) LEFT JOIN (SELECT p_type AS tag, count(DISTINCT l_orderkey) AS assets FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1) USING (tag) LEFT JOIN (SELECT p_type AS tag, count(DISTINCT p_brand) AS aliases FROM part GROUP BY 1) USING (tag)")
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("tag"), F.col("p_brand").alias("alias"))
    links = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("asset"), "l_partkey").join(parts.select("p_partkey", "tag"), F.col("l_partkey") == F.col("p_partkey"))
    return reports.canonical_tags(parts, links)


@register("SELECT p_brand AS tag, count(*) AS n, count(DISTINCT p_size) AS sizes, array_to_string(list_sort(list_distinct(list(p_type))), ',') AS forms FROM part GROUP BY p_brand")
def unresolved_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "part").select(F.col("p_brand").alias("tag"), F.col("p_size").alias("asset"), F.col("p_type").alias("form"))
    return reports.unresolved_tags(links).select("tag", "n", F.col("assets").alias("sizes"), F.array_join("forms", ",").alias("forms"))


@register("WITH t AS (SELECT p_partkey AS id, unnest(list_distinct(string_split(lower(p_name || ' ' || p_type), ' '))) AS term FROM part), df AS (SELECT term, count(*) AS df FROM t GROUP BY term) SELECT id, round(1 - avg(df / (SELECT count(*) FROM part)), 6) AS score FROM t JOIN df USING (term) GROUP BY id")
def rarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ").alias("terms"))
    return rare(parts, "id", F.col("terms")).select("id", F.round("score", 6).alias("score"))


@register("SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, round(sum(o_totalprice), 2) AS cost FROM orders GROUP BY 1")
def cost_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.costs(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice").select("day", F.round("cost", 2).alias("cost"))


@register("SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority AS capability, round(sum(o_totalprice), 2) AS cost, count(*) AS n FROM orders GROUP BY 1, 2")
def cost_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "capability")
    return reports.costs(ledger, "o_orderdate", "o_totalprice", by=["capability"], month=True).withColumn("cost", F.round("cost", 2))


@register("SELECT count(*) AS assets, count(DISTINCT source) AS sources, count(*) FILTER (WHERE length(text) = 0 OR text IS NULL) AS empty, sum(n_chars)::BIGINT AS chars FROM documents")
def index_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.index_health(table(spark, sf_dir, "documents"), "text", "source", "n_chars")


@register("SELECT c_custkey, count(o_orderkey) AS shots, coalesce(round(sum(o_totalprice), 2), 0) AS span FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def collection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = reports.collection_summary(table(spark, sf_dir, "customer"), "c_custkey", table(spark, sf_dir, "orders"), "o_custkey", F.col("o_totalprice"))
    return own.withColumn("span", F.round("span", 2))


@register("SELECT p_brand AS tag, n FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand) ORDER BY n DESC, p_brand LIMIT 20")
def top_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("tag")).agg(_n("n")).orderBy(F.desc("n"), "tag").limit(20)


@register("SELECT o_orderkey, CASE WHEN regexp_replace(lower(trim(o_orderpriority)), '[\\s\\-]+', '_', 'g') IN ('1_urgent', '2_high') THEN regexp_replace(lower(trim(o_orderpriority)), '[\\s\\-]+', '_', 'g') ELSE 'other' END AS priority FROM orders")
def closed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", closed_value("o_orderpriority", ["1_urgent", "2_high"], "other").alias("priority"))


@register("SELECT item_id, CASE WHEN length(text) > 40 THEN substr(text, 1, 39) || '…' ELSE text END AS short, array_to_string(list_slice(list_distinct_ordered, 1, 5), '|') AS terms FROM (SELECT item_id, text, list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: list_position(w, x[1]) = x[2]), lambda x: x[1]) AS list_distinct_ordered FROM (SELECT item_id, text, list_filter(list_transform(string_split(text, ' '), lambda x: trim(substr(lower(trim(x)), 1, 80))), lambda x: x <> '') AS w FROM benchmark))")
def cleaned_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark")
    return rows.select("item_id", shortened("text", 40).alias("short"), F.array_join(clean_list(F.split("text", " "), most=5), "|").alias("terms"))


@register("WITH c AS (SELECT o_custkey AS id, 'priority' AS field, o_orderpriority AS value, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS r, o_orderkey AS source FROM orders) SELECT id, field, value, source, others FROM (SELECT id, field, arg_min(value, r * 1000000000000 + source) AS value, arg_min(source, r * 1000000000000 + source) AS source, count(DISTINCT value) - 1 AS others FROM c GROUP BY id, field)")
def field_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.lit("priority").alias("field"), F.col("o_orderpriority").alias("value"), F.col("o_orderstatus").alias("family"), F.col("o_orderkey").alias("source"))
    return merge_fields(rows, ["id"], ["F", "O"]).select("id", "field", "value", "source", F.size("conflicting").cast("long").alias("others"))


@register("SELECT ext, n FROM (SELECT source AS ext, count(*) AS n FROM documents GROUP BY source) ORDER BY n DESC, ext LIMIT 20")
def skipped_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("ext")).agg(_n("n")).orderBy(F.desc("n"), "ext").limit(20)


@register("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def known_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    return customers.where("c_acctbal > 0").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@register("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def json_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long").getField("k").alias("k")).where("k IS NOT NULL")


@register("SELECT coalesce(r_name, 'ALL') AS region, coalesce(n_name, 'ALL') AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def place_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = F.broadcast(table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")))
    rows = table(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.rollup("r_name", "n_name").agg(_n("n")).select(F.coalesce("r_name", F.lit("ALL")).alias("region"), F.coalesce("n_name", F.lit("ALL")).alias("nation"), "n")


@register("""WITH RECURSIVE t AS (SELECT *, row_number() OVER (ORDER BY p_type) AS id FROM (SELECT p_type, avg(p_size) - 25 AS s, avg(p_retailprice) % 7 - 3 AS p FROM part GROUP BY p_type)),
    c AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity([a.s, a.p], [b.s, b.p]) AS c FROM t a, t b WHERE a.id < b.id), l AS (SELECT a, b FROM c WHERE c >= 0.86 UNION ALL SELECT b, a FROM c WHERE c >= 0.86), r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
    g AS (SELECT a AS tag, least(a, min(b)) AS cluster FROM r GROUP BY a), m AS (SELECT cluster, count(*) AS members FROM g GROUP BY cluster), s AS (SELECT x.cluster, avg(c) AS similarity FROM c JOIN g x ON x.tag = c.a JOIN g y ON y.tag = c.b AND x.cluster = y.cluster GROUP BY x.cluster)
    SELECT tag, cluster, members, round(similarity, 6) AS similarity FROM g JOIN m USING (cluster) JOIN s USING (cluster)""")
def similar_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the part types, a curated list, by what is left of their parts' mean figures."""
    types = table(spark, sf_dir, "part").groupBy("p_type").agg((F.avg("p_size") - 25).alias("s"), (F.avg("p_retailprice") % 7 - 3).alias("p"))
    ids = types.select(F.row_number().over(Window.orderBy("p_type")).cast("long").alias("id"), F.array("s", "p").alias("vector"))  # a row a type
    return tag_clusters(ids).withColumn("similarity", F.round("similarity", 6))


@register("WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS term FROM documents), df AS (SELECT term, count(*) AS df FROM t GROUP BY term) SELECT doc_id, round(1 - avg(df / (SELECT count(*) FROM documents)), 6) AS score, count(*) FILTER (WHERE df <= 1) AS rare_terms FROM t JOIN df USING (term) GROUP BY doc_id")
def document_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rarity of every document by its words."""
    return rare(table(spark, sf_dir, "documents"), "doc_id", ascii_tokens("text")).select("doc_id", F.round("score", 6).alias("score"), F.when(F.col("least_df") <= 1, F.size("rare_terms")).otherwise(0).cast("long").alias("rare_terms"))
