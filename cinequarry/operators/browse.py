"""Browsing a library: filters, pages, cards, job queues, tags, collections, stored metadata and shots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinequarry.functions.text import tag_key
from cinequarry.operators.library import first_of
from cinequarry.plans.broadcasts import checked, shuffled
from cinequarry.plans.scratch import shares

#: Shots of a partition that compares stored with new spans.
SPANS = 200_000


def duration_between(duration: Column, least: int | None = None, most: int | None = None) -> Column:
    """Whether a duration lies within inclusive bounds; unknown ones don't, once a bound is asked."""
    inside = F.lit(True)
    if least is not None:
        inside = inside & F.coalesce(duration >= least, F.lit(False))
    if most is not None:
        inside = inside & F.coalesce(duration <= most, F.lit(False))
    return inside


def shots_between(shots: DataFrame, least: int | None = None, most: int | None = None) -> DataFrame:
    """Shots by their own length, end - start, not by that of their recording."""
    return shots.where(duration_between(F.col("end_ms") - F.col("start_ms"), least, most))


def in_context(assets: DataFrame, *, since: Column | None = None, until: Column | None = None, region: str | None = None, camera: str | None = None, status: str | None = None, session: DataFrame | None = None) -> DataFrame:
    """Assets (captured, media_time, region, camera, status, asset) of a context; what isn't given asks nothing.

    The time is the capture time, else the media's, in [since, until); a
    region is equal, a camera equal but for case; ``session`` (asset) has the
    members of one.
    """
    at = F.coalesce("captured", "media_time")
    for ask, test in ((since, lambda: at >= since), (until, lambda: at < until), (region, lambda: F.col("region") == region), (camera, lambda: F.lower("camera") == camera.lower()), (status, lambda: F.col("status") == status)):
        if ask is not None:
            assets = assets.where(test())
    return assets if session is None else assets.join(session.select("asset").distinct(), "asset", "left_semi")


def sessions_where(sessions: DataFrame, equal: Mapping[str, object] | None = None, *, start: tuple[Column | None, Column | None] = (None, None), end: tuple[Column | None, Column | None] = (None, None)) -> DataFrame:
    """Sessions with equal columns (root, state, region, camera) and inclusive bounds on start and end."""
    for name, value in (equal or {}).items():
        if value not in (None, ""):
            sessions = sessions.where(F.col(name) == value)
    for column, (least, most) in (("start", start), ("end", end)):
        if least is not None:
            sessions = sessions.where(F.col(column) >= least)
        if most is not None:
            sessions = sessions.where(F.col(column) <= most)
    return sessions


def only_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among ``ids``, with ``position`` (where the id first stands) if ids have one; no ids ask nothing."""
    if not ids.limit(1).count():
        return rows
    if "position" not in ids.columns:
        return rows.join(ids.select(key).distinct(), key, "left_semi")
    return rows.join(ids.groupBy(key).agg(F.min("position").alias("position")), key)


def without_job(assets: DataFrame, jobs: DataFrame, kind: str, most: int | None = None) -> DataFrame:
    """Live assets (asset, missing_since) that no job (asset, kind) of the kind covers, oldest id first, at most so many."""
    left = assets.where("missing_since IS NULL").join(jobs.where(F.col("kind") == kind).select("asset"), "asset", "left_anti")
    return left if most is None else left.orderBy("asset").limit(most)


def read_paths(locations: DataFrame) -> DataFrame:
    """asset, path, name of the location (asset, path, is_primary, exists, root_state, seen) that a reader opens.

    Only primary locations that exist on a root that isn't unavailable count;
    the latest seen, then by path.
    """
    usable = locations.where("is_primary AND `exists` AND root_state <> 'unavailable'")
    best = first_of(usable, ["asset"], [F.desc("seen"), F.asc("path")])
    return best.select("asset", "path", F.element_at(F.split("path", "/"), -1).alias("name"))


# Health of a location, the best first: whether it exists, and its root's state.
LOCATION_HEALTH = ((True, "healthy"), (True, "unknown"), (False, "healthy"), (True, "unavailable"), (False, "unknown"), (False, "unavailable"))


def primary_locations(locations: DataFrame) -> DataFrame:
    """The location of each asset that is primary: by health, then the latest seen, the oldest root, root, path and id.

    From (asset, id, path, exists, seen, root, root_state, root_created).
    """
    rank = F.lit(len(LOCATION_HEALTH))
    for place, (there, state) in reversed(list(enumerate(LOCATION_HEALTH))):
        rank = F.when((F.col("exists") == there) & (F.col("root_state") == state), place).otherwise(rank)
    return first_of(locations, ["asset"], [rank, F.desc("seen"), F.asc("root_created"), F.asc("root"), F.asc("path"), F.asc("id")])


def job_summary(jobs: DataFrame, now: Column, deferring: Sequence[str] = ("deferred",)) -> DataFrame:
    """One row of counts of jobs (state, terminal, code, run_after): total, pending, running, succeeded, failed, terminal, deferred.

    A pending job with a deferring code and a later time is deferred, not pending.
    """
    state = lambda s: F.col("state") == s
    deferred = state("pending") & F.coalesce(F.col("code").isin(*deferring), F.lit(False)) & F.coalesce(F.col("run_after") > now, F.lit(False))
    dead = F.coalesce("terminal", F.lit(False))
    return jobs.agg(
        F.count("*").alias("total"),
        F.count_if(state("pending") & ~deferred).alias("pending"),
        F.count_if(state("running")).alias("running"),
        F.count_if(state("succeeded")).alias("succeeded"),
        F.count_if(state("failed") & ~dead).alias("failed"),
        F.count_if(dead).alias("terminal"),
        F.count_if(deferred).alias("deferred"),
    )


def job_issues(jobs: DataFrame, now: Column, deferring: Sequence[str]) -> DataFrame:
    """code, n, assets, terminal, first_at, next_retry, sample of jobs (asset, state, code, terminal, created, run_after) that are stuck, by code.

    Stuck are failed jobs, and pending ones that one of the ``deferring`` codes
    has parked until later than ``now``; the next retry is that of parked ones,
    as a failed job's time lies in the past. An empty code is unknown.
    """
    parked = (F.col("state") == "pending") & (F.col("run_after") > now) & F.col("code").isin(*deferring)
    stuck = jobs.where((F.col("state") == "failed") | F.coalesce(parked, F.lit(False)))
    code = F.coalesce(F.nullif("code", F.lit("")), F.lit("unknown"))
    waiting = F.when(F.col("state") == "pending", F.col("run_after"))
    return stuck.groupBy(code.alias("code")).agg(F.count("*").alias("n"), F.count_distinct("asset").alias("assets"), F.count_if(F.coalesce("terminal", F.lit(False))).alias("terminal"), F.min("created").alias("first_at"), F.min(waiting).alias("next_retry"), F.min("asset").alias("sample"))


def _due(now: Column) -> Column:
    open_states = F.col("state").isin("pending", "failed", "running") & ~F.coalesce("terminal", F.lit(False))
    free = F.col("lease_expires").isNull() | (F.col("lease_expires") <= now)
    return open_states & (F.col("attempts") < F.col("max_attempts")) & (F.col("run_after") <= now) & free


def next_jobs(jobs: DataFrame, now: Column, most: int = 1, *, apart: Sequence[str] = (), sizes: DataFrame | None = None, largest: int = 0) -> DataFrame:
    """The jobs that would be leased next, in order: priority, then age, then id.

    A job can be leased that is pending, failed or has an expired lease, isn't
    terminal, has attempts left, is due, is pinned to no worker, is of no kind
    in ``apart``, and whose asset is not larger than ``largest`` bytes
    (``sizes``: asset, size; 0 asks nothing).
    """
    rows = jobs.where(_due(now) & F.col("assigned").isNull() & ~F.col("kind").isin(*apart) if apart else _due(now) & F.col("assigned").isNull())
    if largest and sizes is not None:
        rows = rows.join(sizes.where(F.col("size") > largest).select("asset"), "asset", "left_anti")
    return rows.orderBy(F.desc("priority"), "created", "id").limit(most)


def heal_stale(jobs: DataFrame, executors: DataFrame, now: Column, stale_before: Column) -> DataFrame:
    """Running jobs whose lease has run out or whose local owner is gone, with healed: released or terminal.

    An owner local-* is gone when no executor (executor, last_seen) of that
    name was seen since. Jobs without attempts left end as terminal.
    """
    alive = executors.where(F.col("last_seen") >= stale_before).select(F.col("executor").alias("owner"), F.lit(True).alias("alive")).distinct()
    rows = jobs.where("state = 'running'").where(~F.coalesce("terminal", F.lit(False))).join(alive, "owner", "left")
    expired = F.coalesce(F.col("lease_expires") <= now, F.lit(False))
    gone = F.coalesce(F.col("owner").startswith("local-"), F.lit(False)) & F.col("alive").isNull()
    return rows.where(expired | gone).withColumn("healed", F.when(F.col("attempts") < F.col("max_attempts"), "released").otherwise("terminal")).drop("alive")


def page(rows: DataFrame, order: Sequence[Column], limit: int, offset: int, window: int = 200) -> DataFrame:
    """Rows of a page with place, has_more, next_offset and window_exhausted on each.

    One row more than the page is looked at; beyond the window nothing more is
    promised. An empty page has no row to say so.
    """
    ranked = rows.orderBy(*order).offset(offset).limit(limit + 1)
    numbered = ranked.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long") + offset)  # limit + 1 rows
    more = F.count("*").over(Window.partitionBy()) > limit
    end = offset + limit >= window
    return numbered.withColumns({"has_more": more & F.lit(not end), "next_offset": F.when(more & F.lit(not end), F.lit(offset + limit)), "window_exhausted": more & F.lit(end)}).where(F.col("place") <= offset + limit)


def merged(first: DataFrame, second: DataFrame, limit: int) -> DataFrame:
    """The best rows of two pools that share none, by score, then id."""
    return first.unionByName(second).orderBy(F.desc("score"), "id").limit(limit)


def normalised_tag_candidates(queries: DataFrame) -> DataFrame:
    """query_id, place, tag: a query (query_id, text) and its words as tags, each once, in order."""
    words = F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != "")
    keys = F.array_distinct(F.filter(F.transform(F.concat(F.array(F.trim("text")), words), tag_key), lambda k: k != ""))
    return queries.select("query_id", F.posexplode(keys).alias("place", "tag"))


def tagged_assets(candidates: DataFrame, links: DataFrame, catalog: DataFrame, aliases: DataFrame) -> DataFrame:
    """query_id, asset of assets that carry a candidate tag (query_id, tag): as it is, as a canonical name or as an alias.

    links (asset, raw, tag_id), catalog (tag_id, name), aliases (tag_id, alias), names normalised.
    """
    candidates, links = checked(candidates), shuffled(links)
    literal = links.join(candidates, links["raw"] == candidates["tag"]).select("query_id", "asset")
    named = catalog.join(candidates, catalog["name"] == candidates["tag"]).select("query_id", "tag_id")
    known = aliases.join(candidates, aliases["alias"] == candidates["tag"]).select("query_id", "tag_id")
    listed = checked(named.unionByName(known).distinct())
    by_id = links.join(listed, "tag_id").select("query_id", "asset")
    # How many rows there are before copies go follows from counts by tag; a partition gets a bounded number of them.
    per = lambda d, c: d.groupBy(F.col(c).alias("t")).agg(F.count("*").alias(f"n_{c}"))
    met = [per(links, x).join(per(asked, y).withColumnRenamed(f"n_{y}", "m"), "t").agg(F.sum(F.col(f"n_{x}") * F.col("m"))).first()[0] for x, asked, y in (("raw", candidates, "tag"), ("tag_id", listed, "tag_id"))]
    parts = shares(links.sparkSession, sum(int(n or 0) for n in met))
    return literal.unionByName(by_id).repartition(parts, "query_id", "asset").distinct()


def asset_search(tagged: DataFrame, lexical: DataFrame, limit: int, allowed: DataFrame | None = None) -> DataFrame:
    """query_id, asset, branch, place: assets by tag first, then lexical ones (query_id, asset, score), each once.

    ``allowed`` (asset) guards both branches before the limit.
    """
    guard = (lambda d: d) if allowed is None else (lambda d: d.join(allowed.select("asset").distinct(), "asset", "left_semi"))
    tags = guard(tagged).select("query_id", "asset", F.lit(0).alias("branch"), F.lit(0.0).alias("score"))
    texts = guard(lexical).select("query_id", "asset", F.lit(1).alias("branch"), "score")
    best = tags.unionByName(texts).groupBy("query_id", "asset").agg(F.min(F.struct("branch", (-F.col("score")).alias("minus"))).alias("b"))
    order = Window.partitionBy("query_id").orderBy("b.branch", "b.minus", "asset")
    return best.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= limit).select("query_id", "asset", "b.branch", "place")


def review_tags(proposals: DataFrame, decisions: DataFrame, catalog: DataFrame, aliases: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(proposals, catalog, aliases, links) after decisions (proposal, approved) on pending proposals.

    Proposals are (proposal, state, name, aliases[, tag_id]). An approved one
    is for its tag, or the one of its name, or a new one. Its aliases and its
    name then belong to this tag, even if another had them, and every link
    whose normalised raw tag is one of them leads to it, linked before or not.
    A rejected one changes its state alone; decisions on what isn't pending
    do nothing. Of approved proposals that claim one alias the last one wins.
    """
    judged = proposals.join(decisions, "proposal", "left")
    state = F.when((F.col("state") != "pending") | F.col("approved").isNull(), F.col("state")).when(F.col("approved"), "approved").otherwise("rejected")
    given = F.col("tag_id") if "tag_id" in proposals.columns else F.lit(None).cast(catalog.schema["tag_id"].dataType)
    approved = judged.where("state = 'pending' AND approved").select("proposal", "name", "aliases", given.alias("given"))
    known = catalog.select("tag_id", "name")
    fresh = approved.where("given IS NULL").select("name").distinct().join(known, "name", "left_anti").select(F.xxhash64("name").alias("tag_id"), "name")
    tags = known.unionByName(fresh)
    owned = approved.join(tags.groupBy("name").agg(F.min("tag_id").alias("own")), "name", "left").select("proposal", F.coalesce("given", "own").alias("tag_id"), F.explode(F.concat("aliases", F.array("name"))).alias("alias"))
    claimed = owned.withColumn("alias", tag_key("alias")).where("alias <> ''").groupBy("alias").agg(F.max_by("tag_id", "proposal").alias("tag_id"))
    names = aliases.select("tag_id", "alias").join(claimed.select("alias"), "alias", "left_anti").select("tag_id", "alias").unionByName(claimed.select("tag_id", "alias"))
    linked = links.withColumn("__key", tag_key("raw")).join(claimed.select(F.col("alias").alias("__key"), F.col("tag_id").alias("__tag")), "__key", "left").withColumn("tag_id", F.coalesce("__tag", "tag_id")).select(*links.columns)
    return judged.select(*[state.alias("state") if c == "state" else c for c in proposals.columns]), tags, names, linked


# Tags that mean one thing.
SAME_TAGS = {
    "city_at_night": "urban_night",
    "night_city": "urban_night",
    "city_night": "urban_night",
    "夜间城市": "urban_night",
    "城市夜景": "urban_night",
    "夜晚城市": "urban_night",
    "shopfront": "storefront",
    "store_front": "storefront",
    "店铺": "storefront",
    "商店": "storefront",
    "behind_the_scene": "behind_the_scenes",
    "behind_scenes": "behind_the_scenes",
}


def semantic_key(tag: Column) -> Column:
    """What tags that mean the same have in common: a known synonym, else the key without a plural s."""
    key = tag_key(tag)
    same = F.create_map(*[F.lit(x) for pair in SAME_TAGS.items() for x in pair])
    plural = key.endswith("s") & ~key.endswith("ss") & (F.octet_length(key) > 4)
    return F.coalesce(same[key], F.when(plural, F.regexp_replace(key, "s$", "")).otherwise(key))


def tag_proposals(unresolved: DataFrame, catalog: DataFrame) -> DataFrame:
    """kind, name, aliases, confidence, affected: proposals for unresolved tags (tag, usage, assets) by meaning.

    The canonical name comes from the most used tag, where plain ASCII counts
    for 2 and a name without a double underscore for 1; ties go to the first
    tag. A known name (catalog: name) only gets aliases, and nothing if there
    are none.
    """
    rows = unresolved.withColumn("key", semantic_key(F.col("tag")))
    score = F.col("usage") + F.when(F.col("tag").rlike("^[\\x00-\\x7F]*$"), 2).otherwise(0) + F.when(F.contains("tag", F.lit("__")), 0).otherwise(1)
    groups = rows.groupBy("key").agg(F.min_by("tag", F.struct((-score).alias("s"), "tag")).alias("best"), F.array_sort(F.collect_list("tag")).alias("tags"), F.sum("assets").alias("affected"))
    named = groups.withColumn("name", semantic_key(F.col("best"))).withColumn("aliases", F.expr("filter(tags, t -> t <> name)"))
    known = catalog.select(tag_key("name").alias("name"), F.lit(True).alias("known")).distinct()
    kind = F.when(F.col("known"), "add_aliases").when(F.size("aliases") > 0, "create_canonical_with_aliases").otherwise("create_canonical")
    sure = F.when(F.size("tags") == 1, 0.72).when(F.size("tags") == 2, 0.86).otherwise(0.93)
    return named.join(known, "name", "left").where("known IS NULL OR size(aliases) > 0").select(kind.alias("kind"), "name", "aliases", sure.alias("confidence"), "affected")


def reordered(items: DataFrame, moves: DataFrame) -> DataFrame:
    """collection, shot, position from 0 after moves (collection, shot, target): moved shots stand before who has their target place."""
    rows = items.join(moves, ["collection", "shot"], "left")
    order = Window.partitionBy("collection").orderBy(F.coalesce("target", "position"), F.when(F.col("target").isNotNull(), 0).otherwise(1), "position", "shot")
    return rows.select("collection", "shot", (F.row_number().over(order) - 1).cast("long").alias("position"))


def added_and_removed(items: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """collection, shot, position from 0 after removing shots and adding new ones, in their order, at the end."""
    kept = items.join(removed, ["collection", "shot"], "left_anti").select("collection", "shot", F.lit(0).alias("side"), F.col("position").cast("long").alias("place"))
    new = added.join(items, ["collection", "shot"], "left_anti").groupBy("collection", "shot").agg(F.min("place").alias("place")).select("collection", "shot", F.lit(1).alias("side"), F.col("place").cast("long").alias("place"))
    order = Window.partitionBy("collection").orderBy("side", "place", "shot")
    return kept.unionByName(new).select("collection", "shot", (F.row_number().over(order) - 1).cast("long").alias("position"))


# How far sources of a time or place, and precisions of a place, are trusted; others not at all.
SOURCE_TRUST = {"manual": 500, "embedded_exif": 400, "embedded_probe": 300, "filesystem": 100}
PRECISION_TRUST = {"exact": 300, "precise": 300, "approximate": 200, "region": 100}
TIME = ("captured", "time_source", "time_confidence")
PLACE = ("latitude", "longitude", "location_source", "location_precision")


def _trust(column: str, table: Mapping[str, int]) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[F.coalesce(F.col(column), F.lit(""))], F.lit(0))


def merge_metadata(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Metadata of both with new values where there are any: not null, 0, false or empty.

    The columns TIME and PLACE, where the tables have them, go together: the
    old ones stay if the new ones lack the time or either coordinate, or come
    from a less trusted source (for a place, in a tie, with less precision)
    while the old ones are known.
    """
    columns = [c for c in new.columns if c != key]
    both = new.select(key, *[F.col(c).alias(f"__{c}") for c in columns]).join(old, key, "full_outer")
    kinds = dict(new.dtypes)

    def value(c: str) -> Column:
        fresh = F.col(f"__{c}")
        empty = fresh == "" if kinds[c] == "string" else ~fresh if kinds[c] == "boolean" else fresh == 0 if kinds[c] in ("int", "bigint", "double", "float") else F.lit(False)
        return F.when(fresh.isNull() | empty, F.col(c)).otherwise(fresh)

    out = {c: value(c) for c in columns}
    if set(TIME[:2]) <= set(columns):
        keep = F.col("__captured").isNull() | ((_trust("__time_source", SOURCE_TRUST) < _trust("time_source", SOURCE_TRUST)) & F.col("captured").isNotNull())
        out |= {c: F.when(keep, F.col(c)).otherwise(F.col(f"__{c}")) for c in TIME if c in columns}
    if set(PLACE) <= set(columns):
        source, before = _trust("__location_source", SOURCE_TRUST), _trust("location_source", SOURCE_TRUST)
        worse = (source < before) | ((source == before) & (_trust("__location_precision", PRECISION_TRUST) < _trust("location_precision", PRECISION_TRUST)))
        known = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
        keep = F.col("__latitude").isNull() | F.col("__longitude").isNull() | (known & worse)
        out |= {c: F.when(keep, F.col(c)).otherwise(F.col(f"__{c}")) for c in PLACE}
    return both.select(key, *[column.alias(c) for c, column in out.items()])


def replace_shots(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """asset, id, start_ms, end_ms, change of every shot of the assets in ``fresh`` (asset, start_ms, end_ms, new_id).

    A span that is stored keeps its id (the smallest, if several have it), a
    new one takes new_id, and stored spans that are gone are removed. Two
    shots of one span in ``fresh`` are an error. reset says whether the asset's
    spans changed at all, so that what was derived from them must go.
    """
    kinds = dict(fresh.dtypes)
    none = lambda kind: F.lit(None).cast(kind)
    span = ["asset", "start_ms", "end_ms"]
    old = stored.select(*span, F.col("id").alias("old_id"), none(kinds["new_id"]).alias("new_id"), F.lit(0).alias("fresh"))
    new = fresh.select(*span, none(dict(stored.dtypes)["id"]).alias("old_id"), "new_id", F.lit(1).alias("fresh"))
    # Both sides meet in one shuffle by asset, in partitions of bounded size; a span without a start or an end equals no other.
    both = old.unionByName(new).where("asset IS NOT NULL").repartition(shares(stored.sparkSession, stored.count(), SPANS), "asset")
    apart = F.when(F.col("start_ms").isNull() | F.col("end_ms").isNull(), F.col("fresh")).otherwise(F.lit(-1))
    spans = both.groupBy(*span, apart.alias("apart")).agg(F.min("old_id").alias("old_id"), F.min("new_id").alias("new_id"), F.sum("fresh").alias("n"))
    own = Window.partitionBy("asset")
    spans = spans.withColumn("found", F.max("n").over(own)).where("found > 0")
    new_id = F.when(F.col("n") > 1, F.raise_error(F.lit("two shots of one span")).cast(kinds["new_id"])).otherwise(F.col("new_id"))
    spans = spans.withColumn("new_id", new_id)
    change = F.when(F.col("old_id").isNull(), "created").when(F.col("new_id").isNull(), "removed").otherwise("kept")
    rows = spans.select("asset", F.coalesce("old_id", "new_id").alias("id"), "start_ms", "end_ms", change.alias("change"))
    return rows.withColumn("reset", F.bool_or(F.col("change") != "kept").over(own))


def library_summary(assets: DataFrame, tags: DataFrame, most: int = 20) -> DataFrame:
    """One row: assets, analysed, bytes of live assets (asset, missing_since, analysed, size), and top_tags of (asset, tag) by use."""
    live = assets.where("missing_since IS NULL")
    counts = live.agg(F.count("*").alias("assets"), F.count_if("analysed").alias("analysed"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    used = tags.join(live.select("asset"), "asset", "left_semi").groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(most)
    listed = used.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "tag"))), lambda t: t["tag"]).alias("top_tags"))
    return counts.crossJoin(listed)  # one row each


def compose_plan(sections: DataFrame, hits: DataFrame, most: int = 3) -> DataFrame:
    """plan, section, place, shot, reused, missing of sections (plan, section, query, required), filled in order from hits (query, shot, score).

    A shot serves one section of a plan; a required section that would stay
    empty takes its best hit again, marked reused, and is missing without any.
    The choice depends on its order, so a plan is one group; of each query
    only as many hits enter as the plan's sections could use up.
    """
    import pandas as pd

    sizes = sections.groupBy("plan").agg((F.count("*") * most).alias("enough"))
    ranked = hits.where("shot IS NOT NULL").withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "shot")))
    rows = sections.join(F.broadcast(sizes), "plan").join(ranked, "query", "left").where("rank IS NULL OR rank <= enough")
    kinds = dict(rows.dtypes)

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for section, own in frame.sort_values(["section", "rank"]).groupby("section", sort=True):
            found = [s for s in own["shot"] if pd.notna(s)]
            chosen = [s for s in found if s not in used][:most]
            used.update(chosen)
            required = bool(own["required"].iloc[0])
            picks = [(s, False) for s in chosen] or ([(found[0], True)] if required and found else [])
            out += [(frame["plan"].iloc[0], section, i, s, reused, False) for i, (s, reused) in enumerate(picks, 1)] or [(frame["plan"].iloc[0], section, 0, None, False, required)]
        return pd.DataFrame(out, columns=["plan", "section", "place", "shot", "reused", "missing"])

    return rows.groupBy("plan").applyInPandas(fill, f"plan {kinds['plan']}, section {kinds['section']}, place long, shot {kinds['shot']}, reused boolean, missing boolean")
