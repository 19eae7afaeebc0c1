"""Browsing and bookkeeping of a media library: facets, status, tags, sessions, ledgers, ingest."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinequarry.functions.vectors import norm, similar_pairs, unit
from cinequarry.operators.graph import connected_components


def facets(rows: DataFrame, wanted: Mapping[str, Sequence], any_of: Mapping[str, Sequence] | None = None) -> DataFrame:
    """Rows whose columns are among the wanted values, all at once; an empty list asks nothing.

    ``any_of`` is for array columns of which one value must be wanted.
    """
    for column, values in wanted.items():
        if values:
            rows = rows.where(F.col(column).isin(*values))
    for column, values in (any_of or {}).items():
        if values:
            rows = rows.where(F.arrays_overlap(F.col(column), F.array(*[F.lit(v) for v in values])))
    return rows


def first_of(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def status(assets: DataFrame, key: str, facts: DataFrame, ranks: Sequence[str], fallback: str) -> DataFrame:
    """key, status: the first of ``ranks`` that a fact (key, state) of the asset has, else the fallback."""
    order = {name: i for i, name in enumerate(ranks)}
    rank = F.create_map(*[x for name, i in order.items() for x in (F.lit(name), F.lit(i))])
    best = facts.where(F.col("state").isin(*ranks)).groupBy(key).agg(F.min(rank[F.col("state")]).alias("__rank"))
    names = F.array(*[F.lit(n) for n in ranks])
    return assets.select(key).join(best, key, "left").select(key, F.coalesce(F.get(names, F.col("__rank")), F.lit(fallback)).alias("status"))


def zero_filled(counts: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """column, n for every value, with 0 where nothing is counted."""
    every = counts.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return every.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def upsert(known: DataFrame, scan: DataFrame, key: Sequence[str], same: Sequence[str]) -> DataFrame:
    """Every row of either side with change: created, changed, unchanged or missing.

    ``same`` are the columns whose equality makes a row unchanged. A row that
    was missing and is found again is changed.
    """
    old = known.select(*key, *[F.col(c).alias(f"__{c}") for c in same], F.lit(True).alias("__known"), *([F.col("missing_since").alias("__missing")] if "missing_since" in known.columns else [F.lit(None).cast("timestamp").alias("__missing")]))
    new = scan.select(*key, *same, F.lit(True).alias("__seen"))
    equal = F.lit(True)
    for c in same:
        equal = equal & F.col(c).eqNullSafe(F.col(f"__{c}"))
    change = F.when(F.col("__seen").isNull(), "missing").when(F.col("__known").isNull(), "created").when(equal & F.col("__missing").isNull(), "unchanged").otherwise("changed")
    return new.join(old, list(key), "full_outer").select(*key, *[F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) for c in same], F.col("__missing").alias("missing_since"), change.alias("change"))


def scan_changes(known: DataFrame, scan: DataFrame) -> DataFrame:
    """path, fingerprint, size, asset, change of every path of a library (path, fingerprint, size, asset, missing) or a scan of it.

    A file is what its fingerprint and size say, wherever it lies. Of the
    scanned paths, created ones hold unknown files, moved ones a known file
    none of whose old paths is still seen with it, linked ones another copy of
    a known file, changed ones another file than before (known elsewhere or
    not), and reappeared ones were missing; missing ones weren't scanned.
    """
    file = ("fingerprint", "size")
    owners = known.groupBy(*file).agg(F.min("asset").alias("owner"))
    still = known.join(scan, ["path", *file], "left_semi").select(*file).distinct().withColumn("still", F.lit(True))
    old = known.select("path", F.col("fingerprint").alias("old_fingerprint"), F.col("size").alias("old_size"), F.col("asset").alias("old_asset"), F.col("missing").alias("was_missing"), F.lit(True).alias("was"))
    rows = scan.select("path", *file, F.lit(True).alias("seen")).join(owners, list(file), "left").join(still, list(file), "left").join(old, "path", "full_outer")
    same = F.col("fingerprint").eqNullSafe(F.col("old_fingerprint")) & F.col("size").eqNullSafe(F.col("old_size"))
    change = (
        F.when(F.col("seen").isNull(), "missing")
        .when(F.col("was") & same & F.col("was_missing"), "reappeared")
        .when(F.col("was") & same, "unchanged")
        .when(F.col("was"), "changed")
        .when(F.col("owner").isNull(), "created")
        .when(F.col("still"), "linked")
        .otherwise("moved")
    )
    asset = F.when(F.col("seen").isNull(), F.col("old_asset")).otherwise(F.col("owner"))
    return rows.select("path", F.coalesce("fingerprint", "old_fingerprint").alias("fingerprint"), F.coalesce("size", "old_size").alias("size"), asset.alias("asset"), change.alias("change"))


def primary_session(memberships: DataFrame) -> DataFrame:
    """asset, session of memberships (asset, session, is_primary, created): the primary one, else the newest, ties by session."""
    return first_of(memberships, ["asset"], [F.desc("is_primary"), F.desc("created"), F.asc("session")]).select("asset", "session")


def mark_missing(changes: DataFrame, now: Column) -> DataFrame:
    """upsert()'s rows with missing_since set once when a row goes missing, and cleared when it is back."""
    return changes.withColumn("missing_since", F.when(F.col("change") == "missing", F.coalesce("missing_since", now)))


def merge_fields(candidates: DataFrame, keys: Sequence[str], ranks: Sequence[str]) -> DataFrame:
    """keys, field, value, source, conflicting: per field the value of the best source, ties by source key.

    From (keys, field, value, family, source). conflicting lists the other values, sorted.
    """
    rank = F.array_position(F.array(*[F.lit(r) for r in ranks]), F.col("family"))
    ranked = candidates.where("value IS NOT NULL AND value <> ''").withColumn("__rank", F.when(rank == 0, len(ranks) + 1).otherwise(rank))
    best = ranked.groupBy(*keys, "field").agg(F.min_by(F.struct("value", "source"), F.struct("__rank", "source")).alias("best"), F.array_sort(F.collect_set("value")).alias("values"))
    return best.select(*keys, "field", "best.value", "best.source", F.array_remove("values", F.col("best.value")).alias("conflicting"))


#: Sources that follow from other captures and are none themselves.
DERIVED = ("proxy", "sidecar", "derived")


def sessions(captures: DataFrame, device_keys: Sequence[str], markers: Sequence[str], gap_ms: int = 30 * 60_000) -> DataFrame:
    """id, session of captures (id, start_ms, device keys, markers; optionally source).

    Captures of one device whose times are at most ``gap_ms`` after the one
    before belong together, and so do those that share a marker; sessions are
    the connected components, named by their smallest id. Keys are trimmed and
    lower-cased, empty ones join nothing, a capture without a time has no
    device neighbour, an id counts once, and derived sources are left out.

    Nothing is sorted by device: captures within one stretch of ``gap_ms`` are
    linked to its first, and stretches that follow each other by their last
    and first, so that a device of a third of all rows is summed in parts.
    """
    if "source" in captures.columns:
        captures = captures.where(~F.coalesce(F.lower(F.trim("source")), F.lit("")).isin(*DERIVED))
    captures = captures.dropDuplicates(["id"])
    key_of = lambda c: F.lower(F.trim(F.col(c).cast("string")))
    links = []
    for name in markers:
        own = captures.select("id", key_of(name).alias("k")).where("k <> ''")
        first = own.groupBy("k").agg(F.min("id").alias("a"))
        links.append(own.join(first, "k").select("a", F.col("id").alias("b")))
    for name in device_keys:
        own = captures.where("start_ms IS NOT NULL").select("id", "start_ms", key_of(name).alias("k"), F.floor(F.col("start_ms") / gap_ms).alias("stretch")).where("k <> ''")
        ends = own.groupBy("k", "stretch").agg(F.min(F.struct("start_ms", "id")).alias("first"), F.max(F.struct("start_ms", "id")).alias("last"))
        links.append(own.join(ends, ["k", "stretch"]).select(F.col("first.id").alias("a"), F.col("id").alias("b")))
        following = ends.select("k", (F.col("stretch") - 1).alias("stretch"), F.col("first").alias("next"))
        links.append(ends.join(following, ["k", "stretch"]).where(F.col("next.start_ms") - F.col("last.start_ms") <= gap_ms).select(F.col("last.id").alias("a"), F.col("next.id").alias("b")))
    if not links:
        return captures.select("id", F.col("id").alias("session"))
    both = links[0]
    for more in links[1:]:
        both = both.unionByName(more)
    labels = connected_components(both.where("a <> b")).select(F.col("node").alias("id"), "label")
    return captures.select("id").join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("session"))


def session_spans(captures: DataFrame, members: DataFrame) -> DataFrame:
    """session, start_ms, end_ms, captures: a session ends with the capture that ends last."""
    end = F.coalesce("end_ms", "start_ms") if "end_ms" in captures.columns else F.col("start_ms")
    return captures.dropDuplicates(["id"]).join(members, "id").groupBy("session").agg(F.min("start_ms").alias("start_ms"), F.max(end).alias("end_ms"), F.count("*").alias("captures"))


def rebuild_sessions(stored: DataFrame, captures: DataFrame, device_keys: Sequence[str], markers: Sequence[str], gap_ms: int = 30 * 60_000) -> DataFrame:
    """id, session, root, origin after the automatic sessions of every root in ``captures`` are made anew.

    ``stored`` (id, session, root, origin) keeps what people set; automatic
    rows of the roots that are rebuilt are replaced. Sessions never cross a
    root: it is part of every key. ``captures`` has a row a location
    (id, root, rank and sessions()' columns); the best-ranked of an asset counts.
    """
    best = first_of(captures, ["root", "id"], [F.col("rank"), F.col("id")])
    own = [*device_keys, *markers]
    keyed = best.withColumns({c: F.when(F.trim(F.col(c)) != "", F.concat_ws("\x1f", "root", F.trim(F.col(c)))) for c in own})
    fresh = sessions(keyed, device_keys, markers, gap_ms).join(best.select("id", "root"), "id").select("id", "session", "root", F.lit("automatic").alias("origin"))
    rebuilt = captures.select("root").distinct()
    kept = stored.where("origin <> 'automatic'").unionByName(stored.where("origin = 'automatic'").join(rebuilt, "root", "left_anti").select(*stored.columns))
    return kept.select("id", "session", "root", "origin").unionByName(fresh)


def rare(rows: DataFrame, key: str, terms: Column) -> DataFrame:
    """key, score, rare_terms, least_df: the mean of 1 - df/N over a row's distinct terms, and its rare terms.

    Rare terms are those of one row only, or else the row's first term.
    """
    n = rows.count()
    each = rows.select(key, F.posexplode(F.array_distinct(terms)).alias("place", "term"))
    df = each.groupBy("term").agg(F.count("*").alias("df"))
    lonely = F.array_sort(F.collect_list(F.when(F.col("df") <= 1, F.col("term"))))
    sums = each.join(df, "term").groupBy(key).agg((1 - F.avg(F.col("df") / F.lit(n))).alias("score"), lonely.alias("lonely"), F.min_by("term", "place").alias("first"), F.min("df").alias("least_df"))
    return sums.select(key, "score", F.when(F.size("lonely") > 0, F.col("lonely")).otherwise(F.array("first")).alias("rare_terms"), "least_df")


def tag_clusters(tags: DataFrame, least: float = 0.86, block: int = 1024) -> DataFrame:
    """tag, cluster, members, similarity of tags (id, vector) alike by cosine; a tag alone is in none.

    Every tag is a query against all others, in blocks that meet in tasks as
    matrices; only pairs that reach ``least`` become rows. similarity is the
    mean over all pairs of a cluster, from the sum of its unit vectors, so
    pairs within a cluster are never made. A vector of another width, or
    without length, is like none.
    """
    rows = tags.where(F.col("vector").isNotNull() & (norm(F.col("vector")) > 0)).select("id", unit("vector").alias("vector"))
    links = similar_pairs(rows, least, block=block)
    labels = connected_components(links.select("a", "b")).select(F.col("node").alias("tag"), F.col("label").alias("cluster"))
    parts = labels.join(rows, F.col("tag") == F.col("id")).select("cluster", F.posexplode("vector").alias("i", "x"))
    sums = parts.groupBy("cluster", "i").agg(F.sum("x").alias("s")).groupBy("cluster").agg(F.sum(F.col("s") * F.col("s")).alias("square"))
    sizes = labels.groupBy("cluster").agg(F.count("*").alias("members")).join(sums, "cluster")
    mean = (F.col("square") - F.col("members")) / (F.col("members") * (F.col("members") - 1))
    return labels.join(sizes.select("cluster", "members", mean.alias("similarity")), "cluster").select("tag", "cluster", "members", "similarity")
