"""Search over a table of queries: compile, retrieve by channels, fuse, gate, select, page and put in context."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinequarry.functions.intervals import RELATIONS, related
from cinequarry.functions.text import CJK, chunks, concepts, with_features
from cinequarry.functions.vectors import cosine, nearest, norm
from cinequarry.functions.vocabulary import compile_queries
from cinequarry.operators import lexical, temporal
from cinequarry.operators.evidence import evidence, gate, observations
from cinequarry.operators.fusion import FIELD_WEIGHTS, PROFILES, RANK_SHIFT
from cinequarry.operators.fusion import pool as fusion_pool
from cinequarry.operators.selection import DIVERSITY, WINDOW, check_page, diversify, neighbours, pool_size
from cinequarry.operators.speech import transcript_channel, words_on_shots
from cinequarry.plans.broadcasts import checked, shuffled
from cinequarry.plans.scratch import scratch_path, settle

FIELDS = ("description", "tags", "objects", "actions", "mood")
MODALITIES = ("lexical", "transcript", "visual", "audio", "sound_event", "speaker")
GAP_MS = 5_000
#: Share of a query's best text-vector score that others must reach.
CUTOFF = 0.8

# Whole queries that put two things in time, and what they say.
TEMPLATES = (
    (r"(?i)^(.+?)\s+and\s+(.+?)\s+(?:happen\s+)?at\s+the\s+same\s+time$", "simultaneous"),
    (r"(?i)^(.+?)\s+while\s+(.+?)$", "simultaneous"),
    (r"^(.+?)\s*和\s*(.+?)\s*同时出现$", "simultaneous"),
    (r"(?i)^(.+?)\s+before\s+(.+?)$", "before"),
    (r"^(.+?)\s*在\s*(.+?)\s*之前出现$", "before"),
    (r"(?i)^(.+?)\s+after\s+(.+?)$", "after"),
    (r"^(.+?)\s*之后出现\s*(.+?)$", "after"),
)


def temporal_queries(queries: DataFrame) -> DataFrame:
    """query_id, left, relation, right, max_gap_ms of queries (query_id, text) of a known form; others have no row."""
    text = F.trim("text")
    found = [F.when(text.rlike(p), F.struct(F.trim(F.regexp_extract(text, p, 1)).alias("left"), F.lit(r).alias("relation"), F.trim(F.regexp_extract(text, p, 2)).alias("right"))) for p, r in TEMPLATES]
    rows = queries.select("query_id", F.coalesce(*found).alias("t")).where("t IS NOT NULL AND t.left <> '' AND t.right <> ''")
    return rows.select("query_id", "t.*", F.when(F.col("t.relation").isin("before", "after"), GAP_MS).otherwise(0).cast("long").alias("max_gap_ms"))


def fingerprint(text: Column, mode: Column, version: str) -> Column:
    """16 hexadecimal digits of a query, its mode and the profiles' version."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit(version), F.coalesce(mode, F.lit("")), F.coalesce(text, F.lit(""))), 256), 1, 16)


def request_fingerprint(plain: str, extra_json: str = "") -> str:
    """A fingerprint() with what a request asks beside its text, as JSON."""
    return hashlib.sha256(f"{plain}|{extra_json}".encode()).hexdigest()[:16] if extra_json else plain


def check_request(request: Mapping) -> None:
    """Raise ValueError for what a request may not ask.

    Keys: modalities, reference_id, visual_shot_id, speaker_filter (asset_id,
    generation and speaker, or profile_id) and temporal: conditions (id,
    modality, query) and predicates (id, left, relation, right, max_gap_ms).
    """
    if request.get("reference_id") and request.get("visual_shot_id"):
        raise ValueError("a reference and a shot can't both be given")
    modalities = list(request.get("modalities", ()))
    temporal = request.get("temporal") or {}
    conditions, predicates = list(temporal.get("conditions", ())), list(temporal.get("predicates", ()))
    if unknown := [m for m in [*modalities, *(c.get("modality") for c in conditions)] if m not in MODALITIES]:
        raise ValueError(f"unknown modality {unknown[0]!r}")
    if "speaker" in [*modalities, *(c["modality"] for c in conditions)] and not request.get("speaker_filter"):
        raise ValueError("the speaker modality needs a speaker filter")
    if len(conditions) > 8 or len(predicates) > 16:
        raise ValueError("at most 8 conditions and 16 predicates")
    for kind, rows in (("condition", conditions), ("predicate", predicates)):
        ids = [(r.get("id") or "").strip() for r in rows]
        if "" in ids or len(set(ids)) < len(ids):
            raise ValueError(f"every {kind} needs an id of its own")
    if any(not (c.get("query") or "").strip() for c in conditions):
        raise ValueError("a condition needs a query")
    known = {c["id"] for c in conditions}
    for p in predicates:
        gap = p.get("max_gap_ms", 0)
        if p["left"] not in known or p["right"] not in known:
            raise ValueError(f"predicate {p['id']!r} has an unknown condition")
        if p["relation"] not in RELATIONS or gap < 0 or (p["relation"] in ("before", "after") and gap <= 0):
            raise ValueError(f"predicate {p['id']!r} has an unknown relation or lacks a gap")
    speaker = request.get("speaker_filter")
    if speaker:
        own, profile = [(speaker.get(k) or "").strip() for k in ("asset_id", "generation", "speaker")], (speaker.get("profile_id") or "").strip()
        if not (all(own) and not profile or profile and not any(own)):
            raise ValueError("a speaker filter names one speaker of an asset or one profile")


@dataclass
class Library:
    """What a search reads, built once: shots, their index, features and observations, and spoken words on shots."""

    shots: DataFrame  # id, asset, session, ordinal, start_ms, end_ms, description, tags, objects, actions, mood
    index: lexical.Index
    features: DataFrame  # id, terms, vector
    observed: DataFrame
    placed: DataFrame
    paths: DataFrame  # asset, path
    #: Channels of the caller's own: name to a function of (queries, library) that gives query_id, id, score.
    retrievers: Mapping[str, Callable[[DataFrame, Library], DataFrame]] = field(default_factory=dict)
    #: Last step over the selected rows; the identity if none.
    rerank: Callable[[DataFrame], DataFrame] | None = None
    #: Text vectors of shots (id, vector), all of one model.
    text_vectors: DataFrame | None = None
    #: Rows of timed channels.
    recordings: temporal.Recordings | None = None


def _joined(name: str) -> Column:
    return F.col(name) if name == "description" else F.array_join(F.coalesce(F.col(name), F.array().cast("array<string>")), " ")


def build_library(shots: DataFrame, words: DataFrame, paths: DataFrame, **plugs) -> Library:
    """The library of shots, spoken words (asset, ordinal, start_ms, end_ms, text, confidence) and paths (asset, path)."""
    spark = shots.sparkSession
    index = lexical.write_index(shots, "id", {name: F.flatten(chunks(_joined(name))) for name in FIELDS}, scratch_path(spark))
    text = F.concat_ws(" ", *[_joined(name) for name in FIELDS])
    features = settle(with_features(shots.select("id", concepts(text).alias("terms")), "terms"))
    return Library(shots, index, features, settle(observations(shots)), settle(words_on_shots(words, shots)), paths, **plugs)


def lexical_channel(queries: DataFrame, library: Library) -> DataFrame:
    """query_id, id, score of shots with all of a query's words (query_id, text, intent), fields weighted by intent."""
    asked = settle(lexical.phrases(queries))
    weighted = [i for i in FIELD_WEIGHTS]
    parts = []
    for weights, where in [(None, ~F.col("intent").isin(*weighted)), *((FIELD_WEIGHTS[i], F.col("intent") == i) for i in weighted)]:
        own = asked.join(queries.where(where).select("query_id"), "query_id", "left_semi")
        parts.append(lexical.search_index(library.index, own, weights))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.select("query_id", "id", lexical.unit_score(F.col("score")).alias("score")).where("score > 0")


def semantic_channel(queries: DataFrame, library: Library) -> DataFrame:
    """query_id, id, score: cosine of hashed features, of shots that share a concept or word with the query."""
    asked = settle(with_features(queries.select("query_id", concepts("text").alias("terms")), "terms"))
    own = library.features.select("id", F.explode("terms").alias("term"))
    pairs = own.join(checked(asked.select("query_id", F.explode("terms").alias("term"))), "term").select("query_id", "id").distinct()
    scored = pairs.join(checked(asked.select("query_id", F.col("vector").alias("q")), 20_000), "query_id").join(shuffled(library.features.select("id", "vector")), "id")
    return scored.select("query_id", "id", F.round(cosine("q", "vector"), 9).alias("score")).where("score > 0")


def check_vectors(vectors: DataFrame) -> None:
    """Raise ValueError if a query vector (query_id, vector) is empty, has a component that isn't finite, or no length."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    length = norm(F.col("vector"))
    bad = vectors.where(~F.coalesce((F.size("vector") > 0) & finite & (length > 0) & (length < float("inf")), F.lit(False))).limit(1).collect()
    if bad:
        raise ValueError(f"invalid query vector (query {bad[0]['query_id']})")


def embedding_channel(vectors: DataFrame, stored: DataFrame, size: int, *, share: float = CUTOFF) -> DataFrame:
    """query_id, id, score of the stored text vectors (id, vector) nearest to each query's (query_id, vector), exactly.

    Every stored vector is somewhat like any query, so only scores of at least
    ``share`` of the query's best one count; those of another width never do.
    An invalid query vector is an error.
    """
    check_vectors(vectors)
    found = nearest(stored, vectors.select(F.col("query_id").alias("id"), "vector"), k=size, exclude_self=False)
    best = Window.partitionBy("query_id")
    return found.withColumn("__best", F.max("score").over(best)).where(F.col("score") >= share * F.col("__best")).select("query_id", "id", "score")


def similar_channel(queries: DataFrame, library: Library, vectors: DataFrame | None = None, size: int = WINDOW) -> DataFrame:
    """query_id, id, score: the shots most like a query, by text vectors, or by hashed features where these give nothing.

    Queries are (query_id, text); ``vectors`` (query_id, vector) those that an
    embedding model gave for them. A query without a vector, or whose model
    has none in the library, falls back.
    """
    if vectors is None or library.text_vectors is None:
        return semantic_channel(queries, library)
    check_vectors(vectors)
    own = vectors.join(queries.select("query_id"), "query_id", "left_semi")
    measured = settle(nearest(library.text_vectors, own.select(F.col("query_id").alias("id"), "vector"), k=size, exclude_self=False).select("query_id", "id", "score"))
    rest = queries.join(measured.select("query_id").distinct(), "query_id", "left_anti")
    return measured.unionByName(semantic_channel(rest, library))


def similar_to(ids: DataFrame, library: Library, size: int = WINDOW) -> DataFrame:
    """query_id (a shot's id), id, score: the shots most like given shots (id), themselves left out."""
    stored = library.features.select("id", "vector") if library.text_vectors is None else library.text_vectors
    return nearest(stored, stored.join(ids.select("id").distinct(), "id", "left_semi"), k=size).select("query_id", "id", "score")


def metadata_channel(queries: DataFrame, library: Library) -> DataFrame:
    """query_id, id, score 1 of shots whose file's name holds a word of the query; a hint, never evidence."""
    runs = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(rf"([a-z0-9_]+|[{CJK}]+)"), 1)
    terms = queries.select("query_id", F.explode(F.array_distinct(runs)).alias("term"))
    hinted = lexical.name_hints(library.paths, "asset", "path", terms)
    return shuffled(library.shots.select("id", "asset")).join(hinted, "asset").select("query_id", "id", "score")


def _weights(spark, extra: Mapping[str, float]) -> DataFrame:
    """intent, signal, weight: 1 for every channel of plain fusion, timed ones too, the profile's weights for the others."""
    plain = ("auto", "fact")
    rows = [(intent, s, 1.0 if intent in plain else w) for intent, own in PROFILES.items() for s, w in {**own, **(dict.fromkeys(temporal.CHANNELS, 1.0) if intent in plain else {}), **extra}.items()]
    return spark.createDataFrame(rows, "intent string, signal string, weight double")


def _universe_rows(semantic: DataFrame, queries: DataFrame, allowed: DataFrame, size: int) -> DataFrame:
    """``semantic`` with the first ``size`` allowed shots at score 0 where it has no other: under filters all of them may be found."""
    first = F.array(*[F.lit(r["id"]) for r in allowed.select("id").distinct().orderBy("id").limit(size).collect()]).cast(f"array<{dict(allowed.dtypes)['id']}>")
    every = queries.select("query_id", F.explode(first).alias("id"), F.lit(0.0).alias("score"))  # size rows a query, whatever the library
    return semantic.unionByName(every.join(semantic.select("query_id", "id"), ["query_id", "id"], "left_anti").select("query_id", "id", "score"))


def search(
    queries: DataFrame,
    library: Library,
    *,
    limit: int = 0,
    offset: int = 0,
    allowed: DataFrame | None = None,
    extra_weights: Mapping[str, float] | None = None,
    vectors: DataFrame | None = None,
    requests: temporal.Requests | None = None,
) -> DataFrame:
    """query_id, place, id, score, intent, previous, next, has_more of every query's page of shots.

    ``queries`` are (query_id, text[, mode]); ``allowed`` (id) is the universe
    of shots, filtered before anything is ranked: all of it is found, at 0 if
    by nothing else. ``vectors`` (query_id, vector) are the queries' text
    vectors. ``requests`` add timed channels, and conditions and predicates
    that a shot's recording must answer (see temporal.evaluate()). Facts are gated by
    evidence, creative queries are selected more diversely, similar ones are
    ranked by likeness alone. Queries that find nothing have no rows.
    """
    limit, offset = check_page(limit, offset)
    target = offset + limit + 1
    size = pool_size(target)
    plans, needs = compile_queries(queries)
    plans, needs = settle(plans), settle(needs)
    if vectors is not None:
        vectors = settle(vectors)
    timed = [r.select("query_id") for r in (requests.modalities, requests.conditions) if r is not None] if requests is not None else []
    asked = plans.select("query_id").limit(0)
    for r in timed:
        asked = asked.unionByName(r)
    asked = settle(asked.distinct())
    similar = plans.where("intent = 'similar'").join(asked, "query_id", "left_anti")  # a request for more is no plain search for likeness
    ranked = plans.join(similar.select("query_id"), "query_id", "left_anti")
    rest = ranked.withColumn("phrase", F.coalesce("phrase", "text"))
    semantic = semantic_channel(ranked, library)
    if allowed is not None:
        allowed = settle(allowed.select("id").distinct())
        semantic = _universe_rows(settle(semantic.join(allowed, "id", "left_semi")), ranked, allowed, size)
    channels = {"lexical": lexical_channel(ranked, library), "semantic": semantic, "metadata": metadata_channel(ranked, library), "transcript": transcript_channel(rest, library.placed)}
    if vectors is not None and library.text_vectors is not None:
        own = vectors.join(ranked.where(F.col("intent").isin(*[i for i, w in PROFILES.items() if "embedding" in w])), "query_id", "left_semi")
        channels["embedding"] = embedding_channel(own, library.text_vectors, size)
    channels |= {name: f(ranked, library) for name, f in library.retrievers.items()}
    rows = None
    for name, own in channels.items():
        one = own.select("query_id", "id", F.lit(name).alias("signal"), "score")
        one = one if allowed is None else one.join(allowed, "id", "left_semi")
        one = fusion_pool(one, size)
        rows = one if rows is None else rows.unionByName(one)
    extra = dict(extra_weights or {})
    spans = library.shots.select(F.col("id").alias("shot"), "asset", "start_ms", "end_ms")
    if requests is not None and requests.modalities is not None:
        temporal.check_requests(requests)
        shots = None if allowed is None else spans.select("shot", "asset").join(allowed.select(F.col("id").alias("shot")), "shot", "left_semi")
        rows = rows.unionByName(temporal.channel_rows(requests, _recordings(library), spans, size, allowed=shots))
    weights = F.broadcast(_weights(queries.sparkSession, extra))
    used = rows.join(checked(ranked.select("query_id", "intent")), "query_id").join(weights, ["intent", "signal"])
    order = Window.partitionBy("query_id", "signal").orderBy(F.desc("score"), "id")
    pooled = settle(used.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size))
    parts = pooled.groupBy("query_id", "id", "intent").agg(F.array_sort(F.collect_list(F.struct("signal", (F.col("weight") / (RANK_SHIFT + F.col("rank"))).alias("p")))).alias("parts"))
    fused = parts.select("query_id", "id", "intent", F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["p"]).alias("score"))
    if requests is not None and requests.conditions is not None:
        fused = _answering(fused, requests, library, spans, allowed)
    fused = settle(fused)
    facts = fused.where("intent = 'fact'")
    spoken = needs.where("kind = 'speech'").select("query_id", "value")
    said = transcript_channel(spoken.withColumnRenamed("value", "phrase"), library.placed).join(spoken, "query_id").select("id", "value") if spoken.limit(1).count() else None
    proof = evidence(facts.select("query_id", "id"), needs, library.observed, said)
    passed = gate(facts, proof).unionByName(fused.where("intent <> 'fact'"))
    pool = passed.join(shuffled(library.shots.select("id", "asset", "session", "start_ms")), "id")
    chosen = None
    for name, diversity in (("creative", DIVERSITY["creative"]), ("", 0.2)):
        own = diversify(pool.where(F.col("intent") == name if name else F.col("intent") != "creative"), target, diversity)
        chosen = own if chosen is None else chosen.unionByName(own)
    if similar.limit(1).count():
        alike = similar_channel(similar, library, vectors)
        alike = alike if allowed is None else alike.join(allowed, "id", "left_semi")
        chosen = chosen.unionByName(lexical.top(alike, "id", WINDOW).select("query_id", "id", "score", F.col("rank").alias("place")))
    chosen = settle(chosen)
    many = chosen.groupBy("query_id").agg(F.count("*").alias("n"))
    page = chosen.where((F.col("place") > offset) & (F.col("place") <= offset + limit)).join(many, "query_id").join(plans.select("query_id", "intent"), "query_id")
    if library.rerank is not None:
        page = library.rerank(page)
    context = shuffled(neighbours(library.shots, "id", "asset", "ordinal"))
    return page.join(context, "id").select("query_id", "place", "id", "score", "intent", "previous", "next", (F.col("n") > offset + limit).alias("has_more"))


def _recordings(library: Library) -> temporal.Recordings:
    if library.recordings is None:
        raise ValueError("the library has no recordings of timed channels")
    return library.recordings


def _answering(fused: DataFrame, requests: temporal.Requests, library: Library, spans: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """Without the shots of recordings that don't answer their query's conditions; queries without conditions keep all."""
    shots = None if allowed is None else spans.select("shot", "asset").join(allowed.select(F.col("id").alias("shot")), "shot", "left_semi")
    assets = temporal.Evaluation(requests, _recordings(library), spans, allowed=shots).assets()
    bound = requests.conditions.select("query_id").distinct()
    free = fused.join(bound, "query_id", "left_anti")
    tested = fused.join(bound, "query_id", "left_semi").join(library.shots.select("id", "asset"), "id").join(assets, ["query_id", "asset"], "left_semi")
    return free.unionByName(tested.select(*free.columns))


def related_pairs(hits: DataFrame, shots: DataFrame, asked: DataFrame) -> DataFrame:
    """query_id, left, right of shots in which a temporal query's (temporal_queries()) two sides stand in its relation.

    ``hits`` are (query_id, side, id) of each side's own search; a side's time
    is that of its shots, which must be of one asset.
    """
    own = lambda side: hits.where(F.col("side") == side).join(shots.select("id", "asset", "start_ms", "end_ms"), "id").select("query_id", "asset", F.col("id").alias(side), "start_ms", "end_ms")
    left = own("left").join(checked(asked.select("query_id", "relation", "max_gap_ms")), "query_id")
    return related(left, own("right"), ["query_id", "asset"]).select("query_id", "left", "right")
