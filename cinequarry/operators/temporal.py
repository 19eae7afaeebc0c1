"""Requests over timed channels: conditions and predicates of many queries as tables, evaluated together.

A request has conditions, each answered by the windows of one channel, and
predicates, each a relation between two conditions of one query. A recording
answers it if it has a window for every condition and, for every predicate, a
pair of windows in its relation. Conditions, predicates and their relations
are rows, so one interval join serves all queries.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinequarry.functions.intervals import RELATIONS, holds_by, near, support_by
from cinequarry.functions.vectors import dot, norm
from cinequarry.operators.modalities import active, distinct_matches, evidence_class, place_on_shots, sound_labels, within
from cinequarry.plans.broadcasts import checked
from cinequarry.plans.scratch import settle, shares

#: Channels that windows come from, and how much one query may ask.
CHANNELS = ("visual", "audio", "sound_event", "speaker")
MOST_CONDITIONS, MOST_PREDICATES = 8, 16
#: Frames, and conditions that ask for them, of a block in which they meet.
BLOCK = 1024
WINDOW = ("asset", "shot", "record", "start_ms", "end_ms", "score", "status")


@dataclass
class Recordings:
    """What timed channels search: rows of generations, of which the heads (asset, modality, generation) are active.

    vectors has, for visual and audio, (record, asset, generation, space,
    start_ms, end_ms, vector[, shot]); events are (record, asset, generation,
    label, start_ms, end_ms, raw_score[, shot]), turns (record, asset,
    generation, speaker, start_ms, end_ms[, shot]). A column status says how
    sure an observation is; without one it is possible.
    """

    heads: DataFrame
    vectors: Mapping[str, DataFrame] = field(default_factory=dict)
    events: DataFrame | None = None
    turns: DataFrame | None = None


@dataclass
class Requests:
    """What queries ask of timed channels, any part of it optional.

    modalities are (query_id, modality, text, space, vector): channels to
    retrieve by. conditions are the same with a name, condition; predicates
    (query_id, predicate, left, relation, right, max_gap_ms); speakers
    (query_id, asset, generation, speaker) the turns that a query's speaker
    conditions mean.
    """

    modalities: DataFrame | None = None
    conditions: DataFrame | None = None
    predicates: DataFrame | None = None
    speakers: DataFrame | None = None


def _refuse(found: list[tuple[DataFrame, str]]) -> None:
    """Raise ValueError for the first of the rules that any row breaks; all are tested in one job."""
    broken = None
    for at, (rows, what) in enumerate(found):
        own = rows.select(F.col("query_id").cast("string").alias("query_id"), F.lit(at).alias("at"), F.lit(what).alias("what"))
        broken = own if broken is None else broken.unionByName(own)
    if broken is not None and (bad := broken.orderBy("at").limit(1).collect()):
        raise ValueError(f"{bad[0]['what']} (query {bad[0]['query_id']})")


def check_requests(requests: Requests) -> None:
    """Raise ValueError for what no request may ask; the rules of search.check_request(), for a table of them."""
    rules: list[tuple[DataFrame, str]] = []
    refuse = lambda rows, what: rules.append((rows, what))
    asked = [r for r in (requests.modalities, requests.conditions) if r is not None]
    speakers = None if requests.speakers is None else requests.speakers.select("query_id").distinct()
    for rows in asked:
        refuse(rows.where(~F.coalesce(F.col("modality").isin(*CHANNELS), F.lit(False))), "unknown modality")
        refuse(rows.where(F.col("modality").isin("visual", "audio") & (F.col("space").isNull() | F.coalesce(F.size("vector") <= 0, F.lit(True)))), "a visual or audio condition needs a space and a vector")
        spoken = rows.where("modality = 'speaker'")
        refuse(spoken if speakers is None else spoken.join(speakers, "query_id", "left_anti"), "the speaker modality needs a speaker filter")
    if requests.predicates is not None and requests.conditions is None:
        refuse(requests.predicates, "a predicate has an unknown condition")
    for rows, name, most in ((requests.conditions, "condition", MOST_CONDITIONS), (requests.predicates, "predicate", MOST_PREDICATES)):
        if rows is not None:
            sizes = rows.groupBy("query_id").agg(F.count("*").alias("n"), F.count_distinct(F.nullif(F.trim(name), F.lit(""))).alias("own"))
            refuse(sizes.where(F.col("n") > most), f"more than {most} {name}s")
            refuse(sizes.where("n <> own"), f"every {name} needs an id of its own")
    if requests.conditions is not None:
        refuse(requests.conditions.where("coalesce(trim(text), '') = ''"), "a condition needs a query")
    if requests.predicates is not None and requests.conditions is not None:
        known = requests.conditions.select("query_id", "condition")
        for side in ("left", "right"):
            refuse(requests.predicates.withColumn("condition", F.col(side)).join(known, ["query_id", "condition"], "left_anti"), "a predicate has an unknown condition")
        gap = F.coalesce("max_gap_ms", F.lit(0))
        refuse(requests.predicates.where(~F.coalesce(F.col("relation").isin(*RELATIONS), F.lit(False)) | (gap < 0) | (F.col("relation").isin("before", "after") & (gap <= 0))), "a predicate has an unknown relation or lacks a gap")
    _refuse(rules)


def _with_status(rows: DataFrame) -> DataFrame:
    return rows if "status" in rows.columns else rows.withColumn("status", F.lit("possible"))


def _on_shots(rows: DataFrame, shots: DataFrame, modality: str, keys: tuple[str, ...]) -> DataFrame:
    """keys, modality, WINDOW of rows that have a shot, or of each shot that they overlap."""
    if "shot" not in rows.columns:
        rows = place_on_shots(settle(rows), shots)  # written, as it is read three times
    return rows.withColumn("modality", F.lit(modality)).where("shot IS NOT NULL").select(*keys, "modality", *WINDOW)


def windows_of(asked: DataFrame, recordings: Recordings, shots: DataFrame, speakers: DataFrame | None = None, allowed: DataFrame | None = None, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """keys, modality, WINDOW of all that answers the rows ``asked`` (keys, modality, text, space, vector).

    Vectors answer with every record of their space and width whose cosine is
    positive, sounds with the events of the classes that the text names,
    speakers with their turns. Rows without a shot stand on every shot (shot,
    asset, start_ms, end_ms) that they overlap. The answer is complete, as
    predicates must see all of it; what a result shows is cut later.
    """
    spark = asked.sparkSession
    out = None

    def add(found: DataFrame, modality: str) -> None:
        nonlocal out
        rows = _on_shots(_with_status(found), shots, modality, keys)
        out = rows if out is None else out.unionByName(rows)

    for modality in ("visual", "audio"):
        if modality in recordings.vectors:
            rows = within(active(recordings.vectors[modality], recordings.heads, modality), allowed)
            own = asked.where(F.col("modality") == modality).select(*keys, "space", F.col("vector").alias("__q"), norm(F.col("vector")).alias("__a"))
            lengths = F.col("__a") * F.col("__b")  # each vector's once, not once a pair
            met = rows.withColumn("__b", norm(F.col("vector"))).join(checked(own, 20_000), "space").where((F.size("__q") == F.size("vector")) & (lengths > 0))
            found = met.withColumn("score", F.round(dot(F.col("__q"), F.col("vector")) / lengths, 6)).where("score > 0")
            add(found.drop("vector", "__q", "space", "__a", "__b"), modality)
    if recordings.events is not None:
        rows = within(active(recordings.events, recordings.heads, "sound_event"), allowed)
        named = sound_labels(spark, asked.where("modality = 'sound_event'").select(F.struct(*keys).alias("query_id"), "text")).select("query_id.*", "label")
        add(rows.join(checked(named), "label").withColumn("score", F.col("raw_score")).drop("raw_score", "label"), "sound_event")
    if recordings.turns is not None and speakers is not None:
        rows = within(active(recordings.turns, recordings.heads, "speaker"), allowed)
        own = asked.where("modality = 'speaker'").select(*keys).join(speakers, "query_id")
        add(rows.join(checked(own), ["asset", "generation", "speaker"]).withColumn("score", F.lit(1.0)), "speaker")
    if out is None:
        raise ValueError("no recordings answer timed channels")
    return out


def supports(windows: DataFrame, predicates: DataFrame) -> DataFrame:
    """query_id, predicate, asset, relation, left_record, right_record, supports, evidence: every pair that a predicate accepts.

    ``windows`` are (query_id, condition, WINDOW). supports are the intervals
    that show the relation; the evidence is confirmed where both observations
    are.
    """
    one = settle(windows.select("query_id", "condition", "asset", "record", "start_ms", "end_ms", "status").distinct())  # on several shots, but one observation
    gap = F.coalesce("max_gap_ms", F.lit(0)).cast("long")
    pad = F.when(F.col("relation").isin("before", "after"), F.col("max_gap_ms")).otherwise(0)
    asked = predicates.select("query_id", "predicate", "left", "relation", F.col("right").alias("condition"), gap.alias("max_gap_ms")).withColumn("reach", F.length(F.bin(pad)))
    sides = ["query_id", "left", "condition", "reach"]
    # Conditions meet once for all predicates between them whose gaps are of one power of two, not once a predicate.
    reaches = asked.groupBy(*sides).agg(F.max(pad).alias("pad_ms"))
    keys = ["query_id", "condition", "asset"]  # the right side's: its windows serve all predicates that mean them
    told = one.select("query_id", F.col("condition").alias("left"), "asset", F.col("record").alias("left_record"), F.col("status").alias("left_status"), "start_ms", "end_ms")
    left = settle(told.join(checked(reaches), ["query_id", "left"]))
    right = settle(one.join(checked(asked.select("query_id", "condition").distinct()), ["query_id", "condition"], "left_semi").select(*keys, F.col("record").alias("right_record"), F.col("status").alias("right_status"), "start_ms", "end_ms"))
    l, r = (F.col("left_start_ms"), F.col("left_end_ms")), (F.col("right_start_ms"), F.col("right_end_ms"))
    met = near(left, right, keys).join(checked(asked), sides).where(holds_by(F.col("relation"), l, r, F.col("max_gap_ms")))
    sure = lambda c: (F.lit(True), F.col(c))
    return met.select("query_id", "predicate", "asset", "relation", "left_record", "right_record", support_by(F.col("relation"), l, r).alias("supports"), evidence_class(sure("left_status"), sure("right_status")).alias("evidence"))


def all_of(wanted: DataFrame, facts: DataFrame) -> DataFrame:
    """request, asset of the recordings that have every one of the items that ``wanted`` (request, item) lists.

    ``facts`` are (item, asset, n). A request's rarest item gives its
    candidates, so that no recording is met for what most of them have.
    """
    each = wanted.select("request", "item").distinct()
    met = each.join(facts.groupBy("item").agg(F.count("*").alias("assets")), "item", "left")
    rarest = met.groupBy("request").agg(F.min_by("item", F.coalesce("assets", F.lit(0))).alias("item"), F.count("*").alias("items"))
    likely = facts.select("item", "asset").join(rarest, "item").select("request", "asset", "items")
    shown = likely.join(each, "request").join(facts.select("item", "asset"), ["item", "asset"])
    return shown.groupBy("request", "asset", "items").agg(F.count("*").alias("n")).where("n = items").select("request", "asset")


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows``, written, with a number of their own in the column ``name``."""
    return settle(rows.withColumn(name, F.monotonically_increasing_id()))


def _listed(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


class Evaluation:
    """What all requests that have conditions find: assets(), matches() and supports(), of which only what is called for is worked out.

    What many queries ask, a condition, a predicate between two or a whole
    request, is answered once; only results are written out a query. Vectors
    come last: where frames stand in time is the same for all queries, so
    likenesses are only computed for frames that a predicate can use, of
    recordings that have all else, and for what is shown of answers.
    """

    def __init__(self, requests: Requests, recordings: Recordings, shots: DataFrame, *, allowed: DataFrame | None = None) -> None:
        requests = Requests(**{k: None if v is None else settle(v) for k, v in vars(requests).items()})  # small tables that are read many times
        check_requests(requests)
        self._ask(requests)
        self._look(requests, recordings, shots, allowed)
        self._answer()

    def _ask(self, requests: Requests) -> None:
        """Numbers for what is asked: c of a condition, kind of its windows (of all frames of a space alike), p and way of a predicate, of conditions and of kinds, request and outline of a query."""
        spoken = F.when(F.col("modality") == "speaker", F.col("query_id"))
        seen = F.col("modality").isin("visual", "audio")
        rows = requests.conditions.withColumn("__c", _meaning("modality", "text", "space", "vector", spoken.alias("own")))
        each = _numbered(rows.dropDuplicates(["__c"]).withColumns({"query_id": spoken, "seen": seen}), "c")
        spaces = each.where("seen").groupBy("modality", "space").agg(F.min("c").alias("kind"))
        self.conditions = settle(each.join(spaces, ["modality", "space"], "left").withColumn("kind", F.coalesce("kind", "c")))
        known = self.conditions.select("__c", "c", "kind", "seen")
        named = settle(rows.select("query_id", "condition", "__c").join(known, "__c").drop("__c"))
        items = named.select("query_id", F.col("condition").alias("name"), F.lit(0).alias("part"), F.col("c").alias("item"), F.col("kind").alias("plain"), "seen")
        self.predicates = None
        if requests.predicates is not None:
            side = lambda name: named.select("query_id", F.col("condition").alias(name), F.col("c").alias(f"{name}_c"), F.col("kind").alias(f"{name}_kind"), F.col("seen").alias(f"{name}_seen"))
            gap = F.coalesce("max_gap_ms", F.lit(0)).cast("long").alias("max_gap_ms")
            told = settle(requests.predicates.select("query_id", "predicate", "left", "relation", "right", gap).join(side("left"), ["query_id", "left"]).join(side("right"), ["query_id", "right"]))
            shape, whole = ["left_kind", "relation", "right_kind", "max_gap_ms"], ["left_c", "relation", "right_c", "max_gap_ms"]
            ways = _numbered(told.select(*shape).distinct(), "way")
            self.predicates = _numbered(told.drop("query_id", "predicate", "left", "right").dropDuplicates(whole).join(ways, shape), "p")
            self.ways = ways
            asked = told.select("query_id", "predicate", *whole).join(self.predicates.select(*whole, "p", "way", (F.col("left_seen") | F.col("right_seen")).alias("seen")), whole)
            items = items.unionByName(asked.select("query_id", F.col("predicate").alias("name"), F.lit(1).alias("part"), F.col("p").alias("item"), F.col("way").alias("plain"), "seen"))
        # Queries that ask the same by the same names are one request; requests that differ in vectors alone have one outline.
        sets = items.groupBy("query_id").agg(F.sort_array(F.collect_set(F.struct("part", "name", "item", "plain", "seen"))).alias("items")).withColumn("__r", _meaning("items"))
        plain = F.array_sort(F.array_distinct(F.transform("items", lambda x: F.struct(x["part"].alias("part"), x["plain"].alias("plain")))))
        sets = settle(sets.withColumn("__o", _meaning(plain.alias("o"))))
        requested = _numbered(sets.groupBy("__r").agg(F.first("items").alias("items"), F.first("__o").alias("__o"), F.count("*").alias("queries")), "request")
        outlines = requested.groupBy("__o").agg(F.min("request").alias("outline"))
        listed = requested.join(outlines, "__o")
        self.requests = settle(listed.select("request", "outline", "queries", F.exists("items", lambda x: x["seen"]).alias("seen")))
        self.items = settle(listed.select("request", "outline", F.inline("items")))
        self.queries = settle(sets.select("query_id", "__r").join(requested.select("__r", "request"), "__r").drop("__r"))

    def _look(self, requests: Requests, recordings: Recordings, shots: DataFrame, allowed: DataFrame | None) -> None:
        """Windows (kind, modality, WINDOW) of sounds and speakers, those of all frames without a score, and the pairs of each way of a predicate."""
        parts = []
        self.frames = None
        if recordings.events is not None or (recordings.turns is not None and requests.speakers is not None):
            asked = self.conditions.where("NOT seen").select("query_id", "kind", "modality", "text", "space", "vector")
            parts.append(windows_of(asked, replace(recordings, vectors={}), shots, requests.speakers, allowed, keys=("query_id", "kind")).drop("query_id"))
        spaces = self.conditions.where("seen").select("kind", "modality", "space").distinct()
        own = {r["modality"] for r in spaces.select("modality").distinct().collect()} & set(recordings.vectors)
        for modality in sorted(own):
            rows = _with_status(within(active(recordings.vectors[modality], recordings.heads, modality), allowed))
            rows = rows.where("size(vector) > 0 AND NOT exists(vector, x -> x IS NULL)").join(spaces.where(F.col("modality") == modality).drop("modality"), "space")
            told = settle(rows.withColumn("vector", F.col("vector").cast("array<double>")).drop("space", "generation"))
            looked = told.select("kind", "asset", "record", "vector").dropDuplicates(["kind", "asset", "record", "vector"])
            self.frames = looked if self.frames is None else self.frames.unionByName(looked)
            parts.append(_on_shots(told.drop("vector").withColumn("score", F.lit(None).cast("double")), shots, modality, ("kind",)))
        if not parts and not recordings.vectors:
            raise ValueError("no recordings answer timed channels")
        spark = shots.sparkSession
        self.windows = settle(_listed(parts)) if parts else None
        self.frames = None if self.frames is None else settle(self.frames)
        self.pairs = None
        if self.windows is None:
            kind = dict(shots.dtypes)["asset"]
            self.facts = spark.createDataFrame([], f"item string, asset {kind}, n long")
            return
        facts = self.windows.groupBy(F.concat(F.lit("c"), F.col("kind")).alias("item"), "asset").agg(F.count("*").alias("n"))
        if self.predicates is not None:
            ways = self.ways.select(F.lit(0).alias("query_id"), F.col("way").alias("predicate"), F.col("left_kind").alias("left"), "relation", F.col("right_kind").alias("right"), "max_gap_ms")
            self.pairs = settle(supports(self.windows.withColumnRenamed("kind", "condition").withColumn("query_id", F.lit(0)), ways).drop("query_id").withColumnRenamed("predicate", "way"))
            facts = facts.unionByName(self.pairs.groupBy(F.concat(F.lit("p"), F.col("way")).alias("item"), "asset").agg(F.count("*").alias("n")))
        self.facts = settle(facts)

    def _answer(self) -> None:
        """request, asset of all answers, and the pairs (p, asset, ...) of predicates about vectors."""
        listed = self.items.select(F.col("outline").alias("request"), F.concat(F.when(F.col("part") == 0, "c").otherwise("p"), F.col("plain")).alias("item"))
        plain = settle(all_of(listed, self.facts).withColumnRenamed("request", "outline"))
        met = self.requests.select("request", "outline", "seen").join(plain, "outline").drop("outline")
        self.alike = None
        if self.frames is None:
            self.answers = settle(met.where("NOT seen").drop("seen"))
            return
        likely = settle(met.where("seen").drop("seen"))
        own = self.items.where("seen")
        lone, facts, needed = own.where("part = 0").select("request", F.col("item").alias("c"), F.col("plain").alias("kind")), [], []
        if self.pairs is not None:
            told = own.where("part = 1").select("request", F.col("item").alias("p"))
            needed.append(told.select("request", F.concat(F.lit("p"), "p").alias("item")))
            rules = self.predicates.where("left_seen OR right_seen")
            sides = [(side, rules.where(f"{side}_seen")) for side in ("left", "right")]
            used = _listed([told.join(rows, "p").select("request", F.col(f"{side}_c").alias("c")) for side, rows in sides])
            lone = lone.join(used.distinct(), ["request", "c"], "left_anti")
            asked = settle(likely.join(told, "request").select("p", "asset").distinct().join(rules.select("p", "way", "left_c", "left_kind", "left_seen", "right_c", "right_kind", "right_seen"), "p"))
            near = self.pairs.join(rules.select("way").distinct(), "way", "left_semi")
            wanted = settle(_listed([asked.where(f"{side}_seen").select(F.col(f"{side}_c").alias("c"), F.col(f"{side}_kind").alias("kind"), "asset") for side, _ in sides]).distinct())
            usable = _listed([near.join(rows.select("way", F.col(f"{side}_kind").alias("kind")).distinct(), "way").select("kind", "asset", F.col(f"{side}_record").alias("record")) for side, rows in sides]).distinct()
            like = settle(self._likenesses(wanted, self.frames.join(usable, ["kind", "asset", "record"], "left_semi")).select("c", "asset", "record").distinct())
            pairs = asked.join(near, ["way", "asset"])
            for side, _ in sides:
                shown = like.select(F.col("c").alias(f"{side}_c"), "asset", F.col("record").alias(f"{side}_record"), F.lit(True).alias(f"{side}_like"))
                pairs = pairs.join(shown, [f"{side}_c", "asset", f"{side}_record"], "left").where(f"NOT {side}_seen OR {side}_like")
            self.alike = settle(pairs.select("p", "asset", "relation", "left_record", "right_record", "supports", "evidence"))
            facts.append(self.alike.select(F.concat(F.lit("p"), "p").alias("item"), "asset").distinct())
        lone = settle(lone)
        if lone.limit(1).count():
            needed.append(lone.select("request", F.concat(F.lit("c"), "c").alias("item")))
            wanted = settle(likely.join(lone, "request").select("c", "kind", "asset").distinct())
            facts.append(self._likenesses(wanted, self.frames).select(F.concat(F.lit("c"), "c").alias("item"), "asset").distinct())
        wants = settle(_listed(needed))
        full = wants.groupBy("request").agg(F.count("*").alias("items"))
        shown = likely.join(wants, "request").join(_listed(facts), ["item", "asset"], "left_semi").groupBy("request", "asset").agg(F.count("*").alias("n"))
        self.answers = settle(met.where("NOT seen").drop("seen").unionByName(shown.join(full, "request").where("n = items").select("request", "asset")))

    def _likenesses(self, wanted: DataFrame, frames: DataFrame) -> DataFrame:
        """c, kind, asset, record, score of every frame (kind, asset, record, vector) whose cosine to a condition's vector is positive, where ``wanted`` (c, kind, asset; written) asks for it.

        A recording's frames and the conditions that ask for them meet in blocks.
        """
        keys = ["kind", "asset", "part", "team"]
        parts = lambda rows, name: rows.groupBy("kind", "asset").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
        sizes = parts(frames, "parts").join(parts(wanted, "teams"), ["kind", "asset"])
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        vectors = self.conditions.where("seen").select("c", F.col("vector").cast("array<double>").alias("vector"))
        left = wanted.join(sizes, ["kind", "asset"]).join(vectors, "c").select("kind", "asset", every("parts").alias("part"), F.pmod(F.xxhash64("c"), "teams").cast("int").alias("team"), "c", "vector")
        right = frames.join(sizes, ["kind", "asset"]).select("kind", "asset", F.pmod(F.xxhash64("record"), "parts").cast("int").alias("part"), every("teams").alias("team"), "record", "vector")
        types = dict(frames.dtypes)
        met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_cosines, f"c long, kind long, asset {types['asset']}, record {types['record']}, score double")
        return met.withColumn("score", F.round("score", 6))

    def _spread(self, rows: DataFrame, total: DataFrame) -> DataFrame:
        """``rows`` (request, ...) written out a query, in partitions of bounded size; ``total`` (request, n) says how many there are at most."""
        most = total.join(self.requests.select("request", "queries"), "request").agg(F.coalesce(F.sum(F.col("n") * F.col("queries")), F.lit(0))).first()[0]
        return rows.repartition(shares(rows.sparkSession, int(most))).join(checked(self.queries), "request").drop("request")

    def _sizes(self, part: int) -> DataFrame:
        """request, n: rows of its answers' windows (part 0) or pairs (1), at most."""
        listed = self.items.where(F.col("part") == part).select("request", F.concat(F.lit("cp"[part]), "plain").alias("item"))
        return self.answers.join(listed, "request").join(self.facts, ["item", "asset"]).select("request", "n")

    def assets(self) -> DataFrame:
        """query_id, asset that answers."""
        return self._spread(self.answers, self.answers.select("request", F.lit(1).alias("n"))).select("query_id", "asset")

    def matches(self, limit: int | None = None) -> DataFrame:
        """Windows (query_id, condition, modality, WINDOW) of answers, one a condition, asset and interval; ``limit`` keeps so many a condition, in order of shot, time and record."""
        told = self.items.where("part = 0").select("request", F.col("name").alias("condition"), F.col("item").alias("c"), F.col("plain").alias("kind"), "seen")
        meant = settle(self.answers.join(told, "request"))
        wanted = settle(meant.select("c", "kind", "asset", "seen").distinct())
        if self.windows is None:
            return self._spread(meant.select("request", "condition"), meant.select("request", F.lit(0).alias("n")))
        shown = self.windows.withColumnRenamed("kind", "c").join(wanted.where("NOT seen"), ["c", "asset"], "left_semi")
        if self.frames is not None:
            like = self._likenesses(wanted.where("seen").drop("seen"), self.frames)
            frames = self.windows.drop("score").join(like, ["kind", "asset", "record"])
            shown = shown.unionByName(frames.select(*shown.columns))
        if limit is None:
            shown = distinct_matches(shown.withColumnRenamed("c", "condition")).withColumnRenamed("condition", "c")
        rows = meant.select("request", "condition", "c", "asset").join(shown, ["c", "asset"]).select("request", "condition", "modality", *WINDOW)
        rows = self._spread(rows, self._sizes(0)).select("query_id", "condition", "modality", *WINDOW)
        if limit is None:
            return rows
        order = Window.partitionBy("query_id", "condition").orderBy("shot", "start_ms", "end_ms", "record")
        return distinct_matches(rows.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= limit).drop("__n"))

    def supports(self) -> DataFrame | None:
        """Every pair (supports()) that shows a predicate of an answer; None without predicates."""
        if self.pairs is None:
            return None
        told = self.items.where("part = 1").select("request", F.col("name").alias("predicate"), F.col("item").alias("p"), F.col("plain").alias("way"), "seen")
        meant = self.answers.join(told, "request")
        told = ["request", "predicate", "asset", "relation", "left_record", "right_record", "supports", "evidence"]
        rows = meant.where("NOT seen").join(self.pairs, ["way", "asset"]).select(*told)
        if self.alike is not None:
            rows = rows.unionByName(meant.where("seen").join(self.alike, ["p", "asset"]).select(*told))
        return self._spread(rows, self._sizes(1)).select("query_id", *told[1:])


def _cosines(asked: pd.DataFrame, frames: pd.DataFrame) -> pd.DataFrame:
    """The pairs of a condition and a frame of one width whose cosine is positive."""
    sides, out = [], []
    for own, name in ((asked, "c"), (frames, "record")):
        widths = own["vector"].map(len).to_numpy() if len(own) else np.empty(0, int)
        found = {}
        for width in set(widths.tolist()):
            some = own[widths == width]
            matrix = np.stack(some["vector"].to_numpy())
            lengths = np.sqrt((matrix * matrix).sum(axis=1))
            good = ~(lengths <= 0)
            found[width] = some[name].to_numpy()[good], matrix[good], lengths[good]
        sides.append(found)
    for width in sides[0].keys() & sides[1].keys():
        (c, a, a_length), (record, b, b_length) = sides[0][width], sides[1][width]
        score = (a @ b.T) / (a_length[:, None] * b_length[None, :])
        q, f = np.nonzero(~(score <= 0))
        out.append(pd.DataFrame({"c": c[q], "kind": frames["kind"].iloc[0], "asset": frames["asset"].iloc[0], "record": record[f], "score": score[q, f]}))
    return pd.concat(out) if out else pd.DataFrame({x: [] for x in ("c", "kind", "asset", "record", "score")})


def evaluate(requests: Requests, recordings: Recordings, shots: DataFrame, *, allowed: DataFrame | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(query_id, asset that answers; its matches; its supports) of all requests that have conditions: see Evaluation, which gives each alone."""
    found = Evaluation(requests, recordings, shots, allowed=allowed)
    return found.assets(), found.matches(limit), found.supports()


def _meaning(*parts: Column | str) -> Column:
    """The same for all rows that ask the same."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def channel_rows(requests: Requests, recordings: Recordings, shots: DataFrame, size: int, *, allowed: DataFrame | None = None) -> DataFrame:
    """query_id, id, signal, score: the best ``size`` shots of every timed channel that a query retrieves by."""
    windows = windows_of(requests.modalities, recordings, shots, requests.speakers, allowed)
    best = windows.groupBy("query_id", "modality", "shot").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id", "modality").orderBy(F.desc("score"), "shot")
    ranked = best.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= size)
    return ranked.select("query_id", F.col("shot").alias("id"), F.col("modality").alias("signal"), "score")
