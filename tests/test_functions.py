"""Functions and operators against plain restatements on small inline tables."""

from __future__ import annotations

import hashlib
import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cinequarry.functions import intervals, text, timecode, vectors
from cinequarry.functions.pruning import pruned_nearest
from cinequarry.functions.vocabulary import compile_queries, named, speech_phrase
from cinequarry.operators import fusion, lexical, library, quality, selection, timeline
from cinequarry.operators.evidence import evidence, gate, observations
from cinequarry.operators.graph import connected_components
from cinequarry.sources import edl, ingest
from cinequarry.streaming import refresh


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'array<string>' if isinstance(v, list) else 'long'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def test_tokens(spark):
    assert one(spark, text.chunks("t"), t="Clip_雨夜街道_final No9 é") == [["clip_"], ["雨夜", "夜街", "街道"], ["_final"], ["no9"], ["é"]]
    assert one(spark, text.tokens("t"), t="雨") == ["雨"]
    assert one(spark, text.tokens("t"), t=None) == []
    assert one(spark, text.ascii_tokens("t"), t="A-b2 ü") == ["a", "b2"]
    assert one(spark, text.tag_key("t"), t="  Night -- City! ") == "night_city"
    assert one(spark, text.closed_value("t", ["close_up"], "other"), t="Close-Up") == "close_up"
    assert one(spark, text.closed_value("t", ["close_up"], "other"), t=None) == "other"
    assert one(spark, text.clean_list("t"), t=[" A", "a", "", "b"]) == ["a", "b"]
    assert one(spark, text.concepts("t"), t="A carefree car on the 街 at evening") == ["night", "street", "traffic", "carefree", "the"]
    assert text.fnv1a(b"") == 0x811C9DC5 and text.fnv1a(b"a") == 0xE40C292C


def test_features(spark):
    rows = text.with_features(spark.createDataFrame([(1, ["a", "b"]), (2, [])], "id long, terms array<string>"), "terms").orderBy("id").collect()
    want = np.zeros(64)
    for t in (b"a", b"b"):
        h = text.fnv1a(t)
        want[h % 64] += 1 if h % 2 == 0 else -1
    assert np.allclose(rows[0]["vector"], want / np.linalg.norm(want)) and not any(rows[1]["vector"])


@pytest.mark.parametrize("sent", [0, 1 << 20])
def test_nearest_is_exact(spark, sent):
    r = np.random.default_rng(1)
    data = r.normal(size=(80, 5))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)] + [(900, [0.0] * 5), (901, [1.0]), (902, None)], "id long, vector array<double>").repartition(3)
    got = {(x["query_id"], x["rank"]): (x["id"], x["score"]) for x in vectors.nearest(rows, rows.where("id % 20 = 0"), k=3, sent_bytes=sent, block=2).collect()}
    unit = data / np.linalg.norm(data, axis=1)[:, None]
    for q in (0, 20, 40, 60):
        best = sorted(((-round(float(unit[q] @ unit[i]), 6), i) for i in range(80) if i != q and unit[q] @ unit[i] > 0))[:3]
        for k, (s, i) in enumerate(best, 1):
            assert got[q, k] == (i, pytest.approx(-s, abs=2e-6))


@pytest.mark.parametrize("sent", [0, 1 << 20])
def test_nearest_of_copies(spark, sent):
    r = np.random.default_rng(5)
    data = r.normal(size=(700, 4))
    data[50:650] = data[50]  # the k-th neighbour ties with hundreds, the least ids count
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id long, vector array<double>").repartition(5)
    found = vectors.nearest(rows, rows.where("id % 7 = 0"), k=5, sent_bytes=sent, block=30).collect()
    unit = data / np.linalg.norm(data, axis=1)[:, None]
    scores = np.round(unit @ unit.T, 6)
    want = {(q, k): i for q in range(0, 700, 7) for k, (s, i) in enumerate(sorted((-s, i) for i, s in enumerate(scores[q].tolist()) if i != q and s > 0)[:5], 1)}
    assert {(x["query_id"], x["rank"]): x["id"] for x in found} == want


def test_best_pairs_need_little_memory():
    r = np.random.default_rng(6)
    data = r.normal(size=(12_000, 8))
    data[::2] = data[0]
    frame = pd.DataFrame({"id": np.arange(len(data)), "vector": list(data)})
    tracemalloc.start()
    found = vectors.best_pairs(frame.iloc[:3000], frame, 20, 6, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 60_000 and peak < 60 << 20  # all scores at once are 288 MB


def test_ranks_in_ranges(spark):
    rows = spark.range(3000).select((F.col("id") % 2).alias("query_id"), "id", F.lit("lexical").alias("signal"), F.when(F.col("id") < 2500, 0.5).otherwise(F.col("id") / 3000).alias("score"))
    got = sorted(tuple(r) for r in fusion.fuse(rows, "auto", None).collect())
    assert len(got) == 3000 and got == sorted(tuple(r) for r in fusion.rrf(rows).collect())


def test_pruned_neighbours(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(12, 16))
    points = centres[r.integers(0, 12, 900)] + r.normal(scale=0.15, size=(900, 16))
    points[100:400] = points[100]  # a third are copies
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)] + [(1000, [0.0] * 16), (1001, None), (1002, [1.0] * 3), (1003, [])]
    vecs = spark.createDataFrame(rows, "id long, vector array<double>").repartition(4)
    asked = vecs.where("id % 37 = 0 OR id > 999").where("vector IS NULL OR size(vector) IN (0, 16)")
    for options in ({}, {"exclude_self": False}, {"rows": 50, "pivots": 5, "rings": 3}):
        found, compared = pruned_nearest(vecs, asked, k=7, **options)
        want = vectors.nearest(vecs, asked, k=7, exclude_self=options.get("exclude_self", True))
        assert sorted(tuple(x) for x in found.collect()) == sorted(tuple(x) for x in want.collect())
        assert 0 < compared.compared < (0.5 if not options else 1.0) * compared.there
    assert pruned_nearest(vecs.limit(0), asked, k=3)[0].count() == 0 == pruned_nearest(vecs, asked.limit(0), k=3)[0].count()
    with pytest.raises(ValueError, match="widths"):
        pruned_nearest(vecs, vecs, k=3)


@pytest.mark.parametrize("relation", intervals.RELATIONS)
def test_relations(spark, relation):
    r = random.Random(4)
    rows = [(k, i, s, s + r.choice([0, 5, 40, 300])) for i in range(60) for k in (0, 1) for s in [r.randrange(1000)]]
    left = spark.createDataFrame(rows, "k long, a long, start_ms long, end_ms long")
    right = left.withColumnRenamed("a", "b")
    got = sorted((x["k"], x["a"], x["b"]) for x in intervals.related(left, right, "k", relation, max_gap_ms=25).collect())
    rule = {
        "simultaneous": lambda ls, le, rs, re: ls < re and le > rs,
        "before": lambda ls, le, rs, re: le <= rs and rs - le <= 25,
        "after": lambda ls, le, rs, re: re <= ls and ls - re <= 25,
        "during": lambda ls, le, rs, re: rs <= ls and le <= re,
        "starts_within": lambda ls, le, rs, re: rs <= ls < re,
        "ends_within": lambda ls, le, rs, re: rs < le <= re,
    }[relation]
    assert got == sorted((k, a, b) for k, a, ls, le in rows for k2, b, rs, re in rows if k == k2 and rule(ls, le, rs, re))


@pytest.mark.parametrize("relation", intervals.RELATIONS)
def test_relations_of_mixed_lengths(spark, relation):
    """From a millisecond to a day, before and after zero; the relation said once, or by each row."""
    r = random.Random(9)
    rows = [("k", i, s, s + r.choice([0, 1, 2, 3, 1000, 3_600_000, 86_400_000, r.randrange(1, 10**7)])) for i in range(120) for s in [r.randrange(-(10**7), 10**8)]]
    rows += [("k", 200 + i, s, e) for i, (_, _, s, e) in enumerate(rows[:30])] + [("k", 300 + i, e, e + 7) for i, (_, _, s, e) in enumerate(rows[:30])]
    left = spark.createDataFrame(rows, "k string, a long, start_ms long, end_ms long")
    right = left.withColumnRenamed("a", "b")
    want = sorted((a, b) for _, a, ls, le in rows for _, b, rs, re in rows if {
        "simultaneous": ls < re and le > rs, "before": le <= rs <= le + 5000, "after": re <= ls <= re + 5000, "during": rs <= ls and le <= re, "starts_within": rs <= ls < re, "ends_within": rs < le <= re,
    }[relation])
    assert sorted((x["a"], x["b"]) for x in intervals.related(left, right, "k", relation, max_gap_ms=5000).collect()) == want
    said = left.withColumns({"relation": F.lit(relation), "max_gap_ms": F.lit(5000)})
    met = intervals.related(said, right, ["k"])
    assert sorted((x["a"], x["b"]) for x in met.collect()) == want
    with pytest.raises(Exception, match="unknown relation"):
        intervals.related(said.withColumn("relation", F.lit("near")), right, "k").collect()


def test_long_intervals_are_written_a_few_times(spark):
    hours = spark.createDataFrame([("k", 0, 36_000_000)], "k string, start_ms long, end_ms long").withColumn("a", F.lit(1))
    short = spark.createDataFrame([("k", s, s + 10) for s in range(0, 36_000_000, 3_600_000)], "k string, start_ms long, end_ms long").withColumn("b", F.col("start_ms"))
    assert intervals.related(hours, short, "k", "simultaneous").count() == 10
    level = intervals._level(F.col("start_ms"), F.col("end_ms"))
    written = intervals._binned(hours, F.col("start_ms"), F.col("end_ms"), F.array(level), "__a")
    assert written.count() <= 2  # in bins of its own length; a fixed width of 10 s would take 3,600


def test_islands_and_timecode(spark):
    rows = spark.createDataFrame([("a", 0, 10), ("a", 10, 20), ("a", 5, 8), ("a", 21, 30)], "k string, start_ms long, end_ms long")
    assert sorted(map(tuple, intervals.islands(rows, ["k"]).collect())) == [("a", 0, 20, 3), ("a", 21, 30, 1)]
    for frame, want in ((0, "00:00:00;00"), (1799, "00:00:59;29"), (1800, "00:01:00;02"), (17982, "00:10:00;00"), (107892, "01:00:00;00")):
        assert one(spark, timecode.timecode(F.col("f"), 30, drop=True), f=frame) == want
    assert one(spark, timecode.timecode(F.col("f"), 25), f=90000 * 101 + 26) == "101:00:01:01"


def test_compiler(spark):
    queries = {1: "a dog on a street without people", 2: "night city", 3: "“打开 door” in the kitchen", 4: "没有人的海边", 5: "carefree carpet", 6: "给我找 car", 7: "", 8: "shot_ABC123x again", 9: "他说你好"}
    plans, rows = compile_queries(spark.createDataFrame(list(queries.items()), "query_id long, text string"))
    needs: dict[int, set] = {}
    for r in rows.collect():
        needs.setdefault(r["query_id"], set()).add((r["need"], r["value"]))
    intents = {r["query_id"]: r["intent"] for r in plans.collect()}
    assert {("must", "dog"), ("should", "street"), ("must_not", "person")} <= needs[1]
    assert needs[2] == {("must", "night"), ("must", "city")}
    assert ("must", "打开 door") in needs[3] and ("must_not", "person") in needs[4] and ("must_not", "beach") not in needs[4] and needs[5] == {("must", "carefree"), ("must", "carpet")}
    assert intents == {1: "fact", 2: "semantic", 3: "speech", 4: "fact", 5: "fact", 6: "creative", 7: "auto", 8: "similar", 9: "speech"}


def test_evidence_in_other_scripts_and_denied_words(spark):
    schema = "id long, description string, objects array<string>, actions array<string>, tags array<string>, mood array<string>"
    rows = [(1, "一只老虎", ["老虎"], [], [], []), (2, "no tiger here", [], [], [], []), (3, "a tiger, no zebra", ["大老虎们"], [], [], []), (4, "没有人的海边", [], [], [], []), (5, "人在海边", [], [], [], []), (6, None, None, [None, "Tiger cub"], [], []), (7, "tigers", [], [], [], [])]
    shots = spark.createDataFrame(rows, schema)
    queries = spark.createDataFrame([(1, "老虎"), (2, "tiger"), (3, "没有人的海边"), (4, "zebra")], "query_id long, text string")
    _, needs = compile_queries(queries)
    candidates = queries.select("query_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(7).cast("long"))).alias("id"), F.lit(1.0).alias("score"))
    observed = observations(shots)
    proof = evidence(candidates, needs, observed)
    states = {(r["query_id"], r["id"], r["value"]): r["state"] for r in proof.collect()}
    assert [states[1, i, "老虎"] for i in range(1, 8)] == ["confirmed", "unknown", "confirmed", "unknown", "unknown", "unknown", "unknown"]
    assert [states[2, i, "tiger"] for i in range(1, 8)] == ["unknown", "contradicted", "possible", "unknown", "unknown", "confirmed", "unknown"]
    assert states[3, 4, "person"] == "unknown" and states[3, 5, "person"] == "possible" and states[4, 3, "zebra"] == "contradicted"
    passed = {(r["query_id"], r["id"]) for r in gate(candidates, proof).collect()}
    assert {i for q, i in passed if q == 1} == {1, 3} and {i for q, i in passed if q == 2} == {3, 6} and (3, 4) in passed and (3, 5) not in passed


def test_speech_phrases(spark):
    texts = ["他说“”明天见", "他说 明天见", "“a b” 说 c", "say 'x' \"y\"", "plain", "说"]
    got = [r["p"] for r in spark.createDataFrame(list(enumerate(texts)), "i long, text string").orderBy("i").select(speech_phrase(F.col("text")).alias("p")).collect()]
    assert got == [None, "明天见", "a b", "y", None, None]


def test_ids_of_any_type(spark):
    rows = spark.createDataFrame([("q", "a", "x", "", 0, 0.9), ("q", "b", "y", "", 9000, 0.8), ("q", "c", "z", "s", 0, 0.7), ("q", "d", "w", "s", 0, 0.6)], "query_id string, id string, asset string, session string, start_ms long, score double")
    got = [(r["id"], round(r["score"], 6)) for r in selection.diversify(rows, 4).orderBy("place").collect()]
    assert got[:3] == [("a", 0.9), ("b", 0.8), ("c", 0.7)] and got[3][0] == "d" and got[3][1] < 0.6  # an empty session is none
    vecs = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("c", [0.0, 1.0])], "id string, vector array<double>")
    for sent in (1 << 20, 0):
        assert [(r["id"], r["rank"]) for r in vectors.nearest(vecs, vecs.where("id = 'a'"), k=2, sent_bytes=sent).collect()] == [("b", 1)]
    assert [tuple(r) for r in vectors.similar_pairs(vecs, 0.7).orderBy("a", "b").collect()] == [("a", "b"), ("b", "c")]


def test_named_and_evidence(spark):
    schema = "id long, description string, objects array<string>, actions array<string>, tags array<string>, mood array<string>"
    shots = spark.createDataFrame([(1, "an empty beach with no people", ["beach"], [], [], []), (2, "people walk", ["Person"], ["walking"], [], []), (3, "a pedestrian far off", [], [], [], []), (4, "rain", [], [], [], [])], schema)
    denied = {(r["id"], r["concept"]): r["denied"] for r in named(shots.withColumnRenamed("description", "text"), "id").collect()}
    assert denied[1, "person"] and not denied[1, "beach"] and not denied[2, "person"]
    needs = spark.createDataFrame([(1, "must", "object", "person"), (2, "must_not", "object", "person")], "query_id long, need string, kind string, value string")
    candidates = spark.createDataFrame([(q, i, 1.0) for q in (1, 2) for i in range(1, 5)], "query_id long, id long, score double")
    proof = evidence(candidates, needs, observations(shots))
    states = {(r["query_id"], r["id"]): r["state"] for r in proof.collect()}
    assert [states[1, i] for i in range(1, 5)] == ["contradicted", "confirmed", "possible", "unknown"]
    assert [states[2, i] for i in range(1, 5)] == ["unknown", "confirmed", "possible", "unknown"]
    assert {(r["query_id"], r["id"]): r["score"] for r in gate(candidates, proof).collect()} == {(1, 2): 1.0, (1, 3): 0.5, (2, 1): 1.0, (2, 4): 1.0}
    assert {r["id"]: r["sources"] for r in proof.where("query_id = 1").collect()} == {1: ["description"], 2: ["description", "objects"], 3: ["description"], 4: []}
    # A should neither lowers the factor nor refutes.
    mixed = spark.createDataFrame([(1, 1, "must", "a", "confirmed"), (1, 1, "should", "b", "unknown"), (1, 2, "must", "a", "confirmed"), (1, 2, "should", "b", "contradicted")], "query_id long, id long, need string, value string, state string")
    assert {r["id"]: r["score"] for r in gate(candidates.where("query_id = 1 AND id < 3"), mixed).collect()} == {1: 1.0, 2: 1.0}


def test_fusion_invariants(spark):
    r = random.Random(3)
    rows = spark.createDataFrame([(1, i, s, r.random()) for s in ("lexical", "semantic", "metadata") for i in r.sample(range(40), 20)], "query_id long, id long, signal string, score double")
    plain = {x["id"]: x["score"] for x in fusion.rrf(rows).collect()}
    equal = {x["id"]: x["score"] for x in fusion.weighted_rrf(rows, {"lexical": 1, "semantic": 1, "metadata": 1}).collect()}
    again = {x["id"]: x["score"] for x in fusion.rrf(rows.repartition(5)).collect()}
    assert plain == equal == again
    assert fusion.weighted_rrf(rows, {"lexical": 0.5, "semantic": 0, "metadata": -1}).count() == 20


def test_lexical_phrases_and_hints(spark):
    docs = spark.createDataFrame([(1, "rain on the street"), (2, "a train on the street"), (3, None)], "id long, t string")
    terms = spark.createDataFrame([(1, "rain"), (1, "street")], "query_id long, term string")
    assert [r["id"] for r in lexical.bm25(docs, "id", {"t": text.ascii_tokens("t")}, terms).collect()] == [1]
    files = spark.createDataFrame([(1, "/a/rain_7.mp4"), (2, "/rain/train 7.mp4"), (3, "/x/雨夜.mp4")], "id long, path string")
    hints = spark.createDataFrame([(1, "train"), (2, "雨")], "query_id long, term string")
    assert sorted((r["query_id"], r["id"]) for r in lexical.name_hints(files, "id", "path", hints).collect()) == [(1, 2), (2, 3)]


def test_selection(spark):
    pool = spark.createDataFrame([(1, 1, 1, 9, 0, 1.0), (1, 2, 1, 9, 3000, 0.99), (1, 3, 1, 9, 9000, 0.9), (1, 4, 2, None, 0, 0.8), (1, 5, 3, 9, 0, 0.85)], "query_id long, id long, asset long, session long, start_ms long, score double")
    rows = selection.diversify(pool, 4).orderBy("place").collect()
    # 1 is chosen, 2 is a burst of it, 3 costs 0.25 beside it, 5 0.2 for its session with 1 and with 3, 4 nothing.
    assert [(r["id"], round(r["score"], 6)) for r in rows] == [(1, 1.0), (4, 0.8), (3, 0.65), (5, 0.45)]
    burst = spark.createDataFrame([(1, 1, 1, 7, 0, 1.0), (1, 3, 1, 7, 9000, 0.9), (1, 5, 3, 7, 0, 0.85)], "query_id long, id long, asset long, session long, start_ms long, score double")
    assert [(r["id"], round(r["score"], 6)) for r in selection.diversify(burst, 3).orderBy("place").collect()] == [(1, 1.0), (3, 0.65), (5, 0.45)]
    assert [r["id"] for r in selection.diversify(pool, 2, 0).orderBy("place").collect()] == [1, 2]
    assert selection.pool_size(1) == 30 and selection.pool_size(100) == 200 and selection.check_page() == (20, 0)
    with pytest.raises(ValueError):
        selection.check_page(50, 180)


def test_library(spark):
    captures = spark.createDataFrame(
        [(1, 0, 9_000_000, "x", None, "camera"), (2, 1_800_000, 1_800_020, " X", "Reel", "camera"), (3, 9_000_000, 9_000_001, "y", "reel ", "camera"), (4, 3_600_001, 9_900_001, "x", None, None), (5, 0, 1, None, None, "camera"), (6, 1, 2, "x", "reel", "Proxy"), (2, 1_800_000, 1_800_020, " X", "Reel", "camera"), (7, None, None, "x", "", "camera")],
        "id long, start_ms long, end_ms long, device string, marker string, source string",
    )
    found = library.sessions(captures, ["device"], ["marker"])
    assert {r["id"]: r["session"] for r in found.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 7: 7}
    assert (1, 0, 9_000_001, 3) in {tuple(r) for r in library.session_spans(captures, found).collect()}
    rooted = captures.withColumns({"root": F.when(F.col("id") < 3, "r1").otherwise("r2"), "rank": F.lit(1)})
    stored = spark.createDataFrame([(1, 90, "r1", "automatic"), (8, 91, "r3", "automatic"), (2, 92, "r1", "manual")], "id long, session long, root string, origin string")
    again = {(r["id"], r["session"], r["root"], r["origin"]) for r in library.rebuild_sessions(stored, rooted, ["device"], ["marker"]).collect()}
    assert {(8, 91, "r3", "automatic"), (2, 92, "r1", "manual"), (1, 1, "r1", "automatic"), (2, 1, "r1", "automatic"), (3, 3, "r2", "automatic")} <= again and (1, 90, "r1", "automatic") not in again
    fields = spark.createDataFrame([(1, "camera", "A", "exif", "s2"), (1, "camera", "B", "exif", "s1"), (1, "camera", "C", "guess", "s0"), (1, "place", "", "exif", "s1")], "id long, field string, value string, family string, source string")
    row = library.merge_fields(fields, ["id"], ["exif", "name"]).first()
    assert (row["value"], row["source"], row["conflicting"]) == ("B", "s1", ["A", "C"])
    tags = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.99, 0.1]), (3, [0.0, 1.0]), (4, [1.0])], "id long, vector array<double>")
    for block in (2, 1024):
        got = library.tag_clusters(tags, block=block).collect()
        assert {(r["tag"], r["cluster"], r["members"]) for r in got} == {(1, 1, 2), (2, 1, 2)} and got[0]["similarity"] == pytest.approx(0.99 / np.hypot(0.99, 0.1))
    assert {r["node"]: r["label"] for r in connected_components(spark.createDataFrame([(1, 2), (3, 2), (5, 6)], "a long, b long")).collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5}


def test_timeline(spark):
    words = spark.createDataFrame([(1, i, w, 300 * i + (5000 if i > 3 else 0), 300 * i + 250 + (5000 if i > 3 else 0)) for i, w in enumerate("Say hello there my friend hello there".split())], "asset long, ordinal long, text string, start_ms long, end_ms long")
    assert [tuple(r) for r in timeline.phrase_hits(words, ["asset"], ["hello", "there"]).collect()] == [(1, 300, 850), (1, 6500, 7050)]
    assert timeline.phrase_hits(words, ["asset"], ["my", "friend"]).count() == 0  # the gap is too long
    cells = spark.createDataFrame([("a", i, s) for i, s in enumerate([0.0, 0.5, 0.5, 0.5, 0.1, 0.5, 0.5, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1, 0.9, 0.0, 0.0])], "k string, cell long, score double")
    assert [tuple(r) for r in timeline.sound_events(cells, ["k"]).collect()] == [("a", 100, 700, 0.5)]
    ends = spark.createDataFrame([("a", i, s) for i, s in enumerate([0.0, 0.5, 0.5, 0.5, 0.1])], "k string, cell long, score double")
    # One low cell at the end doesn't close: the event ends with the recording.
    assert [tuple(r) for r in timeline.sound_events(ends, ["k"]).collect()] == [("a", 100, 500, 0.5)]
    patches = spark.createDataFrame([("a", 0, 0.0), ("a", 1, 1.0)], "k string, patch long, score double")
    durations = spark.createDataFrame([("a", 1250)], "k string, duration_ms long")
    got = {r["cell"]: r["score"] for r in timeline.patch_cells(patches, ["k"], durations, "k").collect()}
    assert len(got) == 13 and got[0] == 0 and got[4] == pytest.approx(20 / 120) and got[5] == 0.5 and got[12] == 1.0
    plan = lambda ms, size: one(spark, timeline.plan_windows(F.col("d"), F.col("b"), 1000), d=ms, b=size)
    assert [tuple(w) for w in plan(100_000, 1000)] == [(0, 100_000)] and [tuple(w) for w in plan(0, 9)] == [(0, 0)]
    assert [tuple(w) for w in plan(100_000, 2500)] == [(0, 40_000), (35_000, 75_000), (70_000, 100_000)]
    assert [tuple(w) for w in plan(900_000, 10)] == [(0, 480_000), (475_000, 900_000)] and len(plan(60_000, 1_000_000)) == 3
    frames = lambda a, b, mode="boundary_aware": one(spark, timeline.plan_frames(F.col("a"), F.col("b"), mode), a=a, b=b)
    assert frames(0, 1001) == [200, 701] and frames(100, 10_100) == [1100, 3600, 6600, 9100] and frames(5, 5) == [] and frames(0, 1) == [0, 1]
    assert frames(0, 40_000) == [2000, 8000, 16_000, 24_000, 32_000, 38_000] and frames(0, 4000, "uniform") == [500, 1500, 2500, 3500]
    rows = [(1, 0, 100, "one text", ["b", "", "a"], 0.5), (1, 50, 150, "One  text ", ["a", "c"], 0.9), (1, 100, 200, "one text", ["d"], 0.1), (1, 40, 190, "other", [], 0.1), (2, 0, 10, "one text", [], 0.1), (2, 0, 30, "one text", ["z"], None), (2, 29, 50, "one text", ["y"], 0.2)]
    found = sorted(tuple(r) for r in timeline.merge_window_shots(spark.createDataFrame(rows, "asset long, start_ms long, end_ms long, text string, tags array<string>, confidence double")).collect())
    # The third shot of asset 1 touches the kept span [0, 100) and doesn't overlap it; asset 2 keeps the wider span.
    assert found == [(1, 0, 100, "one text", ["b", "", "a", "c"], 0.9), (1, 40, 190, "other", [], 0.1), (1, 100, 200, "one text", ["d"], 0.1), (2, 0, 30, "one text", ["z"], 0.1), (2, 29, 50, "one text", ["y"], 0.2)]
    scenes = timeline.merge_window_scenes(spark.createDataFrame([("a", 0, 10, "t", ["x"]), ("a", 2, 30, "t", ["y"])], "asset string, start_ms long, end_ms long, text string, tags array<string>"))
    assert [tuple(r) for r in scenes.collect()] == [("a", 0, 10, "t", ["x", "y"])]
    analyses = spark.createDataFrame([(1, 1, "", 0.0, 2, ["a"]), (1, 2, "s", 0.8, 1, ["b", "a"]), (2, 1, None, 0.0, 0, [])], "asset long, window long, summary string, confidence double, people long, tags array<string>")
    assert {r["asset"]: (r["summary"], r["confidence"], r["people"], r["tags"]) for r in timeline.merge_window_analyses(analyses, ["tags"]).collect()} == {1: ("s", 0.8, 2, ["a", "b"]), 2: (None, 0.0, 0, [])}
    things = spark.createDataFrame([(1, 2, [("dog", 1, 0.9)]), (1, 1, [("Cat", 1, 0.5), (" ", 9, 0.9), ("Dog  ", 3, 0.2)])], "asset long, window long, things array<struct<name:string,count:int,confidence:double>>")
    assert sorted(tuple(r)[1:] for r in timeline.merge_named(things, "things").collect()) == [(1, "Cat", 1, 0.5), (2, "Dog  ", 3, 0.9)]
    shots = spark.createDataFrame([(1, 0, 100, "A  cat", ["x"], 0.5), (1, 60, 200, "a cat", ["y"], 0.9), (1, 500, 600, "a cat", [], 0.1)], "asset long, start_ms long, end_ms long, text string, tags array<string>, confidence double")
    assert sorted(tuple(r) for r in timeline.merge_window_shots(shots).collect()) == [(1, 0, 100, "A  cat", ["x"], 0.5), (1, 60, 200, "a cat", ["y"], 0.9), (1, 500, 600, "a cat", [], 0.1)]
    with pytest.raises(ValueError):
        timeline.validate_predicates({"a": "x"}, [("a", "before", "a", 0)])


def test_quality(spark):
    p = spark.createDataFrame([(1, 1, 0, 100), (1, 2, 0, 90), (1, 3, 500, 600)], "k long, id long, start_ms long, end_ms long")
    t = spark.createDataFrame([(1, 11, 0, 95), (1, 12, 10, 100)], "k long, id long, start_ms long, end_ms long")
    assert {(r["prediction"], r["truth"]) for r in quality.match_events(p, t, ["k"]).collect()} == {(2, 11), (1, 12)}
    trials = spark.createDataFrame([(0.9, True), (0.8, True), (0.4, True), (0.5, False), (0.1, False)], "score double, same boolean")
    row = quality.equal_error(quality.threshold_sweep(trials)).first()
    assert row["eer"] == pytest.approx((0.5 + 1 / 3) / 2)
    scores = quality.event_scores(p, t, quality.match_events(p, t, ["k"]), ["k"]).first()
    assert scores["micro_f1"] == scores["macro_f1"] == pytest.approx(0.8) and scores["boundary_error_ms"] == pytest.approx((2.5 + 5) / 2)


def frame_by_frame(reference, hypothesis, duration):
    """Diarization error by single frames and all assignments."""
    from itertools import permutations

    n = duration // 10

    def mark(turns):
        out = [""] * n
        for s, a, b in sorted(turns, key=lambda x: (min(x[1] // 10, n), min(x[2] // 10, n), x[0])):
            for i in range(a // 10, min(b // 10, n)):
                out[i] = s
        return out

    ref, hyp = mark(reference), mark(hypothesis)
    near, depth = set(), [0] * n
    for _, a, b in reference:
        for edge in (a // 10, b // 10):
            near.update(range(edge - 25, edge + 25))
        for i in range(a // 10, min(b // 10, n)):
            depth[i] += 1
    names, guesses = sorted({r for r in ref if r}), sorted({h for h in hyp if h})
    shared = lambda r, h: sum(x == r and y == h for x, y in zip(ref, hyp, strict=True))
    best = max((dict(zip(names, p, strict=False)) for p in permutations([*guesses, *[None] * len(names)], len(names))), key=lambda m: sum(shared(r, h) for r, h in m.items()))
    wrong = [best[r] != h or not shared(r, h) if r else bool(h) for r, h in zip(ref, hyp, strict=True)]
    rates = []
    for keep in (lambda i: True, lambda i: depth[i] <= 1):
        own = [wrong[i] for i in range(n) if i not in near and keep(i)]
        rates.append(sum(own) / len(own) if own else 0.0)
    return rates, len(guesses) - len(names)


def test_diarization(spark):
    r = random.Random(9)
    turns = lambda names: [(r.choice(names), s, s + r.choice([300, 900, 2500])) for s in sorted(r.randrange(20_000) for _ in range(r.randint(3, 12)))]
    cases = {i: (turns("ABC"[: 1 + i % 3]), turns("xyzw"[: 1 + i % 4])) for i in range(12)}
    schema = "asset long, speaker string, start_ms long, end_ms long"
    ref, hyp = (spark.createDataFrame([(i, *t) for i, both in cases.items() for t in both[side]], schema) for side in (0, 1))
    durations = spark.createDataFrame([(i, 21_005) for i in cases], "asset long, duration_ms long")
    for row in quality.diarization_error(ref, hyp, durations).collect():
        rates, off = frame_by_frame(*cases[row["asset"]], 21_005)
        assert (row["der_with_overlap"], row["der_without_overlap"], row["speaker_count_error"]) == (pytest.approx(rates[0]), pytest.approx(rates[1]), off)


def test_assignment():
    from itertools import permutations

    r = np.random.default_rng(2)
    for rows, columns in ((1, 4), (5, 5), (6, 3), (3, 6)):
        w = r.integers(0, 9, (rows, columns)).astype(float)
        wide = w if rows <= columns else w.T
        best = max(sum(wide[i, p[i]] for i in range(len(wide))) for p in permutations(range(wide.shape[1]), len(wide)))
        pairs = quality.best_assignment(w)
        assert sum(w[a, b] for a, b in pairs) == best and len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(wide)
    assert len(quality.best_assignment(r.random((40, 30)))) == 30


def test_sources(spark, tmp_path):
    big = np.random.default_rng(1).bytes(13 << 20)
    (tmp_path / "a.mp4").write_bytes(big)
    (tmp_path / "b.txt").write_bytes(b"y")
    files = ingest.scan(spark, str(tmp_path))
    assert {r["extension"]: r["wanted"] for r in files.collect()} == {"mp4": True, "txt": False}
    assert [tuple(r) for r in ingest.skipped_extensions(files).collect()] == [("txt", 1)]
    marks = ingest.fingerprints(spark, str(tmp_path))
    half = len(big) // 2 - (2 << 20)
    want = hashlib.sha256(f"{len(big)}:".encode() + big[: 4 << 20] + big[half : half + (4 << 20)] + big[-(4 << 20) :]).hexdigest()
    got = {r["size"]: r["fingerprint"] for r in marks.collect()}
    assert got == {len(big): want, 1: hashlib.sha256(b"1:y").hexdigest()}
    assert ingest.sample_offsets((4 << 20) + 2) == [0, 1, 2] and ingest.sample_offsets(9) == [0]
    assert ingest.fingerprints(spark, str(tmp_path), marks).count() == 2
    rows = spark.createDataFrame([(1, '[{"start_ms":0,"end_ms":5,"text":"a"},{"start_ms":5,"end_ms":5,"text":"b"}]'), (2, "junk")], "id long, js string")
    assert [tuple(r) for r in ingest.segments(rows, "id", "js").collect()] == [(1, 0, 0, 5, "a")]
    blobs = spark.createDataFrame([(1, bytearray(np.array([1, 2], "<f4").tobytes())), (2, bytearray(b"abc")), (3, None)], "id long, b binary")
    assert {r["id"]: r["vector"] for r in ingest.vectors_of_blobs(blobs, "id", "b").collect()} == {1: [1.0, 2.0], 2: None, 3: None}
    back = ingest.blobs_of_vectors(spark.createDataFrame([(1, [1.0, 2.0]), (2, []), (3, None)], "id long, vector array<float>"), "id")
    assert {r["id"]: r["blob"] for r in back.collect()} == {1: bytearray(np.array([1, 2], "<f4").tobytes()), 2: None, 3: None}
    cuts = spark.createDataFrame([("l", 1, "long clip name A", 0, 1000), ("l", 2, "long clip name B", 40, 1020)], "list string, position long, clip string, start_ms long, end_ms long")
    lines = [r["line"] for r in edl.edl(cuts, "list").orderBy("line_no").collect()]
    assert lines[:2] == ["TITLE: l", "FCM: NON-DROP FRAME"] and lines[2] == "001  LONG_CLI  V     C        00:00:00:00  00:00:01:00  00:00:00:00  00:00:01:00"
    assert lines[3].split()[1] == "LONG_C_2" and lines[3].endswith("00:00:01:00  00:00:02:00")
    late = spark.createDataFrame([("l", 1, "", 60_000, 660_000)], "list string, position long, clip string, start_ms long, end_ms long")
    drop = [r["line"] for r in edl.edl(late, "list", fps=29.97, title="T").orderBy("line_no").collect()]
    assert drop[:2] == ["TITLE: T", "FCM: DROP FRAME"] and drop[2].split()[4:6] == ["00:00:59;28", "00:10:59;28"]
    for a, b in ((-1, 50), (50, 50), (0, 3)):
        with pytest.raises(Exception, match="a clip"):
            edl.edl(spark.createDataFrame([("l", 1, "x", a, b)], cuts.schema), "list").collect()


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(1, "one two two"), (2, "two")], "id long, t string").write.parquet(str(source))
    stream = spark.readStream.schema("id long, t string").parquet(str(source))
    refresh.follow_postings(stream, "id", "t", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert {(r["id"], r["token"], r["tf"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, "one", 1), (1, "two", 2), (2, "two", 1)}
    events = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:29:00"), (1, "2024-01-01 02:00:00")], "k long, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r["n"] for r in refresh.stream_sessions(events, "k", "ts").collect()) == [1, 2]
    assert refresh.stream_rollup(events, "k", "ts").count() == 2


def test_hashes_of_many_terms():
    import pyarrow as pa

    from cinequarry.functions.text import LONG_TERM, fnv1a, fnv1a_each

    words = ["a", "", "雨夜", "x" * LONG_TERM, "y" * (LONG_TERM + 1), "z" * 500, "ñandú"] * 3
    for own in (pa.array(words), pa.array(words).slice(3, 9), pa.array(words, pa.large_string()), pa.array([], pa.string()), pa.array([""])):
        assert fnv1a_each(own).tolist() == [fnv1a(w.encode()) for w in own.to_pylist()]


def test_single_precision_rules_out_no_neighbour():
    """Copies, ties and near ties: the k best are those of all exact scores, although few are computed."""
    from cinequarry.functions.vectors import _Heads

    rng = np.random.default_rng(5)
    for width, k in ((64, 10), (3, 4), (700, 2)):
        rows = rng.integers(-3, 4, size=(3000, width)).astype(float)
        rows[:, 0] = 5
        rows[1000:1400] = rows[:400] + (1e-7 if width == 64 else 0) * rng.normal(size=(400, width))
        rows /= np.linalg.norm(rows, axis=1, keepdims=True)
        ids = rng.permutation(len(rows))
        heads = _Heads([(width, ids[:50], rows[:50])], k, 6, True)
        computed = []
        exact = heads._near
        heads._near = lambda *args, exact=exact, computed=computed: computed.append(exact(*args)) or computed[-1]
        for lo in range(0, len(rows), 500):
            heads.meet([(width, ids[lo : lo + 500], rows[lo : lo + 500])])
        scores = np.round(rows[:50] @ rows.T, 6)
        for q in range(50):
            best = sorted((-s, i) for s, i in zip(scores[q], ids, strict=True) if s > 0 and i != ids[q])[:k]
            assert [(-s, i) for s, i in zip(heads.scores[0][q], heads.ids[0][q], strict=True) if s > 0] == best
        assert any(x is not None for x in computed)
