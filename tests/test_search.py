"""The whole search on a small library of cases that are easy to get wrong."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cinequarry.operators import modalities, search, speech, temporal
from cinequarry.plans.broadcasts import checked

SHOT = "id long, asset long, session long, ordinal long, start_ms long, end_ms long, description string, tags array<string>, objects array<string>, actions array<string>, mood array<string>"


@pytest.fixture(scope="module")
def library(spark):
    shots = [
        (1, 1, 1, 0, 0, 4000, "a train leaves the station in rain", ["rain"], ["train"], [], []),
        (2, 1, 1, 1, 4000, 8000, "trainees running in a gym", [], ["person"], ["running"], []),
        (3, 2, 1, 0, 0, 5000, "a beach without people", ["beach"], [], [], []),
        (4, 2, 1, 1, 6000, 9000, "a beach full of people", ["beach"], ["people"], [], []),
        (5, 3, 2, 0, 0, 1000, "umbrella at night", ["night"], ["umbrella"], [], []),
        (6, 3, 2, 1, 1100, 2000, "umbrella at night", ["night"], ["umbrella"], [], []),
        (7, 4, None, 0, 0, 9000, "雨夜街道 with cars", ["night"], ["汽车"], [], ["cinematic"]),
        (8, 5, None, 0, 0, 9000, "a carefree dance", [], [], ["dancing"], []),
        (9, 6, 2, 0, 0, 9000, "two people at a table", [], ["person", "table"], [], []),
    ]
    words = [(6, i, s, s + 200, t, c) for i, (s, t, c) in enumerate([(0, "We", None), (300, "meet", 0.9), (600, "again", 0.5), (1000, "你", None), (1300, "好", None), (5000, "tomorrow", None)])]
    words += [(5, 0, 0, 100, "meet", None), (5, 1, 9000, 9100, "again", None)]
    paths = [(a, f"/media/clip_{a}.mp4") for a in range(1, 6)] + [(6, "/train/雨 table_9.mov")]
    return search.build_library(spark.createDataFrame(shots, SHOT), spark.createDataFrame(words, "asset long, ordinal long, start_ms long, end_ms long, text string, confidence double"), spark.createDataFrame(paths, "asset long, path string"))


def found(spark, library, queries, **kw):
    rows = search.search(spark.createDataFrame(list(enumerate(queries)), "query_id long, text string"), library, **kw).collect()
    out: dict[int, list] = {i: [] for i in range(len(queries))}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["place"])):
        out[r["query_id"]].append(r)
    return [[r["id"] for r in out[i]] for i in out], out


def test_search(spark, library):
    ids, rows = found(spark, library, ["train", "beach without people", "umbrella", "雨夜", "“meet again”", "“你好”", "说 好 tomorrow", "car", "nothing of this kind", "night city", "给我找 umbrella"])
    assert ids[0] == [1]  # neither trainees nor a folder's name
    assert ids[1] == [3]  # the crowded beach is refuted
    assert ids[2] == [5]  # 6 is a burst of 5
    assert ids[3][0] == 7 and 7 in ids[7] and 8 not in ids[7]
    assert ids[4] == [9] and ids[5] == [9]  # the phrase in 8 is too far apart
    assert ids[6] == [] and ids[8] == []
    assert rows[9] and rows[9][0]["intent"] == "semantic" and rows[10][0]["intent"] == "creative"
    assert (rows[0][0]["previous"], rows[0][0]["next"], rows[0][0]["has_more"]) == (None, 2, False)
    assert found(spark, library, ["beach"], limit=1)[1][0][0]["has_more"] and found(spark, library, ["beach"], limit=1, offset=1)[0] == [[4]]
    only = library.shots.where("id <> 1").select("id")
    assert found(spark, library, ["train"], allowed=only)[0] == [[]]


def test_modes_and_plugs(spark, library):
    frame = spark.createDataFrame([(0, "umbrella", "creative"), (1, "umbrella", ""), (2, "umbrella", None)], "query_id long, text string, mode string")
    assert {r["query_id"]: r["intent"] for r in search.search(frame, library).collect()} == {0: "creative", 1: "fact", 2: "fact"}
    with pytest.raises(Exception, match="unknown mode"):
        search.search(spark.createDataFrame([(0, "umbrella", "odd")], "query_id long, text string, mode string"), library).collect()
    from dataclasses import replace

    own = replace(library, retrievers={"always": lambda q, lib: q.select("query_id", F.lit(8).cast("long").alias("id"), F.lit(1.0).alias("score"))}, rerank=lambda page: page.withColumn("score", F.lit(7.0)))
    rows = search.search(spark.createDataFrame([(0, "给我找 umbrella")], "query_id long, text string"), own, extra_weights={"always": 1.0}).collect()
    assert 8 in {r["id"] for r in rows} and {r["score"] for r in rows} == {7.0}


def test_temporal_queries(spark, library):
    texts = ["A dog while rain", "x AND y at the same time", "x and y happen at the same time", "train before beach", "雨 在 车 之前出现", "a after b", "雨之后出现车", "雨 和 车 同时出现", "plain", " while b"]
    got = {r["query_id"]: (r["left"], r["relation"], r["right"], r["max_gap_ms"]) for r in search.temporal_queries(spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")).collect()}
    assert got == {0: ("A dog", "simultaneous", "rain", 0), 1: ("x", "simultaneous", "y", 0), 2: ("x", "simultaneous", "y", 0), 3: ("train", "before", "beach", 5000), 4: ("雨", "before", "车", 5000), 5: ("a", "after", "b", 5000), 6: ("雨", "after", "车", 5000), 7: ("雨", "simultaneous", "车", 0)}
    hits = spark.createDataFrame([(0, "left", 1), (0, "right", 2), (0, "right", 4)], "query_id long, side string, id long")
    asked = spark.createDataFrame([(0, "train", "before", "running", 5000)], "query_id long, left string, relation string, right string, max_gap_ms long")
    assert [tuple(r) for r in search.related_pairs(hits, library.shots, asked).collect()] == [(0, 1, 2)]


CONDITION = "query_id long, condition string, modality string, text string, space string, vector array<double>"
PREDICATE = "query_id long, predicate string, left string, relation string, right string, max_gap_ms long"


@pytest.fixture(scope="module")
def timed(spark, library):
    """The library with sounds, frames and speakers on its recordings."""
    from dataclasses import replace

    heads = spark.createDataFrame([(a, m, 1) for a in range(1, 7) for m in temporal.CHANNELS], "asset long, modality string, generation long")
    events = [(1, 1, 1, "/m/06mb1", 0, 1000, 0.9, "confirmed"), (2, 1, 1, "/m/03kmc9", 1500, 2000, 0.8, "confirmed"), (3, 2, 1, "/m/03kmc9", 0, 400, 0.9, "possible"), (4, 2, 1, "/m/06mb1", 900, 1400, 0.5, "confirmed"), (5, 3, 1, "/m/06mb1", 0, 300, 0.5, "possible"), (6, 3, 2, "/m/03kmc9", 400, 500, 0.9, "confirmed"), (7, 6, 1, "/m/06mb1", 0, 300, 0.5, "possible"), (8, 6, 1, "/m/03kmc9", 8000, 8500, 0.5, "possible")]
    frames = [(11, 1, 1, "s", 500, 600, [1.0, 0.0]), (12, 2, 1, "s", 950, 1000, [0.9, 0.1]), (13, 3, 1, "s", 0, 100, [0.0, 1.0]), (14, 4, 1, "other", 0, 100, [1.0, 0.0])]
    turns = [(21, 6, 1, "anna", 100, 250), (22, 1, 1, "anna", 0, 100), (23, 6, 1, "ben", 0, 9000)]
    own = temporal.Recordings(
        heads,
        {"visual": spark.createDataFrame(frames, "record long, asset long, generation long, space string, start_ms long, end_ms long, vector array<double>")},
        spark.createDataFrame(events, "record long, asset long, generation long, label string, start_ms long, end_ms long, raw_score double, status string"),
        spark.createDataFrame(turns, "record long, asset long, generation long, speaker string, start_ms long, end_ms long"),
    )
    text = spark.createDataFrame([(1, [1.0, 0.0]), (5, [0.8, 0.6]), (6, [0.7, 0.7]), (9, [0.0, 1.0]), (3, [1.0])], "id long, vector array<double>")
    return replace(library, recordings=own, text_vectors=text)


def asked(spark, conditions, predicates=(), speakers=()):
    rows = [(q, c, m, t, "s" if m == "visual" else None, [1.0, 0.0] if m == "visual" else None) for q, c, m, t in conditions]
    return temporal.Requests(conditions=spark.createDataFrame(rows, CONDITION), predicates=spark.createDataFrame(list(predicates), PREDICATE) if predicates else None, speakers=spark.createDataFrame(list(speakers), "query_id long, asset long, generation long, speaker string") if speakers else None)


def test_conditions_and_predicates_of_many_queries(spark, timed):
    rain, siren = (lambda q, c="a": (q, c, "sound_event", "rain")), (lambda q, c="b": (q, c, "sound_event", "a police siren"))
    requests = asked(
        spark,
        [rain(1), siren(1), rain(2), siren(2), rain(3), siren(3), rain(4), (4, "v", "visual", "x"), (5, "s", "speaker", "x"), rain(5), rain(6), siren(6), rain(7)],
        [(1, "p", "a", "before", "b", 5000), (2, "p", "a", "after", "b", 5000), (3, "p", "a", "simultaneous", "b", 0), (4, "p", "v", "during", "a", 0), (5, "p", "s", "during", "a", 0), (6, "p", "a", "before", "b", 5000), (6, "q", "b", "before", "a", 5000)],
        [(5, 6, 1, "anna")],
    )
    spans = timed.shots.select(F.col("id").alias("shot"), "asset", "start_ms", "end_ms")
    assets, matches, held = temporal.evaluate(requests, timed.recordings, spans)
    got: dict[int, set] = {}
    for r in assets.collect():
        got.setdefault(r["query_id"], set()).add(r["asset"])
    # In 6 the siren is over five seconds behind; in 3 the siren is of an old generation; 6 asks for both orders; 7 has no predicate.
    assert got == {1: {1}, 2: {2}, 4: {1, 2}, 5: {6}, 7: {1, 2, 3, 6}}
    shown = {(r["query_id"], r["asset"], r["left_record"], r["right_record"]): ([tuple(s) for s in r["supports"]], r["evidence"]) for r in held.collect()}
    assert shown[1, 1, 1, 2] == ([(0, 1000), (1500, 2000)], "confirmed") and shown[2, 2, 4, 3] == ([(900, 1400), (0, 400)], "possible") and shown[4, 1, 11, 1] == ([(500, 600)], "possible")
    assert {(r["query_id"], r["condition"], r["record"]) for r in matches.where("query_id IN (1, 5)").collect()} == {(1, "a", 1), (1, "b", 2), (5, "s", 21), (5, "a", 7)}
    cut = temporal.evaluate(requests, timed.recordings, spans, limit=1)[1]
    assert cut.where("query_id = 7").count() == 1 and cut.where("query_id = 1").count() == 2
    only = temporal.evaluate(requests, timed.recordings, spans, allowed=spans.where("asset <> 1").select("shot", "asset"))[0]
    assert {r["asset"] for r in only.where("query_id = 4").collect()} == {2}


def test_what_many_queries_ask_is_answered_once(spark, timed, monkeypatch):
    many = range(1, 41)
    requests = asked(spark, [(q, c, "sound_event", t) for q in many for c, t in (("a", "rain"), ("b", "a police siren"))], [(q, "p", "a", "before", "b", 5000) for q in many])
    sizes = []
    windows_of, supports = temporal.windows_of, temporal.supports
    monkeypatch.setattr(temporal, "windows_of", lambda rows, *args, **more: sizes.append(rows.count()) or windows_of(rows, *args, **more))
    monkeypatch.setattr(temporal, "supports", lambda windows, rows: sizes.append(rows.count()) or supports(windows, rows))
    assets, matches, held = temporal.evaluate(requests, timed.recordings, timed.shots.select(F.col("id").alias("shot"), "asset", "start_ms", "end_ms"))
    assert sizes == [2, 1]  # two conditions and a predicate, not eighty and forty
    assert {(r["query_id"], r["asset"]) for r in assets.collect()} == {(q, 1) for q in many}
    assert held.count() == 40 and matches.count() == 80


def test_likeness_comes_last(spark, timed, monkeypatch):
    """Cosines are asked for where all else holds alone, and one that rounds to 0 is positive still."""
    rain, siren, look = ("a", "sound_event", "rain", None, None), ("b", "sound_event", "siren", None, None), lambda q: ("v", "visual", "x", "s", [1e-7, float(q)])
    conditions = [(q, *c) for q in range(1, 9) for c in (rain, look(q))] + [(q, *c) for q in range(9, 31) for c in (rain, siren, look(q))]
    predicates = [(q, "p", "v", "during", "a", 0) for q in range(1, 31)] + [(q, "q", "b", "during", "a", 0) for q in range(9, 31)]
    asked_for = []
    own = temporal.Evaluation._likenesses
    monkeypatch.setattr(temporal.Evaluation, "_likenesses", lambda self, wanted, frames: asked_for.append(wanted.count()) or own(self, wanted, frames))
    requests = temporal.Requests(conditions=spark.createDataFrame(conditions, CONDITION), predicates=spark.createDataFrame(predicates, PREDICATE))
    found = temporal.Evaluation(requests, timed.recordings, timed.shots.select(F.col("id").alias("shot"), "asset", "start_ms", "end_ms"))
    assert {(r["query_id"], r["asset"]) for r in found.assets().collect()} == {(q, a) for q in range(1, 9) for a in (1, 2, 3)}
    assert asked_for == [8 * 3]  # no siren is heard in rain, so none of the other 22 pictures is compared
    assert {(r["record"], r["score"]) for r in found.matches().where("query_id = 1 AND condition = 'v'").collect()} == {(11, 0.0), (12, 0.110432), (13, 1.0)}
    assert found.supports().count() == 8 * 3


def test_matches_are_written_out_last(spark, timed, monkeypatch):
    """Forty queries that ask the same share their two windows up to the last step; other names make another request."""
    many = range(1, 42)
    name = lambda q, c: c if q <= 40 else f"{c}{c}"
    requests = asked(spark, [(q, name(q, c), "sound_event", t) for q in many for c, t in (("a", "rain"), ("b", "a police siren"))], [(q, "p", name(q, "a"), "before", name(q, "b"), 5000) for q in many])
    shared = []
    own = temporal.Evaluation._spread
    monkeypatch.setattr(temporal.Evaluation, "_spread", lambda self, rows, total: shared.append(rows.count()) or own(self, rows, total))
    matches = temporal.Evaluation(requests, timed.recordings, timed.shots.select(F.col("id").alias("shot"), "asset", "start_ms", "end_ms")).matches()
    assert shared == [4]  # of two requests
    assert {(r["query_id"], r["condition"], r["record"]) for r in matches.collect()} == {(q, name(q, c), n) for q in many for c, n in (("a", 1), ("b", 2))}


def test_conditions_meet_once_for_many_predicates(spark, timed, monkeypatch):
    """Eight predicates between two conditions, with gaps of three sizes, meet their windows three times."""
    gaps = {"before": [1100, 1200, 1300, 2047, 400], "after": [1500], "during": [0], "simultaneous": [0]}
    rules = [(r, g) for r, own in gaps.items() for g in own]
    requests = asked(spark, [(q, c, "sound_event", t) for q in range(len(rules)) for c, t in (("a", "rain"), ("b", "a police siren"))], [(q, "p", "a", r, "b", g) for q, (r, g) in enumerate(rules)])
    met = []
    near = temporal.near
    monkeypatch.setattr(temporal, "near", lambda left, right, keys: met.append(left.groupBy("left_record").count().agg(F.max("count")).first()[0]) or near(left, right, keys))
    held = temporal.Evaluation(requests, timed.recordings, timed.shots.select(F.col("id").alias("shot"), "asset", "start_ms", "end_ms")).supports()
    assert met == [3]  # gaps of 0, of 256 to 511 and of 1024 to 2047 ms
    rain, siren = {1: (1, 0, 1000), 2: (4, 900, 1400)}, {1: (2, 1500, 2000), 2: (3, 0, 400)}
    want = {(q, a) for q, (r, g) in enumerate(rules) for a in (1, 2) if (r == "before" and 0 <= siren[a][1] - rain[a][2] <= g) or (r == "after" and 0 <= rain[a][1] - siren[a][2] <= g)}
    assert {(r["query_id"], r["asset"]) for r in held.collect()} == want and len(want) == 5


def test_search_with_requests(spark, timed):
    queries = spark.createDataFrame([(0, "train"), (1, "people"), (2, "people")], "query_id long, text string")
    requests = asked(spark, [(0, "a", "sound_event", "rain"), (0, "b", "sound_event", "siren"), (1, "a", "sound_event", "rain"), (1, "b", "sound_event", "siren")], [(0, "p", "a", "before", "b", 5000), (1, "p", "a", "after", "b", 5000)])
    rows = search.search(queries, timed, requests=requests).collect()
    assert {r["id"] for r in rows if r["query_id"] == 0} == {1} and {r["id"] for r in rows if r["query_id"] == 1} <= {3, 4}
    assert {r["id"] for r in rows if r["query_id"] == 2} > {r["id"] for r in rows if r["query_id"] == 1}  # asks for nothing in time
    # A shot that only a timed channel finds; the mode keeps the evidence gate out.
    creative = spark.createDataFrame([(0, "zzz", "auto")], "query_id long, text string, mode string")
    seen = temporal.Requests(modalities=spark.createDataFrame([(0, "visual", "zzz", "s", [1.0, 0.0])], "query_id long, modality string, text string, space string, vector array<double>"))
    spoken = spark.createDataFrame([(0, "", "auto")], creative.schema)
    assert {r["id"] for r in search.search(spoken, timed, requests=seen).collect()} == {1, 3}
    with pytest.raises(ValueError, match="recordings"):
        from dataclasses import replace

        search.search(queries, replace(timed, recordings=None), requests=requests)


def test_refused_requests(spark, timed):
    fine = (0, "a", "sound_event", "rain")
    for conditions, predicates in (
        ([(0, "a", "smell", "x")], ()),
        ([(0, "a", "speaker", "x")], ()),
        ([fine, fine], ()),
        ([fine, (0, " ", "sound_event", "x")], ()),
        ([(0, str(i), "sound_event", "x") for i in range(9)], ()),
        ([(0, "a", "sound_event", " ")], ()),
        ([fine], [(0, "p", "a", "before", "a", 0)]),
        ([fine], [(0, "p", "a", "near", "a", 1)]),
        ([fine], [(0, "p", "a", "during", "z", 1)]),
        ([fine], [(1, "p", "a", "during", "a", 1)]),
    ):
        with pytest.raises(ValueError):
            temporal.check_requests(asked(spark, conditions, predicates))
    rows = spark.createDataFrame([(0, "a", "visual", "x", None, [1.0])], CONDITION)
    with pytest.raises(ValueError, match="vector"):
        temporal.check_requests(temporal.Requests(conditions=rows))


def test_likeness(spark, timed):
    queries = spark.createDataFrame([(0, "umbrella", "similar"), (1, "umbrella", "similar"), (2, "umbrella", "semantic")], "query_id long, text string, mode string")
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (2, [1.0, 0.0])], "query_id long, vector array<double>")
    rows = search.search(queries, timed, vectors=vectors).orderBy("query_id", "place").collect()
    assert [(r["id"], round(r["score"], 3)) for r in rows if r["query_id"] == 0] == [(1, 1.0), (5, 0.8), (6, 0.707)]  # by vectors of its width, all of them
    assert {r["id"] for r in rows if r["query_id"] == 1} == {5, 6}  # no vector: by hashed features
    assert 1 in {r["id"] for r in rows if r["query_id"] == 2}  # the embedding channel takes part, down to 0.8 of its best
    assert {r["id"] for r in search.embedding_channel(vectors.where("query_id = 2"), timed.text_vectors, 10).collect()} == {1, 5}
    for bad in ([], [0.0, 0.0], [float("nan"), 1.0], None):
        with pytest.raises(ValueError, match="invalid query vector"):
            search.check_vectors(spark.createDataFrame([(0, bad)], "query_id long, vector array<double>"))
    near = search.similar_to(spark.createDataFrame([(1,)], "id long"), timed).collect()
    assert {r["id"] for r in near} == {5, 6}
    only = timed.shots.where("id IN (6, 9)").select("id")
    assert [r["id"] for r in search.search(queries.where("query_id = 0"), timed, vectors=vectors, allowed=only).collect()] == [6]


def test_filters_keep_the_whole_universe(spark, timed):
    only = timed.shots.where("id IN (3, 8, 9)").select("id")
    frame = spark.createDataFrame([(0, "zebra crossing", "semantic")], "query_id long, text string, mode string")
    assert search.search(frame, timed).count() == 0
    assert {r["id"] for r in search.search(frame, timed, allowed=only).collect()} == {3, 8, 9}


def test_many_queries_are_shuffled(spark, library, monkeypatch):
    """A table of queries beyond what may be broadcast gives what a small one does."""
    from cinequarry.operators import lexical
    from cinequarry.plans import broadcasts

    texts = ["train", "beach without people", "umbrella", "“meet again”", "“你好”", "给我找 umbrella", "table"]
    few = found(spark, library, texts)[0]
    monkeypatch.setattr(broadcasts, "MOST_ROWS", 2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert found(spark, library, texts)[0] == few
        plan = lexical.search_index(library.index, lexical.phrases(spark.createDataFrame([(i, "train") for i in range(5)], "query_id long, text string")))._jdf.queryExecution().toString()
        assert "BroadcastHashJoin" not in plan and "BroadcastNestedLoopJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.undo()
    many = spark.range(100_000).selectExpr("id AS query_id", "CASE WHEN id % 1000 = 0 THEN 'train' ELSE concat('word', id) END AS text")
    hits = lexical.search_index(library.index, lexical.phrases(many)).groupBy("id").count().collect()
    assert [tuple(r) for r in hits] == [(1, 100)]


def test_request_rules():
    condition = {"id": "a", "modality": "visual", "query": "x"}
    fine = {"modalities": ["visual"], "temporal": {"conditions": [condition, condition | {"id": "b"}], "predicates": [{"id": "p", "left": "a", "relation": "before", "right": "b", "max_gap_ms": 5}]}}
    search.check_request(fine)
    search.check_request({"modalities": ["speaker"], "speaker_filter": {"profile_id": "x"}})
    search.check_request({"modalities": ["speaker"], "speaker_filter": {"asset_id": "x", "generation": "g", "speaker": "s"}})
    for bad in (
        {"reference_id": "r", "visual_shot_id": "s"},
        {"modalities": ["smell"]},
        {"modalities": ["speaker"]},
        {"modalities": ["speaker"], "speaker_filter": {"asset_id": "x", "profile_id": "y"}},
        {"temporal": {"conditions": [condition] * 2}},
        {"temporal": {"conditions": [condition | {"id": str(i)} for i in range(9)]}},
        {"temporal": {"conditions": [condition | {"query": " "}]}},
        {"temporal": {"conditions": [condition], "predicates": [{"id": "p", "left": "a", "relation": "before", "right": "a", "max_gap_ms": 0}]}},
        {"temporal": {"conditions": [condition], "predicates": [{"id": "p", "left": "a", "relation": "near", "right": "a"}]}},
        {"temporal": {"conditions": [condition], "predicates": [{"id": "p", "left": "a", "relation": "during", "right": "z"}]}},
    ):
        with pytest.raises(ValueError):
            search.check_request(bad)
    assert search.request_fingerprint("abc") == "abc" and len(search.request_fingerprint("abc", "{}")) == 16


def test_phrase_rule():
    spans = [("hello", 0, 100), ("big", 200, 300), ("world", 400, 500), ("你", 600, 700), ("好", 800, 900), ("吗", 3000, 3100)]
    assert speech.follows(["hello", "world"], spans) and speech.follows(["你好"], spans) and speech.follows(["world", "你好"], spans)
    assert not speech.follows(["你好吗"], spans) and not speech.follows(["world", "hello"], spans) and not speech.follows(["hello", "吗"], spans) and not speech.follows(["好你"], spans)


def test_speech_sources(spark):
    segments = spark.createDataFrame([(1, 0, 0, 900, "Hi 你好"), (2, 0, 5, 6, "x")], "asset long, ordinal long, start_ms long, end_ms long, text string")
    assert [(r["asset"], r["ordinal"], r["text"]) for r in speech.expanded(segments).orderBy("asset", "ordinal").collect()] == [(1, 0, "hi"), (1, 1, "你"), (1, 2, "好"), (2, 0, "x")]
    words = spark.createDataFrame([(2, 0, 0, 5, " aligned "), (2, 1, 5, 5, "gone")], segments.schema)
    assert {(r["asset"], r["text"]) for r in speech.spoken(words, speech.expanded(segments)).collect()} == {(1, "hi"), (1, "你"), (1, "好"), (2, " aligned "), (2, "gone")}
    assert [tuple(r) for r in speech.aligned_transcript(words).collect()] == [(2, "aligned")]
    windows = spark.createDataFrame([(1, 10, 0, 500), (1, 11, 500, 2000)], "asset long, window long, start_ms long, end_ms long")
    assert sorted(tuple(r) for r in speech.sliced(segments, windows).collect()) == [(10, 0, 0, 500, "Hi 你好"), (11, 0, 0, 400, "Hi 你好")]


def test_sound_words_and_consent(spark):
    queries = spark.createDataFrame([(1, "a Car Horn in the rain"), (2, "train"), (3, "雷声 and dogs"), (4, "raindrops, hotdogs")], "query_id long, text string")
    got: dict[int, set] = {}
    for r in modalities.sound_labels(spark, queries).collect():
        got.setdefault(r["query_id"], set()).add(r["label"])
    assert got == {1: {"/m/0912c9", "/m/06mb1"}, 3: {"/m/0ngt1", "/m/0bt9lr"}}
    with pytest.raises(PermissionError):
        modalities.speaker_matches(queries, False, profile=1)


def test_large_sides_are_never_broadcast(spark, library):
    """Files of rows that compress well are small, their rows in the driver aren't."""
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    queries = spark.createDataFrame([(1, "red car")], "query_id long, text string")
    assert "SortMergeJoin" in plan(search.semantic_channel(queries, library))
    many = spark.range(20)
    assert "BroadcastExchange" in plan(spark.range(100).join(checked(many, 20), "id"))
    assert "BroadcastExchange" not in plan(spark.range(100).join(checked(many, 19), "id"))
