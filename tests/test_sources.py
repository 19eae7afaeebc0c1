"""Corpora, reference images, and index refresh on files and small tables."""

from __future__ import annotations

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cinequarry.functions.text import ascii_tokens, pieces
from cinequarry.operators import lexical, quality, segments
from cinequarry.plans import scratch
from cinequarry.sources import ingest


def test_corpus(spark, tmp_path):
    (tmp_path / "clips").mkdir()
    (tmp_path / "clips" / "a.mp4").write_bytes(b"x")
    truth = {"queries": [{"query": "rain", "language": "en", "intent": "fact", "expected": [{"asset": "a.mp4", "start_ms": 0, "end_ms": 5}, {"asset": "b.mp4", "start_ms": 1, "end_ms": 2}]}, {"query": "nothing", "expected": []}]}
    (tmp_path / "ground_truth.json").write_text(json.dumps(truth, indent=1))
    got = {(r["query"], r["asset"], r["start_ms"], r["missing"]) for r in ingest.corpus(spark, str(tmp_path)).collect()}
    assert got == {("rain", "a.mp4", 0, False), ("rain", "b.mp4", 1, True), ("nothing", None, None, False)}


def test_references_expire(spark):
    rows = spark.createDataFrame([("a", 10, 5_000, "old"), ("a", 12, 5_000, "new"), ("b", 1, 2_000, "gone")], "id string, s long, ttl_ms long, image string").withColumn("created", F.timestamp_seconds("s")).drop("s")
    assert [(r["id"], r["image"]) for r in ingest.live_references(rows, F.timestamp_seconds(F.lit(16))).collect()] == [("a", "new")]
    assert ingest.live_references(rows, F.timestamp_seconds(F.lit(17))).count() == 0


def test_index_refresh_and_phrases(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the red ring of fire"), (2, "ring the red bell"), (3, "雨夜街道 rain")], "id long, t string")
    fields = {"body": F.flatten(lexical.chunks("t"))}
    index = lexical.write_index(docs, "id", fields, str(tmp_path / "one"))
    ask = lambda *texts: lexical.phrases(spark.createDataFrame(list(enumerate(texts)), "query_id long, text string"))
    found = lambda i, *texts: sorted((r["query_id"], r["id"]) for r in lexical.search_index(i, ask(*texts)).collect())
    assert found(index, "red ring", "夜街", "雨街", "bell rain", "") == [(0, 1), (0, 2), (1, 3)]
    two = spark.createDataFrame([(0, 0, 0, "red"), (0, 0, 1, "ring")], "query_id long, phrase int, place int, token string")
    assert [r["id"] for r in lexical.search_index(index, two).collect()] == [1]
    later = lexical.refresh_index(index, docs.where("id = 2").withColumn("t", F.lit("red ring")), fields)
    assert sorted(r["id"] for r in lexical.search_index(later, two).collect()) == [1, 2]
    assert lexical.open_index(spark, str(tmp_path / "one")).lengths.count() == 3
    flat = lexical.search_index(index, ask("red ring"), {"body": 1.0}).collect()
    assert {r["id"]: r["score"] for r in flat} == {r["id"]: r["score"] for r in lexical.search_index(index, ask("red ring")).collect()}
    assert not any(r["score"] for r in lexical.search_index(index, ask("red ring"), {"body": -3.0}).collect())


def made_docs(spark, seed, ids):
    r = random.Random(seed)
    words = [f"w{int(r.paretovariate(0.7))}" for _ in range(4000)]
    return spark.createDataFrame([(i, " ".join(r.choices(words, k=r.choice([0, 1, r.randrange(200)])))) for i in ids], "id long, t string").repartition(4)


def test_segments(spark, tmp_path):
    """Versions, tombstones and merging: every version answers as an index of its rows would."""
    fields = {"body": ascii_tokens("t")}
    base = made_docs(spark, 1, range(600))
    index = lexical.write_index(base, "id", fields, str(tmp_path / "own"))
    changed, gone = made_docs(spark, 2, [*range(100, 106), 600]), spark.createDataFrame([(7,), (8,), (99_999,)], "id long")
    later = lexical.refresh_index(index, changed, fields, removed=gone)
    assert [s.n for s in later.segments] == [600, 7] and later.version == index.version + 1
    assert later.segments[1].rows < 0.03 * later.segments[0].rows and later.segments[0] == index.segments[0]  # what was there is not written again
    now = base.join(changed, "id", "left_anti").join(gone, "id", "left_anti").unionByName(changed)
    asked = spark.createDataFrame([(1, 0, 0, "w1"), (2, 0, 0, "w2"), (2, 1, 0, "w1"), (3, 0, 0, "w17"), (4, 0, 0, "nothing")], "query_id long, phrase int, place int, token string")
    told = lambda i: {(r["query_id"], r["id"]): round(r["score"], 9) for r in lexical.search_index(i, asked).collect()}
    fresh = lexical.write_index(now, "id", fields, str(tmp_path / "fresh"))
    assert told(later) == told(fresh) and (later.n, later.length) == (fresh.n, fresh.length) == (599, fresh.length)
    assert sorted(tuple(r) for r in later.lengths.collect()) == sorted(tuple(r) for r in fresh.lengths.collect())
    merged = segments.compact(later)
    assert len(merged.segments) == 1 and told(merged) == told(fresh) and (merged.n, merged.length) == (fresh.n, fresh.length)
    # A reader of the first version still sees it; a writer who follows an old version is refused.
    assert told(lexical.open_index(spark, index.path, index.version)) == told(index) != told(fresh)
    with pytest.raises(RuntimeError, match="another writer"):
        lexical.refresh_index(index, changed, fields)
    segments.vacuum(merged)
    assert told(lexical.open_index(spark, index.path)) == told(fresh)
    with pytest.raises(FileNotFoundError):
        lexical.open_index(spark, index.path, index.version)
    again = merged
    for i in range(3):  # large refreshes merge by themselves
        again = lexical.refresh_index(again, made_docs(spark, 3 + i, range(400)), fields)
    assert len(again.segments) <= 2 and again.n == 599 + 2
    empty = lexical.write_index(base.limit(0), "id", fields, str(tmp_path / "empty"))
    assert empty.n == 0 and told(empty) == {}


def test_blocks_give_the_best_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "HEAVY", 20)
    fields = {"body": ascii_tokens("t"), "title": F.slice(ascii_tokens("t"), 1, 3)}
    base = made_docs(spark, 1, range(3000))
    index = lexical.write_index(base, "id", fields, str(tmp_path / "one"))
    changed = made_docs(spark, 5, range(40))
    for own in (index, lexical.refresh_index(index, changed, fields, removed=spark.createDataFrame([(50,)], "id long"))):
        asked = spark.createDataFrame([(1, "w1"), (2, "w1"), (2, "w2"), (3, "w3"), (3, "w5"), (4, "w40"), (5, "nothing"), (5, "w1")], "query_id long, token string")
        phrased = asked.withColumns({"phrase": F.dense_rank().over(Window.partitionBy("query_id").orderBy("token")), "place": F.lit(0)})
        for weights in (None, {"title": 2.5, "body": 0.8}):
            every = lexical.top(lexical.search_index(own, phrased, weights), "id", 10)
            best, reading = lexical.top_index(own, asked, 10, weights)
            want = {(r["query_id"], r["rank"]): (r["id"], round(r["score"], 9)) for r in every.collect()}
            assert {(r["query_id"], r["rank"]): (r["id"], round(r["score"], 9)) for r in best.collect()} == want
            assert 0 < reading.read < reading.there
    one, reading = lexical.top_index(index, asked.where("query_id = 1"), 10)
    assert reading.read < 0.5 * reading.there


def test_suite_evidence(spark):
    results = spark.createDataFrame([(1, 5, 1)], "query_id long, id long, rank long")
    judged = spark.createDataFrame([(1, 5, 2), (1, 6, 1), (2, 7, 0)], "query_id long, id long, grade long")
    queries = spark.createDataFrame([(1, "fact", "fact", False), (2, "speech", "fact", True)], "query_id long, expected_intent string, intent string, expected_empty boolean")
    proof = spark.createDataFrame([(1, 5, "a", "confirmed", "confirmed"), (1, 5, "b", "possible", "unknown"), (1, 5, "c", "unknown", "unknown")], "query_id long, id long, value string, state string, expected string")
    row = quality.relevance_suite(results, judged, queries, proof).first()
    assert (row["recall"], row["precision"], row["empty_rate"], row["empty_accuracy"], row["intent_accuracy"], row["not_relevant_hits"]) == (0.5, 0.05, 0.5, 1.0, 0.5, 0)
    assert row["evidence_correct"] == pytest.approx(2 / 3) and row["evidence_precision"] == 0.5


def test_scratch_is_deleted(spark):
    before = scratch.written(spark)
    table = scratch.settle(spark.range(5))
    assert table.count() == 5
    own = [p for p in scratch.written(spark) if p not in before]
    scratch.discard(spark, [*own, "/somewhere/else"])
    assert scratch.written(spark) == before
    with pytest.raises(Exception, match="(?i)file|path"):
        spark.read.parquet(own[0]).count()


def test_bm25_without_an_index_is_that_of_one(spark):
    docs = spark.createDataFrame([(i, f"word{i % 3} word{i % 5} the the") for i in range(40)], "id long, t string")
    terms = spark.createDataFrame([(1, "word1"), (1, "the"), (2, "word4")], "query_id long, term string")
    plain = {(r["query_id"], r["id"]): round(r["score"], 9) for r in lexical.bm25(docs, "id", {"t": ascii_tokens("t")}, terms).collect()}
    index = lexical.write_index(docs, "id", {"t": ascii_tokens("t")}, scratch.scratch_path(spark))
    asked = terms.select("query_id", F.xxhash64("term").alias("phrase"), F.lit(0).alias("place"), F.col("term").alias("token"))
    assert plain == {(r["query_id"], r["id"]): round(r["score"], 9) for r in lexical.search_index(index, asked).collect()} and plain


def test_postings_are_made_in_slices():
    lists = pa.array([["a"] * n for n in (3, 0, 5, 1, 1, 9, 2)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), lists, lists], names=["id", "x", "y"])
    parts = list(segments.slices(batch, ["x", "y"], 10))
    assert [p.column("id").to_pylist() for p in parts] == [[0, 1], [2], [3, 4], [5], [6]]
    assert [p.num_rows for p in pieces([batch, batch], 3)] == [3, 3, 1, 3, 3, 1]


def test_partitions_of_an_index_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "SHARE_ROWS", 100)
    index = lexical.write_index(made_docs(spark, 1, range(300)), "id", {"body": ascii_tokens("t")}, str(tmp_path / "one"))
    sizes = [r["count"] for r in index.table("postings").groupBy(F.spark_partition_id().alias("p"), F.input_file_name()).count().collect()]
    assert sum(sizes) > 1000 and max(sizes) < 400
    phrase = spark.createDataFrame([(1, 0, 0, "w1")], "query_id long, phrase int, place int, token string")
    assert {r["id"] for r in lexical.search_index(index, phrase).collect()} == {r["id"] for r in index.postings.where("token = 'w1'").collect()}
