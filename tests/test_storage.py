"""Scans over time, media folders as a source, edit lists as a sink, and leases as a stream."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from cinequarry.operators import browse, quality, scans
from cinequarry.plans import scratch
from cinequarry.sources import edl, media
from cinequarry.streaming import jobs

FILE = "root string, path string, absolute string, fingerprint string, size long, modified_ns long"


def test_scans_over_time(spark, tmp_path):
    home = str(tmp_path / "library")
    files = lambda *rows: spark.createDataFrame([(root, p, f"/{root}/{p}", f, 1, m) for root, p, f, m in rows], FILE)
    roots = lambda *names: spark.createDataFrame([(n,) for n in names], "root string")
    told = lambda changes: {(r["root"], r["path"]): (r["change"], r["affected"]) for r in changes.collect()}
    one = told(scans.scan_into(home, files(("a", "x", "f1", 1), ("a", "y", "f2", 1), ("a", "y2", "f2", 1), ("a", "z", "f3", 1), ("a", "w", "f4", 1)), roots("a")))
    assert one == {("a", "x"): ("created", True), ("a", "y"): ("created", True), ("a", "y2"): ("added", True), ("a", "z"): ("created", True), ("a", "w"): ("created", True)}
    # x is touched, z moves to q, w is replaced by another file, y2 goes; in another root lie copies of f1 and a new file.
    two = told(scans.scan_into(home, files(("a", "x", "f1", 2), ("a", "y", "f2", 1), ("a", "q", "f3", 1), ("a", "w", "f5", 1), ("b", "x", "f1", 9), ("b", "n", "f6", 1)), roots("a", "b")))
    assert two == {("a", "x"): ("touched", True), ("a", "y"): ("unchanged", False), ("a", "y2"): ("missing", False), ("a", "z"): ("missing", False), ("a", "q"): ("moved", True), ("a", "w"): ("replaced", False), ("b", "x"): ("added", False), ("b", "n"): ("created", True)} | {("a", "w"): ("replaced", True)}
    # y2 comes back, all of root a but y and y2 is gone, and b isn't scanned; y lies under another mount.
    remount = files(("a", "y2", "f2", 1)).unionByName(spark.createDataFrame([("a", "y", "/elsewhere/y", "f2", 1, 1)], FILE))
    three = told(scans.scan_into(home, remount, roots("a")))
    assert three == {("a", "x"): ("missing", False), ("a", "y"): ("remounted", True), ("a", "y2"): ("returned", True), ("a", "q"): ("missing", False), ("a", "w"): ("missing", False), ("a", "z"): ("unchanged", False)}
    version, state = scans.load(spark, home)
    assert version == 3
    live = lambda at=None: {(r["root"], r["path"], r["modified_ns"]) for r in scans.current(state, at).where("present").collect()}
    assert live() == {("a", "y", 1), ("a", "y2", 1), ("b", "x", 9), ("b", "n", 1)}
    assert live(1) == {("a", p, 1) for p in ("x", "y", "y2", "z", "w")} == {(r["root"], r["path"], r["modified_ns"]) for r in scans.current(scans.load(spark, home, 1)[1]).collect()}
    assert live(2) == {("a", "x", 2), ("a", "y", 1), ("a", "q", 1), ("a", "w", 1), ("b", "x", 9), ("b", "n", 1)}
    own = {r["fingerprint"]: (r["present"], r["missing_since"], r["root"], r["path"]) for r in scans.assets(state).collect()}
    assert own == {"f1": (True, None, "b", "x"), "f2": (True, None, "a", "y"), "f3": (False, 3, None, None), "f4": (False, 2, None, None), "f5": (False, 3, None, None), "f6": (True, None, "b", "n")}
    overlaps = state.alias("p").join(state.alias("q"), F.expr("p.root = q.root AND p.path = q.path AND p.since < q.since AND (p.until IS NULL OR p.until > q.since)"))
    assert overlaps.count() == 0
    with pytest.raises(RuntimeError, match="another writer"):
        scans.publish(state, home, 3)


def test_media_folder(spark, tmp_path):
    media.register(spark)
    for name, size in (("a.mov", 5), ("one/b.MP4", 50), ("one/deep/c.mov", 500), ("two/d.txt", 7), ("two/empty.mov", 0), ("two/noext", 3), ("two/.hid.mov", 4)):
        (tmp_path / "m" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "m" / name).write_bytes(b"x" * size)
    os.symlink(tmp_path / "m" / "one", tmp_path / "m" / "loop")
    read = lambda **options: spark.read.format("media_files").options(path=str(tmp_path / "m"), **options).load()
    names = lambda df: sorted(os.path.basename(r["path"]) for r in df.collect())
    every = read()
    assert names(every) == [".hid.mov", "a.mov", "b.MP4", "c.mov", "d.txt", "noext"] and every.rdd.getNumPartitions() == 3
    assert names(read(extensions="mov, mp4")) == [".hid.mov", "a.mov", "b.MP4", "c.mov"]
    large = every.where("size > 5 AND extension IN ('mov', 'mp4') AND path LIKE '%m%'")
    assert names(large) == ["b.MP4", "c.mov"] and names(every.where("extension = ''")) == ["noext"]
    reader = media.MediaReader(str(tmp_path / "m"), [])
    left = list(reader.pushFilters([media.GreaterThan(("size",), 5), media.In(("extension",), ("mov",)), media.EqualTo(("other",), 1)]))
    assert len(left) == 1 and sorted(r[1] for p in reader.partitions() for r in reader.read(p)) == [500]
    with pytest.raises(Exception, match="path"):
        spark.read.format("media_files").load().count()


def test_new_media_files_as_a_stream(spark, tmp_path):
    media.register(spark)
    (tmp_path / "m" / "sub").mkdir(parents=True)

    def put(name, second):
        (tmp_path / "m" / name).write_bytes(b"x")
        os.utime(tmp_path / "m" / name, (second, second))

    def run():
        stream = spark.readStream.format("media_files").options(path=str(tmp_path / "m"), extensions="mov").load()
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return sorted(os.path.basename(r["path"]) for r in spark.read.schema(media.FILES).parquet(str(tmp_path / "out")).collect())

    put("a.mov", 1000)
    put("sub/b.mov", 2000)
    put("sub/skip.txt", 2500)
    assert run() == ["a.mov", "b.mov"]
    put("sub/c.mov", 3000)
    assert run() == ["a.mov", "b.mov", "c.mov"] == run()


def test_edit_lists_are_written_whole(spark, tmp_path):
    out = tmp_path / "lists"
    out.mkdir()
    cuts = spark.createDataFrame([(f"list {k}/é", p, f"clip{p}", 0, 1000 * p) for k in range(5) for p in range(1, 8)], "list string, position long, clip string, start_ms long, end_ms long")
    lines = edl.edl(cuts, "list")
    media.write_edit_lists(lines, "list", str(out))
    assert sorted(os.listdir(out)) == [f"list%20{k}%2F%C3%A9.edl" for k in range(5)]
    want = [r["line"] for r in lines.where("list = 'list 3/é'").orderBy("line_no").collect()]
    assert (out / "list%203%2F%C3%A9.edl").read_bytes().decode() == "".join(f"{line}\r\n" for line in want)
    before = {n: (out / n).read_bytes() for n in os.listdir(out)}
    with pytest.raises(Exception, match="is there already"):
        media.write_edit_lists(lines.withColumn("line", F.lit("x")), "list", str(out))
    broken = lines.withColumn("line", F.when((F.col("list") == "list 2/é") & (F.col("line_no") == 5), F.raise_error(F.lit("a bad line"))).otherwise(F.col("line")))
    with pytest.raises(Exception, match="a bad line"):
        media.write_edit_lists(broken, "list", str(out), overwrite=True)
    assert {n: (out / n).read_bytes() for n in os.listdir(out)} == before  # neither a part of a list nor a trace
    media.write_edit_lists(lines.where("line_no < 3"), "list", str(out), overwrite=True)
    assert all((out / n).read_text().count("\n") == 2 for n in before)


def lease_events(r, n):
    out = []
    for j in range(n):
        at, seq = r.randrange(0, 600), 0
        for _ in range(r.randint(1, 9)):
            kind = r.choice(["enqueue", "lease", "lease", "lease", "renew", "renew", "defer", "done", "fail"])
            out.append((f"j{j}", seq, kind, at, at + r.randrange(1, 400) if kind in ("lease", "renew", "defer") else None))
            seq, at = seq + 1, at + r.randrange(1, 500)
    return out


def frame(spark, rows):
    made = spark.createDataFrame(rows, "job string, seq long, kind string, at_s long, until_s long")
    return made.select("job", "seq", "kind", F.timestamp_seconds("at_s").alias("at"), F.timestamp_seconds("until_s").alias("until"))


def test_leases_as_a_stream(spark, tmp_path):
    """Late, repeated and expired events, in several batches, against the table of all events and a plain account."""
    r = random.Random(22)
    rows = lease_events(r, 120)
    source, end = tmp_path / "in", 10_000
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = frame(spark, rows[:1]).schema
    batches = [[x for x in rows if low <= x[3] < low + 400] for low in range(0, 4800, 400)]
    batches[2] += batches[1]  # a batch that comes twice
    seen: list = []
    for i, own in enumerate([*batches, [("clock", 0, "enqueue", end + 5000, None)], [("clock", 1, "enqueue", end + 5001, None)]]):
        frame(spark, own).coalesce(1).write.mode("append").parquet(str(source))
        stream = jobs.stream_leases(spark.readStream.schema(schema).parquet(str(source)), late="1000 seconds", most=3)
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination() if i in (1, 3, 6, 11, 12, 13) else seen.append(i)
    told = lambda df: sorted((x["job"], x["at"], x["change"], x["attempts"]) for x in df.where("job <> 'clock'").collect())
    got = told(spark.read.schema(jobs.CHANGES).parquet(str(tmp_path / "out")))
    assert got == told(jobs.lease_changes(frame(spark, rows), end * 1000, most=3)) and {g[2] for g in got} == {"leased", "deferred", "ready", "expired", "failed", "done", "terminal"}
    assert jobs.lease_changes(frame(spark, rows + rows), end * 1000, most=3).count() == len(got)  # repeated rows change nothing


def test_lease_rules():
    run = lambda *events, now=10**9: [*jobs.replay(job := jobs.Job(), events, 2), *jobs.advance(job, now, 2)]
    assert run((0, 0, "lease", 100), (1, 50, "renew", 200), (2, 150, "done", None)) == [(0, "leased", 0), (150, "done", 0)]
    assert run((0, 0, "lease", 100), (1, 150, "done", None)) == [(0, "leased", 0), (100, "expired", 1)]  # done came too late
    assert run((0, 0, "lease", 100), (1, 200, "lease", 300)) == [(0, "leased", 0), (100, "expired", 1), (200, "leased", 1), (300, "expired", 2), (300, "terminal", 2)]
    assert run((0, 0, "defer", 100), now=99) == [(0, "deferred", 0)] and run((0, 0, "defer", 100))[1] == (100, "ready", 0)


def test_partitions_grow_with_the_rows(spark, monkeypatch):
    """However many rows there are, a task has a bounded number of them."""
    for module, name in ((scratch, "SHARE_ROWS"), (scans, "SHARE"), (browse, "SPANS"), (quality, "MATCHED"), (quality, "SWEPT")):
        monkeypatch.setattr(module, name, 10, raising=False)
    tags = spark.createDataFrame([(q, "ring") for q in range(4)], "query_id long, tag string")
    links = spark.createDataFrame([(a, "ring", 1) for a in range(50)], "asset long, raw string, tag_id int")
    none = spark.createDataFrame([], "tag_id int, name string, alias string")
    tagged = browse.tagged_assets(tags, links, none, none)
    assert tagged.count() == 200 and tagged.rdd.getNumPartitions() == 20

    spans = spark.createDataFrame([(a, a + s, s, s + 5) for a in range(30) for s in (0, 10)] + [(0, 99, None, 5)], "asset long, id long, start_ms long, end_ms long")
    fresh = spark.createDataFrame([(a, 0, 5 + a % 2, -1) for a in range(20)] + [(0, None, 5, -2)], "asset long, start_ms long, end_ms long, new_id long")
    replaced = browse.replace_shots(spans, fresh)
    assert replaced.rdd.getNumPartitions() == 7
    count = {r["change"]: r["count"] for r in replaced.groupBy("change").count().collect()}
    assert count == {"kept": 10, "created": 11, "removed": 31}  # a span without a start equals no other

    scan = spark.createDataFrame([("r", f"p{i}", f"/p{i}", f"f{i % 5}", 1, 1) for i in range(60)], "root string, path string, absolute string, fingerprint string, size long, modified_ns long")
    roots = spark.createDataFrame([("r",)], "root string")
    state, changes = scans.apply_scan(scans.empty_state(spark), scan, roots, 1)
    assert {r["change"]: r["count"] for r in changes.groupBy("change").count().collect()} == {"created": 5, "added": 55}
    after, changes = scans.apply_scan(scratch.settle(state), scan.where("fingerprint = 'f0'"), roots, 2)
    assert {r["change"]: r["count"] for r in changes.groupBy("change").count().collect()} == {"unchanged": 12, "missing": 48}
    assert after.where("until IS NULL AND NOT present").count() == 48 and after.rdd.getNumPartitions() >= 7

    events = spark.createDataFrame([(u, i, 10 * i, 10 * i + 8) for u in range(4) for i in range(20)], "user long, id long, start_ms long, end_ms long")
    matches = quality.match_events(events, events, ["user"])
    assert matches.where("prediction = truth").count() == 80 == matches.count() and matches.rdd.getNumPartitions() == 8
    turns = spark.createDataFrame([(a, str(i % 2), 1000 * i, 1000 * i + 900) for a in range(15) for i in range(4)], "asset long, speaker string, start_ms long, end_ms long")
    rates = quality.diarization_error(turns, turns, spark.createDataFrame([(a, 4000) for a in range(15)], "asset long, duration_ms long"))
    assert rates.where("der_with_overlap = 0").count() == 15 and rates.rdd.getNumPartitions() == 6
