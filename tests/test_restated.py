"""Queries whose result depends on an order of choices, against plain restatements over the whole tables."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cinequarry.catalog import QUERIES
from cinequarry.operators import browse, modalities


@pytest.fixture(scope="module")
def read(sf):
    return lambda name: pd.read_parquet(f"{sf}/{name}.parquet")


def span(row):
    start = row.ts.value // 1_000_000
    return start, start + 1_800_000


def iou(a, b):
    shared = max(0, min(a[1], b[1]) - max(a[0], b[0]))
    return shared / ((a[1] - a[0]) + (b[1] - b[0]) - shared)


def test_diversity(spark, sf, read):
    rows = read("embeddings").dropna(subset=["embedding"])
    unit = np.stack(rows["embedding"].to_numpy()).astype(float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    ids, label = rows["vec_id"].to_numpy(), dict(zip(rows["vec_id"], rows["label"], strict=True))
    got = defaultdict(list)
    for r in QUERIES["diversity"](spark, sf).orderBy("query_id", "place").collect():
        got[r["query_id"]].append((r["id"], round(r["score"], 5)))
    for q in ids[ids % 20 == 0].tolist():
        scores = np.round(unit @ unit[ids == q][0], 6)
        pool = sorted(((-s, i) for s, i in zip(scores.tolist(), ids.tolist(), strict=True) if i != q and s > 0))[:60]
        chosen: list[tuple[float, int]] = []
        scale = -pool[0][0]
        for minus, i in pool:
            own = [c for _, c in chosen if label[c] == label[i]]
            if any(abs(c - i) * 700 <= 5000 for c in own):
                continue
            kin = sum(label[c] != label[i] and label[c] % 5 == label[i] % 5 for _, c in chosen)
            score = max(0.0, -minus - scale * (0.25 * len(own) + 0.2 * kin))
            chosen.insert(sum(s >= score for s, _ in chosen), (score, i))
            chosen = chosen[:20]
        assert got[q] == [(i, round(s, 5)) for s, i in chosen], q


def greedy(events, predicted, actual):
    """Matches of one user: each prediction in order takes the best free truth."""
    used, out = set(), []
    for p in sorted(events[events.event_type == predicted].itertuples(), key=lambda r: (*span(r), r.event_id)):
        best = max(((iou(span(p), span(t)), -span(t)[0], -t.event_id, t) for t in events[events.event_type == actual].itertuples() if t.event_id not in used and iou(span(p), span(t)) >= 0.5), default=None, key=lambda x: x[:3])
        if best:
            used.add(best[3].event_id)
            out.append((p, best[3], best[0]))
    return out


def test_event_matching(spark, sf, read):
    found = [m for _, own in read("events").groupby("user_id") for m in greedy(own, "click", "view")]
    assert {(r["prediction"], r["truth"]) for r in QUERIES["event_matches"](spark, sf).collect()} == {(p.event_id, t.event_id) for p, t, _ in found} and found
    row = QUERIES["event_f1"](spark, sf).first()
    counts = read("events")["event_type"].value_counts()
    assert row["micro_f1"] == pytest.approx(2 * len(found) / (counts["click"] + counts["view"]))
    assert row["boundary_error_ms"] == pytest.approx(np.mean([abs(span(p)[0] - span(t)[0]) for p, t, _ in found]))
    by_user = defaultdict(int)
    for p, _, _ in found:
        by_user[p.user_id] += 1
    events = read("events")
    f1 = [2 * n / (events[(events.user_id == u) & events.event_type.isin(["click", "view"])].shape[0]) for u, n in by_user.items()]
    assert row["macro_f1"] == pytest.approx(np.mean(f1))


def test_interval_quality(spark, sf, read):
    got = {r["query_id"]: (r["precision"], r["recall"], r["ndcg"]) for r in QUERIES["interval_quality"](spark, sf).collect()}
    for user, own in read("events").groupby("user_id"):
        ranked = sorted(own[own.event_type == "click"].itertuples(), key=lambda r: (not pd.notna(r.value), -r.value if pd.notna(r.value) else 0, r.event_id))[:10]
        good = sorted(own[own.event_type.isin(["view", "purchase"])].itertuples(), key=lambda r: r.event_id)
        grade = lambda g: 2 if g.event_type == "purchase" else 1
        used, hits, dcg = set(), 0, 0.0
        for rank, r in enumerate(ranked, 1):
            for g in good:
                if g.event_id not in used and iou(span(r), span(g)) >= 0.5:
                    used.add(g.event_id)
                    hits, dcg = hits + 1, dcg + (2 ** grade(g) - 1) / math.log2(rank + 1)
                    break
        ideal = sum((2**g - 1) / math.log2(k + 1) for k, g in enumerate(sorted(map(grade, good), reverse=True)[:10], 1))
        if good:
            assert got[user] == pytest.approx((hits / 10, hits / len(good), dcg / ideal)), user


def test_section_plan(spark, sf, read):
    nations, customers = read("nation"), read("customer")
    got = defaultdict(list)
    for r in QUERIES["section_plan"](spark, sf).orderBy("plan", "section", "place").collect():
        got[r["plan"], r["section"]].append((r["place"], r["shot"], r["reused"], r["missing"]))
    hits = defaultdict(list)
    for c in customers.itertuples():
        hits[f"q{c.c_nationkey % 7}"].append((-math.copysign(math.floor(abs(c.c_acctbal) / 1000 + 0.5) * 1000, c.c_acctbal), c.c_custkey))
    for plan, own in nations.groupby("n_regionkey"):
        used = set()
        for n in own.sort_values("n_nationkey").itertuples():
            found = [s for _, s in sorted(hits[f"q{n.n_nationkey % 10}"])]
            picks = [(s, False) for s in found if s not in used][:3]
            used.update(s for s, _ in picks)
            required = n.n_nationkey % 2 == 0
            if not picks and required and found:
                picks = [(found[0], True)]
            want = [(i, s, reused, False) for i, (s, reused) in enumerate(picks, 1)] or [(0, None, False, required)]
            assert got[plan, n.n_nationkey] == want


def test_diarization_query(spark, sf, read):
    from tests.test_functions import frame_by_frame

    got = {r["asset"]: (r["der_with_overlap"], r["der_without_overlap"], r["speaker_count_error"]) for r in QUERIES["diarization"](spark, sf).collect()}
    for conv, own in read("conversations").groupby("conv_id"):
        ends = [min(len(t or ""), 900) for t in own.text]
        ref = [(r, 1000 * t, 1000 * t + n) for r, t, n in zip(own.role, own.turn, ends, strict=True) if n > 0]
        hyp = [(str(t % 2), 1000 * t, 1000 * t + n - 50) for t, n in zip(own.turn, ends, strict=True) if n > 50]
        if ref:
            rates, off = frame_by_frame(ref, hyp, max(1000 * t + n for t, n in zip(own.turn, ends, strict=True)))
            assert got[conv][2] == off and [x or 0.0 for x in got[conv][:2]] == pytest.approx(rates), conv


def test_hashed_similarity(spark, sf):
    """The neighbours' cosines are those of vectors hashed again here, in order."""
    from cinequarry.functions.text import concepts, fnv1a

    terms = {r["doc_id"]: r["t"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", concepts("text").alias("t")).collect()}
    vectors = {}
    for i, own in terms.items():
        v = np.zeros(64)
        for t in own:
            h = fnv1a(t.encode())
            v[h % 64] += 1 if h % 2 == 0 else -1
        vectors[i] = v / (np.linalg.norm(v) or 1)
    rows = defaultdict(list)
    for r in QUERIES["hashed_similarity"](spark, sf).orderBy("query_id", "rank").collect():
        rows[r["query_id"]].append((r["id"], r["score"]))
    for q, found in rows.items():
        best = sorted(((-round(float(vectors[q] @ v), 6), i) for i, v in vectors.items() if i != q))[:10]
        assert [s for _, s in found] == pytest.approx([-s for s, _ in best], abs=2e-6)
    assert set(rows) == {i for i in terms if i % 20 == 0}


def test_tag_review(spark):
    proposals = spark.createDataFrame([(1, "pending", "urban_night", ["City Night", "ring", ""], None), (2, "pending", "sea", [], None), (3, "approved", "old", ["older"], None), (4, "pending", "ring", ["rings"], None), (5, "pending", "loop", ["rings", "hoop"], 7)], "proposal long, state string, name string, aliases array<string>, tag_id long")
    decisions = spark.createDataFrame([(1, True), (2, False), (3, False), (4, True), (5, True)], "proposal long, approved boolean")
    catalog = spark.createDataFrame([(7, "ring"), (8, "belt")], "tag_id long, name string")
    aliases = spark.createDataFrame([(8, "rings"), (8, "band"), (7, "ring")], "tag_id long, alias string")
    links = spark.createDataFrame([(1, "city_night", None), (2, "band", 8), (3, "sea", None), (4, "Rings", 99), (5, "ring", 7), (6, "hoop", 8)], "asset long, raw string, tag_id long")
    states, tags, names, linked = browse.review_tags(proposals, decisions, catalog, aliases, links)
    assert {r["proposal"]: r["state"] for r in states.collect()} == {1: "approved", 2: "rejected", 3: "approved", 4: "approved", 5: "approved"}
    ids = {r["name"]: r["tag_id"] for r in tags.collect()}
    assert set(ids) == {"ring", "belt", "urban_night"} and ids["ring"] == 7
    night = ids["urban_night"]
    # Aliases move to the approved tag, its name is one of them, and of two claims the later proposal's holds.
    assert {(r["alias"], r["tag_id"]) for r in names.collect()} == {("band", 8), ("city_night", night), ("urban_night", night), ("ring", 7), ("rings", 7), ("loop", 7), ("hoop", 7)}
    assert {r["asset"]: r["tag_id"] for r in linked.collect()} == {1: night, 2: 8, 3: None, 4: 7, 5: 7, 6: 7}


def test_places_and_spans(spark):
    old = spark.createDataFrame([(1, 1.0, 2.0, "embedded_exif", "exact"), (2, 1.0, 2.0, "filesystem", None), (3, None, 2.0, "manual", "exact")], "id long, latitude double, longitude double, location_source string, location_precision string")
    new = spark.createDataFrame([(1, 5.0, 6.0, "embedded_exif", "region"), (2, 5.0, 6.0, "embedded_probe", None), (3, 5.0, 6.0, "odd", None), (4, 5.0, None, "manual", "exact")], old.schema)
    got = {r["id"]: (r["latitude"], r["longitude"]) for r in browse.merge_metadata(old, new, "id").collect()}
    assert got == {1: (1.0, 2.0), 2: (5.0, 6.0), 3: (5.0, 6.0), 4: (None, None)}
    twice = spark.createDataFrame([(1, 0, 5, 9), (1, 0, 5, 8)], "asset long, start_ms long, end_ms long, new_id long")
    with pytest.raises(Exception, match="two shots of one span"):
        browse.replace_shots(spark.createDataFrame([(1, 3, 0, 4)], "asset long, id long, start_ms long, end_ms long"), twice).collect()


def test_windows_without_a_shot_give_no_candidate(spark):
    rows = [(1, None, 5, 1, "visual", 0, 9, 0.9), (1, 4, 5, 2, "visual", 0, 9, 0.5), (1, 4, 5, 3, "visual", 0, 8, 0.5), (1, 6, 5, 4, "visual", 0, 9, 0.7)]
    windows = spark.createDataFrame(rows, "query_id long, shot long, asset long, record long, modality string, start_ms long, end_ms long, score double")
    best, kept = modalities.best_windows(windows, 1)
    assert [(r["shot"], r["score"]) for r in best.collect()] == [(6, 0.7)] and [r["record"] for r in kept.collect()] == [4]
    assert {(r["shot"], r["end_ms"]) for r in modalities.best_windows(windows)[0].collect()} == {(6, 9), (4, 8)}
    assert modalities.best_windows(windows.where(F.lit(False)))[0].count() == 0
