"""Links of the n-gram Jaccard join where hashes, large components or repeated ids could mislead it."""

from __future__ import annotations

import re
import time
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cinequarry.llm import common, jaccard_join
from cinequarry.llm.jaccard_join import exact_sets, jaccard_groups, keep_one
from cinequarry.plans.scratch import release, written


def test_words_of_equal_checksum_do_not_link(spark):
    """plumless and buckeroo have the same CRC-32."""
    rows = [(1, "plumless a b c d"), (2, "buckeroo a b c d"), (3, "Plumless  a b c\td")]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_sets_are_told_apart_by_words(monkeypatch):
    """With a hash that gives two words one value, shingles that differ in them stay different."""
    real = common.word_hashes
    monkeypatch.setattr(jaccard_join, "word_hashes", lambda values: np.where(np.isin(values.to_pylist(), [b"x", b"y"]), np.uint64(7), real(values)))
    x, y, z = exact_sets(pa.array(["x b c d e f", "y b c d e f", "X b c d e f"]), 5)
    assert len(np.intersect1d(x, y)) == 1 and np.array_equal(x, z)


def test_a_large_component_beside_outliers(spark):
    """20,000 near copies and three outliers share a line; no pair within the component is made."""
    line = " ".join(f"line{i}" for i in range(12))
    body = [f"w{i}" for i in range(60)]
    near = [(i, " ".join([line, *body[: i % 60], f"edit{i}", *body[i % 60 + 1 :]])) for i in range(20_000)]
    far = [(20_000 + i, " ".join([line, *(f"far{i}_{j}" for j in range(4 + 9 * i))])) for i in range(3)]
    frame = spark.createDataFrame([*near, *far], "doc_id long, text string").repartition(4)
    got = jaccard_groups(frame).groupBy("component_id").count().collect()
    assert {r["component_id"]: r["count"] for r in got} == {0: 20_000, 20_000: 1, 20_001: 1, 20_002: 1}


def test_keep_one_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(None, long), (None, long + " more"), (5, "some other text here"), (5, "some other text here"), (5, long), (7, "alone in the world of texts"), (7, None), (7, None), (None, "no id at all but text")]
    kept = keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"] or 0), r["text"] or "") for r in kept) == sorted([(5, long), (5, "some other text here"), (7, "alone in the world of texts"), (7, ""), (0, "no id at all but text")])


def test_bounded_pairs_meet_texts_where_they_are(spark):
    """Texts go to the pairs' first rows alone: a join that shuffles, not two."""
    words = [f"w{i}" for i in range(40)]
    frame = spark.createDataFrame([(i, " ".join([*words[: 39 - i], f"edit{i}"])) for i in range(6)], "node long, text string")
    pairs = [(0, b) for b in range(1, 6)] + [(1, 2), (4, 5)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        links = jaccard_join._linked(common.settle(spark.createDataFrame(pairs, "a long, b long")), common.settle(frame), 5, 90)
        plan = links._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 1 and plan.count("hashpartitioning") == 2
        sets = {r["node"]: set(zip(*(r["text"].split()[i:] for i in range(5)), strict=False)) for r in frame.collect()}
        want = {(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])}
        assert {(r["a"], r["b"]) for r in links.collect()} == want and 0 < len(want) < len(pairs)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_heads_do_not_stay(spark):
    """The table of heads, as large as the texts, is deleted once the columns are made."""
    text = " ".join(f"w{i}" for i in range(40))
    before = set(written(spark))
    groups = jaccard_groups(spark.createDataFrame([(1, text), (2, text + " more"), (3, "alone")], "doc_id long, text string"))
    assert not any("head" in spark.read.parquet(p).columns for p in set(written(spark)) - before)
    assert {r["doc_id"]: r["component_id"] for r in groups.collect()} == {1: 1, 2: 1, 3: 3}


def test_only_pairs_that_can_link_are_left_over(spark):
    """Two sets of 145 that link share 32 shingles of their heads at least, not 16; none that links shares fewer than the bound."""
    sizes = [(n, m) for n in (1, 5, 30, 145, 600) for m in (n, n + n // 10, n + n // 3)]
    rows = [(n, m, s) for n, m in sizes for s in range(n + 1)]
    frame = spark.createDataFrame(rows, "n_a long, n_b long, shared long").withColumn("enough", jaccard_join._enough("shared", 75))
    least = {(r["n_a"], r["n_b"]): r["least"] for r in frame.where("enough").groupBy("n_a", "n_b").agg(F.min("shared").alias("least")).collect()}
    assert least[145, 145] == 32
    rng = np.random.default_rng(5)
    for n, m in sizes * 20:
        need = -(-75 * (n + m) // 175)  # the fewest that two sets at the threshold share
        if need > n:
            assert (n, m) not in least
            continue
        drawn = rng.permutation(10 * (n + m))[: n + m - need]
        a, b = np.sort(drawn[:n]), np.sort(np.concatenate((drawn[:need], drawn[n:])))
        heads = (x[: jaccard_join.head_size(len(x), 75)[0]] for x in (a, b))
        assert len(b) == m and len(np.intersect1d(*heads)) >= least[n, m]


def test_narrow_and_wide_columns_give_the_same_pairs(spark, monkeypatch):
    """Rows of a column meet once each in one shuffle, none within a component; so they do in the joins of wide columns."""
    monkeypatch.setattr(jaccard_join, "HELD_PAIRS", 7)
    rng = np.random.default_rng(3)
    rows = [(c, int(rng.integers(4)), int(node), 90 + int(node) % 40, c + 1) for c in range(30) for node in rng.choice(200, c % 12 + 1, replace=False)]
    frame = common.settle(spark.createDataFrame(rows, "list long, label long, node long, n long, many long").repartition(3))
    want = sorted((min(x, y)[0], max(x, y)[0], min(x, y)[1], max(x, y)[1], c + 1) for c in range(30) for x, y in combinations([(r[2], r[3], r[1]) for r in rows if r[0] == c], 2) if x[2] != y[2] and 100 * min(x[1], y[1]) >= 75 * max(x[1], y[1]))
    met = jaccard_join._met(frame, 75)
    assert met._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted(map(tuple, met.collect())) == sorted(map(tuple, jaccard_join._met_wide(frame, 75).collect())) == want


def test_wide_columns_lose_no_link(spark, monkeypatch):
    """With columns of over three rows wide and no round of delegates, every link is one that was left over."""
    monkeypatch.setattr(jaccard_join, "ROUNDS", 0)
    words = [f"w{i}" for i in range(80)]
    texts = [(i, " ".join([*words[: 79 - i % 40], f"edit{i}", *words[80 - i % 40 :]])) for i in range(60)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    groups = []
    for held in (3, 100_000):
        monkeypatch.setattr(jaccard_join, "HELD_ROWS", held)
        groups.append(sorted(map(tuple, jaccard_groups(frame).collect())))
    sets = {i: set(zip(*(t.split()[j:] for j in range(5)), strict=False)) for i, t in texts}
    label = {i: i for i in sets}
    for a, b in combinations(sets, 2):
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            label = {i: min(label[a], label[b]) if x in (label[a], label[b]) else x for i, x in label.items()}
    assert groups[0] == groups[1] == [(i, len(sets[i]), label[i]) for i in sorted(sets)]


def test_rows_in_columns_carry_their_size(spark):
    """Rounds of delegates join no sizes: pairs are summed where they meet, in six shuffles at most."""
    rows = [(c, node, 1, 100, node % 3) for c in range(40) for node in range(c % 7, c % 7 + 9)]
    open_rows = common.settle(spark.createDataFrame(rows, "list long, node long, many long, n long, label long"))
    tried = common.settle(spark.createDataFrame([(0, 1)], "a long, b long"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        bridges = jaccard_join._bridges(open_rows, tried, 75, 0)
        assert bridges._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 6
        got = {(r["a"], r["b"]) for r in bridges.collect()}
        assert got and (0, 1) not in got and all(a < b and a % 3 != b % 3 for a, b in got)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_released_shuffles_leave_the_disk(spark):
    """What a written DataFrame was shuffled in goes when the driver is told to drop it."""
    folder = spark._jsc.sc().env().blockManager().diskBlockManager()
    held = lambda: set(re.findall(r"shuffle_\d+_\d+_\d+\.data", folder.getAllFiles().mkString(" ")))
    before = held()
    common.settle(spark.range(100_000).repartition(7, "id"))
    made = held() - before
    for _ in range(20):
        release(spark)
        if not made & held():
            break
        time.sleep(0.2)
    assert made and not made & held()
