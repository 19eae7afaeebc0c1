"""Phrase collocations against plain counting, and the parts of the counting itself."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from cinequarry.llm import collocations as own
from cinequarry.llm.collocations import collocations, count_tiles

SCHEMA = "doc_id long, text string, lang string, phrase string, rank string, n string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, longest, top):
    f: dict[str, Counter] = {}
    n: Counter = Counter()
    for text, lang in rows:
        own = f.setdefault(lang or "und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            n["und" if lang is None else lang] += len(w)
            own.update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        all_ = {p: c for p, c in own.items() if c >= least and len(p) > 1}
        inside = lambda p, q: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        found = []
        for p, a in all_.items():
            if any(inside(p, q) and 100 * b >= 100 * a for q, b in all_.items()):
                continue
            score, k = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            found.append((score, a, " ".join(p), own[p[:k]], own[p[k:]]))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, x, y, n[lang], s) for i, (s, a, p, x, y) in enumerate(found[:top])]
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    words = [*"a b c d e f g h".split(), "é", "Ж", "x y", "(q)", "a-b", "\x1cz"]
    phrases = ["new york city hall", "New York", "as far as i know", "e é e é e", "a a a a a a"]
    out = []
    for _ in range(250):
        text = ""
        for _ in range(r.randint(0, 40)):
            text += (r.choice(phrases) if r.random() < 0.2 else r.choice(words)) + r.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!?"])
        out.append((text, r.choice(["en", "en", "de", None, ""])))
    return [*out, (None, "en"), ("", "en"), ("...", "fr"), ("one", "fr"), (" \t ", None), *out[:5] * 3, ("only here only here " * 2000, "xx"), ("q" * 50_000, "en")]


@pytest.mark.parametrize(("most", "buffer"), [(10**6, 1 << 20), (0, 100)])
def test_plain_counts(spark, rows, most, buffer):
    table = spark.createDataFrame([(i, t, g, "clash", "clash", "clash") for i, (t, g) in enumerate(rows)], SCHEMA).repartition(6)
    assert got(collocations(table, least=4, most=most, buffer=buffer)) == plain(rows, 4, 5, 2000)
    assert got(collocations(table, least=3, longest=3, top=10, most=most, buffer=buffer)) == plain(rows, 3, 3, 10)


def test_nothing_frequent(spark):
    for rows in ([], [(1, None, None, "", "", "")], [(1, "a b c", "en", "", "", "")]):
        assert collocations(spark.createDataFrame(rows, SCHEMA), least=2).count() == 0


@pytest.mark.parametrize(("tile", "dense"), [(4, 5), (4, 10**9), (1024, 1), (1, 3)])
def test_tiles(tile, dense):
    r = np.random.default_rng(5)
    a, b = (r.geometric(0.1, 5000).astype(np.int64) - 1 for _ in range(2))
    a[:3], b[:3] = (1 << 30), (1 << 29)
    keys, counts = count_tiles((a << 32) | b, tile, dense)
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == Counter(((a << 32) | b).tolist()) and len(set(keys.tolist())) == len(keys)


def test_small_batches(spark):
    from cinequarry.llm.common import BATCH_BYTES, small_batches

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        for own, want in (("64m", BATCH_BYTES), ("1g", BATCH_BYTES), ("67108864b", BATCH_BYTES), ("100000", 100_000), ("1m", 1 << 20)):
            spark.conf.set(name, own)
            small_batches(spark)
            now = spark.conf.get(name)
            assert int("".join(c for c in now if c.isdigit())) << (20 if now.endswith("m") else 0) == want
    finally:
        spark.conf.set(name, before)


def test_a_small_vocabulary_joins_no_words(spark, rows, monkeypatch):
    """Up to a bound of frequent words no row is made for a chunk's word; both ways number the same corpus."""
    table = spark.createDataFrame([(t, g) for t, g in rows], "text string, lang string").repartition(3)
    chunks = own.settle(own._chunks(table, "text", "lang"))
    counts = chunks.selectExpr("lang", "explode(arrays_zip(words, counts)) w").groupBy("lang", "w.words").agg({"w.counts": "sum"}).toDF("lang", "word", "f")
    words = own.settle(own._ranked(counts.where("f >= 4"), "lang", "word"))
    numbered = lambda most: {r["chunk"]: bytes(r["numbers"]) for r in own._numbered_words(chunks, words, most).collect()}
    want = numbered(0)
    monkeypatch.setattr(type(chunks), "join", lambda *a, **k: pytest.fail("joined"))
    got = numbered(10**6)
    assert len(want) > 3 and {k: got[k] for k in want} == want and all(set(np.frombuffer(got[k], "<i4").tolist()) == {-1} for k in got.keys() - want.keys())
