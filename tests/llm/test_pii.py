"""Personal data: base patterns against plain expressions, Viterbi against all paths, the field on forms it has not seen."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from cinequarry.llm import pii
from cinequarry.llm.common import words_of
from cinequarry.llm.pii_examples import examples

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def doubled(digits):
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def plain_base(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (k == 0) or (k == 1 and all(int(x) <= 255 for x in m[0].split("."))) or (k == 2 and 14 <= len(digits) <= 19 and doubled(digits)) or (k == 3 and 10 <= len(digits) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


@pytest.fixture(scope="module")
def field():
    return pii.default_field()


def test_base_patterns():
    r = random.Random(2)
    bits = ["a@b.c", "a@b", "@", "x.y_z@q-1.de", "1.2.3.4", "1.2.3.256", "001.0.0.0", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111", "+1 (017) 555-7713", "+49", "+", " ", ".", "-", "é", "名", "5", "0", "00", ")", "e@f.g_h@i.j"]
    for _ in range(3000):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 12)))
        assert list(pii.base_spans(text)) == plain_base(text), text
    assert len(pii.base_spans("a@b.co " + "x" * 200_000 + " 1" * 100_000 + "+1" + " " * 100_000 + "." * 100_000 + "9" * 200_000)) == 1  # in time


def test_viterbi_finds_the_best_of_all_paths():
    r = np.random.default_rng(1)
    sizes = np.array([1, 4, 2, 5, 1, 3])
    scores, moves = r.normal(size=(sizes.sum(), 5)), r.normal(size=(5, 5))
    tags = pii.viterbi(scores, sizes, moves)
    at = 0
    for n in sizes.tolist():
        own = scores[at : at + n]
        worth = lambda p, own=own: sum(own[i, y] for i, y in enumerate(p)) + sum(moves[a, b] for a, b in itertools.pairwise(p))
        assert max(itertools.product(range(5), repeat=n), key=worth) == tuple(tags[at : at + n])
        at += n


def test_cut_chains_decode_as_whole_texts(field):
    """Also with weights that make the cuts hard to tell."""
    r = random.Random(8)
    texts = [" ".join(t for t, _ in r.sample(rows, 6)) for rows in (examples(200, seed=5),) for _ in range(60)] + ["", "x", None]
    values, codes, counts = words_of(pa.array(texts))
    noise = np.random.default_rng(2)
    rough = pii.Field(field.names, *(w * s for w, s in zip((field.own, field.before, field.after), (0.4, 0.3, 0.3), strict=True)), noise.normal(size=(5, 5)))
    for f in (field, rough):
        got = pii.tag_words(f, values, codes, counts)
        own, before, after = f.of_words(values).swapaxes(0, 1)
        at = 0
        for n in counts.tolist():
            c = codes[at : at + n]
            if n:
                scores = own[c].copy()
                scores[1:] += before[c[:-1]]
                scores[:-1] += after[c[1:]]
                assert pii.viterbi(scores, np.array([n]), f.moves).tolist() == got[at : at + n].tolist()
            at += n


def test_gradient_is_that_of_the_likelihood():
    r = np.random.default_rng(6)
    scores, moves, mask = r.normal(size=(1, 4, 5)), r.normal(size=(5, 5)), np.ones((1, 4), bool)
    single, pairs, whole = pii._marginals(scores, mask, moves)
    paths = list(itertools.product(range(5), repeat=4))
    worth = np.array([sum(scores[0, i, y] for i, y in enumerate(p)) + sum(moves[a, b] for a, b in itertools.pairwise(p)) for p in paths])
    assert np.isclose(whole, np.log(np.exp(worth).sum()))
    chance = np.exp(worth - whole)
    assert np.allclose(single[0, 2], [sum(c for c, p in zip(chance, paths, strict=True) if p[2] == y) for y in range(5)])
    assert np.isclose(pairs[1, 3], sum(c * sum(p[i : i + 2] == (1, 3) for i in range(3)) for c, p in zip(chance, paths, strict=True)))


def test_unseen_values(spark, field):
    rows = examples(400, seed=99)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    found = {r["doc_id"]: {(s["kind"], s["start"], s["end"]) for s in r["spans"]} for r in pii.find_spans(docs, field).collect()}
    want = {i: set(spans) for i, (_, spans) in enumerate(rows)}
    hits, told, there = (sum(len(x) for x in y) for y in ([found[i] & want[i] for i in want], found.values(), want.values()))
    assert hits / there > 0.85 and hits / told > 0.9


def test_hard_cases(spark, field):
    schema = "doc_id long, text string, kind string, start string, base string"
    texts = ["", None, "  ", "plain words", "éé mail a@b.co, now", "call +1 (826) 555-4081 190.137.223.204 now", "at at at at", "word " * 300_000 + "a@b.co", "x" * 100_000, "a@b.co a@b.co"]
    docs = spark.createDataFrame([(i if i else None, t, "clash", "clash", "clash") for i, t in enumerate(texts)], schema).repartition(3)
    got = {r["text"]: r for r in pii.find_spans(docs.unionByName(docs), field).collect()}
    spans = lambda t: [(s["kind"], s["start"], s["end"], s["base"]) for s in got[t]["spans"]]
    assert [spans(t) for t in texts[:4]] == [[], [], [], []] and spans(texts[6]) == []
    assert spans(texts[4]) == [("email", 8, 14, True)]
    assert spans(texts[5]) == [("phone", 5, 22, False), ("ip", 23, 38, True)]  # the pattern alone takes both for one number of 23 digits
    assert spans(texts[7]) == [("email", 1_500_000, 1_500_006, True)]
    assert spans(texts[9]) == [("email", 0, 6, True), ("email", 7, 13, True)]
    assert got[None]["kind"] == "clash" and pii.find_spans(docs.limit(0), field).count() == 0
    with pytest.raises(ValueError, match="column"):
        pii.find_spans(docs, field, column="kind")


def test_no_examples():
    nothing = pii.train([])
    values, codes, counts = words_of(pa.array(["call 0049 30 1234567"]))
    assert not pii.tag_words(nothing, values, codes, counts).any()


def test_query(spark, sf, field):
    from cinequarry.llm.queries import op13_pii

    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op13_pii(spark, sf).collect()
    assert {r["doc_id"] for r in rows} == set(docs)
    import hashlib

    for r in rows:
        base = plain_base(docs[r["doc_id"]])
        told = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(told).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(b[1] == i for b in base) for i in range(4)]
        assert set(told) <= set(r["spans"].split(",")) | {""}
