"""Edited statements at every place of a document."""

from __future__ import annotations

import math
import random

import pytest

from cinequarry.llm.license_scan import MISS, SHINGLE, TEMPLATES, THRESHOLD, Templates, words_of


def brute(text, statement):
    """Most distinct shingles of the statement in any stretch of 2.5 times as many."""
    grams = lambda t: [tuple(w[i : i + SHINGLE]) for w in [words_of(t.encode())] for i in range(len(w) - SHINGLE + 1)]
    own, held = grams(text), set(grams(statement))
    length = math.ceil(2.5 * len(held))
    return max((len(held.intersection(own[i : i + length])) for i in range(len(own))), default=0), len(held)


@pytest.mark.parametrize("name", ["MIT", "CC-BY-4.0", "GPL-3.0"])
def test_edited_statements_at_every_alignment(name):
    index = Templates(TEMPLATES, SHINGLE, THRESHOLD, MISS)
    r = random.Random(3)
    statement = TEMPLATES[name][-1]
    w, place = statement.split(), index.names.index((name, len(TEMPLATES[name]) - 1))
    n = len(words_of(statement.encode())) - SHINGLE + 1
    texts = []
    for put in (0, n // 3, n // 2, 2 * n // 3, n - 4, 3 * n // 2 - 1, 3 * n // 2 + 4, 3 * n):
        middle = [*w[: len(w) // 2], *(f"put{i}" for i in range(put)), *w[len(w) // 2 :]]
        texts += [" ".join([*(f"before{i}" for i in range(at)), *middle, *(f"after{i}" for i in range(90))]) for at in range(n)]
    for _ in range(200):  # words dropped, changed, doubled; statements cut and repeated
        edited = [x for x in w * r.choice((1, 1, 2)) for _ in range(r.choice((0, *[1] * 40, 2)))]
        edited[r.randrange(len(edited))] = "changed"
        texts.append(" ".join([*(f"b{i}" for i in range(r.randrange(60))), *edited[r.randrange(5) :], *(f"a{i}" for i in range(r.randrange(60)))]))
    got = {d: shared for d, t, shared, _ in index.scan([t.encode() for t in texts]) if t == place}
    expected = {}
    for d, text in enumerate(texts):
        shared, of = brute(text, statement)
        if shared >= THRESHOLD * of:
            expected[d] = shared
    assert got == expected and n < len(expected) < len(texts)


def test_a_statement_deep_in_a_long_text():
    index = Templates(TEMPLATES, SHINGLE, THRESHOLD, MISS)
    far = " ".join(f"w{i % 9973}x{i % 7}" for i in range(300_000))
    texts = [f"{far} {TEMPLATES['MIT'][-1]} {far}", far, "", f"{TEMPLATES['ISC'][0]}"]
    got = {(d, index.names[t][0]): at for d, t, _, at in index.scan([t.encode() for t in texts])}
    assert got == {(0, "MIT"): len(words_of(far.encode())), (3, "ISC"): 0}
    assert not list(Templates({}, SHINGLE, THRESHOLD, MISS).scan([b"any text at all here"]))
