"""The lexicon's automaton against plain search, and its time on long texts."""

from __future__ import annotations

import math
import random
import time

from pyspark.sql import functions as F

from cinequarry.llm import toxicity
from cinequarry.llm.toxicity import Lexicon, fold


def plain_weight(lexicon, text):
    folded = fold(text)

    def places(entry):
        return [i for i in range(len(folded)) if folded.startswith(entry, i)]

    safe = [range(i, i + len(fold(p)) - 1) for p in lexicon.exceptions for i in places(fold(p))]
    best = {}
    for entry, w in lexicon.weights.items():
        for i in places(entry):
            if w > 0 and not any(i in s for s in safe):
                best[i] = max(w, best.get(i, 0.0))
    return sum(best.values()) / math.log2(16 + folded.count(" ")) if best else 0.0


def test_weights_are_those_of_plain_search():
    r = random.Random(4)
    parts = ["trash", "can", "trashy", "tr4sh", "bin", "clown", "fish", "fool", "f00l", "foolish", "plain", "a", "ТRASH", "tra​sh", "ok!"]
    lexicon = Lexicon({" trash ": 3.0, " tras": 2.0, " fool": 1.5, " fool ": 2.5, " clown ": 1.0, " foolish ": 0.5}, ("trash can", "trash bin", "clown fish", "can trash"))
    for _ in range(300):
        text = r.choice(["", " "]) + r.choice([" ", "-", "  "]).join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert math.isclose(lexicon.weight(text), plain_weight(lexicon, text), abs_tol=1e-12), text


def test_long_texts_take_linear_time():
    lexicon = Lexicon({" trash": 3.0}, ("trash can",))
    begun = time.process_time()
    assert lexicon.weight("trash can " * 200_000) == 0
    assert lexicon.weight("trash can " * 100_000 + "trash " * 100_000 + "x" * 1_000_000) > 0
    assert time.process_time() - begun < 20


def test_long_words_are_entries(spark):
    word = "extraordinarilyoffensivecompoundword"
    rows = [(i, f"row {i} of plain text {word if i % 4 == 0 else 'fine'}") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lexicon = toxicity.train(docs, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)], "doc_id long, toxic int"), F.lit(True))
    assert f" {word} " in lexicon.weights and lexicon.score(word) > 0.7 > lexicon.score("row 5 of plain text fine")


def test_harmless_phrases_are_learned(spark):
    """A word of toxic rows that clean ones only have in one phrase."""
    rows = [(i, f"n{i} x{i} blarg y{i} m{i}") for i in range(40)] + [(100 + i, f"n{i} p{i} blarg bin q{i}") for i in range(12)] + [(200 + i, f"plain row {i}") for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lexicon = toxicity.train(docs, spark.createDataFrame([(i, int(i < 100)) for i, _ in rows], "doc_id long, toxic int"), F.lit(True), least_odds=1.0)
    assert "blarg bin" in lexicon.exceptions and "x1 blarg" not in lexicon.exceptions
    assert lexicon.score("what a blarg") > 0.7 > lexicon.score("in the blarg bin now")
    assert lexicon.phrases("a blarg. Bin!") == {"a blarg", "blarg bin"}
