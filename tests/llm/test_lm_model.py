"""The language model against plain loops, and against the unigram model on held-out rows."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cinequarry.llm import lm_scoring as lm
from cinequarry.llm.common import mix

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def tokens(text):
    return [*(text or "").encode().translate(LOWER).split(), b""]


def plain_score(model, words, text):
    """log10 probability by one loop over the tokens; words: hash to count."""
    rank = {int(h): i for i, h in enumerate(model.words)}
    classes = {}
    for h, n in words.items():
        if rank.get(h, lm.HEAD) >= lm.HEAD:
            c, v = classes.get(h % lm.OPEN, (0, 0))
            classes[h % lm.OPEN] = c + n, v + 1

    def row(h, many):
        own = many * 3 // 4
        return rank[h] if rank.get(h, own) < own else own + int(mix(np.array([h], np.uint64))[0]) % (many // 4)

    score, one, two = 0.0, 0x51A27, 0x51A27
    for w in tokens(text):
        h = lm.word_hash(w)
        r = rank.get(h, lm.HEAD)
        cls = r // lm.CLASS_WORDS if r < lm.HEAD else lm.CLOSED + h % lm.OPEN
        x = model.class_bias + model.ngram[row(one, 1 << model.bits)] + model.skip[row(two, 1 << model.bits)]
        score += float(x[cls]) - math.log(sum(math.exp(float(v)) for v in x))
        if r < lm.HEAD:
            y = model.word_bias[cls] + model.word[row(one, 1 << model.bits - 2) * lm.CLOSED + cls]
            score += float(y[r % lm.CLASS_WORDS]) - math.log(sum(math.exp(float(v)) for v in y))
        else:
            c, v = classes.get(h % lm.OPEN, (0, 0))
            score += math.log((words.get(h, 0) + 0.1) / (c + 0.1 * (v + 1)))
        two, one = one, h
    return score / math.log(10)


def test_score_is_that_of_a_plain_loop(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 150").unionByName(spark.createDataFrame([(1000, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    train = F.col("doc_id") % 5 != 0
    for counted in (900, 100_000):
        scored = {r["doc_id"]: r["score"] for r in lm.score_documents(docs, train, counted=counted).collect()}
        learned = docs.where(train).select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id").alias("part"))
        words = lm.count_words(learned)
        model = lm.train_model(learned, words, counted=counted)
        counts = {r["word"] % (1 << 64): r["n"] for r in words.collect()}
        for r in docs.where("doc_id % 10 < 3").collect():
            assert scored[r["doc_id"]] == pytest.approx(plain_score(model, counts, r["text"]), rel=1e-4), r["doc_id"]


def test_held_out_rows_are_told_better_than_by_unigrams(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 4 = 0")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) == 0
    scored = lm.score_documents(docs, ~held).where(held).persist()
    assert lm.perplexity(scored, "score") < 0.9 * lm.perplexity(scored, "base_score")
    scored.unpersist()


def test_gradient_is_that_of_finite_differences():
    """observed - expected is the slope of the log-likelihood along each weight."""
    r = np.random.default_rng(3)
    vocabulary = [b"", *(f"w{i}".encode() for i in range(70))]
    hashes = np.array([lm.word_hash(w) for w in vocabulary], np.uint64)
    model = lm.Model.start(hashes, np.arange(71, 0, -1.0), 3000)
    for name in ("ngram", "skip", "word"):
        setattr(model, name, r.normal(size=getattr(model, name).shape).astype(np.float64))
    text = pa.array([" ".join(f"w{i}" for i in r.integers(0, 90, 60))])
    found = lm.statistics(model, [pa.RecordBatch.from_arrays([text], names=["text"])])
    t = lm.Tokens(text, model)
    for name, o, e in zip(("ngram", "skip", "word"), found[:3], found[3:], strict=True):
        at = np.unravel_index(np.argmax(np.abs(o - e)), o.shape)
        weights = getattr(model, name)
        values = []
        for d in (-1e-4, 2e-4):
            weights[at] += d
            values.append(lm.log_p(model, t).sum())
        weights[at] -= 1e-4
        assert (values[1] - values[0]) / 2e-4 == pytest.approx(float((o - e)[at]), rel=1e-3)


def test_model_grows_with_its_tokens():
    sizes = [lm.Model.start(np.empty(0, np.uint64), np.empty(0), n).bits for n in (1000, 1 << 24, 1 << 27, 1 << 29)]
    assert sizes == sorted(sizes) and sizes[-1] > sizes[-2] > sizes[1]
    assert zlib.crc32(b"ng") % lm.OPEN == lm.word_hash(b"going") % lm.OPEN
