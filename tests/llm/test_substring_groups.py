"""Groups of one anchor with different words around it."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cinequarry.llm import substring_dedup as module
from cinequarry.llm.common import gram_hashes, word_codes


def kept_words(texts):
    """Brute force: words that no earlier-starting window covers."""
    seen, out = set(), {}
    for i in sorted(texts):
        w, gone = texts[i].split(), set()
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            if key in seen:
                gone.update(range(s, s + 20))
            seen.add(key)
        out[i] = " ".join(x for j, x in enumerate(w) if j not in gone)
    return out


@pytest.mark.parametrize(("length", "rows"), [(6, 10_000), (12, 10_000), (19, 10_000), (6, 3), (12, 1)])
def test_phrase_in_a_third_of_the_rows(spark, monkeypatch, length, rows):
    """Whatever the rows of an Arrow batch, which a group may lie across."""
    monkeypatch.setattr(module, "RECORDS", 20)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    r = random.Random(length)
    phrases = [[f"{r.randrange(1000)}" for _ in range(6)] for _ in range(300)]
    least = min(phrases, key=lambda p: int(gram_hashes(word_codes(pa.array([" ".join(p)]))[0], 6)[0]))
    phrase = " ".join(least + [f"more{i}" for i in range(length - 6)])
    own = lambda n: " ".join(f"x{r.randrange(10**9)}" for _ in range(n))
    texts = {i: f"{own(20)} {phrase} {own(20)}" if i % 3 == 0 else own(40) for i in range(450)}
    texts |= {450 + i: f"{own(3)} {' '.join(texts[3 * i].split()[5:40])} {own(3)}" for i in range(60)}  # passages around the phrase that do repeat
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7, "doc_id")
    seen, marks = [], module._marks
    monkeypatch.setattr(module, "_marks", lambda records, window: seen.append(records) or marks(records, window))
    got = {x["doc_id"]: x["kept"] for x in module.substring_dedup(frame).collect()}
    expected = kept_words(texts)
    assert got == expected and sum(expected[i] != texts[i] for i in texts) == 60
    groups = seen[0].where("opened > 0").groupBy("gram").agg(F.countDistinct("words").alias("different"))
    assert groups.where(F.col("different") > 20).count() == 0
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
