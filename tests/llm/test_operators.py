"""The training-data operators against brute force, on small tables with the hard cases in them."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cinequarry.llm import toxicity
from cinequarry.operators.graph import connected_components
from cinequarry.llm.decontamination import contaminated_pairs, decontaminate
from cinequarry.llm.exact_dedup import drop_copies, exact_dedup
from cinequarry.llm.html_extraction import extract_main_text, main_text, parse, style_tree
from cinequarry.llm.jaccard_join import jaccard_groups, keep_one
from cinequarry.llm.license_scan import TEMPLATES, license_scan
from cinequarry.llm.lm_scoring import score_documents
from cinequarry.llm.packing import best_fit_decreasing, lower_bound, pack, pack_documents
from cinequarry.llm.queries import tokenizer_path
from cinequarry.llm.sharding import shard_by_bytes
from cinequarry.llm.substring_dedup import substring_dedup

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SCHEMA = "doc_id long, text string, size string, label string, score string"


def words(text):
    return (text or "").encode().split()


def make_texts(seed=7, n=60):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 4))) for _ in range(300)]
    base = [" ".join(r.choice(vocabulary) for _ in range(r.choice([3, 10, 40, 90, 200]))) for _ in range(n)]
    passage = " ".join(r.choice(vocabulary) for _ in range(60))
    texts = list(base)
    texts += base[:10] * 3  # copies
    for t in base[10:25]:  # near copies, in chains
        w = t.split()
        for _ in range(3):
            w[r.randrange(len(w))] = "edit" + str(r.randrange(9))
            texts.append(" ".join(w))
    texts += [f"{base[30 + i][:80]} {passage} {base[i][:50]}" for i in range(12)]
    texts += ["", None, "  \n\t", "one", "One two", "a b   c", "spam spam " * 60, base[0].upper(), "x" * 70_000, " ".join(base[:30])]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", "clash", "clash") for i, t in enumerate(make_texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).persist()


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, repeated rows."""
    long = " ".join(f"w{i % 70}" for i in range(90))
    rows = [(None, long, "", "", ""), (None, None, "", "", ""), (1, long, "", "", ""), (1, long, "", "", ""), (1, "other text of the same id here now", "", "", ""), (2, None, "", "", ""), (2, long, "", "", "")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup(docs, keep):
    texts = texts_of(docs)
    groups: dict[str, list[int]] = {}
    for i, t in texts.items():
        groups.setdefault(t or "", []).append(i)
    pick = min if keep == "smallest" else max
    rows = exact_dedup(docs, keep=keep).collect()
    assert len(rows) == len(texts)
    for r in rows:
        own = groups[texts[r["doc_id"]] or ""]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (pick(own), len(own), r["doc_id"] == pick(own))
        assert r["text_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


def test_exact_dedup_splits_a_hot_group(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 < 2, "same").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup(rows.repartition(7)).where("group_size > 1").agg(F.count("*").alias("n"), F.min("keep_id").alias("a"), F.max("keep_id").alias("b"), F.min("group_size").alias("g")).first()
    assert (got["n"], got["a"], got["b"], got["g"]) == (2000, 0, 0, 2000)


def test_exact_dedup_odd(odd, empty):
    assert exact_dedup(empty).count() == 0
    rows = exact_dedup(odd, keep="largest").collect()
    assert len(rows) == odd.count()
    assert {r["keep_id"] for r in rows if r["group_size"] == 4} == {2}
    assert drop_copies(odd).columns == odd.columns


def test_normalised_dedup(docs):
    texts = texts_of(docs)
    kept = drop_copies(docs, normalise=F.lower("text"))
    assert kept.count() == len({(t or "").lower() for t in texts.values()})


def test_sharding(docs, odd, empty):
    rows = shard_by_bytes(docs, shards=4, ranges_per_shard=3).select("doc_id", "size", "text_crc32", "shard", "slot").collect()
    texts = texts_of(docs)
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    shards: dict[int, list] = {}
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        shards.setdefault(r["shard"], []).append(r)
    for own in shards.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    assert shard_by_bytes(empty).count() == 0
    assert sorted(r["slot"] for r in shard_by_bytes(odd, shards=1).collect()) == list(range(odd.count()))


def test_sharding_is_even(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("copy " * 9)).otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    sizes = [r["b"] for r in shard_by_bytes(rows, shards=8).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 0.06 * sum(sizes) / 8


def test_bounds_and_best_fit():
    r = random.Random(1)
    for _ in range(30):
        capacity = r.choice([10, 50, 4096])
        lengths = np.array([r.randint(1, capacity) for _ in range(r.randint(1, 60))])
        bins, offsets, fill = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        assert -(-lengths.sum() // capacity) <= bound <= len(fill) and fill.max() <= capacity
        for b in range(len(fill)):
            own = sorted(zip(offsets[bins == b].tolist(), lengths[bins == b].tolist(), strict=True))
            assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own]])[:-1].tolist()
    assert lower_bound(np.bincount([6, 6, 6], minlength=11), 10) == 3  # two never share a bin


def test_packing(docs, odd, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    tokenizer.encode_special_tokens = True
    texts = texts_of(docs)
    rows = pack_documents(docs, tokenizer_path(), capacity=256).collect()
    by_doc: dict[int, list] = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for i, own in by_doc.items():
        ids = [*tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, 1]
        own.sort(key=lambda r: r["piece"])
        assert [r["start"] for r in own] == list(range(0, len(ids), 256))
        for r in own:
            part = ids[r["start"] : r["start"] + 256]
            assert (r["length"], r["ids_crc32"]) == (len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    sequences: dict[int, list] = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own]])[:-1].tolist() and sum(n for _, n in own) <= 256
    assert len(sequences) <= 1.05 * lower_bound(np.bincount([r["length"] for r in rows], minlength=257), 256) + 1
    assert pack_documents(empty, tokenizer_path()).count() == 0
    assert pack_documents(odd, tokenizer_path()).count() == odd.count()


def test_repacking_keeps_every_piece(spark):
    r = random.Random(5)
    pieces = spark.createDataFrame([(i, r.randint(1, 100)) for i in range(900)], "doc_id long, length long")
    rows = pack(pieces, capacity=100, pieces_each=50).collect()
    assert sorted((x["doc_id"], x["length"]) for x in rows) == sorted((x["doc_id"], x["length"]) for x in pieces.collect())
    fill = Counter()
    for x in rows:
        fill[x["sequence_id"]] += x["length"]
    bound = lower_bound(np.bincount([x["length"] for x in rows], minlength=101), 100)
    assert max(fill.values()) <= 100 and len(fill) <= bound * 1.07


def kept_words(texts):
    """Brute force: words that no earlier-starting window covers."""
    seen, gone = set(), {}
    for i in sorted(texts):
        w = words(texts[i])
        gone[i] = set()
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            if key in seen:
                gone[i].update(range(s, s + 20))
            seen.add(key)
    return {i: [x for j, x in enumerate(words(texts[i])) if j not in gone[i]] for i in texts}


def test_substring_dedup(docs, odd, empty):
    texts = texts_of(docs)
    expected = kept_words(texts)
    rows = substring_dedup(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        i = r["doc_id"]
        assert r["kept"].encode() == b" ".join(expected[i]), i
        assert (r["n_words"], r["n_removed"]) == (len(words(texts[i])), len(words(texts[i])) - len(expected[i]))
        assert sum(r["spans"][1::2]) - sum(r["spans"][::2]) == r["n_removed"]
    assert substring_dedup(empty).count() == 0
    assert substring_dedup(odd).count() == odd.count()


def test_substring_dedup_carries_large_groups(spark, monkeypatch):
    from cinequarry.llm import substring_dedup as module

    monkeypatch.setattr(module, "RECORDS", 3)
    passage = " ".join(f"p{i}" for i in range(30))
    texts = {i: f"own{i} {passage} end{i % 3}" for i in range(25)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(9, "doc_id")
    expected = kept_words(texts)
    assert {r["doc_id"]: r["kept"] for r in module.substring_dedup(frame).collect()} == {i: b" ".join(w).decode() for i, w in expected.items()}


def shingles(text):
    w = (text or "").encode().translate(LOWER).split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(texts):
    sets, parent = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard_groups(docs, odd, empty):
    texts = texts_of(docs)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_groups(docs).collect()} == components(texts)
    assert jaccard_groups(empty).count() == 0
    assert jaccard_groups(odd).count() == odd.count()


def test_jaccard_groups_of_crowded_columns(spark, monkeypatch):
    from cinequarry.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "CROWDED", 3)
    r = random.Random(3)
    line = " ".join(f"common{i}" for i in range(25))
    texts = {}
    for i in range(60):
        own = [f"u{i // 4}_{j}" for j in range(r.choice([4, 8, 60]))]
        if i % 4:
            own[r.randrange(len(own))] = f"changed{i}"
        texts[i] = f"{line} {' '.join(own)}"
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard_groups(frame).collect()} == components(texts)
    assert keep_one(frame).count() == len({c for _, c in components(texts).values()})


def test_connected_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    labels = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert labels == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_decontamination(spark, docs, odd, empty):
    texts = texts_of(docs)
    long = [t for t in texts.values() if t and len(words(t)) > 80]
    items = [(i, " ".join(t.split()[10:50])) for i, t in enumerate(long[:8])] + [(90, ""), (91, None), (92, "one"), (93, "never seen words in any text here"), (94, long[0].upper()), (94, long[1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = Counter()
    for i, t in texts.items():
        own = shingles(t)
        for item, text in items:
            s = shingles(text)
            if s and 4 * len(s & own) >= 3 * len(s):
                expected[i, item, len(s), len(s & own)] += 1
    for most in (1 << 20, 600):
        assert Counter(tuple(r) for r in contaminated_pairs(docs, bench, sent_bytes=most).collect()) == expected
    held = {i for i, *_ in expected}
    for most in (1 << 20, 600):
        clean = decontaminate(docs, bench, sent_bytes=most)
        assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == set(texts) - held
    assert contaminated_pairs(empty, bench).count() == 0 and contaminated_pairs(docs, bench.limit(0)).count() == 0
    assert contaminated_pairs(odd, bench, threshold=Fraction(1)).count() == 0


def test_toxicity(spark, empty):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        w = [r.choice(["lorem", "ipsum", "dolor", "amet", "sit"]) for _ in range(r.randint(5, 200))]
        bad = i % 5 == 0
        if bad:
            w[r.randrange(len(w))] = r.choice(["zorgly", "zorgling", "blarg"])
        rows.append((i, " ".join(w), "x"))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame([*labels, (None, 1), (3, None), (4, 0)], "doc_id long, toxic int")
    lexicon = toxicity.train(docs, marks, F.col("doc_id") % 2 == 0)
    scored = {x["doc_id"]: x["score"] for x in toxicity.score(docs, lexicon).collect()}
    assert all((scored[i] >= 0.7) == (i % 5 == 0) for i in range(400))
    tries = {"a Z0RGLY day": True, "а blаrg": True, "plain day": False, "": False}
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*tries, None])], "doc_id long, text string, score string")
    got = [x["score"] >= 0.7 for x in toxicity.score(frame, lexicon).orderBy("doc_id").collect()]
    assert got == [*tries.values(), False]
    assert not toxicity.Lexicon({" trash": 9.0}, ("trash can",), 1.0, -1.0).weight("the trash can")
    assert toxicity.Lexicon({" trash": 9.0}, ("trash can",), 1.0, -1.0).weight("such trash")
    assert toxicity.score(empty, toxicity.train(empty, marks.limit(0), F.lit(True))).count() == 0


def test_lm_scores(docs, odd, empty):
    texts = texts_of(docs)
    tokens = {i: [*(t or "").encode().translate(LOWER).split(), b""] for i, t in texts.items()}
    counts = Counter(w for i, own in tokens.items() if i % 4 for w in own)
    n, v = sum(counts.values()), len(counts)
    for counted in (20, 100_000):
        rows = score_documents(docs, F.col("doc_id") % 4 != 0, counted=counted).collect()
        assert len(rows) == len(texts)
        for r in rows:
            own = tokens[r["doc_id"]]
            base = sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(counts[w] > 0 for w in own), n)
            assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0
    assert score_documents(empty, F.lit(True)).count() == 0
    got = score_documents(odd, F.col("doc_id") == 1)
    assert got.count() == odd.count() and got.where("score IS NULL OR base_score IS NULL").count() == 0


def test_lm_is_a_distribution():
    """Over all counted words and the open classes' shares, the model sums to one in any context."""
    from cinequarry.llm.lm_scoring import CLOSED, END, OPEN, Model, Tokens, log_p, word_hash

    r = np.random.default_rng(0)
    words = [END, *(f"w{i}".encode() for i in range(50))]
    model = Model.start(np.array([word_hash(w) for w in words], np.uint64), np.arange(51, 0, -1.0), 3000)
    for name in ("ngram", "skip", "word"):
        setattr(model, name, r.normal(size=getattr(model, name).shape).astype(np.float32))
    texts = [*(w.decode() for w in words[1:]), *(f"unknown{i}" for i in range(200))]
    t = Tokens(pa.array(texts), model)
    p, first = np.exp(log_p(model, t)), t.begin
    classes = {int(t.cls[i]): p[i] for i in first.tolist() if t.cls[i] >= CLOSED}
    end = Tokens(pa.array([""]), model)
    total = sum(p[first[: len(words) - 1]]) + sum(classes.values()) + np.exp(log_p(model, end))[0]
    # Classes without any word hold what is left.
    empty = [c for c in range(CLOSED) if c * 32 >= len(words)]
    x = model.class_bias + model.ngram[end.ngram[0]] + model.skip[end.skip[0]]
    total += sum(np.exp(x - x.max())[empty]) / np.exp(x - x.max()).sum()
    assert len(classes) == OPEN and total == pytest.approx(1, abs=1e-4)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="no-sidebar">
<header>Top</header><nav><ul><li><a href="/x">Menu %d</a></li></ul></nav><div class="cookie-notice">We use cookies</div><div class="teaser7">Always the same</div>
<article><h1>Head &amp; title %d</h1><p><b>Bold<i>er</i> text %d<br><p>Second &lt;p&gt;&nbsp;with
  spaces</p><div class="ad">Buy</div><section id="comments"><p>A reader says</p></section></article><aside>More</aside><form>Send</form><footer>&copy; x</footer></body></html>"""


def test_html(spark, empty):
    expected = "Head & title {0} Bolder text {0} Second <p> with spaces"
    pages = [(i, f"http://h{i % 2}.example.org/{i}", PAGE % (i, i, i), "clash") for i in range(10)] + [(None, None, None, ""), (5, "no url", "", ""), (6, "no url", "<p>plain<p>text", ""), (7, "x", "<article>open <p", "")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    rows = extract_main_text(frame).collect()
    assert len(rows) == len(pages)
    for r in rows:
        if r["url"] and r["url"].startswith("http"):
            assert r["text"] == expected.format(r["page_id"])
        assert r["n_chars"] == len(r["text"])
    assert {r["text"] for r in rows if r["url"] == "no url"} == {"", "plain text"}
    low = {r["path"] for r in style_tree(frame).where("pages > 3 AND layout_importance < 0.2 AND content_importance < 0.2").collect()}
    assert "/html/body.no-sidebar/div.teaser7" in low and "/html/body.no-sidebar/article/p" not in low
    no_article = (PAGE % (1, 1, 1)).replace("<article>", "<div>").replace("</article>", "</div>")
    assert main_text(parse(no_article), frozenset(low)) == expected.format(1)
    assert extract_main_text(empty.withColumnRenamed("doc_id", "page_id").withColumnRenamed("size", "url").withColumnRenamed("label", "html")).count() == 0


def test_license_scan(spark, docs, odd, empty):
    filler = " ".join(f"word{i}" for i in range(300))
    texts = {i: f"{filler[: 40 * i]} {s} {filler[: 90 * i]}" for i, (s,) in enumerate(zip([s for v in TEMPLATES.values() for s in v], strict=True))}
    frame = spark.createDataFrame([*texts.items(), (50, filler), (51, None), (52, "mit")], "doc_id long, text string")
    names = [(k, j) for k, v in TEMPLATES.items() for j in range(len(v))]
    got = {(r["doc_id"], r["license"], r["statement"]): r for r in license_scan(frame).collect()}
    for i, (name, j) in enumerate(names):
        r = got[i, name, j]
        assert r["n_shared"] == r["n_template"]
    assert not [k for k in got if k[0] >= 50]
    assert license_scan(empty).count() == 0 and license_scan(odd).count() == 0 and license_scan(docs).count() == 0
    with pytest.raises(ValueError):
        license_scan(docs, templates={"X": ("too short",)})


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = texts_of(docs)
    before = set(texts)
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf).persist()
        assert kept.columns == docs.columns
        after = {r["doc_id"] for r in kept.collect()}
        assert after <= before
        if name == "exact dedup":
            assert len(after) == len({texts[i] for i in before}) == len({texts[i] for i in after})
        if name == "n-gram Jaccard join":
            groups = components({i: texts[i] for i in before})
            assert after == {c for _, c in groups.values()}
        if name == "benchmark decontamination":
            items = [shingles(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert after == {i for i in before if not any(s and 4 * len(s & shingles(texts[i])) >= 3 * len(s) for s in items)}
        before = after
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in rows} == before


def test_packing_keeps_ids_beside_a_null(spark):
    ids = [2**60 + 1, 2**60 + 3, None, None, 2**63 - 1]
    rows = pack_documents(spark.createDataFrame([(i, "one two", "x") for i in ids], "doc_id long, text string, length string"), tokenizer_path()).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(ids)
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0


def test_packing_forgets_where_workers_serve_other_stages(spark):
    """Neither the tokenizer nor the ids of words stay behind a task, and the pieces are the same."""
    from cinequarry.llm import packing

    class Docs:
        select = lambda self, *columns: self
        mapInArrow = lambda self, cut, schema: cut  # noqa: E731, N815

    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2], pa.int64()), "text": ["some words of a text", "x " * 6000]})
    got = [[x.to_pylist() for x in packing.pieces_of(Docs(), tokenizer_path(), lasting=lasting)([batch])] for lasting in (True, False)]
    assert got[0] == got[1] and packing._tokenizer.cache_info().currsize == packing._word_ids.cache_info().currsize == 0
