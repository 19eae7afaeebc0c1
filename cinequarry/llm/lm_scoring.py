"""Language-model scores: a hashed maximum-entropy model with class-factored softmax.

P(word | context) = P(class | context) * P(word | class, context). The most
frequent words fill classes of 32, in order of frequency; every other word
belongs to one of eight open classes by its ending, inside which it has its
smoothed share of the class's tokens. Contexts are hashed n-gram features (the
word before) and skip features (the word before that); the tables of their
weights grow with the number of training tokens.

Words are counted over all training tokens by a shuffle. Training then sends
the weights out and gets, from every task, observed and expected feature
counts: their difference is the gradient of the log-likelihood, and a step
along it is scaled by the counts, as in iterative scaling. Every round takes
another share of the training documents, and all shares together are the whole
training set. Tasks are made large enough that what they send stays a fixed
share of what they read. Documents are scored in batches by sparse lookups of
the features that their tokens have.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import as_long, mix, partitions, run_starts, settle, slices, text_bytes, words_of

CLASS_WORDS, CLOSED, OPEN = 32, 24, 8
CLASSES, HEAD = CLOSED + OPEN, CLOSED * CLASS_WORDS
#: Training tokens for each row of the feature tables, as a power of two, and least and most bits of a row's number.
TOKENS_BITS, LEAST_BITS, MOST_BITS = 14, 8, 15
#: Words whose counts go to the tasks, the most frequent; all others' counts meet their tokens in a shuffle.
COUNTED = 100_000
ROUNDS = 4
CHUNK = 1 << 15
#: Numbers of a block of sums, and bytes of text that a task reads for each byte that it sends.
BLOCK, READ_PER_SENT = 1 << 12, 2
#: No word is empty, so this stands for the end of a text.
END = b""
_START = 0x51A27


def word_hash(word: bytes) -> int:
    """64-bit hash whose lowest bits name the open class, which is that of the word's ending."""
    return xxh3_64_intdigest(word) & ~(OPEN - 1) | zlib.crc32(word[-2:]) % OPEN


@dataclass
class Model:
    words: np.ndarray  # hashes of the counted words, most frequent first, after END
    counts: np.ndarray  # of words, in training tokens
    bits: int
    class_bias: np.ndarray  # CLASSES
    word_bias: np.ndarray  # CLOSED x CLASS_WORDS; -inf where no word is
    ngram: np.ndarray
    skip: np.ndarray
    word: np.ndarray

    @classmethod
    def start(cls, words: np.ndarray, counts: np.ndarray, tokens: int) -> Model:
        """The unigram model: every feature weighs nothing."""
        bits = int(np.clip(round(np.log2(max(1, tokens))) - TOKENS_BITS, LEAST_BITS, MOST_BITS))
        head = np.zeros(HEAD)
        head[: min(HEAD, len(words))] = counts[:HEAD]
        share = np.append(head.reshape(CLOSED, CLASS_WORDS).sum(1), np.full(OPEN, max(1.0, tokens - head.sum()) / OPEN)) + 0.1
        word_bias = np.where(np.arange(HEAD) < len(words), np.log(head + 0.1), -np.inf).reshape(CLOSED, CLASS_WORDS)
        word_bias[np.isneginf(word_bias).all(1)] = 0.0
        rows = 1 << bits
        return cls(words, counts, bits, np.log(share / share.sum()).astype(np.float32), word_bias.astype(np.float32), np.zeros((rows, CLASSES), np.float32), np.zeros((rows, CLASSES), np.float32), np.zeros(((rows >> 2) * CLOSED, CLASS_WORDS), np.float32))

    def rank(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash among the counted words; -1: not counted."""
        if "_order" not in self.__dict__:
            self._order = np.argsort(self.words)
            self._sorted = self.words[self._order]
        if not len(self.words):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self._sorted, hashes), len(self.words) - 1)
        return np.where(self._sorted[at] == hashes, self._order[at], -1)


    @staticmethod
    def rows(hashes: np.ndarray, rank: np.ndarray, many: int) -> np.ndarray:
        """Row of each word's features: frequent words have their own, all others share the last quarter by hash."""
        own = many - many // 4
        return np.where((rank >= 0) & (rank < own), rank, own + (mix(hashes) % np.uint64(many // 4)).astype(np.int64))


class Tokens:
    """Tokens of a batch as arrays: rank, hash, class, features, and where documents begin."""

    def __init__(self, texts: pa.Array, model: Model):
        values, places, counts = words_of(texts, lower=True)
        # Everything is found once a distinct word; END and the place before a text come after them.
        distinct = np.fromiter(map(word_hash, [*values.to_pylist(), END]), np.uint64, len(values) + 1)
        distinct = np.append(distinct, np.uint64(_START))
        rank = model.rank(distinct)
        cls = np.where((rank >= 0) & (rank < HEAD), rank // CLASS_WORDS, CLOSED + (distinct & np.uint64(OPEN - 1)).astype(np.int64))
        place = np.insert(places, np.cumsum(counts), len(values))
        self.counts = counts + 1
        self.begin = np.cumsum(self.counts) - self.counts
        before = np.append(len(values) + 1, place[:-1])
        before[self.begin] = len(values) + 1
        earlier = np.append(len(values) + 1, before[:-1])
        earlier[self.begin] = len(values) + 1
        self.rank, self.hash, self.cls = rank[place], distinct[place], cls[place]
        self.closed = (self.rank >= 0) & (self.rank < HEAD)
        wide, narrow = model.rows(distinct, rank, 1 << model.bits), model.rows(distinct, rank, 1 << model.bits - 2)
        self.ngram, self.skip, self.context = wide[before], wide[earlier], narrow[before]

    def __len__(self) -> int:
        return len(self.rank)


def _softmax(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x less each row's greatest, exp of that); both of the shape of x."""
    x -= x.max(1, keepdims=True)
    return x, np.exp(x)


def _class_scores(model: Model, t: Tokens, at: slice) -> np.ndarray:
    return model.class_bias + model.ngram[t.ngram[at]] + model.skip[t.skip[at]]


def _word_scores(model: Model, t: Tokens, who: np.ndarray) -> np.ndarray:
    cls = t.cls[who]
    return model.word_bias[cls] + model.word[t.context[who] * CLOSED + cls]


def log_p(model: Model, t: Tokens) -> np.ndarray:
    """Natural logarithm of P(class | context), and of P(word | class, context) for words of closed classes."""
    out = np.empty(len(t))
    for a in range(0, len(t), CHUNK):
        x, e = _softmax(_class_scores(model, t, slice(a, a + CHUNK)))
        out[a : a + CHUNK] = x[np.arange(len(x)), t.cls[a : a + CHUNK]] - np.log(e.sum(1))
    closed = np.flatnonzero(t.closed)
    for a in range(0, len(closed), CHUNK):
        who = closed[a : a + CHUNK]
        x, e = _softmax(_word_scores(model, t, who))
        out[who] += x[np.arange(len(x)), t.rank[who] % CLASS_WORDS] - np.log(e.sum(1))
    return out


def _spread(into: np.ndarray, keys: np.ndarray, values: np.ndarray) -> None:
    order = np.argsort(keys, kind="stable")
    starts = run_starts(keys[order])
    into[keys[order[starts]]] += np.add.reduceat(values[order], starts, axis=0)


def _observe(into: np.ndarray, keys: np.ndarray, column: np.ndarray) -> None:
    flat = into.reshape(-1)
    flat += np.bincount(keys * into.shape[1] + column, minlength=len(flat)).astype(np.float32)


def statistics(model: Model, batches: Iterable[pa.RecordBatch]) -> list[np.ndarray] | None:
    """Observed and expected counts of every feature over a task's documents."""
    shapes = [model.ngram.shape, model.skip.shape, model.word.shape]
    observed, expected = [np.zeros(s, np.float32) for s in shapes], [np.zeros(s, np.float32) for s in shapes]
    any_rows = False
    for batch in slices(batches):
        any_rows = True
        t = Tokens(batch.column("text"), model)
        for keys, o in ((t.ngram, observed[0]), (t.skip, observed[1])):
            _observe(o, keys, t.cls)
        closed = np.flatnonzero(t.closed)
        _observe(observed[2], t.context[closed] * CLOSED + t.cls[closed], t.rank[closed] % CLASS_WORDS)
        for a in range(0, len(t), CHUNK):
            at = slice(a, a + CHUNK)
            _, e = _softmax(_class_scores(model, t, at))
            e /= e.sum(1, keepdims=True)
            _spread(expected[0], t.ngram[at], e)
            _spread(expected[1], t.skip[at], e)
        for a in range(0, len(closed), CHUNK):
            who = closed[a : a + CHUNK]
            _, e = _softmax(_word_scores(model, t, who))
            e /= e.sum(1, keepdims=True)
            _spread(expected[2], t.context[who] * CLOSED + t.cls[who], e)
    return [*observed, *expected] if any_rows else None


def _summed(parts: DataFrame, fan: int) -> dict[int, np.ndarray]:
    """Sum vectors (block, values) by block; each block's pass through ``fan`` tasks first, so that none meets them all."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, values in zip(batch.column("block").to_pylist(), batch.column("values").to_pylist(), strict=True):
                v = np.frombuffer(values, np.float32)
                sums[block] = sums[block] + v if block in sums else v.astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_pydict({"block": pa.array(list(sums), pa.int32()), "values": pa.array([v.astype(np.float32).tobytes() for v in sums.values()], pa.binary())})

    schema, n = "block int, values binary", partitions(parts.sparkSession)
    salted = parts.repartition(n, "block", F.pmod(F.col("task"), F.lit(fan))).select("block", "values").mapInArrow(add, schema)
    total = salted.repartition(n, "block").mapInArrow(add, schema)
    return {r["block"]: np.frombuffer(r["values"], np.float32) for r in total.collect()}  # as large as the model


def _round(source: DataFrame, model: Model, text_size: int) -> list[np.ndarray]:
    """Observed and expected counts over all of ``source`` (text), whose texts have about ``text_size`` bytes."""
    from pyspark import TaskContext

    shapes = [model.ngram.shape, model.skip.shape, model.word.shape] * 2
    sizes = [int(np.prod(s)) for s in shapes]
    tasks = max(1, text_size // (READ_PER_SENT * 4 * sum(sizes)))
    sent = source.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = statistics(sent.value, batches)
        if found is None:
            return
        flat = np.concatenate([x.reshape(-1) for x in found])
        blocks = [b for b in range(0, len(flat), BLOCK) if flat[b : b + BLOCK].any()]
        yield pa.RecordBatch.from_pydict({"block": pa.array([b // BLOCK for b in blocks], pa.int32()), "task": pa.array([TaskContext.get().partitionId()] * len(blocks), pa.int32()), "values": pa.array([flat[b : b + BLOCK].tobytes() for b in blocks], pa.binary())})

    flat = np.zeros(sum(sizes))
    for block, values in _summed(source.coalesce(tasks).mapInArrow(work, "block int, task int, values binary"), int(np.ceil(np.sqrt(tasks)))).items():
        flat[block * BLOCK : block * BLOCK + len(values)] = values
    sent.unpersist()
    ends = np.cumsum(sizes)
    return [flat[e - n : e].reshape(s) for e, n, s in zip(ends, sizes, shapes, strict=True)]


def _step(observed: np.ndarray, expected: np.ndarray, rate: float, prior: float = 10.0) -> np.ndarray:
    share = expected / np.maximum(expected.sum(1, keepdims=True), 1e-9)
    return (rate * np.log((observed + prior * share + 1e-6) / (expected + prior * share + 1e-6))).astype(np.float32)


def climb(model: Model, counts: list[np.ndarray], number: int) -> None:
    """One step: class weights share it between the two features that every token has, word weights have one."""
    o_ngram, o_skip, o_word, e_ngram, e_skip, e_word = counts
    total_o, total_e = o_ngram.sum(0), e_ngram.sum(0)
    model.class_bias = model.class_bias + _step(total_o[None], total_e[None], 1.0)[0]
    back = np.log((total_o + 1e-6) / (total_e + 1e-6))
    e_ngram, e_skip = e_ngram * np.exp(back), e_skip * np.exp(back)
    damped = 1 / (1 + 0.5 * number)  # later rounds see other documents: the steps average over them
    model.ngram = model.ngram + _step(o_ngram, e_ngram, 0.6 * damped)
    model.skip = model.skip + _step(o_skip, e_skip, 0.6 * damped)
    model.word = model.word + _step(o_word, e_word, damped)


def count_words(train: DataFrame) -> DataFrame:
    """word (hash), n of every word of all training tokens, END included."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values, places, _ = words_of(batch.column("text"), lower=True)
            n = np.bincount(places, minlength=len(values))
            hashes = np.fromiter(map(word_hash, [*values.to_pylist(), END]), np.uint64, len(values) + 1)
            n = np.append(n, batch.num_rows)
            yield pa.RecordBatch.from_pydict({"word": pa.array(hashes[n > 0].view(np.int64)), "n": pa.array(n[n > 0].astype(np.int64))})

    return train.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def train_model(train: DataFrame, words: DataFrame, rounds: int = ROUNDS, counted: int = COUNTED) -> Model:
    """Fit on all rows of ``train`` (text, part: a number that deals rows to rounds), with their words' counts."""
    end = int(np.array(word_hash(END), np.uint64).view(np.int64))
    top = words.orderBy(F.col("word") != end, F.desc("n"), "word").limit(counted).toPandas()  # bounded by ``counted``
    tokens = int(words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"])
    model = Model.start(top["word"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(float), tokens)
    size = text_bytes(train) if tokens else 0
    for number in range(rounds if tokens else 0):
        climb(model, _round(train.where(F.pmod(F.col("part"), F.lit(rounds)) == number).select("text"), model, size // rounds), number)
    return model


_DOC = pa.schema([("doc", pa.int64()), ("tag", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("unigram", pa.float64()), ("within", pa.float64()), ("model", pa.float64()), ("open", pa.list_(pa.int64())), ("rare", pa.list_(pa.int64()))])
_DOC_SQL = "doc long, tag long, doc_id long, n_tokens long, known long, unigram double, within double, model double, open array<long>, rare array<long>"


def _by_document(source: DataFrame, model: Model) -> DataFrame:
    """Sums that need no rare word's count, and the rare words."""
    sent = source.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        logs = np.append(np.log10(m.counts + 0.1), 0.0)  # the last for words that aren't counted
        for batch in slices(batches):
            t = Tokens(batch.column("text"), m)
            counted = t.rank >= 0
            unigram = logs[t.rank]
            owner = np.repeat(np.arange(batch.num_rows), t.counts)
            opened = np.bincount(owner * CLASSES + t.cls, minlength=batch.num_rows * CLASSES).reshape(-1, CLASSES)[:, CLOSED:]
            rare = np.flatnonzero(~counted)
            ends = np.searchsorted(owner[rare], np.arange(batch.num_rows + 1))
            total = lambda x: np.add.reduceat(x, t.begin)
            cols = [
                *(batch.column(c) for c in ("doc", "tag", "doc_id")),
                pa.array(t.counts),
                pa.array(total(counted.astype(np.int64))),
                pa.array(total(unigram)),
                pa.array(total(np.where(t.closed, 0.0, unigram))),
                pa.array(total(log_p(m, t)) / np.log(10)),
                pa.array(list(opened), pa.list_(pa.int64())),
                pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(t.hash[rare].view(np.int64))),
            ]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, _DOC, strict=True)], schema=_DOC)

    return source.select("doc", "tag", "doc_id", "text").mapInArrow(work, _DOC_SQL)


def score_documents(docs: DataFrame, train: Column, *, text: str = "text", doc_id: str = "doc_id", rounds: int = ROUNDS, counted: int = COUNTED) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row.

    Tokens are the words of the text in ASCII lower case and one end. Rows for
    which ``train`` (over doc_id) holds are learned from. base_score is the
    unigram log10 probability with 0.1 added to every count and one more word
    for all unknown ones; score is the model's log10 probability, in which
    unknown words of an open class share one place likewise.

    Null and empty texts are an end alone; very long ones count whole. A row
    with a null id, for which ``train`` is null, is not learned from. Rows
    repeated with id and text count as often as they occur and score alike.
    Without training rows every token is unknown. An empty table gives no
    rows; further columns are ignored.
    """
    own = F.coalesce(F.col(text), F.lit(""))
    source = docs.select(as_long(doc_id).alias("doc_id"), own.alias("text")).withColumn("trains", F.coalesce(train, F.lit(False)))
    source = source.withColumns({"doc": F.coalesce("doc_id", F.lit(-(1 << 63))), "tag": F.crc32(F.col("text").cast("binary"))})
    learned = source.where("trains").select("text", F.xxhash64("doc_id").alias("part"))
    words = settle(count_words(learned))
    model = train_model(learned, words, rounds, counted)
    by_doc = settle(_by_document(source, model))
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("words")).first()
    tokens, kinds_all = int(totals["tokens"]), int(totals["words"])
    # Counts and kinds of the words of each open class: all words but those of closed classes. A row a class.
    held, kinds = np.zeros(OPEN), np.zeros(OPEN)
    for r in words.groupBy(F.col("word").bitwiseAND(OPEN - 1).alias("cls")).agg(F.sum("n").alias("c"), F.count("*").alias("v")).collect():
        held[r["cls"]], kinds[r["cls"]] = r["c"], r["v"]
    closed = (model.words[:HEAD] & np.uint64(OPEN - 1)).astype(np.int64)
    held -= np.bincount(closed, model.counts[:HEAD], OPEN)
    kinds -= np.bincount(closed, minlength=OPEN)
    places = np.log10(held + 0.1 * (kinds + 1))
    # A word that isn't among the most frequent has few tokens: none is a hot key.
    met = by_doc.select("doc", "tag", F.explode("rare").alias("word")).join(words, "word", "left")
    extra = met.groupBy("doc", "tag").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("rare_unigram"), F.count("n").alias("rare_known"))
    # Rows equal in id and text have the same rare words: count their tokens once.
    copies = by_doc.groupBy("doc", "tag").agg(F.count("*").alias("copies"))
    joined = by_doc.drop("rare").join(extra, ["doc", "tag"], "left").join(copies, ["doc", "tag"])
    added = F.coalesce(F.col("rare_unigram") / F.col("copies"), F.lit(0.0))
    share = sum((F.element_at("open", i + 1) * F.lit(float(p)) for i, p in enumerate(places)), F.lit(0.0))
    return joined.select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce((F.col("rare_known") / F.col("copies")).cast("long"), F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("unigram") + added - F.col("n_tokens") * F.lit(float(np.log10(tokens + 0.1 * (kinds_all + 1))))).alias("base_score"),
        (F.col("model") + F.col("within") + added - share).alias("score"),
    )


def perplexity(scored: DataFrame, column: str) -> float:
    """10 to the mean loss a token; not a number without tokens."""
    row = scored.agg(F.sum(column).alias("s"), F.sum("n_tokens").alias("n")).first()
    return float(10 ** (-row["s"] / row["n"])) if row["n"] else float("nan")
