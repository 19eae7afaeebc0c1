"""Personal data in whole texts: fixed patterns, and a conditional random field that adds to them.

The patterns find e-mail and IP addresses, payment cards and international
phone numbers. The field is a linear chain over the words of a text: a word's
features are shapes (its own and its neighbours'), what its digits are worth,
and neighbouring words that the examples know. It is trained by gradient
ascent on the exact likelihood, and decoded by Viterbi over many stretches at
once in numpy.

A word so surely outside personal data that no transition can outweigh it cuts
the chain: what lies left and right is decoded apart, with the same result as
decoding the whole text. Its weights depend on a word and its neighbours
alone, so they are summed once for each distinct word of a batch.

A null text is empty; empty texts have no spans; very long texts are read
whole; repeated rows, null ids and further columns stay as they are. An empty
table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw_texts, slices, words_of
from .pii_examples import examples

KINDS = ("email", "ip", "card", "phone")
#: Outside, then the kinds.
TAGS = ("", *KINDS)
#: Length of the longest gap between two words of one span, and the characters that a span doesn't begin or end with.
GAP, EDGES = 3, "\"'`.,;:!?<>[]{}|*#&%$_=-/\\"
#: Rounds of training and the strength of the pull to zero.
ROUNDS, PULL = 150, 0.02
_SPANS = "array<struct<kind:string,start:long,end:long,base:boolean>>"


# Base patterns ------------------------------------------------------------------------------------------------------

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    """Whether the check digit fits: from the right, every second digit counts double, less nine beyond nine."""
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Every @ has one local part at most, the run before it; so a text is passed over once."""
    after, at = 0, text.find("@")
    while at >= 0:
        run = text[after:at]
        start = after + len(run.rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        after = found.end() if found else at + 1
        if found:
            yield start, after
        at = text.find("@", after)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) in code points, sorted: leftmost, not overlapping within a kind; failing matches are dropped."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# Features -----------------------------------------------------------------------------------------------------------


def shape(word: str) -> str:
    """Digits as 9, letters as a, all else as it is; runs of letters as one, of over six digits as seven."""
    s = re.sub(r"[0-9]", "9", word[:64])
    s = re.sub(r"[^\W\d_]+", "a", s)
    return re.sub(r"9{7,}", "9999999", s)


@lru_cache(maxsize=1 << 16)
def word_features(word: str) -> tuple[str, ...]:
    """What a word says of itself; its neighbours see the same under other names."""
    core = word.strip(EDGES)
    form = shape(core)
    out = ["any", f"s={form}", "c=" + re.sub(r"9+", "9", form)]
    digits = _NOT_DIGIT.sub("", core)
    if digits:
        out.append(f"n={min(len(digits), 20)}")
        letters = any(c.isalpha() for c in core)
        out.append(f"mixed={letters}")
        if len(digits) >= 14 and not letters:
            out.append(f"luhn={luhn(digits)}")
        parts = core.split(".")
        if len(parts) > 2:
            out.append(f"parts={len(parts)}:{all(p.strip('[]').isdigit() and len(p.strip('[]')) < 4 and int(p.strip('[]')) < 256 for p in parts)}")
    else:
        out.append(f"w={core.lower()[:24]}")
        out.append("dotted=" + str("." in core))
    out.extend(f"has={c}" for c in "@+()" if c in core)
    return tuple(out)


@dataclass(frozen=True)
class Field:
    """Weights of features for each tag, at the word itself, the word before and the word after; and of neighbouring tags."""

    names: dict[str, int]
    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    moves: np.ndarray

    def of_features(self, features: Iterable[str]) -> np.ndarray:
        """What they add to the scores of the word's own tags, of those of the word after and of the word before."""
        at = [self.names[f] for f in features if f in self.names]
        return np.stack([w[at].sum(axis=0) for w in (self.own, self.before, self.after)])

    def of_words(self, words: pa.Array) -> np.ndarray:
        """of_features() of every word, 3 rows each.

        Most words are letters that no example has: they all say the same.
        """
        words = words.cast(pa.string())
        told = pa.array([f[2:] for f in self.names if f.startswith("w=")], pa.string())
        core = pc.utf8_trim(words, characters=EDGES)
        known = pc.is_in(pc.utf8_slice_codeunits(pc.utf8_lower(core), 0, 24), value_set=told)
        plain = pc.and_(pc.match_substring_regex(core, r"^\pL+$"), pc.invert(known)).to_numpy(zero_copy_only=False)
        out = np.empty((len(words), 3, len(TAGS)))
        out[plain] = self.of_features(("any", "s=a", "c=a", "dotted=False"))
        for i in np.flatnonzero(~plain).tolist():
            out[i] = self.of_features(word_features(words[i].as_py()))
        return out

    def sure(self) -> float:
        """By how much a word must prefer to be outside to be so wherever a neighbour is, or the text ends.

        Taking it out of a span's end changes two transitions, or one at the
        text's end; this is the most they can lose.
        """
        m, o = self.moves, self.moves[0, 0]
        y = m[1:, 1:]  # [before, after]
        right, left = y - m[1:, :1], y - m[:1, 1:]  # the word is the span's last, or its first
        return float(max(right.max(), left.max(), (right + m[1:, 0][None, :] - o).max(), (left + m[0, 1:][:, None] - o).max(), (m[0, 1:] + m[1:, 0] - 2 * o).max(), (m[0, 1:] - o).max(), (m[1:, 0] - o).max(), 0.0))

    def bridge(self, words: np.ndarray) -> np.ndarray:
        """The most that a span gains by running through so many words rather than ending before them and starting anew behind."""
        m = self.moves
        return (words + 1) * m[1:, 1:].max() - m[1:, 0].min() - m[0, 1:].min() - (words - 1) * m[0, 0]


def viterbi(scores: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best tags of many sequences, laid one behind the other; of equal paths the one with smaller tags from the right.

    Sequences are sorted by size and stepped together, so a step costs one numpy call for all.
    """
    n = len(sizes)
    if not n:
        return np.empty(0, np.int64)
    first = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    first, left = first[order], sizes[order]
    live = len(order) - np.searchsorted(left[::-1], np.arange(1, left[0] + 1))  # sequences with at least so many words
    best = scores[first]
    back: list[np.ndarray] = []
    last = np.empty((n, scores.shape[1]))
    for t in range(1, int(left[0])):
        m = int(live[t])
        last[m : len(best)] = best[m:]
        paths = best[:m, :, None] + moves[None]
        back.append(paths.argmax(axis=1))
        best = paths.max(axis=1) + scores[first[:m] + t]
    last[: len(best)] = best
    tags = np.empty(int(sizes.sum()), np.int64)
    now = last.argmax(axis=1)
    tags[first + left - 1] = now
    for t in range(int(left[0]) - 1, 0, -1):
        m = int(live[t])
        now[:m] = back[t - 1][np.arange(m), now[:m]]
        tags[first[:m] + t - 1] = now[:m]
    return tags


# Training -----------------------------------------------------------------------------------------------------------


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _marginals(scores: np.ndarray, mask: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(chance of each tag at each word, expected neighbouring tags, log of all paths' weight) by forward and backward sums."""
    n, length, k = scores.shape
    forward, backward = np.zeros_like(scores), np.zeros_like(scores)
    forward[:, 0] = scores[:, 0]
    for t in range(1, length):
        step = _logsum(forward[:, t - 1, :, None] + moves[None], 1) + scores[:, t]
        forward[:, t] = np.where(mask[:, t, None], step, forward[:, t - 1])
    for t in range(length - 2, -1, -1):
        step = _logsum(moves[None] + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
        backward[:, t] = np.where(mask[:, t + 1, None], step, backward[:, t + 1])
    whole = _logsum(forward[:, -1], 1)
    single = np.exp(forward + backward - whole[:, None, None]) * mask[:, :, None]
    pairs = np.zeros((k, k))
    for t in range(1, length):
        both = np.exp(forward[:, t - 1, :, None] + moves[None] + (scores[:, t] + backward[:, t])[:, None, :] - whole[:, None, None])
        pairs += (both * mask[:, t, None, None]).sum(axis=0)
    return single, pairs, float(whole.sum())


def train(rows: list[tuple[str, list[tuple[str, int, int]]]], *, rounds: int = ROUNDS, pull: float = PULL) -> Field:
    """A field from examples: (text, [(kind, start, end)]).

    Gradient ascent with a step of its own for each weight, always over all
    rows, so the same rows give the same weights. Without rows every word is
    outside.
    """
    sentences = []
    for text, spans in rows:
        found = [(m.start(), m.end()) for m in re.finditer(r"[^ \t-\r]+", text)]
        tags = [next((TAGS.index(k) for k, s, e in spans if s < b and a < e), 0) for a, b in found]
        if found:
            sentences.append(([text[a:b] for a, b in found], tags))
    names: dict[str, int] = {}
    for ws, _ in sentences:
        for w in ws:
            for f in word_features(w):
                names.setdefault(f, len(names))
    k, length = len(TAGS), max((len(ws) for ws, _ in sentences), default=1)
    n = len(sentences)
    mask, gold = np.zeros((n, length), bool), np.zeros((n, length), np.int64)
    where, feature = [], []  # cell of the word, feature
    for i, (ws, tags) in enumerate(sentences):
        mask[i, : len(ws)], gold[i, : len(ws)] = True, tags
        for t, w in enumerate(ws):
            for f in word_features(w):
                where.append(i * length + t)
                feature.append(names[f])
    cell, feature = np.array(where, np.int64), np.array(feature, np.int64)
    weights = np.zeros((3, len(names), k))
    weights_of = lambda w: np.stack([np.bincount(cell, w[feature, y], n * length) for y in range(k)], axis=1).reshape(n, length, k)
    moves = np.zeros((k, k))
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(moves), np.zeros_like(moves)]
    once = np.eye(k)
    truth = once[gold] * mask[:, :, None]
    true_pairs = np.einsum("nta,ntb->ab", truth[:, :-1], truth[:, 1:])
    for step in range(1, rounds + 1 if n else 1):
        own, before, after = (weights_of(weights[j]) for j in range(3))
        scores = own.copy()
        scores[:, 1:] += before[:, :-1]
        scores[:, :-1] += after[:, 1:]
        single, pairs, _ = _marginals(np.where(mask[:, :, None], scores, 0.0), mask, moves)
        error = truth - single
        shifted = [error, np.zeros_like(error), np.zeros_like(error)]
        shifted[1][:, :-1], shifted[2][:, 1:] = error[:, 1:], error[:, :-1]
        slope = np.stack([np.stack([np.bincount(feature, e.reshape(-1, k)[cell, y], len(names)) for y in range(k)], axis=1) for e in shifted]) - pull * weights
        for value, gradient, a, b in ((weights, slope, moments[0], moments[1]), (moves, true_pairs - pairs - pull * moves, moments[2], moments[3])):
            a += 0.1 * (gradient - a)
            b += 0.01 * (gradient**2 - b)
            value += 0.1 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    if not n:
        weights, moves = np.zeros((3, 0, k)), np.zeros((k, k))
    return Field(names, weights[0], weights[1], weights[2], moves)


# Decoding -----------------------------------------------------------------------------------------------------------


def tag_words(field: Field, words: pa.Array, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The best tag of every word of all texts; ``codes`` are places among the distinct ``words``."""
    own, before, after = field.of_words(words).swapaxes(0, 1)
    tags = np.zeros(len(codes), np.int8)
    if not len(codes):
        return tags
    text = np.repeat(np.arange(len(counts)), counts)
    same = text[1:] == text[:-1]
    ahead = lambda x: (x[:, 0] - x[:, 1:].max(axis=1))[codes]  # noqa: E731  of outside, at the least
    lead = ahead(own)
    lead[1:] += np.where(same, ahead(before)[:-1], 0.0)
    lead[:-1] += np.where(same, ahead(after)[1:], 0.0)
    # Runs of words that prefer to be outside, by enough to end any span there: those that no span can cross are outside.
    prefers = lead > field.sure() + 1e-9
    change = np.concatenate(([True], (prefers[1:] != prefers[:-1]) | ~same))
    first = np.flatnonzero(change)
    words = np.diff(np.append(first, len(codes)))
    ends = np.concatenate(([True], ~same, [True]))  # a text ends before this place
    outside = prefers[first] & ((np.add.reduceat(lead, first) > field.bridge(words) + 1e-9) | ends[first] | ends[first + words])
    at = np.flatnonzero(~np.repeat(outside, words))
    if not len(at):
        return tags
    scores = own[codes[at]]
    left = (at > 0) & np.concatenate(([False], same))[at]
    right = (at < len(codes) - 1) & np.concatenate((same, [False]))[at]
    scores[left] += before[codes[at[left] - 1]]
    scores[right] += after[codes[at[right] + 1]]
    # An inert word beside a stretch is outside, and its transitions count.
    joined = (np.diff(at) == 1) & (text[at[1:]] == text[at[:-1]])
    start = np.flatnonzero(np.concatenate(([True], ~joined)))
    end = np.append(start[1:], len(at)) - 1
    scores[start] += field.moves[0][None] * left[start][:, None]
    scores[end] += field.moves[:, 0][None] * right[end][:, None]
    tags[at] = viterbi(scores, end - start + 1, field.moves)
    return tags


def _trimmed(word: str) -> tuple[int, int]:
    body = word.rstrip(EDGES + ")")
    return len(body) - len(body.lstrip(EDGES)), len(body)


def added_spans(text: str, tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of runs of words of one tag, without the punctuation around them."""
    out: list[tuple[int, int, int]] = []
    before, last = -1, 0  # the word before that counts, and its tag unless a mark closes it
    for i, m in enumerate(re.finditer(r"[^ \t-\r]+", text)):
        tag = int(tags[i])
        if not tag:
            continue
        a, b = _trimmed(m[0])
        if a >= b:
            continue
        start, end = m.start() + a, m.start() + b
        if out and before == i - 1 and last == tag and start - out[-1][2] <= GAP:
            out[-1] = (out[-1][0], tag - 1, end)
        else:
            out.append((start, tag - 1, end))
        before, last = i, 0 if m[0][-1] in ".,;:!?" else tag
    return out


def plausible(kind: int, text: str) -> bool:
    """Whether a span that the field adds can be of its kind at all."""
    digits = sum(c.isdigit() for c in text)
    if kind == 0:  # a name, a sign or word for @, a host
        local, _, host = re.sub(r"\W?\bat\b\W?", "@", text, flags=re.ASCII).partition("@")
        return local.strip(" @") != "" and re.search(r"[^\W\d_]", host) is not None and ("@" in text or "dot" in host or "." in host)
    if kind == 1:
        return 4 <= digits <= 12
    return 12 <= digits <= 19 if kind == 2 else 7 <= digits <= 15


def find_spans(docs: DataFrame, field: Field, *, text: str = "text", column: str = "spans") -> DataFrame:
    """``docs`` with ``column``: (kind, start, end, base) by start, then kind, in code points with the end exclusive.

    All spans of the base patterns, and those of the field that meet none of them.
    """
    if column in docs.columns:
        raise ValueError(f"there is a column {column} already: name another")
    shared = docs.sparkSession.sparkContext.broadcast(field)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in slices(batches, "__text"):
            texts = batch.column("__text")
            values, codes, counts = words_of(texts)
            tags = tag_words(known, values, codes, counts)
            held = np.add.reduceat(np.append(tags != 0, False), np.minimum(np.cumsum(counts) - counts, len(tags))) * (counts > 0)
            # Patterns need a digit or an @, which most texts lack.
            marked = pc.match_substring_regex(pc.fill_null(texts, ""), "[0-9@]").to_numpy(zero_copy_only=False)
            out, first = [], 0
            for i, n in enumerate(counts.tolist()):
                spans: list[dict] = []
                if marked[i] or held[i]:
                    whole = texts[i].as_py() or ""
                    base = base_spans(whole)
                    spans = [{"kind": KINDS[k], "start": s, "end": e, "base": True} for s, k, e in base]
                    if held[i]:
                        for s, k, e in added_spans(whole, tags[first : first + n]):
                            if plausible(k, whole[s:e]) and not any(s < e2 and s2 < e for s2, _, e2 in base):
                                spans.append({"kind": KINDS[k], "start": s, "end": e, "base": False})
                        spans.sort(key=lambda x: (x["start"], KINDS.index(x["kind"]), x["end"]))
                out.append(spans)
                first += n
            columns = [batch.column(c) for c in batch.schema.names if c != "__text"]
            names = [c for c in batch.schema.names if c != "__text"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.list_(span))], names=[*names, column])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{column}` {_SPANS}"])
    return docs.withColumn("__text", F.coalesce(F.col(text).cast("string"), F.lit(""))).mapInArrow(found, schema)


def default_field(*, rounds: int = ROUNDS) -> Field:
    """The field trained on the built-in examples."""
    return train(examples(), rounds=rounds)
