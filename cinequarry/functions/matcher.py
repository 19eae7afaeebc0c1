"""One automaton over all surface words, for many texts: places, substrings of scripts without blanks, and denials.

A trie of the words with failure links finds every word of a text in one pass,
however many words there are; so texts never meet a word table in a join.
Plain words count where no plain letter or digit stands beside them, words of
scripts without blanks (wide ones) anywhere. Offsets are UTF-8 bytes of the
lower-case text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping, Sequence
from functools import lru_cache

import ahocorasick

_PLAIN = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
#: Letters that a term may have, and those that make it wide.
TERM, WIDE = r"[a-z0-9぀-鿿]+", r"[⺀-鿿]"
_TERMS, _WIDE, _WORDS = re.compile(TERM), re.compile(WIDE), re.compile(r"[a-z0-9]+")


class Matcher:
    """The automaton of some words."""

    def __init__(self, words: Iterable[str]):
        self.automaton = ahocorasick.Automaton()
        for w in set(words):
            self.automaton.add_word(w, w)
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def places(self, text: str) -> Iterator[tuple[str, int]]:
        """(word, character where it begins) of every word of a lower-case text, by end."""
        if self.empty:
            return
        for end, word in self.automaton.iter(text):
            start = end - len(word) + 1
            if word.isascii() and (start and text[start - 1] in _PLAIN or end + 1 < len(text) and text[end + 1] in _PLAIN):
                continue
            yield word, start


@lru_cache(maxsize=8)
def matcher(words: tuple[str, ...]) -> Matcher:
    """A matcher that a worker builds once."""
    return Matcher(words)


class Offsets:
    """Bytes before a character."""

    def __init__(self, text: str):
        self.text, self.plain = text, text.isascii()

    def __call__(self, at: int) -> int:
        return at if self.plain else len(self.text[:at].encode())


def denial_spans(text: str, found: Sequence[tuple[str, int]], negations: Sequence[str], clause_ends: str) -> list[tuple[int, int]]:
    """Byte ranges that the negation words among ``found`` deny.

    A wide word denies up to the end of its clause at every occurrence, a
    plain one itself and two bytes more, at its first.
    """
    out, seen = [], set()
    byte = Offsets(text)
    for word, start in found:
        if word not in negations:
            continue
        end = start + len(word)
        if word.isascii():
            if word not in seen:
                seen.add(word)
                out.append((byte(start), byte(end) + 2))
        else:
            stop = end
            while stop < len(text) and text[stop] not in clause_ends:
                stop += 1
            out.append((byte(start), byte(stop)))
    return out


def families(found: Sequence[tuple[str, int]], names: Mapping[str, Sequence[tuple[str, str]]]) -> dict[tuple[str, str], int]:
    """(kind, concept) to the earliest character of any of its words; ``names`` gives the concepts of a word."""
    out: dict[tuple[str, str], int] = {}
    for word, start in found:
        for family in names.get(word, ()):
            out[family] = min(start, out.get(family, start))
    return out


def terms(text: str) -> Iterator[tuple[str, int]]:
    """(term, first character) of every run of letters and digits, each once."""
    seen = set()
    for m in _TERMS.finditer(text):
        if m[0] not in seen:
            seen.add(m[0])
            yield m[0], m.start()


def words(text: str) -> dict[str, int]:
    """Every plain word and the first character where it stands whole."""
    out: dict[str, int] = {}
    for m in _WORDS.finditer(text):
        out.setdefault(m[0], m.start())
    return out


def wide_grams(text: str) -> set[str]:
    """Every two and three neighbouring letters of a term with a wide one among them: what a short wide term can be found by."""
    out = set()
    for m in _TERMS.finditer(text):
        run = m[0]
        if run.isascii():
            continue
        for n in (2, 3):
            out.update(g for i in range(len(run) - n + 1) if _WIDE.search(g := run[i : i + n]))
    return out


def is_wide(term: str) -> bool:
    return _WIDE.search(term) is not None
