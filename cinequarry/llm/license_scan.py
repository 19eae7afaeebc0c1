"""License scans: MinHash bands over overlapping text windows retrieve templates.

A template of n shingles is held where a stretch of SPREAD * n shingles, at any
place of a document, has the threshold's share of them; so up to 1.5 n words may
be put in. Templates are grouped by their number of shingles. For a group of at
most L, a document is cut into blocks of L / 4 shingles; every stretch lies whole
in a window of blocks that is less than a block longer. A template held in it has
a known least Jaccard similarity s with that window; the group has as many bands
of one MinHash value as bring the chance that none collides, (1 - s) ** bands,
under ``miss``. A window has a template's value only if one of its blocks has, so
blocks are looked up. Retrieved templates are verified in the whole document, on
their shingles' words, in every stretch.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict, deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, as_long, gram_hashes, mix, raw_texts, slices, word_codes

# Public licence statements.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.",),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "BSD-2-Clause": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "AGPL-3.0": ("You should have received a copy of the GNU Affero General Public License along with this program.",),
    "CC-BY-SA-4.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",),
}
_PUNCTUATION = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))
_FOLD = bytes(_PUNCTUATION[LOWER[b]] for b in range(256))
SHINGLE, THRESHOLD, MISS = 5, 0.75, 1e-6
#: Shingles of a stretch to those of the template.
SPREAD = 2.5


def words_of(text: bytes) -> list[bytes]:
    """Lower-case words without ASCII punctuation."""
    return text.translate(_FOLD).split()


def _grams(words: list[bytes], k: int) -> list[tuple[bytes, ...]]:
    return [tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []


class Templates:
    def __init__(self, templates: dict[str, tuple[str, ...]], k: int, threshold: float, miss: float):
        self.k, self.threshold = k, threshold
        self.names = [(name, i) for name, texts in templates.items() for i in range(len(texts))]
        self.sets = [set(_grams(words_of(templates[name][i].encode()), k)) for name, i in self.names]
        codes = [word_codes(pa.array([templates[name][i].encode().translate(_FOLD)]))[0] for name, i in self.names]
        self.hashes = hashes = [np.unique(gram_hashes(c, min(k, max(1, len(c))))) for c in codes]
        by_size: dict[int, list[int]] = defaultdict(list)
        for t, h in enumerate(hashes):
            if len(h):
                by_size[math.ceil(math.log(len(h), 1.25))].append(t)
        telling: set[int] = set()
        #: Block length, seeds of the bands, and the templates by band and value.
        self.groups: list[tuple[int, np.ndarray, list[dict[int, list[int]]]]] = []
        for _, members in sorted(by_size.items()):
            longest = max(len(hashes[t]) for t in members)
            block = max(1, longest // 4)
            s = min(self.needed(t) / (self.stretch(t) + block - 1 + len(hashes[t]) - self.needed(t)) for t in members)
            bands = math.ceil(math.log(miss) / math.log(1 - s))
            seeds = mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(longest)) | np.uint64(1)
            tables: list[dict[int, list[int]]] = []
            for seed in seeds:
                table: dict[int, list[int]] = defaultdict(list)
                for t in members:
                    values = hashes[t] * seed
                    table[int(values.min())].append(t)
                    telling.add(int(hashes[t][values.argmin()]))
                tables.append(dict(table))
            self.groups.append((block, seeds, tables))
        #: Shingles that give a template its value in some band, sorted.
        self.telling = np.array(sorted(telling), np.uint64)

    def needed(self, template: int) -> int:
        return max(1, math.ceil(self.threshold * len(self.sets[template]) - 1e-9))

    def stretch(self, template: int) -> int:
        return math.ceil(SPREAD * len(self.sets[template]))

    def scan(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
        """(text, template, most shared shingles, first word of that stretch) of every template held.

        A block can only have a template's value of a band if it holds the
        shingle that gives it, so texts without any of these are passed over.
        """
        codes, counts = word_codes(pa.array([t.translate(_FOLD) for t in texts], pa.binary()))
        grams = gram_hashes(codes, self.k)
        if not len(self.telling):
            return
        at = np.minimum(np.searchsorted(self.telling, grams), len(self.telling) - 1)
        ends = np.cumsum(counts)
        places = np.unique(np.searchsorted(ends, np.flatnonzero(self.telling[at] == grams), side="right")).tolist()
        if places:
            spans = [slice(int(ends[d] - counts[d]), int(ends[d])) for d in places]
            own = np.concatenate([codes[s] for s in spans])
            for doc, *rest in self._retrieved([texts[d] for d in places], own, counts[places]):
                yield places[doc], *rest

    def _retrieved(self, texts: list[bytes], codes: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        grams = gram_hashes(codes, self.k)
        padded = np.append(grams, np.uint64(0))
        ends = np.cumsum(counts)
        sizes = np.maximum(counts - self.k + 1, 0)
        found: set[tuple[int, int]] = set()
        for length, seeds, tables in self.groups:
            per = -(-sizes // length)
            owner = np.repeat(np.arange(len(texts)), per)
            if not len(owner):
                continue
            inner = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
            starts = (ends - counts)[owner] + inner * length
            stops = np.minimum(starts + length, (ends - self.k + 1)[owner])
            edges = np.stack([starts, stops], 1).reshape(-1)
            for seed, table in zip(seeds, tables, strict=True):
                low = np.minimum.reduceat(padded * seed, edges)[::2]
                wanted = np.fromiter(table, np.uint64, len(table))
                for b in np.flatnonzero(np.isin(low, wanted)).tolist():
                    found.update((int(owner[b]), t) for t in table[int(low[b])])
        for doc, t in sorted(found):
            begin = int(ends[doc] - counts[doc])
            shared, at = self.most(words_of(texts[doc]), grams[begin : begin + int(sizes[doc])], t)
            if shared >= self.needed(t):
                yield doc, t, shared, at

    def most(self, words: list[bytes], grams: np.ndarray, template: int) -> tuple[int, int]:
        """(most distinct shingles of the template in a stretch, the first of them in the first such stretch)."""
        inside: deque[tuple[int, tuple[bytes, ...]]] = deque()
        times: Counter = Counter()
        best, first, length = 0, 0, self.stretch(template)
        for at in np.flatnonzero(np.isin(grams, self.hashes[template])).tolist():
            gram = tuple(words[at : at + self.k])
            if gram not in self.sets[template]:
                continue
            inside.append((at, gram))
            times[gram] += 1
            while inside[0][0] <= at - length:
                _, old = inside.popleft()
                times[old] -= 1
                if not times[old]:
                    del times[old]
            if len(times) > best:
                best, first = len(times), inside[0][0]
        return best, first


def license_scan(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", templates: dict[str, tuple[str, ...]] = TEMPLATES, k: int = SHINGLE, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """doc_id, license, statement, n_template, n_shared, first_word: a row per document and statement that it holds.

    Words are lower-cased (ASCII) and split at white space and ASCII
    punctuation. A statement of n distinct k-word shingles is held when a
    stretch of SPREAD * n shingles has at least ``threshold`` of them; n_shared
    is the most that one stretch has, first_word where the first shared shingle
    of the first such stretch begins. Templates of fewer than k words are
    refused.

    Null, empty and short texts hold nothing; very long ones are scanned whole. Repeated rows and ids give rows
    each. An empty table gives no rows; further columns are not read, whatever their names.
    """
    short = [s for texts in templates.values() for s in texts if len(words_of(s.encode())) < k]
    if short:
        raise ValueError(f"templates need {k} words at least: {short}")
    index = Templates(templates, k, threshold, miss)
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("statement", pa.int32()), ("n_template", pa.int64()), ("n_shared", pa.int64()), ("first_word", pa.int64())])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = batch.column("doc_id")
            rows = [(ids[d].as_py(), *index.names[t], len(index.sets[t]), shared, at) for d, t, shared, at in index.scan(raw_texts(batch))]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    source = docs.select(as_long(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return source.mapInArrow(scan, "doc_id long, license string, statement int, n_template long, n_shared long, first_word long")


def statement_pattern(text: str) -> re.Pattern:
    """A plain pattern for a statement's words, for spot checks."""
    return re.compile(r"\W+".join(re.escape(w.decode()) for w in words_of(text.encode())), re.I)
