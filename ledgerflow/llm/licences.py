"""Licence notices in documents: a trained paragraph classifier, confirmed by comparison with templates.

Word n-grams are sparse features of a multinomial logistic regression over licence families and an unknown class. It is
trained on variants of the templates (words dropped and embedded in other words) and on paragraphs of other text; the
unknown class's offset is then set so that on held-back variants and paragraphs its probability is right on average.

Every paragraph of every text is classified, in windows of several widths, since a notice may be a few words of a long one.
Paragraphs end at blank lines; line breaks and comment marks in them don't matter. Where a family is likely in some window,
its templates are looked for: a notice is a place where enough of a template's word pairs are, and whose words, without those
of other notices, are predicted as that family.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Short notices and headers of public licences, as their texts ask to be quoted.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "MIT License",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Apache License Version 2.0, January 2004",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    ),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.",),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."),
    "ISC": ("Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
}
#: Fixed value: the tag that names a licence in a line of source.
TAG = "SPDX-License-Identifier: "
UNKNOWN = "unknown"
#: A template's word pairs are looked for within twice so many words, or twice its own.
REACH = 24
#: Widths of the windows that are classified, in words, each moved by a quarter; a family is looked for from LIKELY on.
WIDTHS, LIKELY = (4, 8, 16, 32, 64), 0.2
#: Words whose windows are classified at a time.
_CHUNK = 1 << 14
LEAST_PROBABILITY, LEAST_OVERLAP = 0.5, 0.75
VARIANTS, EPOCHS, RATE, PENALTY = 60, 12, 0.5, 1e-4
_WORD = re.compile(r"[^\W_]+(?:[-.][^\W_]+)*")
_FILLER = "lorem ipsum dolor sit amet consectetur project code documentation see file details copyright author year contact page more about read section".split()


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(words: list[str]) -> list[str]:
    """Runs of one to three words, as often as they occur."""
    return [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def templates() -> dict[str, tuple[str, ...]]:
    """The templates of every family, with its tag."""
    return {f: (*t, TAG + f) for f, t in TEMPLATES.items()}


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]  # the last is UNKNOWN
    vocabulary: dict[str, int]
    weights: np.ndarray
    offset: np.ndarray

    @cached_property
    def pairs(self) -> dict[str, list[frozenset[str]]]:
        return {f: [frozenset(" ".join(p) for p in zip(w, w[1:], strict=False)) for w in map(words_of, t)] for f, t in templates().items()}

    def probabilities(self, words: list[str]) -> np.ndarray:
        at = [i for g in grams(words) if (i := self.vocabulary.get(g)) is not None]
        z = self.weights[at].sum(axis=0) / math.sqrt(max(1, len(at))) + self.offset
        e = np.exp(z - z.max())
        return e / e.sum()

    @cached_property
    def _numbers(self) -> tuple[dict[str, int], list[tuple[np.ndarray, np.ndarray]]]:
        """Numbers of the vocabulary's words, from 1; and for runs of 1, 2, 3 words their sorted codes and places in the weights."""
        words = {w: n for n, w in enumerate(sorted(g for g in self.vocabulary if " " not in g), 1)}
        coded: list[list[tuple[int, int]]] = [[], [], []]
        for g, place in self.vocabulary.items():
            code = 0
            for w in g.split(" "):
                code = code * (len(words) + 1) + words[w]
            coded[g.count(" ")].append((code, place))
        return words, [tuple(np.array(sorted(c), np.int64).reshape(-1, 2).T) for c in coded]

    def likely(self, words: list[str]) -> list[tuple[int, int, int]]:
        """(first word, end, family) of the windows in which a family is likely: every window of WIDTHS is classified."""
        number, coded = self._numbers
        ids = np.fromiter(map(number.get, words, repeat(0)), np.int64, len(words))
        if not ids.any():
            return []  # no feature at all
        found = []
        for begin in range(0, len(ids), _CHUNK):
            found += [(begin + a, begin + b, f) for a, b, f in self._likely(ids[begin : begin + _CHUNK + WIDTHS[-1]], len(number) + 1, coded)]
        return found

    def _likely(self, ids: np.ndarray, base: int, coded: list) -> list[tuple[int, int, int]]:
        n, code = len(ids), np.zeros(len(ids), np.int64)
        ends, places, pairs = [], [], np.empty(0, np.int64)
        for length, (known, place) in enumerate(coded, 1):
            code = code[: max(0, n - length + 1)] * base + ids[length - 1 :]
            at = np.minimum(np.searchsorted(known, code), len(known) - 1)
            hit = np.flatnonzero(known[at] == code)
            ends.append(hit + length)
            places.append(place[at[hit]])
            if length == 2:
                pairs = ends[-1]
                if not len(pairs):
                    return []
        # a run is counted at its end; one that begins before a window is taken for the window's
        end_of, place = np.concatenate(ends), np.concatenate(places)
        order = np.argsort(end_of, kind="stable")
        end_of = end_of[order]
        sums = np.concatenate((np.zeros((1, self.weights.shape[1])), np.cumsum(self.weights[place[order]], axis=0)))
        found = []
        for width in WIDTHS:
            first = np.arange(0, max(1, n - width // 2), max(1, width // 4))
            last = np.minimum(first + width, n)
            # a window without any word pair of a template has nothing that could be confirmed
            some = np.searchsorted(pairs, last, "right") > np.searchsorted(pairs, first, "right")
            first, last = first[some], last[some]
            low, high = np.searchsorted(end_of, first, "right"), np.searchsorted(end_of, last, "right")
            z = (sums[high] - sums[low]) / np.sqrt(np.maximum(1, high - low))[:, None] + self.offset
            e = np.exp(z - z.max(axis=1, keepdims=True))
            p = e[:, :-1] / e.sum(axis=1, keepdims=True)
            found += [(int(first[i]), int(last[i]), int(f)) for i, f in zip(*np.nonzero(p >= LIKELY), strict=True)]
            if width >= n:
                break
        return found

    @cached_property
    def _templates(self) -> list[tuple[str, frozenset[str]]]:
        return [(f, t) for f, of in self.pairs.items() for t in of]

    @cached_property
    def _holders(self) -> dict[str, list[int]]:
        """The templates that hold a word pair, by their places in _templates."""
        found: dict[str, list[int]] = {}
        for k, (_, pairs) in enumerate(self._templates):
            for p in sorted(pairs):
                found.setdefault(p, []).append(k)
        return found

    @cached_property
    def _every(self) -> dict[str, frozenset[str]]:
        return {f: frozenset().union(*of) for f, of in self.pairs.items()}

    def _readings(self, words: list[str], families: set[str]) -> list[tuple[float, float, list[int], str]]:
        """(overlap, density, places of the template's word pairs, family) wherever enough of a template is within reach, best first."""
        hits: dict[int, list[tuple[int, str]]] = {}
        for i, p in enumerate(map(" ".join, zip(words, words[1:], strict=False))):
            for k in self._holders.get(p, ()):
                hits.setdefault(k, []).append((i, p))
        found = []
        for k, of in hits.items():
            family, pairs = self._templates[k]
            if family not in families or len({p for _, p in of}) < LEAST_OVERLAP * len(pairs):
                continue
            for first, (start, _) in enumerate(of):
                seen: dict[str, int] = {}
                for j in range(first, len(of)):
                    i, p = of[j]
                    if i > start + 2 * max(REACH, len(pairs)) - 2:
                        break
                    seen.setdefault(p, i)
                if len(seen) >= LEAST_OVERLAP * len(pairs):
                    at = list(seen.values())
                    found.append((len(seen) / len(pairs), len(at) / (at[-1] - at[0] + 1), at, family))
        return sorted(found, key=lambda r: (-r[0], -r[1], -len(r[2]), r[2][0], r[3]))

    def _notices(self, words: list[str], families: set[str]) -> list[tuple[int, str, float, float]]:
        """(first word, family, probability, overlap) of the confirmed notices among the words.

        A reading is classified without the words of other notices. One that shares words with a notice counts only if
        it has a word pair of its own that the notice's family has not; so parts of a notice are not read again.
        """
        waiting, owner, found = self._readings(words, families), {}, []
        again = True
        while again:
            again, later = False, []
            for reading in waiting:
                share, _, at, family = reading
                own = {j for i in at for j in (i, i + 1)}
                fresh = [words[i] + " " + words[i + 1] for i in at if i not in owner or i + 1 not in owner]
                if not all(any(p not in self._every[f] for p in fresh) for f in {owner[i] for i in own if i in owner}):
                    continue
                p = self.probabilities([words[i] for i in range(at[0], at[-1] + 2) if i in own or i not in owner])
                if self.families[int(p.argmax())] != family or p.max() < LEAST_PROBABILITY:
                    later.append(reading)
                    continue
                found.append((at[0], family, float(p.max()), share))
                for i in own:
                    owner.setdefault(i, family)
                again = True
            waiting = later
        return sorted(found)

    def scan(self, text: str) -> list[tuple[int, str, float, float]]:
        """(line, family, probability, overlap) of the confirmed notices of a text, each at the line of its first word.

        Notices run across line breaks, but not across blank lines.
        """
        lines = text.lower().split("\n")
        blocks, words, bounds, begin = [], [], [0], 0
        while begin < len(lines):
            end = begin
            while end < len(lines) and lines[end].strip():
                end += 1
            if end > begin:
                blocks.append((begin, end))
                words += _WORD.findall("\n".join(lines[begin:end]))
                bounds.append(len(words))
            begin = end + 1
        wanted: dict[int, set[str]] = {}
        for first, last, family in self.likely(words):
            for b in range(bisect_right(bounds, first) - 1, bisect_left(bounds, last)):
                wanted.setdefault(b, set()).add(self.families[family])
        found = []
        for b, families in sorted(wanted.items()):
            begin, end = blocks[b]
            block = lines[begin:end]
            per = [_WORD.findall(line) for line in block]
            for k in range(len(per) - 1):  # a word broken at a hyphen stays on its first line
                if per[k] and per[k + 1] and block[k].rstrip().endswith(per[k][-1] + "-"):
                    head, tail = per[k][-1], per[k + 1].pop(0)
                    per[k][-1] = head + tail if head + tail in self.vocabulary else head + "-" + tail
            at = [begin + k for k, part in enumerate(per) for _ in part]
            found += [(at[first], *n) for first, *n in self._notices([w for part in per for w in part], families)]
        return found


def train(seed: int = 3) -> Model:
    """Fit on variants of the templates; nothing of the corpus is needed, so nothing of it is sampled."""
    rng = np.random.default_rng(seed)
    every = templates()
    families = (*every, UNKNOWN)
    vocabulary: dict[str, int] = {}
    for t in every.values():
        for text in t:
            for g in sorted(set(grams(words_of(text)))):
                vocabulary.setdefault(g, len(vocabulary))
    everything = [w for t in every.values() for text in t for w in words_of(text)]

    def variant(words: list[str]) -> list[str]:
        kept = [w for w in words if rng.random() > 0.08]
        pad = [str(w) for w in rng.choice(_FILLER, rng.integers(0, 24))]
        cut = int(rng.integers(0, len(pad) + 1))
        return pad[:cut] + kept + pad[cut:]

    def stranger() -> list[str]:
        """Notice words out of order among others: what is not a notice."""
        n = int(rng.integers(1, 10))
        mixed = [str(w) for w in rng.choice(everything, n)] + [str(w) for w in rng.choice(_FILLER, rng.integers(0, 24))]
        return [mixed[i] for i in rng.permutation(len(mixed))]

    rows = [(variant(words_of(text)), k) for k, f in enumerate(every) for text in every[f] for _ in range(VARIANTS)]
    rows += [(stranger(), len(every)) for _ in range(len(rows) // 2)]
    vectors = [([i for g in grams(w) if (i := vocabulary.get(g)) is not None], k) for w, k in rows]
    held, used = vectors[::5], [v for i, v in enumerate(vectors) if i % 5]
    weights, offset = np.zeros((len(vocabulary), len(families))), np.zeros(len(families))
    squares = np.full((len(vocabulary), len(families)), 1e-2)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(used)):
            at, k = used[i]
            size = math.sqrt(max(1, len(at)))
            z = weights[at].sum(axis=0) / size + offset
            e = np.exp(z - z.max())
            g = e / e.sum()
            g[k] -= 1.0
            squares[at] += (g / size) ** 2
            weights[at] -= RATE * (g / size + PENALTY * weights[at]) / np.sqrt(squares[at])
            offset -= 0.02 * g
    low, high = -6.0, 6.0
    share = sum(k == len(every) for _, k in held) / len(held)
    for _ in range(40):  # the offset at which the unknown class's mean probability is its share
        mid = (low + high) / 2
        trial = offset + np.append(np.zeros(len(every)), mid)
        mean = 0.0
        for at, _ in held:
            z = weights[at].sum(axis=0) / math.sqrt(max(1, len(at))) + trial
            e = np.exp(z - z.max())
            mean += float(e[-1] / e.sum())
        low, high = (mid, high) if mean / len(held) < share else (low, mid)
    return Model(families, vocabulary, weights, offset + np.append(np.zeros(len(every)), (low + high) / 2))


SCHEMA = "doc_id long, n_notices long, families string, first_paragraph long, score double, overlap double"


def scan_licences(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_notices, families, first_paragraph, score, overlap), one row per row of ``docs``.

    families joins the distinct families in order, by commas; score and overlap are the best notice's. Without a
    notice, and for null or empty texts: 0, an empty string, -1, 0 and 0. Rows alike give rows alike.
    """
    known = model or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                hits = known.scan(text.as_py() or "")
                best = max(((p, o) for _, _, p, o in hits), default=(0.0, 0.0))
                rows.append((key.as_py(), len(hits), ",".join(sorted({h[1] for h in hits})), hits[0][0] if hits else -1, *best))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.float64()]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(id_col, text_col).mapInArrow(run, SCHEMA)


def op6(spark, sf_dir: str) -> DataFrame:
    return scan_licences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
