"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

Paragraphs (runs of lines, and each line; long ones in windows of words) are sparse vectors of word 1- and 2-grams. Of
findings that overlap, the one with more of its family's word pairs stands (`resolved`). A multinomial logistic
regression tells licence families and an unknown class apart; its temperature is calibrated on examples
it was not trained on, and what is then less likely than THRESHOLD counts as unknown. A family is confirmed
if the paragraph shares enough word pairs with one of the family's templates.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import doc_texts

#: Words of a paragraph's window, probability and share of common word pairs that a finding needs.
WINDOW, THRESHOLD, SIMILAR = 80, 0.5, 0.5
EXAMPLES, SEED = 6_000, 5
UNKNOWN = "unknown"

#: Short forms of public licence notices, by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "GPL-2.0": (
        "This program is licensed under the GNU General Public License, version 2.",
        "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or any later version.",
    ),
    "LGPL": (
        "Licensed under the GNU Lesser General Public License.",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; version 2.1 of the License",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or any later version.",
    ),
    "AGPL-3.0": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    ),
    "BSD": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
    "ISC": (
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC0": (
        "Released under CC0 1.0 Universal.",
        "This is free and unencumbered software released into the public domain.",
    ),
    "proprietary": (
        "All rights reserved.",
        "This software is proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
    ),
}

#: Sentences about licences that grant none: the hard part of the unknown class.
OTHERS = (
    "he lost his driving license in the city", "a licensed professional should do this work", "the licence fee was paid in full",
    "see the file license for details of the project", "copyright law was changed in that year", "they released the version under great pressure",
    "the general public was not permitted to use the building", "free software is a matter of liberty", "apache helicopters over the city",
    "a student of mit released a study", "the terms of the contract are subject to change", "permission was granted by the king",
    "the software was released in version 2.0 and version 3.0", "creative work for the commons of the town", "this work is under review",
    "a copy of the book and its source", "under the bridge by the public library", "gnu antelopes live in the plains",
)
_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
#: A letter or digit, and comment marks at the start of a line that look like words (others are no words).
_SIGN, _MARK = re.compile(r"[^\W_]"), re.compile(r"(?m)^\s*(?:rem|dnl)\b")
#: Words so common that they do not make a paragraph worth a look.
_PLAIN = frozenset("a an and any are as at be by can either for free from has have he his in into is it its later may of on or see that "
                   "the their they this to under was with you city year full work use used file name terms".split())


def words_of(paragraph: str) -> list[str]:
    return _WORD.findall(_MARK.sub("", paragraph.lower()))


def grams_of(words: list[str]) -> list[str]:
    return [*words, *map(" ".join, zip(words, words[1:]))]


def blocks(text: str) -> Iterator[list[tuple[int, int]]]:
    """The (start, end) of the lines of every paragraph: a run of lines with a letter or digit; marks alone are no line."""
    at, run = 0, []
    for line in text.split("\n"):
        if _SIGN.search(line):
            run.append((at, at + len(line)))
        elif run:
            yield run
            run = []
        at += len(line) + 1
    if run:
        yield run


def windows(text: str, start: int, end: int, window: int = WINDOW) -> Iterator[tuple[int, int]]:
    """(start, end) of a part of the text, if long of windows of its words that overlap by half."""
    if end - start <= 5 * window:
        yield start, end
        return
    tokens = [m.span() for m in re.finditer(r"\S+", text[start:end]) if _SIGN.search(m[0])]
    for k in range(0, max(1, len(tokens) - window // 2) if tokens else 0, window // 2):
        yield start + tokens[k][0], start + tokens[min(k + window, len(tokens)) - 1][1]


def paragraphs(text: str, window: int = WINDOW) -> Iterator[tuple[int, int]]:
    """(start, end) of every paragraph and of every line inside it, long ones in windows; empty ones are left out."""
    for lines in blocks(text):
        yield from spans_of(text, lines, window)


def spans_of(text: str, lines: list[tuple[int, int]], window: int = WINDOW) -> Iterator[tuple[int, int]]:
    if len(lines) > 1:
        yield from windows(text, lines[0][0], lines[-1][1], window)
    for i, j in lines:
        yield from windows(text, i, j, window)


@dataclass
class Classifier:
    """Weights of grams by family (the last is the unknown class), and the words that make a paragraph worth a look."""

    families: list[str]
    grams: dict[str, int]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    triggers: frozenset[str]
    pairs: dict[str, list[frozenset[str]]]

    def classify(self, words: list[str]) -> tuple[str, float]:
        """The family, unknown if none is likely enough, and its calibrated probability."""
        at = sorted({self.grams[g] for g in grams_of(words) if g in self.grams})
        z = (self.weights[at].sum(0) + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        if self.families[best] == UNKNOWN or p[best] < THRESHOLD:
            return UNKNOWN, float(p[-1])
        return self.families[best], float(p[best])

    def similarity(self, family: str, words: list[str]) -> float:
        """Largest share of word pairs that the paragraph and one of the family's templates have in common, of the shorter's."""
        own = frozenset(zip(words, words[1:]))
        return max((len(own & t) / max(1, min(len(own), len(t))) for t in self.pairs[family]), default=0.0)

    def evidence(self, family: str, words: list[str]) -> frozenset[tuple[str, str]]:
        """The word pairs that the paragraph has in common with any of the family's templates."""
        return frozenset(zip(words, words[1:])) & frozenset().union(*self.pairs[family])


@dataclass
class Finding:
    start: int
    end: int
    family: str
    probability: float
    similarity: float
    evidence: frozenset[tuple[str, str]]


def resolved(found: list[Finding], similar: float = SIMILAR) -> list[Finding]:
    """One finding for each notice, in order of place: confirmed ones, then most evidence, then the shortest go first.

    A finding that overlaps an earlier one falls if it names the same family, or if at most half of its evidence
    is not the other's as well: a line of a notice says less than the notice. Two notices side by side both stand.
    """
    longest, taken, starts = max((x.end - x.start for x in found), default=0), [], []
    for x in sorted(found, key=lambda x: (x.similarity < similar, -len(x.evidence), x.end - x.start, x.start)):
        low, high = bisect_left(starts, x.start - longest), bisect_left(starts, x.end)
        if all(y.end <= x.start or (y.family != x.family and 2 * len(x.evidence - y.evidence) > len(x.evidence))
               for y in taken[low:high]):
            k = bisect_left(starts, x.start)
            starts.insert(k, x.start)
            taken.insert(k, x)
    return sorted(taken, key=lambda x: (x.start, x.end, x.family))


def examples(n: int = EXAMPLES, seed: int = SEED) -> list[tuple[list[str], str]]:
    """Labelled paragraphs: templates cut, worn and set among other words; a third belongs to no family."""
    rng = random.Random(seed)
    letters = "etaoinshrdlu"

    def noise(k: int) -> list[str]:
        return ["".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(k)]

    families, out = list(TEMPLATES), []
    vocabulary = [w for ts in TEMPLATES.values() for t in ts for w in words_of(t)]
    while len(out) < n:
        kind = rng.random()
        if kind < 0.12:
            out.append((noise(rng.randint(1, 40)), UNKNOWN))
        elif kind < 0.22:  # single words of licences among others
            words = noise(rng.randint(4, 30)) + rng.choices(vocabulary, k=rng.randint(1, 3))
            out.append((rng.sample(words, len(words)), UNKNOWN))
        elif kind < 0.34:
            out.append((noise(rng.randint(0, 6)) + words_of(rng.choice(OTHERS)) + noise(rng.randint(0, 6)), UNKNOWN))
        else:
            family = rng.choice(families)
            words = words_of(rng.choice(TEMPLATES[family]))
            if len(words) > 12 and rng.random() < 0.4:  # a wrapped line of it
                k = rng.randint(0, len(words) - 9)
                words = words[k : k + rng.randint(9, len(words))]
            words = [w for w in words if rng.random() > 0.04] or words
            out.append((noise(rng.choice([0, 0, 1, 3, 10])) + words + noise(rng.choice([0, 0, 2, 8])), family))
    return out


def fit(labelled: list[tuple[list[str], str]] | None = None, rounds: int = 300, penalty: float = 1e-4) -> Classifier:
    """Trains on (words, family) examples, every fifth of which is kept back for the temperature."""
    data = labelled or examples()
    families = [*sorted({f for _, f in data} - {UNKNOWN}), UNKNOWN]
    known = sorted({g for ts in TEMPLATES.values() for t in ts for g in grams_of(words_of(t))}
                   | {g for t in OTHERS for g in grams_of(words_of(t))})
    grams = {g: i for i, g in enumerate(known)}
    rows = [np.array(sorted({grams[g] for g in grams_of(w) if g in grams}), np.int64) for w, _ in data]
    target = np.array([families.index(f) for _, f in data])
    kept_back = np.arange(len(data)) % 5 == 4

    def logits(some: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
        parts = [rows[i] for i in some]
        sums = np.add.reduceat(np.vstack([w[np.concatenate(parts).astype(np.int64)], np.zeros(w.shape[1])]),
                               np.minimum(np.cumsum([0, *map(len, parts)])[:-1], sum(map(len, parts))))
        return np.where(np.array([len(p) for p in parts])[:, None] > 0, sums, 0.0) + b

    train = np.flatnonzero(~kept_back)
    at = np.concatenate([rows[i] for i in train])
    row = np.repeat(np.arange(len(train)), [len(rows[i]) for i in train])
    w, b = np.zeros((len(grams), len(families))), np.zeros(len(families))
    speed_w, speed_b = np.zeros_like(w), np.zeros_like(b)
    order = np.argsort(at, kind="stable")
    used, first = np.unique(at[order], return_index=True)
    by_gram = row[order]
    for _ in range(rounds):  # gradient steps with momentum
        z = logits(train, w, b)
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(train)), target[train]] -= 1
        grad = np.zeros_like(w)
        grad[used] = np.add.reduceat(p[by_gram], first) / len(train)
        speed_w = 0.9 * speed_w - 2.0 * (grad + penalty * w)
        speed_b = 0.9 * speed_b - 2.0 * p.mean(0)
        w, b = w + speed_w, b + speed_b

    back = np.flatnonzero(kept_back)
    z = logits(back, w, b)

    def loss(t: float) -> float:
        y = z / t
        y = y - y.max(1, keepdims=True)
        return float((np.log(np.exp(y).sum(1)) - y[np.arange(len(back)), target[back]]).mean())

    temperature = min((math.exp(k / 10) for k in range(-15, 16)), key=loss)
    triggers = frozenset(x for ts in TEMPLATES.values() for t in ts for x in words_of(t)) - _PLAIN
    pairs = {f: [frozenset(zip(x, x[1:])) for t in TEMPLATES.get(f, ()) for x in [words_of(t)]] for f in families}
    return Classifier(families, grams, w, b, temperature, triggers, pairs)


def scan(docs: DataFrame, model: Classifier | None = None, similar: float = SIMILAR) -> DataFrame:
    """Licence notices of all documents: doc_id, start, end (code points), family, probability, similarity, confirmed.

    Null and empty texts have none; a repeated document gives its rows again. Paragraphs with less than two
    words from any template are unknown without a look at the weights.
    """
    known = model or fit()

    def worth(words: list[str]) -> bool:
        return not known.triggers.isdisjoint(words) and sum(w in known.triggers for w in words) >= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.bool_())
        names = ["doc_id", "start", "end", "family", "probability", "similarity", "confirmed"]
        for b in batches:
            out = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                for lines in blocks(text):
                    if not worth(words_of(text[lines[0][0] : lines[-1][1]])):
                        continue  # nor is any part of it
                    found = []
                    for i, j in spans_of(text, lines):
                        words = words_of(text[i:j])
                        if not worth(words):
                            continue
                        family, p = known.classify(words)
                        if family != UNKNOWN:
                            s = known.similarity(family, words)
                            found.append(Finding(i, j, family, p, s, known.evidence(family, words)))
                    out += [(doc, x.start, x.end, x.family, x.probability, x.similarity, x.similarity >= similar)
                            for x in resolved(found, similar)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return doc_texts(docs).mapInArrow(
        run, "doc_id long, start long, end long, family string, probability double, similarity double, confirmed boolean")
