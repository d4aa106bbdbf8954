"""Licence scans: a trained paragraph classifier, confirmed by templates.

A multinomial logistic regression over sparse word n-grams (one to three words) tells licence
families apart.  It is trained here from templates, altered at random, against background paragraphs (a
bounded sample of the corpus's lines, and built-in near misses) and against licence-like
paragraphs of made-up licences, the unknown class.  Its temperature is fitted on templates held out of
training; a family counts only if its calibrated probability reaches ``sure``
and a template of that family is close to the paragraph, otherwise the paragraph is unknown.  Of families that the
classifier holds possible, such as two versions of one licence, the closest template's is taken.

Every line of every text is classified, and so is every run of consecutive lines without a blank one between them
(a line without words is blank, so comment marks are no matter) of at most ``MOST_WORDS`` words that comes close to a template:
hard-wrapped notices are judged whole.  Of results that share lines the closest to its template
is reported, at its first line; a run must gain ``GAIN`` over what its lines say alone.  Features hold a word of the
licence vocabulary (all words of the templates but plain ones, however frequent in the corpus), so a line
without such a word has no feature and is background.  Lines close to a template are never background to learn from.

Defined results: a null or empty text is one empty paragraph without a licence; repeated rows give a row
each, and one of them teaches; a null id is scanned and not learned from; very long texts are scanned whole; an empty table gives
an empty result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import slices

#: Statements of each family, as they stand in files and pages.  "bsd" is the paragraph that all BSD licences begin with.
TEMPLATES = {
    "agpl-3.0": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This project is released under the Apache 2.0 license.",
        "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "artistic-2.0": [
        "Licensed under the Artistic License 2.0.",
        "This package is free software; you may redistribute it and/or modify it under the terms of the Artistic License, version 2.0.",
        "SPDX-License-Identifier: Artistic-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Use of this source code is governed by a BSD-style license.",
        "Distributed under the terms of a BSD license.",
    ],
    "bsd-2-clause": ["Released under the BSD 2-Clause License.", "Licensed under the simplified BSD license.", "SPDX-License-Identifier: BSD-2-Clause"],
    "bsd-3-clause": [
        "Released under the BSD 3-Clause License.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Licensed under the new BSD license, 3-clause.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "bsl-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software.",
        "SPDX-License-Identifier: BSL-1.0",
    ],
    "cc-by-4.0": [
        "Licensed under CC BY 4.0.",
        "Attribution 4.0 International (CC BY 4.0)",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This article is distributed under the terms of the Creative Commons Attribution License.",
    ],
    "cc-by-nc-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "Attribution-NonCommercial 4.0 International (CC BY-NC 4.0)",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Creative Commons BY-NC: no commercial use is permitted.",
    ],
    "cc-by-nc-nd-4.0": [
        "Licensed under CC BY-NC-ND 4.0.",
        "Attribution-NonCommercial-NoDerivatives 4.0 International (CC BY-NC-ND 4.0)",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
        "Distributed under the Creative Commons Attribution-NonCommercial-NoDerivatives License.",
    ],
    "cc-by-nc-sa-4.0": [
        "Licensed under CC BY-NC-SA 4.0.",
        "Attribution-NonCommercial-ShareAlike 4.0 International (CC BY-NC-SA 4.0)",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "Distributed under the Creative Commons Attribution-NonCommercial-ShareAlike License.",
    ],
    "cc-by-nd-4.0": [
        "Licensed under CC BY-ND 4.0.",
        "Attribution-NoDerivatives 4.0 International (CC BY-ND 4.0)",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "Distributed under the Creative Commons Attribution-NoDerivatives License.",
    ],
    "cc-by-sa-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "Attribution-ShareAlike 4.0 International (CC BY-SA 4.0)",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "cc0-1.0": [
        "Released under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "This work is dedicated to the public domain under CC0.",
    ],
    "epl-2.0": [
        "Licensed under the Eclipse Public License, version 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is free software under the terms of version 2 of the GNU General Public License.",
        "Licensed under the GPL v2.",
        "Released under GPL v2.",
        "This file is under GPL version 2.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software under the terms of version 3 of the GNU General Public License.",
        "Licensed under the GPL v3.",
        "Released under GPL v3.",
        "Code is released under the GNU GPL v3 license.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "isc": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ],
    "lgpl-2.1": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is free software under the terms of the GNU Lesser General Public License.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "reserved": [
        "All rights reserved.",
        "Copyright 2021 Example Inc. All rights reserved.",
        "No part of this publication may be reproduced without prior written permission of the publisher.",
    ],
    "unlicense": [
        "Released under the Unlicense.",
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
    ],
    "zlib": [
        "Released under the zlib license.",
        "Licensed under the zlib/libpng license.",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
        "SPDX-License-Identifier: Zlib",
    ],
}
#: Paragraphs that share words with licences and are none.
NEAR_MISSES = [
    "He renewed his driving license at the public office last week.",
    "The version of the story that the public heard was free of details.",
    "Students at MIT released a new version of the source code.",
    "The Apache people lived on the plains under open skies.",
    "Permission to enter the general area was granted by the author of the plan.",
    "The foundation published the terms of the prize and its conditions.",
    "Commons and lords met in the house; all rights of the people were discussed.",
    "The work of the international group is available to every person.",
    "Use of the garden is free for any person with a copy of the ticket.",
    "The mozilla logo was redrawn, and the binary star was photographed again.",
]
BACKGROUND, UNKNOWN = "background", "unknown"
#: Words of the templates that tell nothing.
PLAIN = {"in", "of", "the", "to", "or", "for", "is", "a", "any", "by", "this", "at", "that", "as", "are", "an", "no", "you", "may", "not", "with", "and", "be", "from", "it", "was", "part", "met", "all", "can", "its", "into", "means", "above", "appear", "name", "names", "you", "option", "later", "fee", "each", "such", "must", "will", "held", "including"}
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
_GPL = re.compile(r"\b([al]?gpl)(v?[0-9])")


def words_of(paragraph: str) -> list[str]:
    """The words of a paragraph; names like GPLv2 are two."""
    low = paragraph.lower()
    return _WORD.findall(_GPL.sub(r"\1 \2", low) if "gpl" in low else low)


#: The longest run of lines, in words, and what it must gain in closeness.  A run with twice a template's words may be close to it.
MOST_WORDS, GAIN = 2 * max(len(words_of(t)) for texts in TEMPLATES.values() for t in texts), 0.1


def grams(words: list[str], rare: frozenset | None = None) -> set[str]:
    """Runs of one to three words; with rare, those that hold such a word."""
    out = set()
    for n in (1, 2, 3):
        for i in range(len(words) - n + 1):
            run = words[i : i + n]
            if rare is None or any(w in rare for w in run):
                out.add(" ".join(run))
    return out


def _altered(text: str, rng: np.random.Generator) -> str:
    """A template as it may stand in a text: words lost, swapped in or added around it, or another case."""
    words = [w for w in text.split() if rng.random() > 0.06] or text.split()
    fill = ["see", "notice", "copyright", "2019", "2024", "john", "the", "file", "code", "for", "details", "is", "data", "doe", "inc"]
    some = lambda most: [fill[i] for i in rng.integers(0, len(fill), rng.integers(0, most))]
    out = " ".join([*some(4), *words, *some(4)])
    return [str.lower, str.upper, str][rng.integers(0, 3)](out)


def _made_up(rng: np.random.Generator) -> str:
    """A licence nobody knows."""
    part = ["zor", "quen", "bal", "tri", "mek", "lun", "fos", "dar"]
    name = "".join(part[i] for i in rng.integers(0, len(part), 2)).title()
    forms = ["Licensed under the {} License, version {}.", "Released under the {} Public License.", "This work is licensed under the {} General License, version {}.", "SPDX-License-Identifier: LicenseRef-{}", "Distributed under the terms of the {} Source License {}.", "This software is under the {} community licence."]
    return _altered(forms[rng.integers(0, len(forms))].format(name, f"{rng.integers(1, 9)}.{rng.integers(0, 9)}"), rng)


@dataclass(frozen=True)
class Model:
    classes: list
    columns: dict
    rare: frozenset
    weights: np.ndarray
    intercepts: np.ndarray
    temperature: float
    sure: float = 0.6
    close: float = 0.5

    def probabilities(self, words: list[str]) -> np.ndarray:
        at = [self.columns[g] for g in grams(words, self.rare) if g in self.columns]
        z = (self.weights[at].sum(axis=0) + self.intercepts) / self.temperature
        z = np.exp(z - z.max())
        return z / z.sum()

    def classify(self, paragraph: str) -> tuple[str, float, float]:
        """Class, calibrated probability and closeness to the family's nearest template."""
        words = words_of(paragraph)
        if self.rare.isdisjoint(words):
            return BACKGROUND, 1.0, 0.0
        p = self.probabilities(words)
        best = int(p.argmax())
        name = self.classes[best]
        if name == BACKGROUND:
            return name, float(p[best]), 0.0
        if name == UNKNOWN:
            return name, float(p[best]), 0.0
        # Families that differ in a word or two: the templates must say the same, or decide between likely ones.
        near = {c: closeness(words, c) for i, c in enumerate(self.classes) if c == name or c in TEMPLATES and p[i] >= 0.05}
        closest = max(near, key=lambda c: (round(near[c], 9), c == name))
        both = float(p[best] + p[self.classes.index(closest)]) if closest != name else float(p[best])
        if both < self.sure or near[closest] < self.close:
            return UNKNOWN, float(p[best]), near[name]
        return closest, both, near[closest]

    def classify_lines(self, lines: list[str], known: dict[str, tuple] | None = None) -> list[tuple[int, str, float, float]]:
        """First line, class, probability and closeness of the lines and runs of lines that are not background."""
        known = {} if known is None else known

        def cached(paragraph):
            if paragraph not in known:
                if len(known) > 50_000:
                    known.clear()
                known[paragraph] = self.classify(paragraph)
            return known[paragraph]

        alone = [cached(line) for line in lines]
        found = [(i, i + 1, *x) for i, x in enumerate(alone) if x[0] != BACKGROUND]
        for i, j, _ in runs([words_of(line) for line in lines], self.close):
            name, p, near = cached(" ".join(lines[i:j]))
            quiet = all(x[0] == BACKGROUND for x in alone[i:j])
            if name not in (BACKGROUND, UNKNOWN) or name == UNKNOWN and quiet and p >= self.sure and near == 0:
                found.append((i, j, name, p, near))
        # The closest first, short runs before long ones.
        found.sort(key=lambda x: (x[2] == UNKNOWN, -round(x[4] - (GAIN if x[1] - x[0] > 1 else 0), 9), x[1] - x[0], x[0]))
        taken, out = np.zeros(len(lines), bool), []
        for i, j, name, p, near in found:
            if not taken[i:j].any():
                taken[i:j] = True
                out.append((i, name, p, near))
        return sorted(out)


def _parts(words: list[str]) -> set[tuple]:
    return set(zip(words, words[1:])) | {(w,) for w in words}


_TEMPLATE_PARTS = {family: [_parts(words_of(t)) for t in texts] for family, texts in TEMPLATES.items()}


def _marks(family: str, text: str) -> list[frozenset]:
    """The words that a template has and another family's half-alike template has not, for each such template; all words of a template of three."""
    words, parts = words_of(text), _parts(words_of(text))
    others = [p for f, texts in _TEMPLATE_PARTS.items() if f != family for p in texts if 2 * len(parts & p) >= len(parts)]
    told = {frozenset((w,) for w in words if w not in PLAIN and (w,) not in p) for p in others}
    if len(words) <= 3:
        told |= {frozenset([(w,)]) for w in words}
    return sorted(told - {frozenset()}, key=sorted)


_TEMPLATE_MARKS = {family: [_marks(family, t) for t in texts] for family, texts in TEMPLATES.items()}


#: Only lines with such a word can be other than background.
GATE = frozenset({w for texts in TEMPLATES.values() for t in texts for w in words_of(t)} - PLAIN | {"licence"})


def runs(words: list[list[str]], least: float) -> Iterator[tuple[int, int, list[str]]]:
    """First line, end and words of the runs of two or more lines that are so close to a template."""
    marked = np.concatenate([[0], np.cumsum([not GATE.isdisjoint(w) for w in words])]).tolist()
    stop, n = 0, 0
    for i in range(len(words)):
        if stop < i:
            stop, n = i, 0
        while stop < len(words) and words[stop] and n + len(words[stop]) <= MOST_WORDS:
            n += len(words[stop])
            stop += 1
        # What is not close in the longest run is not in a shorter one.
        if stop - i > 1 and marked[stop] > marked[i] and licence_like([w for x in words[i:stop] for w in x], least):
            for j in range(i + 2, stop + 1):
                run = [w for x in words[i:j] for w in x]
                if marked[j] > marked[i] and licence_like(run, least):
                    yield i, j, run
        n -= len(words[i]) if stop > i else 0


def not_licences(lines: list[str], least: float = 0.5) -> list[int]:
    """The lines in no passage close to a template; of passages that share lines the closest counts."""
    words = [words_of(line) for line in lines]
    close = [(i, i + 1, w) for i, w in enumerate(words) if licence_like(w, least)] + list(runs(words, least))
    close.sort(key=lambda x: (-max(closeness(x[2], f) for f in TEMPLATES), x[1] - x[0], x[0]))
    taken = np.zeros(len(lines), bool)
    for i, j, _ in close:
        if not taken[i:j].any():
            taken[i:j] = True
    return np.flatnonzero(~taken).tolist()


def closeness(words: list[str], family: str) -> float:
    """The largest share of a template's words and word pairs that the paragraph has.

    A template counts only with half of the words that tell it from each half-alike one of another family.
    """
    mine = _parts(words)
    templates = zip(_TEMPLATE_PARTS[family], _TEMPLATE_MARKS[family])
    return max((len(mine & theirs) / len(theirs) for theirs, marks in templates if all(2 * len(mine & m) >= len(m) for m in marks)), default=0.0)


def licence_like(words: list[str], least: float = 0.5) -> bool:
    """Whether a template of any family is so close: no background to learn from."""
    mine = _parts(words)
    return any(len(mine & theirs) >= least * len(theirs) for family in _TEMPLATE_PARTS.values() for theirs in family)


def fit(background: list[str], each: int = 60, steps: int = 200, seed: int = 3) -> Model:
    """Trains on altered templates.  The temperature is fitted on altered forms of templates (the last of each family)
    that a first model has not seen; the second learns from all.
    """
    rng = np.random.default_rng(seed)
    classes = [BACKGROUND, UNKNOWN, *TEMPLATES]
    templates = {t for texts in TEMPLATES.values() for t in texts}
    background = [p for p in background if not licence_like(words_of(p))]

    def made(n, pick):
        rows = [(BACKGROUND, p) for p in [*background[: 20 * n], *NEAR_MISSES * (n // 4)] if p not in templates]
        rows += [(UNKNOWN, _made_up(rng)) for _ in range(4 * n)]
        for family, texts in TEMPLATES.items():
            some = pick(texts)
            rows += [(family, _altered(some[i % len(some)], rng)) for i in range(n)]
        return rows

    def learned(rows):
        count = Counter(g for _, p in rows for g in grams(words_of(p), GATE))
        columns = {g: i for i, g in enumerate(sorted(g for g, c in count.items() if c >= 3))}
        return columns, *_regression(*_matrix(rows, columns, classes), len(classes), steps)

    columns, w, b = learned(made(each, lambda texts: texts[:-1]))
    x, y, times = _matrix(made(each // 3, lambda texts: texts[-1:]), columns, classes)
    z = x @ w + b

    def cost(t):
        s = z / t
        return float((np.logaddexp.reduce(s, axis=1) - s[np.arange(len(y)), y]) @ times)

    temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=cost)
    columns, w, b = learned(made(each, lambda texts: texts))
    return Model(classes, columns, GATE, w, b, temperature)


def _matrix(rows: list[tuple[str, str]], columns: dict, classes: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, class and number of the different rows; most background has no feature at all."""
    seen = Counter((classes.index(c), tuple(sorted(columns[g] for g in grams(words_of(p), GATE) if g in columns))) for c, p in rows)
    x = np.zeros((len(seen), len(columns)), dtype=np.float32)
    for i, (_, at) in enumerate(seen):
        x[i, list(at)] = 1
    return x, np.array([c for c, _ in seen]), np.array(list(seen.values()))


def _regression(x: np.ndarray, y: np.ndarray, times: np.ndarray, n_classes: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and intercepts of a multinomial logistic regression in which all classes weigh the same."""
    share = times / np.bincount(y, weights=times, minlength=n_classes)[y]
    share /= share.sum()
    w, b = np.zeros((x.shape[1], n_classes), np.float32), np.zeros(n_classes, np.float32)
    b[0] = 1.0
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for step in range(1, steps + 1):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p *= share[:, None]
        for value, m, v, g in ((w, mw, vw, x.T @ p + 1e-4 * w), (b, mb, vb, p.sum(0))):
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            value -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w, b


def train(docs: DataFrame, most_background: int = 2000, most_documents: int = 1000, most_chars: int = 4000) -> Model:
    """A model whose background is a bounded sample of the corpus's lines.

    Of ``most_documents`` ids with the smallest hashes one row each gives all its lines, but those of passages close to a
    template; of these the ``most_background`` with the smallest hashes are learned from.  Lines over ``most_chars``
    characters are not learned from, so what reaches the driver has a bound; they are scanned like all others.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = docs.select("doc_id").filter("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_documents)
    some = docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(batches):
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                lines = text.split("\n")
                yield pa.RecordBatch.from_arrays([pa.array([lines[i] for i in not_licences(lines) if len(lines[i]) <= most_chars], pa.string())], names=["line"])

    lines = some.select("text").mapInArrow(run, "line string").distinct().orderBy(F.xxhash64("line"), "line").limit(most_background)
    return fit([r["line"] for r in lines.collect()])


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_paragraphs and found (an array of paragraph, family, probability and closeness) of every document."""
    kind = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("closeness", pa.float64())]))

    def run(batches):
        known: dict[str, tuple] = {}
        for batch in slices(batches):
            counts, found = [], []
            for t in batch.column(1).to_pylist():
                lines = (t or "").split("\n")
                mine = []
                if not model.rare.isdisjoint(words_of(t or "")):
                    mine = [{"paragraph": i, "family": name, "probability": p, "closeness": near} for i, name, p, near in model.classify_lines(lines, known)]
                counts.append(len(lines))
                found.append(mine)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(found, kind)], names=["doc_id", "n_paragraphs", "found"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_paragraphs long, found array<struct<paragraph:int,family:string,probability:double,closeness:double>>")
