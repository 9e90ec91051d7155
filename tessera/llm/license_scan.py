"""Licence scan by a trained paragraph classifier.

A paragraph is a run of lines that have words. The presence of sparse n-grams of one to three words, those that occur in
TEMPLATES, goes into a multinomial logistic regression over the licence families and `none`, which is fitted on varied
templates and, for `none`, on the lines and paragraphs of a sample of the corpus and on prose that speaks of licences. A
temperature fitted on held-out ones calibrates the probabilities. Paragraphs, and the lines of them, that more likely than not
are a licence are compared with the templates: the family holds if its own templates are covered best and to at least COVER by
the pairs of words; otherwise the family is `unknown`. Since the other words of a paragraph weigh against a notice within it,
the passages that cover a template to at least COVER, within REACH times its length, are judged as paragraphs of their own,
however the notice is broken into lines. Of passages that overlap the one that covers its template best holds.

A paragraph has a row for each of its lines that is a licence as a whole, one for each family of a passage that no such line
has, and one for itself if it is judged a licence and none of these is there. It isn't `unknown` where it has a family.

Result: doc_id, first_line, last_line (from 0), family, probability (of the family, for `unknown` of any licence), similarity
(to the best template of the family, for `unknown` of any).

Defined results: a null or empty text has no lines; lines without words part paragraphs and count for the numbering; texts of
any length are read whole; a null doc_id is carried as it is; repeated rows are each reported; of families that are covered
alike the one predicted holds, of passages that cover their templates alike the first; of texts of equal hash all are in the
sample or none. Only doc_id and text are read, so other columns may clash; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import text as X

#: Phrases of each family's usual notices, in the words by which it is known.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT license",
        "This project is distributed under the terms of the MIT License",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy",
        "to deal in the Software without restriction, including without limitation the rights",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License)",
        "This project is released under the Apache License 2.0",
        "Apache License Version 2.0, January 2004",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "under the terms of the GNU General Public License as published by",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "Released under the GNU GPL v3",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "LGPL": (
        "under the terms of the GNU Lesser General Public License",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
        "Licensed under the LGPL version 2.1 or later",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "AGPL": (
        "under the terms of the GNU Affero General Public License",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "Licensed under the AGPL version 3",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "BSD": (
        "Released under the BSD License.",
        "Licensed under the 3-Clause BSD License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "Redistributions of source code must retain the above copyright notice",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "MPL": (
        "This Source Code Form is subject to the terms of the Mozilla Public License",
        "Licensed under the Mozilla Public License, version 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "ISC": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose",
        "SPDX-License-Identifier: ISC",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "available under the Creative Commons Attribution-ShareAlike License",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "public domain": (
        "This is free and unencumbered software released into the public domain.",
        "This work is dedicated to the public domain under CC0 1.0",
        "No rights reserved. Released into the public domain.",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright by the authors. All rights reserved.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited",
        "This software is proprietary and confidential",
    ),
}
#: Prose that isn't a licence though it uses the words.
PROSE = (
    "the city gave the restaurant a new license to sell wine last year",
    "she asked for permission to use the public garden in the summer",
    "the general said that the public would have to wait for the software",
    "he lost his driving license and all his papers under the bridge",
    "version two of the plan was released in june and the work goes on",
    "the rights of the workers are reserved for later talks",
    "copy the text into the file and use it without the first line",
    "free speech is a right of the public and of the press",
    "this software has a version number and a source for each file",
    "a license is needed to fish in the lake with or without a boat",
    "the terms of the contract were published by the foundation",
    "the domain of the king was public land released from tax",
)
FAMILIES = tuple(TEMPLATES)
NONE = len(FAMILIES)
GRAMS = 3
COVER = 0.6
#: Words within which a template's pairs are sought, as a multiple of its own.
REACH = 1.5
#: Variants of each family to fit on, and documents (those of lowest hash) whose lines stand for ordinary text.
VARIANTS, SAMPLE = 120, 4000
STEPS, L2 = 300, 1e-3

_LEFT = ("", "", "this file is", "the code of this project is", "note", "copyright 2019 the authors", "documentation", "unless stated otherwise this text is", "footer")
_RIGHT = ("", "", "see the file for details", "for more information visit our site", "contact the authors with questions", "version of today")


class Scanner(NamedTuple):
    """Known n-gram hashes in order, their weights per class, the classes' biases and the temperature."""

    grams: np.ndarray
    table: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


def lines(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, offsets, row, number) of every line that has words."""
    w = X.words(text)
    breaks = np.flatnonzero(w.data == 10)
    row = np.repeat(np.arange(len(w.off) - 1), np.diff(w.off))
    passed = np.searchsorted(breaks, w.begin)
    begins = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (passed[1:] != passed[:-1])))[: len(row)])
    before = np.searchsorted(breaks, w.row[row[begins]])  # line breaks before the row
    return w.hash, np.append(begins, len(w.hash)), row[begins], passed[begins] - before


def paragraphs(off: np.ndarray, row: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Where each paragraph begins among the lines, and the number of lines."""
    return np.append(np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (number[1:] != number[:-1] + 1)))[: len(row)]), len(row))


def _grams(hashes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, hash) of each n-gram of one to GRAMS words within a line."""
    owner = np.repeat(np.arange(len(off) - 1), np.diff(off))
    at, out, h = [], [], np.zeros(len(hashes), np.uint64)
    for k in range(GRAMS):
        n = max(0, len(hashes) - k)
        h = X.mix(h[:n] * np.uint64(0xD1342543DE82EF95) + hashes[k:] + np.uint64(k + 1))
        ok = owner[:n] == owner[k:]
        at.append(owner[:n][ok])
        out.append(h[ok])
    return np.concatenate(at), np.concatenate(out)


def _table(grams: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << 20, bool)
    table[(grams >> np.uint64(44)).astype(np.int64)] = True
    return table


def _known(hashes: np.ndarray, off: np.ndarray, grams: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, number) of the distinct known n-grams of each line."""
    at, h = _grams(hashes, off)
    some = np.flatnonzero(table[(h >> np.uint64(44)).astype(np.int64)])
    k = np.minimum(np.searchsorted(grams, h[some]), len(grams) - 1)
    hit = grams[k] == h[some]
    pair = np.unique(at[some[hit]] * len(grams) + k[hit])
    return pair // len(grams), pair % len(grams)


def probabilities(hashes: np.ndarray, off: np.ndarray, s: Scanner) -> np.ndarray:
    """The calibrated probabilities of each line's classes."""
    at, k = _known(hashes, off, s.grams, s.table)
    n = len(off) - 1
    z = np.stack([np.bincount(at, w[k], n) for w in s.weights.T], axis=1) if n else np.zeros((0, NONE + 1))
    z = (z / np.sqrt(np.maximum(np.diff(off), 1))[:, None] + s.bias) / s.temperature
    z = np.exp(z - z.max(axis=1, keepdims=True)) if n else z
    return z / z.sum(axis=1, keepdims=True)


def variants(rng: np.random.Generator, many: int) -> tuple[list[str], list[int]]:
    """Templates with words left out, put in, and put around them."""
    filler = " ".join(PROSE).split()
    out, y = [], []
    for f, phrases in enumerate(TEMPLATES.values()):
        for _ in range(many):
            p = phrases[rng.integers(len(phrases))].split()
            if len(p) > 5:
                p = [x for x in p if rng.random() > 0.06]
            if rng.random() < 0.2:
                p.insert(int(rng.integers(len(p) + 1)), str(rng.choice(filler)))
            if rng.random() < 0.3 and f + 1 < len(FAMILIES):
                p = p + phrases[rng.integers(len(phrases))].split()
            out.append(" ".join((_LEFT[rng.integers(len(_LEFT))], *p, _RIGHT[rng.integers(len(_RIGHT))])))
            y.append(f)
    words = [x for phrases in TEMPLATES.values() for p in phrases for x in p.split()]
    for _ in range(4 * many):  # ordinary text, and the templates' words without their order
        kind = rng.random()
        some = rng.choice(words if kind < 0.3 else filler, int(rng.integers(4, 16))).tolist()
        out.append(PROSE[rng.integers(len(PROSE))] if kind > 0.6 else " ".join(some))
        y.append(NONE)
    return out, y


def coverage(hashes: np.ndarray) -> np.ndarray:
    """For each family the greatest share of a template's pairs of words that a line has."""
    own = set(X.ngrams(hashes, np.array([0, len(hashes)]), 2)[0].tolist())
    return np.array([max(len(own & t) / len(t) for t in family) for family in _PAIRS])


def _pairs() -> list[list[set[int]]]:
    return [[set(X.ngrams(w, np.array([0, len(w)]), 2)[0].tolist()) for w in map(X.hash_words, family)] for family in TEMPLATES.values()]


_PAIRS = _pairs()


def fit(ordinary: pa.Array, seed: int = 9) -> Scanner:
    """The classifier; ordinary: texts of the corpus whose lines and paragraphs are no licence, save those that cover a template."""
    rng = np.random.default_rng(seed)
    texts, y = variants(rng, VARIANTS)
    held_texts, held_y = variants(rng, VARIANTS // 4)
    all_templates = pa.array([p for family in TEMPLATES.values() for p in family])
    h, off, _, _ = lines(all_templates)
    grams = np.unique(_grams(h, off)[1])
    table = _table(grams)

    def matrix(h: np.ndarray, off: np.ndarray) -> np.ndarray:
        at, k = _known(h, off, grams, table)
        x = np.zeros((len(off) - 1, len(grams)), np.float32)
        x[at, k] = 1
        return x / np.sqrt(np.maximum(np.diff(off), 1)).astype(np.float32)[:, None]

    h, off, row, _ = lines(pa.array(texts))
    x = matrix(h, off)
    y = np.array(y)[row]
    weight = np.ones(len(y))
    h, off, row, _ = lines(pa.array(held_texts))
    hx, hy = matrix(h, off), np.array(held_y)[row]
    hw = np.ones(len(hy))
    for a, b in X.slices(ordinary):
        h, off, row, number = lines(ordinary.slice(a, b - a))
        for o in (off, off[paragraphs(off, row, number)]):
            if len(o) < 2:
                continue
            known = np.zeros(len(o) - 1, bool)
            known[_known(h, o, grams, table)[0]] = True
            own = [h[x:y] for x, y, k in zip(o, o[1:], known) if k]
            own = [w for w in own if coverage(w).max() < COVER]
            size = np.concatenate(([0], np.cumsum([len(w) for w in own]))).astype(np.int64)
            # those without a known n-gram are all alike: one row stands for them
            ox = np.concatenate((matrix(np.concatenate(own), size) if own else x[:0], np.zeros((1, len(grams)), np.float32)))
            many = np.append(np.ones(len(own)), (~known).sum())
            pick = rng.random(len(ox)) < 0.8
            pick[-1] = True
            x, y, weight = np.concatenate((x, ox[pick])), np.concatenate((y, np.full(pick.sum(), NONE))), np.concatenate((weight, many[pick]))
            hx, hy, hw = np.concatenate((hx, ox[~pick])), np.concatenate((hy, np.full((~pick).sum(), NONE))), np.concatenate((hw, many[~pick]))
    none = y == NONE
    share = weight * np.where(none, 0.5 / max(1, weight[none].sum()), 0.5 / weight[~none].sum())
    target = np.eye(NONE + 1, dtype=np.float32)[y]
    w, b = np.zeros((len(grams), NONE + 1), np.float32), np.zeros(NONE + 1, np.float32)
    prev_w, prev_b, scale = w, b, np.float32(2 / (share @ np.square(x).sum(1) + 1))
    for t in range(STEPS):
        look_w, look_b = w + t / (t + 3) * (w - prev_w), b + t / (t + 3) * (b - prev_b)
        e = (_softmax(x @ look_w + look_b) - target) * share[:, None].astype(np.float32)
        prev_w, prev_b = w, b
        w, b = (look_w - scale * (x.T @ e + L2 * look_w)).astype(np.float32), (look_b - scale * e.sum(0)).astype(np.float32)
    z = hx @ w + b
    grid = np.exp(np.linspace(-2.5, 2, 91))
    loss = [-(hw * np.log(np.maximum(_softmax(z / g)[np.arange(len(hy)), hy], 1e-9))).sum() for g in grid]
    return Scanner(grams, table, w.astype(np.float64), b.astype(np.float64), float(grid[int(np.argmin(loss))]))


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _pair_table() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all templates' pairs: the hashes in order, with the template of each, the number of pairs of each template,
    and the high bits that occur."""
    templates = [t for family in _PAIRS for t in family]
    h = np.array([x for t in templates for x in t], np.uint64)
    of = np.repeat(np.arange(len(templates)), [len(t) for t in templates])
    order = np.argsort(h, kind="stable")
    return h[order], of[order], np.array([len(t) for t in templates]), _table(h)


_PAIR, _PAIR_OF, _PAIRS_IN, _PAIR_TABLE = _pair_table()


def passages(hashes: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(paragraph, begin, end) of the places that cover a template to at least COVER, those that cover it best first within a
    paragraph, none overlapping another."""
    h = X.mix(X.mix(hashes[:-1] + np.uint64(1)) * np.uint64(0xD1342543DE82EF95) + hashes[1:] + np.uint64(2)) if len(hashes) else hashes
    at = np.flatnonzero(_PAIR_TABLE[(h >> np.uint64(44)).astype(np.int64)])
    line = np.searchsorted(off, at, "right") - 1
    lo, hi = np.searchsorted(_PAIR, h[at]), np.searchsorted(_PAIR, h[at], "right")
    ok = (hi > lo) & (at + 1 < off[line + 1])
    at, line, lo, many = at[ok], line[ok], lo[ok], (hi - lo)[ok]
    k = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())
    at, line, template, pair = np.repeat(at, many), np.repeat(line, many), _PAIR_OF[k], k
    order = np.lexsort((at, template, line))
    at, line, template, pair = at[order], line[order], template[order], pair[order]
    least = np.ceil(COVER * _PAIRS_IN - 1e-9).astype(np.int64)
    reach = np.ceil(REACH * (_PAIRS_IN + 1)).astype(np.int64)
    # the place of the pair that a passage must reach to hold enough of them: all others are left out at once
    last = np.arange(len(at)) + least[template] - 1
    inside = np.minimum(last, len(at) - 1)
    some = np.flatnonzero((last < len(at)) & (line[inside] == line) & (template[inside] == template) & (at[inside] + 2 - at <= reach[template]))
    got: dict[int, list[tuple[float, int, int, int]]] = {}
    for i in some.tolist():
        t, seen, end, j = template[i], set(), int(at[i]) + 2, i
        while j < len(at) and line[j] == line[i] and template[j] == t and at[j] + 2 - at[i] <= reach[t]:
            if int(pair[j]) not in seen:
                seen.add(int(pair[j]))
                end = int(at[j]) + 2
            j += 1
        if len(seen) >= least[t]:
            got.setdefault(int(line[i]), []).append((-len(seen) / _PAIRS_IN[t], -len(seen), int(at[i]), end))
    for n, places in got.items():
        taken = np.zeros(off[n + 1] - off[n], bool)
        for _, _, begin, end in sorted(places):
            if not taken[begin - off[n] : end - off[n]].any():
                taken[begin - off[n] : end - off[n]] = True
                yield n, begin, end


def _judged(hashes: np.ndarray, p: np.ndarray) -> tuple[str, float, float]:
    """The family, probability and similarity of a line of these words and probabilities."""
    best = int(np.argmax(p[:NONE]))
    cover = coverage(hashes)
    if cover[best] >= COVER and cover[best] >= cover.max():
        return FAMILIES[best], float(p[best]), float(cover[best])
    return "unknown", float(1 - p[NONE]), float(cover.max())


def found(text: pa.Array, s: Scanner) -> list[tuple[int, int, int, str, float, float]]:
    """(row, first line, last line, family, probability, similarity) of a text column's licences."""
    out = []
    for a, b in X.slices(text):
        h, off, row, number = lines(text.slice(a, b - a))
        if not len(row):
            continue
        begins = paragraphs(off, row, number)
        line_of, paragraph_of = np.repeat(np.arange(len(row)), np.diff(off)), np.repeat(np.arange(len(begins) - 1), np.diff(begins))
        got: dict[int, dict[tuple[int, str], tuple]] = {}  # by paragraph, then by first line and family
        p = probabilities(h, off, s)
        for k in np.flatnonzero(p[:, NONE] < 0.5).tolist():
            family, *rest = _judged(h[off[k] : off[k + 1]], p[k])
            got.setdefault(int(paragraph_of[k]), {})[k, family] = (k, k, family, *rest)
        whole = off[begins]
        places = list(passages(h, whole))
        if places:
            parts = [h[begin:end] for _, begin, end in places]
            q = probabilities(np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts]))), s)
            for (n, begin, end), words, x in zip(places, parts, q):
                if x[NONE] < 0.5:
                    family, *rest = _judged(words, x)
                    first, last = int(line_of[begin]), int(line_of[end - 1])
                    there = got.setdefault(n, {})
                    if last > first:  # its lines by themselves are pieces of it
                        there = got[n] = {k: x for k, x in there.items() if not (first <= k[0] <= last and k[1] in (family, "unknown"))}
                    if all(f != family for _, f in there):
                        there[first, family] = (first, last, family, *rest)
        several = np.flatnonzero(np.diff(begins) > 1)
        several = several[[n not in got for n in several.tolist()]]
        if len(several):
            parts = [h[whole[n] : whole[n + 1]] for n in several]
            q = probabilities(np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts]))), s)
            for n, words, x in zip(several.tolist(), parts, q):
                if x[NONE] < 0.5:
                    got[n] = {(0, ""): (int(begins[n]), int(begins[n + 1]) - 1, *_judged(words, x))}
        for n in sorted(got):
            known = any(x[2] != "unknown" for x in got[n].values())
            for first, last, family, *rest in sorted(got[n].values(), key=lambda x: x[:3]):
                if family != "unknown" or not known:
                    out.append((a + int(row[first]), int(number[first]), int(number[last]), family, *rest))
    return out


def train(docs: DataFrame) -> Scanner:
    """Fitted with at most SAMPLE documents of docs, those of lowest hash, as ordinary text."""
    hashed = docs.where("text IS NOT NULL").select("text", F.xxhash64("text").alias("h"))
    most = hashed.select("h").orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]  # hashes alone are sorted, no texts
    few = [] if most is None else hashed.where(F.col("h") <= most).distinct().toArrow().sort_by([("h", "ascending"), ("text", "ascending")]).column("text").to_pylist()
    return fit(pa.array(few[:SAMPLE], pa.string()))


def scanned(docs: DataFrame) -> DataFrame:
    """The result that the module describes; nothing is shuffled but the sample."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(train(slim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = found(batch.column(1), shared.value)
            row, first, last, family, p, cover = zip(*rows) if rows else ((),) * 6
            yield pa.record_batch(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(family, pa.string()), pa.array(np.round(np.array(p, float), 6)), pa.array(np.round(np.array(cover, float), 6))],
                names=["doc_id", "first_line", "last_line", "family", "probability", "similarity"],
            )

    return slim.mapInArrow(run, "doc_id long, first_line int, last_line int, family string, probability double, similarity double")
