"""Licence notices in documents, by a trained paragraph classifier.

Blank lines part the paragraphs of a text. Multinomial logistic regression on
sparse word n-grams tells licence families apart, and all of them from an unknown
class, which it learns from lines of the corpus and from lines that speak of
licences without granting one. The probabilities are calibrated on variants that
were not trained on.

1. A paragraph's words, whatever lines they stand on, are compared with the
   templates: a stretch that holds enough of one, and a name of its family, is a
   confirmed notice, of every family of which that is true.
2. Lines outside of notices that run over several lines are classified. A family
   that is predicted is compared with its templates, too; neighbouring lines of
   one family that none of them confirms are one notice, compared as a whole.

The classifier is trained on variants of the templates below and on a bounded
number of corpus lines; scanning reads every line of every text.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechloom.llm.columns import portions
from speechloom.llm.training import few_by_hash

# Short public notices of licence families.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This project is released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "This software is distributed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "gpl-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "agpl-3.0": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "bsd": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "epl-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "isc": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ),
    "zlib": (
        "Released under the zlib License.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions.",
        "SPDX-License-Identifier: Zlib",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Released under the Unlicense.",
        "SPDX-License-Identifier: Unlicense",
    ),
    "cc-by-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-sa-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by-nc-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc0-1.0": (
        "This work is dedicated to the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work under the CC0 1.0 Universal Public Domain Dedication.",
    ),
}
# Words by which a family is told from those with like templates.
NAMES = {
    "apache-2.0": ("apache",),
    "mit": ("mit", "permission is hereby granted"),
    "gpl-3.0": ("gnu general public", "gpl"),
    "gpl-2.0": ("gnu general public", "gpl"),
    "epl-2.0": ("eclipse public", "epl"),
    "isc": ("isc", "this permission notice appear"),
    "zlib": ("zlib", "redistribute it freely"),
    "unlicense": ("unlicense", "free and unencumbered"),
    "lgpl": ("lesser general public", "lgpl"),
    "agpl-3.0": ("affero general public", "agpl"),
    "bsd": ("bsd", "redistribution and use"),
    "mpl-2.0": ("mozilla", "mpl"),
    "cc-by-4.0": ("cc by 4", "attribution 4"),
    "cc-by-sa-4.0": ("by sa", "attribution sharealike"),
    "cc-by-nc-4.0": ("by nc", "attribution noncommercial"),
    "cc0-1.0": ("cc0", "public domain"),
}
# What must stand with the name where a family is one version of several.
VERSIONS = {
    "apache-2.0": ("2 0", "version 2", "v2", "apache 2"),
    "gpl-3.0": ("version 3", "gpl 3", "v3", "v 3", "license 3"),
    "gpl-2.0": ("version 2", "gpl 2", "v2", "v 2", "license 2"),
    "agpl-3.0": ("version 3", "agpl 3", "v3", "v 3", "license 3"),
    "mpl-2.0": ("2 0", "version 2", "v2", "mpl 2"),
    "epl-2.0": ("2 0", "version 2", "v2", "epl 2"),
}
# By which a text says that a licence does not hold.
DENIED = re.compile(
    r"\b(?:not|never|no longer) (?:\w+ ){0,2}(?:licensed|released|distributed|available|covered|published)\b"
)
# Lines that speak of licences but are no notice of a family.
DECOYS = (
    "All rights reserved.",
    "Copyright 2020 by the author.",
    "A driving license is required to rent a car.",
    "The license plate of the car was missing.",
    "Please read the terms of use before you continue.",
    "This page was released last week.",
    "The software is sold under a commercial license.",
    "Version 2.0 of the game was published under a new name.",
    "He was granted a fishing license free of charge.",
    "The work of the foundation is open to the public.",
    "Contact us to obtain a license.",
    "The general public is free to visit the library.",
)
UNKNOWN = "unknown"
WORDS = re.compile(r"\w+")
GRAMS = 3
# Variants of each template to train and to calibrate on, and corpus paragraphs.
VARIANTS, HELD_VARIANTS, CORPUS_DOCS, CORPUS_PARAGRAPHS = 24, 8, 300, 2000
# Long lines are cut into pieces of so many words, each of which may be drawn.
PIECE_WORDS = 200
# N-grams in a larger share of corpus paragraphs tell nothing about licences.
COMMON_SHARE = 0.005
RIDGE, ROUNDS = 1e-4, 300
LEAST_PROBABILITY, LEAST_SIMILARITY = 0.5, 0.6
# A notice has at most so many times the words of its template, and so many more.
LONGER, MORE_WORDS = 1.5, 4


def words_of(paragraph: str) -> list[str]:
    return WORDS.findall(paragraph.lower())


def grams_of(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[k : k + size]) for size in range(1, GRAMS + 1) for k in range(len(words) - size + 1)}


def _variants(template: str, count: int, seed: int) -> list[list[str]]:
    """Wordings near a template: some words lost or changed, others around it."""
    rng = random.Random(seed)
    base = words_of(template)
    around = words_of("copyright 2019 the authors of this project see file for details code data text note")
    out = [base]
    while len(out) < count:
        words = [w for w in base if rng.random() > 0.08] or base
        before = rng.sample(around, rng.randint(0, 4))
        after = rng.sample(around, rng.randint(0, 4))
        out.append([*before, *words, *after])
    return out


@dataclass(frozen=True)
class Classifier:
    classes: tuple[str, ...]
    places: dict[tuple[str, ...], int]
    weights: np.ndarray
    bias: np.ndarray
    heat: float

    def probabilities(self, words: list[str]) -> np.ndarray | None:
        """Of the classes; None without any known n-gram, which is unknown."""
        get = self.places.get
        at = sorted({p for g in grams_of(words) if (p := get(g)) is not None})
        if not at:
            return None
        return _softmax((self.weights[at].sum(0) + self.bias) / self.heat)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(background: list[str]) -> Classifier:
    """Trains on variants of the templates, on decoys and on corpus paragraphs,
    and finds the temperature that makes held-out probabilities fit best."""
    classes = (*TEMPLATES, UNKNOWN)
    train, held = [], []
    for number, family in enumerate(TEMPLATES):
        for k, template in enumerate(TEMPLATES[family]):
            train += [(w, number) for w in _variants(template, VARIANTS, 1000 * number + k)]
            held += [(w, number) for w in _variants(template, HELD_VARIANTS, 500_000 + 1000 * number + k)[1:]]
    unknown = len(classes) - 1
    for k, decoy in enumerate(DECOYS):
        train += [(w, unknown) for w in _variants(decoy, VARIANTS, 900_000 + k)]
        held += [(w, unknown) for w in _variants(decoy, HELD_VARIANTS, 950_000 + k)[1:]]
    plain = [words_of(p) for p in background]
    # A licence line of the corpus is no example of the unknown class.
    sure = {g for t in TEMPLATES.values() for x in t for g in grams_of(words_of(x)) if len(g) == GRAMS}
    plain = [w for w in plain if w and not grams_of(w) & sure]
    train += [(w, unknown) for w in plain[::2]]
    held += [(w, unknown) for w in plain[1::2]]
    often = Counter(g for w in plain for g in grams_of(w))
    known = Counter(g for w, label in train if label != unknown for g in grams_of(w))
    limit = COMMON_SHARE * max(len(plain), 1)
    places = {g: k for k, g in enumerate(sorted(g for g, n in known.items() if n > 2 and often[g] <= limit))}

    def matrix(rows):
        x = np.zeros((len(rows), len(places)), np.float32)
        for k, (words, _) in enumerate(rows):
            x[k, [places[g] for g in grams_of(words) if g in places]] = 1
        return x, np.array([label for _, label in rows])

    x, y = matrix(train)
    target = np.eye(len(classes))[y]
    weight = (1 / np.bincount(y, minlength=len(classes))[y])[:, None] / len(classes)
    w, bias = np.zeros((len(places), len(classes))), np.zeros(len(classes))
    first = [np.zeros_like(w), np.zeros_like(bias)]
    second = [np.zeros_like(w), np.zeros_like(bias)]
    for step in range(1, ROUNDS + 1):
        error = weight * (_softmax(x @ w + bias) - target)
        for k, (value, grad) in enumerate(((w, x.T @ error + RIDGE * w), (bias, error.sum(0)))):
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.999 * second[k] + 0.001 * grad**2
            value -= 0.1 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    hx, hy = matrix(held)
    z = hx @ w + bias
    heats = [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0]
    loss = [-np.log(_softmax(z / h)[np.arange(len(hy)), hy] + 1e-12).mean() for h in heats]
    return Classifier(classes, places, w, bias, heats[int(np.argmin(loss))])


def pairs_of(words: list[str]) -> list[tuple[str, str]]:
    return list(zip(words, words[1:]))


# (family, its word pairs, most words of a notice) of each template, and the
# templates that hold a pair.
PATTERNS = [
    (family, frozenset(pairs_of(w)), int(LONGER * len(w)) + MORE_WORDS)
    for family, templates in TEMPLATES.items()
    for w in map(words_of, templates)
]
HOLDERS: dict[tuple[str, str], list[int]] = {}
for _number, (_, _pairs, _) in enumerate(PATTERNS):
    for _pair in _pairs:
        HOLDERS.setdefault(_pair, []).append(_number)
FIRST_NAMES = frozenset(name.split()[0] for names in NAMES.values() for name in names)


def similarity(words: list[str], family: str) -> float:
    """The largest share of a template's word pairs that a paragraph holds."""
    held = set(pairs_of(words))
    return max(len(pairs & held) / len(pairs) for own, pairs, _ in PATTERNS if own == family)


def _stretches(at: list[int], found: list, pattern: tuple) -> list[tuple[int, int]]:
    """(first, one past the last word) of stretches of words that hold enough of
    a template, from the places and values of its pairs in a paragraph."""
    _, pairs, most = pattern
    least = LEAST_SIMILARITY * len(pairs)
    out: list[tuple[int, int]] = []
    inside: Counter = Counter()
    first = 0
    for last, pair in enumerate(found):
        inside[pair] += 1
        while at[last] + 2 - at[first] > most:
            inside[found[first]] -= 1
            if not inside[found[first]]:
                del inside[found[first]]
            first += 1
        if len(inside) >= least:
            # Repeated pairs before those that count are none of the notice.
            while inside[found[first]] > 1:
                inside[found[first]] -= 1
                first += 1
            if out and at[first] < out[-1][1]:
                out[-1] = (out[-1][0], at[last] + 2)
            else:
                out.append((at[first], at[last] + 2))
    return out


def named(words: list[str], start: int, end: int, family: str) -> bool:
    """Whether a stretch of words has a name of the family, with its version there or
    in the few words after it, and does not deny the licence."""
    text = f" {' '.join(words[start:end])} "
    after = f" {' '.join(words[start : end + MORE_WORDS])} "
    versions = VERSIONS.get(family)
    if not any(f" {name} " in text for name in NAMES[family]):
        return False
    if versions and not any(f" {version} " in after for version in versions):
        return False
    return not DENIED.search(" ".join(words[max(0, start - MORE_WORDS) : end]))


def confirmed(words: list[str]) -> list[tuple[int, int, str]]:
    """(first, one past the last word, family) of the stretches of a paragraph
    that hold enough of a template and are ``named`` as its family."""
    if FIRST_NAMES.isdisjoint(words):
        return []
    hits: dict[int, tuple[list, list]] = {}
    for k, pair in enumerate(zip(words, words[1:])):
        for number in HOLDERS.get(pair, ()):
            at, found = hits.setdefault(number, ([], []))
            at.append(k)
            found.append(pair)
    by_family: dict[str, list[tuple[int, int]]] = {}
    for number, (at, found) in hits.items():
        family = PATTERNS[number][0]
        for start, end in _stretches(at, found, PATTERNS[number]):
            if named(words, start, end, family):
                by_family.setdefault(family, []).append((start, end))
    out = []
    for family, spans in by_family.items():
        # Templates of a family that overlap are one notice.
        joined: list[list[int]] = []
        for start, end in sorted(spans):
            if joined and start < joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], end)
            else:
                joined.append([start, end])
        out += [(start, end, family) for start, end in joined]
    return sorted(out)


def notices(text: str | None, model: Classifier) -> list[tuple]:
    """(number of the first line, first and one past the last character, family,
    probability, similarity, confirmed) of the lines, or runs of lines, of a text
    that are taken for a licence notice."""
    out, at, paragraph = [], 0, []
    for number, line in enumerate((text or "").split("\n")):
        if line.strip():
            paragraph.append((number, at, line, words_of(line)))
        elif paragraph:
            out += _paragraph_notices(paragraph, model)
            paragraph = []
        at += len(line) + 1
    return out + (_paragraph_notices(paragraph, model) if paragraph else [])


def _paragraph_notices(lines: list[tuple], model: Classifier) -> list[tuple]:
    words = [w for *_, own in lines for w in own]
    line_of = [k for k, (*_, own) in enumerate(lines) for _ in own]
    # By first and last line and family; a row has no more than one of these.
    rows: dict[tuple[int, int, str], tuple[float, float, bool]] = {}
    inside = set()
    for start, end, family in confirmed(words):
        p = model.probabilities(words[start:end])
        if p is None or p[model.classes.index(UNKNOWN)] >= LEAST_PROBABILITY:
            continue
        first, last = line_of[start], line_of[end - 1]
        if last > first:
            inside.update(range(first, last + 1))
        like = similarity([w for *_, own in lines[first : last + 1] for w in own], family)
        rows[first, last, family] = (float(p[model.classes.index(family)]), like, True)
    for k, (*_, own) in enumerate(lines):
        guess = _guess(own, model) if own and k not in inside else None
        if guess:
            rows[k, k, guess[0]] = guess[1:]
    kept: list[tuple[int, int, str, tuple]] = []
    for (first, last, family), values in sorted(rows.items()):
        if kept and not values[2]:
            before, end, own, (_, _, sure) = kept[-1]
            if own == family and end + 1 == first and not sure:
                whole = _guess([w for *_, x in lines[before : last + 1] for w in x], model, family)
                kept[-1] = (before, last, family, whole[1:])
                continue
        kept.append((first, last, family, values))
    return [
        (lines[a][0], lines[a][1], lines[b][1] + len(lines[b][2]), family, *values)
        for a, b, family, values in kept
    ]


def _guess(words: list[str], model: Classifier, family: str | None = None) -> tuple | None:
    """(family, probability, similarity, confirmed) of the family that words are
    taken for, if any, or of a given one."""
    p = model.probabilities(words)
    if p is None:
        return None
    best = int(p.argmax()) if family is None else model.classes.index(family)
    if family is None and (model.classes[best] == UNKNOWN or p[best] < LEAST_PROBABILITY):
        return None
    like = similarity(words, model.classes[best])
    sure = like >= LEAST_SIMILARITY and named(words, 0, len(words), model.classes[best])
    return model.classes[best], float(p[best]), like, sure


def train(docs: DataFrame, id_column: str, text_column: str) -> Classifier:
    """Fits with a bounded number of paragraphs from a bounded number of documents."""
    rows = docs.select(
        F.col(f"`{id_column}`").cast("string").alias("id"),
        F.col(f"`{text_column}`").cast("string").alias("text"),
    )
    some = few_by_hash(rows.where("text is not null"), ["id", "text"], CORPUS_DOCS, docs.count())
    words = some.select(F.explode(F.split("text", "\n")).alias("line")).select(F.split("line", " ").alias("words"))
    pieces = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("words") - 1) / PIECE_WORDS).cast("int")),
        lambda k: F.array_join(F.slice("words", k * PIECE_WORDS + 1, F.lit(PIECE_WORDS)), " "),
    )
    lines = words.select(F.explode(pieces).alias("line")).where("line <> ''").distinct()
    found = lines.orderBy(F.xxhash64("line"), "line").limit(CORPUS_PARAGRAPHS).collect()
    return fit(sorted(r["line"] for r in found))


def scanned(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row per licence notice and family: the document's id, ``paragraph``
    (number of its first line, from 0), ``start`` and ``end`` (characters of its
    whole lines), ``family``, ``probability``, ``similarity`` to the nearest
    template of the family, and ``confirmed``. A line with several notices of
    different families has a row for each.

    Null, empty and blank texts have no notice. Ids may be null or repeat; every
    row of the table is scanned. Equal lines get equal results. Other columns
    play no part. An empty table gives an empty table.
    """
    model = train(docs, id_column, text_column)
    rows = docs.select(
        F.col(f"`{id_column}`").alias("_ls_id"), F.col(f"`{text_column}`").cast("string").alias("_ls_text")
    )
    names = ["paragraph", "start", "end", "family", "probability", "similarity", "confirmed"]
    kinds = [pa.int64()] * 3 + [pa.string(), pa.float64(), pa.float64(), pa.bool_()]

    def run(batches):
        for batch in portions(batches):
            at, found = [], []
            for k, text in enumerate(batch.column("_ls_text").to_pylist()):
                rows = notices(text, model)
                at += [k] * len(rows)
                found += rows
            ids = batch.column("_ls_id").take(pa.array(at, pa.int64()))
            columns = zip(*found) if found else [()] * len(names)
            values = [pa.array(list(x), kind) for x, kind in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([ids, *values], ["_ls_id", *names])

    kind = rows.schema["_ls_id"].dataType.simpleString()
    ddl = "paragraph long, start long, end long, family string, probability double, similarity double, confirmed boolean"
    return rows.mapInArrow(run, f"_ls_id {kind}, {ddl}").withColumnRenamed("_ls_id", id_column)
