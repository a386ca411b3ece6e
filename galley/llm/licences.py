"""Licence scan: a paragraph classifier in DataFrame functions alone.

A softmax regression with an L1 penalty over words and pairs of words is fitted on the
driver to a table of licence notices and of other sentences (some of which talk of
licences, permissions or people named Apache). A temperature fitted to notices that were
kept out calibrates its probabilities; "unknown" is a class like the others.

A paragraph is a run of lines between blank ones (a line of comment signs alone is blank).
Its passages are scored: each of its lines, and, of its words whatever the lines, windows
twice as long as the longest notice that overlap by half, so that every notice lies whole in
one, however it is wrapped. Words are runs of a-z and numbers, so comment signs don't count.
A predicted family is confirmed when most word triples of one of its notices are in the
passage. A paragraph has a row for each family that a passage is predicted to be, with the
passage that is most like one of the family's notices.

Only paragraphs with a word without which every passage is unknown are scored. The scan is one narrow
pass: no shuffle, no join and no Python, however skewed the input.

A null text has no paragraph. Texts and paragraphs of any length work. Repeated rows and
null doc_ids give their findings as often as they come; documents without findings give no
row; other columns are ignored, and an empty table gives an empty table. The negatives of the
training table are sentences written for it and strings of frequent words of four languages.
"""

from __future__ import annotations

import json
import random
import re
import zlib
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

UNKNOWN = "unknown"
#: A prediction needs this probability; a notice is met with this share of its triples; slots of the table of weights.
LEAST, SHARE, SLOTS = 0.5, 0.8, 1 << 12
#: What lies between paragraphs (both for Spark and for DuckDB).
BETWEEN = r"\n(?:[^\p{L}\p{N}\n]*\n)+"

# Names of licences and usual notices, by family. 0 stands for any number.
NAMES = {
    "MIT": ["MIT License", "the MIT License", "Expat License", "MIT-License"],
    "Apache": ["Apache License, Version 2.0", "Apache-2.0", "the Apache License, Version 2.0", "Apache License 2.0"],
    "GPL": ["GNU General Public License", "the GNU General Public License, version 3", "GPL-3.0-or-later", "GPLv2", "GNU GPL version 2", "the GPL"],
    "LGPL": ["GNU Lesser General Public License", "the GNU Lesser General Public License, version 2.1", "LGPL-2.1-only", "the LGPL"],
    "AGPL": ["GNU Affero General Public License", "the GNU Affero General Public License, version 3", "AGPL-3.0-only", "the AGPL"],
    "BSD": ["BSD License", "BSD-3-Clause", "the 2-clause BSD License", "BSD-2-Clause", "the New BSD License"],
    "MPL": ["Mozilla Public License", "the Mozilla Public License, v. 2.0", "MPL-2.0"],
    "CC-BY": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "CC-BY-4.0", "the Creative Commons Attribution License"],
    "CC-BY-SA": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-3.0"],
    "CC-BY-NC": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0"],
    "CC0": ["CC0 1.0", "CC0 1.0 Universal Public Domain Dedication", "the Unlicense", "CC0-1.0"],
}
NOTICES = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    ],
    "Apache": [
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
    ],
    "GPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program",
    ],
    "LGPL": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "AGPL": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
    ],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "CC-BY": ["This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC0": ["This is free and unencumbered software released into the public domain", "To the extent possible under law, the author has waived all copyright and related rights to this work"],
    "Proprietary": ["All rights reserved", "This software is proprietary and confidential", "Unauthorized copying of this file, via any medium, is strictly prohibited", "Copyright 2020 Example Corp. All rights reserved."],
}
FRAMES = [
    "Licensed under {}.", "Released under {}.", "This work is licensed under {}.", "Distributed under the terms of {}.", "SPDX-License-Identifier: {}", "License: {}",
    "This project is licensed under {}", "Available under {}", "Code is released under {}.", "{}", "is made available under {}", "This file is subject to {}.",
]
OTHERS = [
    "He lost his driving license on the way to work", "The license plate of the car was blue", "The Apache helicopter landed near the village", "She studied at MIT and released a record",
    "You need permission to enter the building", "The warranty of this machine ends in May", "The public library is open without charge", "A general in the public service",
    "Please attribute the quote to its author", "The museum showed works in the creative arts", "All rights and duties of members are listed below", "The software was distributed to schools",
    "The version of the story that we know", "The wild beast known as gnu lives in the south", "A common licence fee is paid by each household", "The terms of the contract were agreed in writing",
    "Copy the file to the disk and close the program", "The conditions of the road were bad", "The foundation published a report", "Source and binary stars are seen at night",
    "The work is done by the commons committee", "cc the mail to all members by noon", "a new clause was added to the text", "no commercial break was shown", "they share all that they have alike",
    "The Mozilla browser opened a public page", "The driver's licence and the fishing licence", "the list of conditions is long", "the holder of the name",
    "er kam mit dem Zug und ging mit ihr nach Haus", "mit der Zeit wird sich das zeigen", "das Haus mit dem roten Dach ist von mir", "nicht mit den anderen zu verwechseln mit",
    "la casa de la que no se sabe por el camino con los del no", "le chat de la maison est dans une cour pour que les gens", "por la tarde en el parque con los perros del barrio", "un homme qui est sur le pont avec des amis",
]

_STOP = frozenset("a an and any are as at be by for from he her his if in is it its may not of on or our she that the their them they this to under was we were which with without you your 0 s v all no".split())


def words_of(text: str) -> list[str]:
    """Runs of a-z and of digits (any number counts as 0) of the lower-cased text."""
    return re.findall("[a-z]+|0", re.sub("[0-9]+", "0", text.lower()))


def _grams(words: list[str]) -> set[str]:
    """Words and pairs of neighbours, without those of stop words only."""
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if a not in _STOP or b not in _STOP]
    return {w for w in words if w not in _STOP} | set(pairs)


@dataclass
class Model:
    classes: list[str]
    start: list[float]
    weights: dict[str, list[float]]
    temperature: float


def training_table(rows: int = 1600, seed: int = 11) -> list[tuple[str, str]]:
    """(text, class): notices in their usual frames, some shortened or among other words, and other sentences."""
    r = random.Random(seed)
    filler = [w for s in OTHERS for w in s.split()]
    out = []
    families = list(NOTICES)
    for n in range(rows):
        if n % 3 == 0:
            words = r.choice(OTHERS).split() + [r.choice(filler) for _ in range(r.randint(0, 10))]
            if r.random() < 0.4:
                r.shuffle(words)
            out.append((" ".join(words), UNKNOWN))
            continue
        family = r.choice(families)
        if family in NAMES and r.random() < 0.6:
            text = r.choice(FRAMES).format(r.choice(NAMES[family]))
        else:
            text = r.choice(NOTICES[family])
            words = text.split()
            if len(words) > 14 and r.random() < 0.4:
                a = r.randint(0, len(words) // 3)
                text = " ".join(words[a : a + max(12, len(words) // 2)])
        if r.random() < 0.3:
            text = f"{' '.join(r.choice(filler) for _ in range(r.randint(1, 8)))} {text}"
        if r.random() < 0.2:
            text = f"{text} {' '.join(r.choice(filler) for _ in range(r.randint(1, 8)))}"
        out.append((text, family))
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@cache
def train(penalty: float = 0.0005, rounds: int = 250) -> Model:
    """Fits weights by accelerated proximal steps, then the temperature on rows that were kept out."""
    table = training_table()
    classes = [*NOTICES, UNKNOWN]
    grams = [_grams(words_of(t)) for t, _ in table]
    count: dict[str, int] = {}
    for g in grams:
        for x in g:
            count[x] = count.get(x, 0) + 1
    names = sorted(x for x, c in count.items() if c >= 4)
    column = {x: i for i, x in enumerate(names)}
    x = np.zeros((len(table), len(names)), np.float32)
    for i, g in enumerate(grams):
        x[i, [column[v] for v in g if v in column]] = 1
    y = np.eye(len(classes), dtype=np.float32)[[classes.index(c) for _, c in table]]
    out = np.arange(len(table)) % 5 == 4
    fit_x, fit_y = x[~out], y[~out]
    w = np.zeros((len(names), len(classes)), np.float32)
    start = np.log(fit_y.mean(0) + 1e-3).astype(np.float32)
    start[-1] += 1.5  # without any known word a paragraph is unknown
    ahead, t, rate = w.copy(), 1.0, 4.0 / max(1.0, float((fit_x**2).sum(1).mean()))
    for _ in range(rounds):
        p = _softmax(fit_x @ ahead + start)
        new = ahead - rate * (fit_x.T @ (p - fit_y) / len(fit_x))
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        later = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, w, t = new + (t - 1) / later * (new - w), new, later
    logits = x[out] @ w + start
    target = y[out].argmax(1)
    temperatures = np.geomspace(0.2, 5, 60)
    loss = [-np.log(_softmax(logits / k)[np.arange(len(target)), target] + 1e-12).mean() for k in temperatures]
    best = float(temperatures[int(np.argmin(loss))])
    kept = np.flatnonzero(np.abs(w).sum(1) > 0)
    return Model(classes, [round(float(v), 4) for v in start], {names[i]: [round(float(v), 4) for v in w[i]] for i in kept}, round(best, 4))


def _triples(text: str) -> list[str]:
    words = words_of(text)
    return sorted({" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))})


def templates() -> dict[str, list[list[str]]]:
    """The word triples of each family's notices, and of its names in their frames."""
    framed = {f: [frame.format(n) for n in names for frame in FRAMES if frame != "{}"] for f, names in NAMES.items()}
    return {f: [_triples(t) for t in NOTICES[f] + framed.get(f, [])] for f in NOTICES}


#: Words of the longest notice. A passage has twice as many, and the next begins so many later.
LONGEST = max(len(words_of(t)) for ts in NOTICES.values() for t in ts)


def triggers(model: Model) -> list[str]:
    """Words of which every passage that isn't unknown has one.

    A gram speaks for a family by what it adds to the family's sum over unknown's. Of the
    grams that speak for some family the weakest are left out while, for every family, all
    that they could add together stays below unknown's head start; of each of the others a
    word is kept. A passage without any of these words is unknown whatever else it holds.
    """
    lead = np.array(model.start[-1]) - np.array(model.start[:-1])
    speaks = {g: np.maximum(np.array(w[:-1]) - w[-1], 0) for g, w in model.weights.items()}
    left, kept = np.zeros(len(lead)), set()
    for gram, more in sorted(speaks.items(), key=lambda x: (float(x[1].max()), x[0])):
        if (left + more < lead - 1e-6).all():
            left = left + more
            continue
        words = [w for w in gram.split() if w not in _STOP]
        if not kept & set(words):
            kept.add(max(words, key=lambda w: (len(w), w)))
    return sorted(kept)


def _constant(value, kind: str):
    """A nested constant, which the optimiser folds into a literal."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, paragraph (its place from 0), family, probability, similarity, confirmed of each licence paragraph and family."""
    model = model or train()
    known = _constant(triggers(model), "array<string>")
    slots: list[list[dict]] = [[] for _ in range(SLOTS)]
    for gram, w in model.weights.items():
        slots[zlib.crc32(gram.encode()) % SLOTS].append({"g": gram, "w": w})
    table = _constant(slots, "array<array<struct<g:string,w:array<double>>>>")
    names, start = _constant(model.classes, "array<string>"), _constant(model.start, "array<double>")
    spelled = _constant(templates(), "map<string,array<array<string>>>")

    def words(text):
        # numbers become 0 and everything else but a-z a gap, as in words_of
        return F.array_remove(F.split(F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]+", " 0 "), "[^a-z0]+", " "), " "), "")

    def passages(paragraph):
        """The words of each line and window."""
        size, step = 2 * LONGEST, LONGEST
        lines = F.filter(F.transform(F.split(paragraph, "\n"), words), lambda w: F.size(w) <= size)

        def windows(w):
            last = F.greatest(F.ceil((F.size(w) - size) / step), F.lit(0)).cast("int")
            return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(w, i * step + 1, F.lit(size)))

        wide = F.when(paragraph.contains("\n") | (F.length(paragraph) > size), F.flatten(F.transform(F.array(words(paragraph)), windows))).otherwise(F.array().cast("array<array<string>>"))
        return F.filter(F.array_distinct(F.concat(lines, wide)), lambda w: F.arrays_overlap(w, known))

    def grams(w):
        pairs = F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, y: F.concat_ws(" ", x, y))
        return F.array_distinct(F.concat(w, pairs))

    def logits(w):
        def add(total, gram):
            hit = F.filter(F.get(table, (F.crc32(gram.cast("binary")) % SLOTS).cast("int")), lambda e: e["g"] == gram)
            return F.aggregate(hit, total, lambda t, e: F.zip_with(t, e["w"], lambda x, y: x + y))

        return F.aggregate(grams(w), start, add)

    def triples(w):
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))), lambda i: F.array_join(F.slice(w, i + 1, F.lit(3)), " "))

    # Each step maps an array, so what a later step uses twice is computed once.
    def findings(paragraph):
        scored = F.transform(passages(paragraph), lambda w: F.struct(w.alias("w"), logits(w).alias("z")))
        topped = F.transform(scored, lambda s: F.struct(s["w"].alias("w"), s["z"].alias("z"), F.array_max(s["z"]).alias("top")))
        guessed = F.transform(
            topped,
            lambda s: F.struct(
                s["w"].alias("w"),
                F.get(names, (F.array_position(s["z"], s["top"]) - 1).cast("int")).alias("family"),
                F.round(1 / F.aggregate(s["z"], F.lit(0.0), lambda t, v: t + F.exp((v - s["top"]) / model.temperature)), 4).alias("probability"),
            ),
        )
        sure = F.filter(guessed, lambda s: (s["family"] != UNKNOWN) & (s["probability"] >= LEAST))
        cut = F.transform(sure, lambda s: F.struct(s["family"].alias("family"), triples(s["w"]).alias("t"), s["probability"].alias("probability")))

        def compared(s):
            shares = F.transform(F.try_element_at(spelled, s["family"]), lambda n: F.size(F.array_intersect(n, s["t"])) / F.size(n))
            return F.struct(s["family"].alias("family"), F.round(F.array_max(shares), 4).alias("similarity"), s["probability"].alias("probability"))

        # of each family the passage that is most like a notice, of equals the likeliest
        def best(found):
            return F.filter(found, lambda x, i: ~x["family"].eqNullSafe(F.get(found, i + 1)["family"]))

        return F.flatten(F.transform(F.array(F.array_sort(F.transform(cut, compared))), best))

    def hot(text):
        return F.arrays_overlap(F.split(F.lower(text), "[^a-z]+"), known)

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).where(hot(F.col("text")))
    parts = rows.select("doc_id", F.posexplode(F.split("text", BETWEEN)).alias("paragraph", "text")).where(hot(F.col("text")))
    hits = parts.select("doc_id", F.col("paragraph").cast("long").alias("paragraph"), F.inline(findings(F.col("text"))))
    return hits.select("doc_id", "paragraph", "family", "probability", "similarity", (F.col("similarity") >= SHARE).alias("confirmed"))


def predict(text: str, model: Model | None = None) -> tuple[str, float]:
    """Class and probability of one paragraph, on the driver (for tests)."""
    model = model or train()
    words = words_of(text)
    z = np.array(model.start)
    for g in _grams(words):
        z = z + np.array(model.weights.get(g, [0.0] * len(z)))
    p = _softmax(z[None] / model.temperature)[0]
    return model.classes[int(z.argmax())], float(p.max())


def op2_licences(spark, sf_dir: str) -> DataFrame:
    """Licence paragraphs of all documents."""
    return scan(common.table(spark, sf_dir, "documents"))
