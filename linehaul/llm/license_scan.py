"""License scan: a trained paragraph classifier, in DataFrame functions only.

A sparse multinomial logistic regression over words and word pairs names a paragraph's licence family or says unknown;
its probabilities are calibrated on notices held out of the fit, and a comparison with the family's notices confirms it. The fit is of a fixed set of notices and runs on the driver; the
scan is joins and aggregates, and looks closer only at paragraphs that have one of the words without which, by the
weights, no family can win.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Notices by family. They stand for the licences' own short forms and headers.
NOTICES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "SPDX-License-Identifier: Apache-2.0",
        "Apache 2.0 license",
        "This project is released under the Apache License 2.0.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
        "This project is licensed under the terms of the MIT license.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
        "Distributed under the terms of the GNU GPL v3.",
        "Released under the GPL version 2 or later.",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ),
    "agpl": (
        "This program is distributed under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "This work is licensed under CC BY 4.0.", "Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"),
    "cc-by-sa": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "This work is licensed under CC BY-SA 4.0.", "Licensed under CC BY-SA 4.0.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "cc-by-nc": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "This work is licensed under CC BY-NC 4.0.", "Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "public-domain": ("To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal.", "This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: CC0-1.0"),
    "proprietary": ("Copyright. All rights reserved.", "Proprietary software. All rights reserved.", "This document is confidential and proprietary; no part of it may be reproduced without prior written permission."),
}
#: Prose that shares words with notices but grants nothing.
PROSE = (
    "He renewed his driving license under the new rules of the general public office.",
    "The apache helicopter was released in version after version of the game.",
    "She studied at MIT and was free to use the library without a fee.",
    "A licensed physician may not use this procedure without permission.",
    "The public domain of the town is common to all and free of charge.",
    "Creative people share work and attribution is common in the arts.",
    "The source of the river is subject to the terms of the treaty.",
    "The foundation published the following conditions for the prize.",
    "All rights and duties of tenants are written in the copy of the contract.",
    "The software was modified and distributed in binary form by a person of the firm.",
    "Copyright law is taught in the second year of the course.",
    "International trade in commercial goods grew by 4.0 percent.",
    "The new version of the file can be found in the project folder.",
    "This program is on television at eight and the work is by a general.",
    "The report was released under the name of the library.",
)
#: Words of any English prose; paragraphs of these alone are examples of unknown.
COMMON = "the of and to in is this that or be with by for as are it on at from not you may without only a an any all was were has have had which who whom their there they he she his her its our your if then than so such no nor but can will would should must other more most some one two new use used found under part person file work source version following right copy permitted".split()
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UNKNOWN = "unknown"


def tokens(text: str) -> list[str]:
    return [t for t in re.split(_GAP, text.lower()) if t]


def grams(words: list[str]) -> set[str]:
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))}


@dataclass(frozen=True)
class Model:
    """weights[feature][class] over the classes, the last of which is unknown; already divided by the temperature."""

    classes: tuple[str, ...]
    bias: tuple[float, ...]
    weights: dict[str, tuple[float, ...]]
    anchors: tuple[str, ...]
    temperature: float


def distinctive(most: int = 3) -> dict[str, set[str]]:
    """Of each family the words of its notices that at most ``most`` families have, and no common prose."""
    by = {f: {w for n in notices for w in tokens(n)} for f, notices in NOTICES.items()}
    return {f: {w for w in by[f] if w not in COMMON and len(w) > 1 and sum(w in v for v in by.values()) <= most} for f in by}


def _examples(seed: int, copies: int, which: Callable[[int], bool] = lambda i: True) -> list[tuple[list[str], int]]:
    """Notices whose number in their family is wanted, with words dropped, swapped for made-up ones and set into made-up text.

    Unknown are prose, shuffled scraps, and notices in which made-up words stand for all that is the family's own:
    licences of other names.
    """
    rng, families, own = np.random.default_rng(seed), list(NOTICES), distinctive()
    made_up = lambda n: ["zq" + "".join(rng.choice(list("abcdefgh"), 3)) for _ in range(n)]
    out, unknown = [], len(families)
    for k, family in enumerate(families):
        for i, notice in enumerate(NOTICES[family]):
            if not which(i):
                continue
            words = tokens(notice)
            out.append((words, k))
            for _ in range(copies):
                kept = [w if rng.random() > 0.05 else made_up(1)[0] for w in words if len(words) < 8 or rng.random() > 0.08]
                out.append((made_up(rng.integers(0, 6)) + kept + made_up(rng.integers(0, 6)), k))
                other = [made_up(1)[0] if w in own[family] else w for w in words]
                out.append((made_up(rng.integers(0, 6)) + other + made_up(rng.integers(0, 6)), unknown))
    pool = [w for v in NOTICES.values() for n in v for w in tokens(n)]
    for i, text in enumerate(PROSE):
        if not which(i):
            continue
        words = tokens(text)
        for _ in range(copies):
            out.append(([w for w in words if rng.random() > 0.1] + made_up(rng.integers(0, 4)), unknown))
    for _ in range(25 * copies):
        common = [str(v) for v in rng.choice(COMMON, rng.integers(1, 60))] + made_up(rng.integers(0, 20))
        out.append(([common[i] for i in rng.permutation(len(common))], unknown))
    for _ in range(20 * copies):
        out.append((made_up(rng.integers(1, 30)), unknown))
        out.append(([str(w) for w in rng.choice(pool, rng.integers(1, 3))] + made_up(rng.integers(3, 15)), unknown))
    return out


def _matrix(examples: list[tuple[list[str], int]], index: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((len(examples), len(index)))
    for r, (words, _) in enumerate(examples):
        x[r, [index[g] for g in grams(words) if g in index]] = 1
    return x, np.array([k for _, k in examples])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _fit(examples: list[tuple[list[str], int]], l1: float, steps: int, rate: float) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """(features, weights, bias) by accelerated proximal gradient with L1, every class weighing the same."""
    seen: dict[str, int] = {}
    for words, _ in examples:
        for g in grams(words):
            # what is made of common words and single digits alone tells nothing, and half of all paragraphs have it
            if "zq" not in g and any(len(v) > 1 and v not in COMMON for v in g.split(" ")):
                seen[g] = seen.get(g, 0) + 1
    index = {g: i for i, g in enumerate(sorted(g for g, n in seen.items() if n >= 3))}
    x, y = _matrix(examples, index)
    classes = len(NOTICES) + 1
    hot = np.eye(classes)[y]
    each = 1 / (np.bincount(y, minlength=classes)[y] * classes)
    w, b = np.zeros((len(index), classes)), np.zeros(classes)
    v, momentum = w, 1.0
    for _ in range(steps):
        g = (_softmax(x @ v + b) - hot) * each[:, None]
        new = v - rate * (x.T @ g)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * l1, 0)
        following = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        v = new + (momentum - 1) / following * (new - w)
        w, momentum = new, following
        b -= rate * g.sum(0)
    return index, w, b


@lru_cache(maxsize=4)
def train(copies: int = 12, l1: float = 3e-4, steps: int = 250, rate: float = 2.0, seed: int = 7, folds: int = 4) -> Model:
    """The model of all notices. Its temperature minimises the loss of notices and prose that were held out of the fit, fold by fold."""
    out = []
    for fold in range(folds):
        index, w, b = _fit(_examples(seed, copies, lambda i, fold=fold: i % folds != fold), l1, steps, rate)
        x, y = _matrix(_examples(seed + 1, copies, lambda i, fold=fold: i % folds == fold), index)
        out.append((x @ w + b, y))
    scores, y = np.concatenate([s for s, _ in out]), np.concatenate([k for _, k in out])
    # classes weigh the same here too
    each = 1 / np.bincount(y, minlength=len(NOTICES) + 1)[y]
    temperature = min((-(np.log(_softmax(scores / t)[np.arange(len(y)), y] + 1e-300) * each).sum(), t) for t in np.geomspace(0.2, 5, 40))[1]
    index, w, b = _fit(_examples(seed, copies), l1, steps, rate)
    w, b = w / temperature, b / temperature
    kept = {g: tuple(np.round(w[i], 9).tolist()) for g, i in index.items() if np.any(w[i])}
    bias = tuple(np.round(b, 9).tolist())
    return Model((*NOTICES, UNKNOWN), bias, kept, _anchors(bias, kept), float(temperature))


def _anchors(bias: tuple[float, ...], weights: dict[str, tuple[float, ...]]) -> tuple[str, ...]:
    """Words of which a paragraph must have one for any family to score above unknown: without them the gains left don't reach."""
    gain = {g: [max(0.0, v - w[-1]) for v in w[:-1]] for g, w in weights.items()}
    need = [bias[-1] - v for v in bias[:-1]]
    anchors: set[str] = set()
    while True:
        left = {g: v for g, v in gain.items() if not anchors & set(g.split(" "))}
        short = [sum(v[k] for v in left.values()) - need[k] for k in range(len(need))]
        k = int(np.argmax(short))
        if short[k] < 0 or not left:
            return tuple(sorted(anchors))
        by_word: dict[str, float] = {}
        for g, v in left.items():
            for word in g.split(" "):
                by_word[word] = by_word.get(word, 0) + v[k]
        anchors.add(max(sorted(by_word), key=lambda v: (v not in COMMON and len(v) > 1, by_word[v])))


#: A line end in the middle of a sentence: what stands before ends none, and the next line is not blank.
_WRAPPED = r"\n(?<![.!?:;\s&&[^\r]]\r?\n)[ \t]*(?=[^\s])"


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text: its lines, those that are wrapped in the middle of a sentence joined."""
    return F.split(F.regexp_replace(text, _WRAPPED, " "), r"[\r\n]+")


def paragraph_words(text: Column) -> Column:
    return F.split(F.lower(text), _GAP)


def pairs_of(word_list: Column) -> Column:
    pair = F.transform(F.sequence(F.lit(1), F.size(word_list) - 1), lambda i: F.concat_ws(" ", F.get(word_list, i - 1), F.get(word_list, i)))
    return F.when(F.size(word_list) > 1, pair).otherwise(F.array().cast("array<string>"))


def license_paragraphs(docs: DataFrame, least: float = 0.2, confirm: float = 0.6, report: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, paragraph, family, predicted, probability, template_similarity, confirmed)``: paragraphs that name or quote a licence.

    ``paragraph`` counts a text's paragraphs from 0; lines wrapped in the middle of a sentence are one. A paragraph is
    ``predicted`` to be of the family with the largest probability if that is at least ``least`` and above unknown's;
    ``template_similarity`` is the largest mean, over the family's notices, of the shares of a notice's words and of its
    neighbouring pairs that the paragraph has, and ``family`` is the prediction if that reaches ``confirm``, else
    unknown; what is not confirmed is reported where the probability reaches ``report``. All paragraphs of all whole texts, however long, are classified. Null and empty texts have none; between
    equal probabilities the family first in the list is taken; identical rows give one result, rows of one id the
    results of all their texts; an empty table none.
    """
    spark, model = docs.sparkSession, train()
    anchors = F.array(*[F.lit(a) for a in model.anchors])
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode_outer(paragraphs(F.col(text_col))).alias("paragraph", "line")).where("line IS NOT NULL")
    # (outer explodes and arrays of one: so the optimizer does not split every text again in a filter)
    words = lines.select("doc_id", "paragraph", F.explode(F.array(paragraph_words(F.col("line")))).alias("w"))
    near = words.where(F.arrays_overlap("w", anchors)).select("doc_id", "paragraph", F.filter("w", lambda x: x != "").alias("w")).dropDuplicates()
    features = F.array_distinct(F.concat("w", pairs_of(F.col("w"))))
    k = len(model.classes)
    # the weights are bounded by the notices' words
    weights = spark.createDataFrame([(g, *w) for g, w in sorted(model.weights.items())], "feature string, " + ", ".join(f"s{i} double" for i in range(k)))
    sums = near.select("doc_id", "paragraph", "w", F.explode(features).alias("feature")).join(F.broadcast(weights), "feature")
    sums = sums.groupBy("doc_id", "paragraph", "w").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(k)])
    # sums of doubles in any order: rounded, so that reruns agree
    scores = F.array(*[F.round(F.col(f"s{i}") + F.lit(model.bias[i]), 9) for i in range(k)])
    scored = sums.select("doc_id", "paragraph", "w", F.explode(F.array(scores)).alias("s")).select("*", F.array_max("s").alias("top"))
    total = F.aggregate("s", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    scored = scored.select("doc_id", "paragraph", "w", (F.array_position("s", F.col("top")) - 1).cast("int").alias("class"), (1 / total).alias("probability"))
    found = scored.where((F.col("class") < k - 1) & (F.col("probability") >= least))
    notices = spark.createDataFrame([(i, sorted(set(t)), sorted(grams(t) - set(t))) for i, f in enumerate(NOTICES) for t in map(tokens, NOTICES[f])], "class int, notice array<string>, pairs array<string>")
    share = lambda x, of: F.size(F.array_intersect(x, of)) / F.size(of)
    alike = (share(F.col("w"), F.col("notice")) + share(F.col("v"), F.col("pairs"))) / 2
    compared = found.withColumn("v", pairs_of(F.col("w"))).join(F.broadcast(notices), "class").groupBy("doc_id", "paragraph", "w", "class", "probability").agg(F.max(alike).alias("template_similarity"))
    predicted = F.element_at(F.array(*[F.lit(c) for c in model.classes]), F.col("class") + 1)
    sure = F.col("template_similarity") >= confirm
    return compared.where(sure | (F.col("probability") >= report)).select("doc_id", "paragraph", F.when(sure, predicted).otherwise(UNKNOWN).alias("family"), predicted.alias("predicted"), F.round("probability", 6).alias("probability"), F.round("template_similarity", 6).alias("template_similarity"), sure.alias("confirmed"))
