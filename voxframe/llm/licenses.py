"""License scans: a trained paragraph classifier, confirmed against templates; DataFrame functions alone on the main path.

A paragraph is a line of a text; its words are runs of a-z and 0-9 after lower-casing A-Z. A sparse (L1) softmax
regression on word and word-pair presence gives each licence family and the class "unknown" a score. It is trained here,
on variants of the short public notices below and on made-up prose, some of it about licences; the unknown class is then
calibrated: its bias is the smallest that lets no more than CALIBRATION of held-out prose pass for a licence. Weights are
rounded to integers, so scores add up alike in any engine and order.

A prediction is confirmed if a notice of its family has at least CONFIRM percent of its word pairs in the paragraph.

Paragraphs without any of the model's anchor words are left out before n-grams are made. The anchors are chosen so that
this is exact: what other words can add up to never lifts a family over "unknown".

Result: a row per paragraph that is either given a family or names licences (NAMES) in a way that no
family explains, which is "unknown". Defined results: null and empty texts have no paragraphs; repeated rows are scanned
row by row; equal scores go to the family that sorts first; an empty table gives an empty result; columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

import functools
import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: Words that make a paragraph one about licences.
NAMES = ["license", "licensed", "licence", "licenced", "copyright", "copyleft"]
CONFIRM = 60
CALIBRATION = 0.001
SCALE = 1000
#: Short notices in public use, by family.
NOTICES = {
    "apache": ["Licensed under the Apache License, Version 2.0", "Released under the Apache License 2.0", "Distributed under the Apache License, Version 2.0", "you may not use this file except in compliance with the Apache License", "SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["Licensed under the BSD 3-Clause License", "This software is released under the BSD License", "Use of this source code is governed by a BSD-style license", "Redistribution and use in source and binary forms, with or without modification, are permitted", "SPDX-License-Identifier: BSD-3-Clause"],
    "cc-by": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "Available under the Creative Commons Attribution License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Released under CC BY-NC-SA 4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "Text is available under the Creative Commons Attribution-ShareAlike License", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc0": ["Released under CC0 1.0", "To the extent possible under law, all copyright and related rights are waived under CC0", "Dedicated to the public domain under CC0 1.0 Universal"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3", "Released under the GNU GPL version 2 or later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1", "Released under the LGPL version 3", "under the terms of the GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-2.1-only"],
    "mit": ["Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the terms of the MIT license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "SPDX-License-Identifier: MIT"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "proprietary": ["All rights reserved", "Copyright. All rights reserved", "No part of this publication may be reproduced without prior written permission", "Proprietary and confidential. Unauthorized copying is prohibited"],
}
#: Prose about licences that grants none.
NEGATIVES = [
    "she lost her driving license in may", "the license plate was covered with mud", "the copyright office opens at nine", "fishing without a licence is an offence",
    "the public library is free of charge", "he was released from prison", "the new version was released in spring", "under the terms of the treaty all troops withdrew",
    "a general election and the public mood", "no part of the road was reserved for bicycles", "all rooms are reserved for guests", "the mit campus lies on the river", "apache helicopters were seen",
    "the copyright dispute was settled", "license fees rose again", "written permission from a parent is needed", "the source of the river", "gnu and zebra graze on the plain",
    "the committee licensed a new operator", "creative people in common spaces", "commons debate on attribution of the attack", "the software was free and easy to modify",
]
#: Licences outside the families: what the unknown class has to hold back.
FOREIGN = [
    "Licensed under the ISC license", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3", "Licensed under the GNU Affero General Public License v3", "Eclipse Public License - v 2.0",
    "Released under the Eclipse Public License 1.0", "Boost Software License - Version 1.0", "Distributed under the zlib license", "Released under the Artistic License 2.0",
    "Licensed under the European Union Public Licence 1.2", "Licensed under the Microsoft Public License", "Common Development and Distribution License Version 1.0", "Licensed under the Open Software License 3.0",
    "SIL Open Font License Version 1.1", "Licensed under the Server Side Public License version 1", "Licensed under the Business Source License 1.1", "Licensed under the Python Software Foundation License Version 2",
    "Released under the PostgreSQL License", "Distributed under the terms of the Ruby license", "SPDX-License-Identifier: ISC", "SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: EPL-2.0", "SPDX-License-Identifier: Zlib",
]


def words_of(paragraph: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), paragraph))


def grams_of(words: list[str]) -> set[str]:
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))}


class Classifier:
    """weights: gram -> {class: integer}; bias: class -> integer; anchors: words one of which every licence has."""

    def __init__(self, weights: dict[str, dict[str, int]], bias: dict[str, int], anchors: list[str]):
        self.weights, self.bias, self.anchors = weights, bias, anchors

    def scores(self, words: list[str]) -> dict[str, int]:
        out = dict(self.bias)
        for g in grams_of(words):
            for k, w in self.weights.get(g, {}).items():
                out[k] += w
        return out


def _examples(r: random.Random, n: int) -> list[tuple[list[str], str]]:
    def noise(k: int) -> list[str]:
        return ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 3))) for _ in range(k)]

    common = "the of and a to in is it that for with on by this as are was be at or from an not have you all may any new one our".split()
    out: list[tuple[list[str], str]] = []
    for _ in range(n):
        for family, notices in NOTICES.items():
            for notice in notices:
                words = [w for w in words_of(notice) if r.random() > 0.06]
                out.append((noise(r.choice([0, 0, 0, 2, 6])) + words + noise(r.choice([0, 0, 0, 3])), family))
        for text in FOREIGN:
            words = [w for w in words_of(text) if r.random() > 0.03]
            out.append((noise(r.choice([0, 0, 2])) + words + noise(r.choice([0, 0, 3])), UNKNOWN))
        for text in NEGATIVES:
            out.append((noise(r.choice([0, 2])) + [w for w in words_of(text) if r.random() > 0.1] + noise(r.choice([0, 3])), UNKNOWN))
        for _ in range(40):
            out.append(([w for _ in range(r.randint(1, 25)) for w in (noise(1) if r.random() < 0.6 else [r.choice(common)])], UNKNOWN))
    return out


@functools.cache
def trained(seed: int = 5, variants: int = 12, rounds: int = 250) -> Classifier:
    r = random.Random(seed)
    data, held = _examples(r, variants), _examples(r, variants)
    grams = sorted({g for notices in (*NOTICES.values(), FOREIGN) for notice in notices for g in grams_of(words_of(notice))})
    number = {g: i for i, g in enumerate(grams)}
    classes = [*sorted(NOTICES), UNKNOWN]
    x = np.zeros((len(data), len(grams)))
    y = np.zeros((len(data), len(classes)))
    for row, (words, k) in enumerate(data):
        x[row, [number[g] for g in grams_of(words) if g in number]] = 1
        y[row, classes.index(k)] = 1
    w, b = np.zeros((len(grams), len(classes))), np.zeros(len(classes))
    share = np.where(y[:, -1] > 0, 0.5 / y[:, -1].sum(), 0.5 / (len(y) - y[:, -1].sum()))[:, None]
    rate = 4.0
    for _ in range(rounds):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        error = (p - y) * share
        w -= rate * (x.T @ error)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * 2e-4, 0)  # L1: few weights remain
        b -= rate * error.sum(0)
    whole = np.rint(w * SCALE).astype(int)
    bias = dict(zip(classes, np.rint(b * SCALE).astype(int).tolist()))
    weights = {g: {c: int(v) for c, v in zip(classes, whole[i]) if v} for g, i in number.items() if whole[i].any()}
    model = Classifier(weights, bias, [])
    # calibration of the unknown class on held-out prose, and so that a paragraph without evidence is unknown
    over = []
    for words, k in held:
        if k == UNKNOWN:
            s = model.scores(words)
            over.append(max(v for c, v in s.items() if c != UNKNOWN) - s[UNKNOWN])
    over.sort(reverse=True)
    model.bias[UNKNOWN] += max(0, over[int(CALIBRATION * len(over))] + 1)
    model.bias[UNKNOWN] = max(model.bias[UNKNOWN], max(v for c, v in model.bias.items() if c != UNKNOWN) + 1)
    model.anchors = _anchors(model, [words for words, k in data + held if k == UNKNOWN])
    return model


def _anchors(model: Classifier, prose: list[list[str]]) -> list[str]:
    """Words without which no family can win: words that are frequent in prose are left out as long as all grams made of
    left-out words together can't lift any family over "unknown"."""
    often: dict[str, int] = {}
    for words in prose:
        for word in words:
            often[word] = often.get(word, 0) + 1
    every = sorted({word for g in model.weights for word in g.split()} - set(NAMES), key=lambda word: (-often.get(word, 0), word))
    anchors = {*every, *NAMES}
    for word in every:
        fewer = anchors - {word}
        free = [ws for g, ws in model.weights.items() if not fewer.intersection(g.split())]
        if all(sum(max(0, ws.get(c, 0) - ws.get(UNKNOWN, 0)) for ws in free) <= model.bias[UNKNOWN] - model.bias[c] for c in NOTICES):
            anchors = fewer
    return sorted(anchors)


def _templates() -> list[tuple[str, int, str, int]]:
    """(family, notice, word pair, number of the notice's pairs)"""
    out, k = [], 0
    for family in sorted(NOTICES):
        for notice in NOTICES[family]:
            words = words_of(notice)
            pairs = sorted({f"{a} {b}" for a, b in zip(words, words[1:])})
            out += [(family, k, p, len(pairs)) for p in pairs]
            k += 1
    return out


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def scan(docs: DataFrame, model: Classifier | None = None, confirm: int = CONFIRM) -> DataFrame:
    """doc_id, paragraph (from 0), family, margin (thousandths over "unknown"), coverage (percent), confirmed."""
    model = model or trained()
    spark = docs.sparkSession
    lines = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("paragraph", "line"))
    lines = lines.select("_row", "doc_id", "paragraph", F.split(_lower(F.col("line")), "[^a-z0-9]+").alias("words"))
    lines = lines.where(F.arrays_overlap("words", F.array(*map(F.lit, model.anchors))))
    lines = lines.withColumn("words", F.filter("words", lambda w: w != ""))
    pairs = F.when(F.size("words") > 1, F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", F.lit(2), F.size("words") - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    grams = lines.select("_row", "doc_id", "paragraph", F.explode(F.array_distinct(F.concat("words", pairs))).alias("gram"))

    # one row per gram: its weights for all classes and the notices it is a pair of; a few hundred rows, fixed by the model
    classes = [*sorted(NOTICES), UNKNOWN]
    templates = _templates()
    notices = sorted({(k, family, n) for family, k, _, n in templates})
    pair_of: dict[str, set[int]] = {}
    for _, k, p, _ in templates:
        pair_of.setdefault(p, set()).add(k)
    names = sorted({*model.weights, *pair_of, *NAMES})
    rows = [(g, *(model.weights.get(g, {}).get(c, 0) for c in classes), *(int(k in pair_of.get(g, ())) for k, _, _ in notices), int(g in NAMES)) for g in names]
    schema = "gram string, " + ", ".join(f"w{i} int" for i in range(len(classes))) + ", " + ", ".join(f"t{k} int" for k, _, _ in notices) + ", named int"
    known = F.broadcast(spark.createDataFrame(rows, schema))
    sums = [F.sum(f"w{i}").alias(f"w{i}") for i in range(len(classes))] + [F.sum(f"t{k}").alias(f"t{k}") for k, _, _ in notices] + [F.max("named").alias("named")]
    found = grams.join(known, "gram").groupBy("_row", "doc_id", "paragraph").agg(*sums)

    score = [F.col(f"w{i}") + model.bias[c] for i, c in enumerate(classes)]
    best = F.greatest(*score[:-1])
    family = F.lit(UNKNOWN)
    for c, s in reversed(list(zip(classes[:-1], score))):
        family = F.when((s == best) & (best > score[-1]), F.lit(c)).otherwise(family)
    coverage = F.lit(0)
    for c in classes[:-1]:
        own = [F.floor(F.col(f"t{k}") * 100 / n).cast("int") for k, f, n in notices if f == c]
        coverage = F.when(F.col("family") == c, F.greatest(*own)).otherwise(coverage)
    out = found.withColumn("family", family).withColumn("margin", (best - score[-1]).cast("long")).withColumn("coverage", coverage)
    out = out.where((F.col("family") != UNKNOWN) | (F.col("named") == 1))
    return out.select("doc_id", "paragraph", "family", "margin", "coverage", (F.col("coverage") >= confirm).alias("confirmed"))


def scan_sql(model: Classifier | None = None, confirm: int = CONFIRM) -> str:
    """The same over a long table of weights."""
    model = model or trained()
    classes = [*sorted(NOTICES), UNKNOWN]
    q = lambda s: "'" + s.replace("'", "''") + "'"
    weights = ", ".join(f"({q(g)}, {q(c)}, {w})" for g, ws in model.weights.items() for c, w in ws.items())
    bias = ", ".join(f"({q(c)}, {model.bias[c]})" for c in classes)
    pairs = ", ".join(f"({q(f)}, {k}, {q(p)}, {n})" for f, k, p, n in _templates())
    anchors = ", ".join(map(q, model.anchors))
    names = ", ".join(map(q, NAMES))
    return f"""
WITH weights(gram, class, w) AS (VALUES {weights}), bias(class, b) AS (VALUES {bias}), templates(family, notice, gram, n) AS (VALUES {pairs}),
d AS (SELECT row_number() OVER () AS r, doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT r, doc_id, unnest(range(len(ls))) AS paragraph, unnest(ls) AS line FROM d),
p AS (SELECT r, doc_id, paragraph, list_filter(regexp_split_to_array(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda x: x <> '') AS ws FROM l),
c AS (SELECT * FROM p WHERE list_has_any(ws, [{anchors}])),
g AS (SELECT r, doc_id, paragraph, unnest(list_distinct(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])))) AS gram FROM c),
s AS (SELECT k.r, k.doc_id, k.paragraph, bias.class, bias.b + coalesce(sum(weights.w), 0) AS score
  FROM c k CROSS JOIN bias LEFT JOIN g ON g.r = k.r AND g.paragraph = k.paragraph LEFT JOIN weights ON weights.gram = g.gram AND weights.class = bias.class GROUP BY k.r, k.doc_id, k.paragraph, bias.class, bias.b),
u AS (SELECT r, paragraph, score AS unknown FROM s WHERE class = {q(UNKNOWN)}),
m AS (SELECT s.r, s.doc_id, s.paragraph, max(score) AS best, arg_min(class, (-score, class)) AS top FROM s WHERE class <> {q(UNKNOWN)} GROUP BY ALL),
f AS (SELECT m.r, m.doc_id, m.paragraph, CASE WHEN best > unknown THEN top ELSE {q(UNKNOWN)} END AS family, CAST(best - unknown AS BIGINT) AS margin FROM m JOIN u USING (r, paragraph)),
t AS (SELECT r, paragraph, family, max(x) AS coverage FROM (SELECT g.r, g.paragraph, family, notice, CAST(floor(count(*) * 100 / any_value(n)) AS INTEGER) AS x
  FROM g JOIN templates USING (gram) GROUP BY ALL) GROUP BY ALL)
SELECT f.doc_id, CAST(f.paragraph AS INTEGER) AS paragraph, f.family, margin, coalesce(coverage, 0) AS coverage, coalesce(coverage, 0) >= {confirm} AS confirmed
FROM f LEFT JOIN t ON t.r = f.r AND t.paragraph = f.paragraph AND t.family = f.family JOIN c ON c.r = f.r AND c.paragraph = f.paragraph
WHERE f.family <> {q(UNKNOWN)} OR list_has_any(ws, [{names}])"""
