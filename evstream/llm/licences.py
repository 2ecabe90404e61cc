"""Licence scan: a trained paragraph classifier on sparse word n-grams, confirmed by templates.

A paragraph is a line. Its word n-grams (one to three words) weigh on the licence families, on the class
"unknown" (notices of licences of no family here) and on the class "none"; weights come from a softmax regression
with an L1 penalty, trained on the templates below (whole, with words lost, inside other words) and on others'
notices against look-alikes, and its temperature is fitted on held-out variants, so probabilities are calibrated.
A paragraph whose best family is probable is compared with that family's templates. It is "unknown" if it is
probably a notice (1 less the probability of "none", which then is the probability reported) but no family is
probable and confirmed.

Notices are often wrapped. So runs of consecutive lines with words are scored too, as far as a template can
reach: no more words than the longest template has of each line, and no more between the first line and the
last. A run names a family as a line does, n-grams and template words running across its line breaks; of runs
and lines of one family that overlap, the shortest stays, and lines inside a run that stays are not "unknown".
A run is reported as its first line's number and its whole length, and is never "unknown" itself.

Scanning uses DataFrame functions only. A paragraph without a word of any feature that speaks for a family
can only be "none" and is not taken apart; that is a property of the sum, not a cut.

Null text counts as empty and has one empty paragraph. Null doc_ids and repeated rows get rows of their
own. An empty table gives an empty table. Other columns are never looked at.
"""

from __future__ import annotations

import json
import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAMS = 3
SURE = 0.5
CONTAINED = 0.75
WORD = "[a-z0-9]+(?:[.+-][a-z0-9]+)*"

#: What the licences' own texts, notices and tags say, by family.
TEMPLATES: dict[str, list[str]] = {
    "AGPL": ["Licensed under the GNU Affero General Public License, version 3.", "GNU Affero General Public License as published by the Free Software Foundation", "Released under the AGPL-3.0 license.", "You should have received a copy of the GNU Affero General Public License along with this program", "SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "you may not use this file except in compliance with the License", "Released under the Apache-2.0 license.", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied", "See the License for the specific language governing permissions and limitations under the License", "each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license", "SPDX-License-Identifier: Apache-2.0"],
    "BSD": ["Released under the BSD License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause"],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC0": ["Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "dedicated to the public domain under CC0", "SPDX-License-Identifier: CC0-1.0"],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.", "GNU General Public License as published by the Free Software Foundation", "Licensed under the GNU General Public License, version 2.", "Released under the GPL-3.0 license.", "either version 3 of the License, or at your option any later version", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "You should have received a copy of the GNU General Public License along with this program", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later"],
    "ISC": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE", "SPDX-License-Identifier: ISC"],
    "LGPL": ["Licensed under the GNU Lesser General Public License, version 3.", "GNU Lesser General Public License as published by the Free Software Foundation", "Released under the LGPL-3.0 license.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "You should have received a copy of the GNU Lesser General Public License along with this library", "SPDX-License-Identifier: LGPL-2.1-or-later", "SPDX-License-Identifier: LGPL-3.0-only"],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "Licensed under the MIT License.", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY", "SPDX-License-Identifier: MIT"],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0", "SPDX-License-Identifier: MPL-2.0"],
}
#: Notices of licences of no family above, from which the class "unknown" is learned.
OTHERS = [
    "This software is provided as-is, without any express or implied warranty, and the authors are not liable for damages arising from its use.", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.",
    "Everyone is permitted to copy and distribute verbatim or modified copies of this license document.", "This is free and unencumbered software released into the public domain.", "Distributed under the Boost Software License, Version 1.0.", "Licensed under the European Union Public Licence, version 1.2.",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.", "Licensed under the Artistic License, version 2.0.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.", "SPDX-License-Identifier: EPL-2.0", "SPDX-License-Identifier: Zlib",
    "Licensed under the Acme Commercial License, version 1.", "This software is proprietary and may only be used under a commercial license agreement.", "Released under the Blue Oak Model License.", "Licensed under the Open Software License, version 3.0.", "Use of this program is subject to the terms of the End User License Agreement.", "Licensed under the Example Public License, version 7.", "Released under the Vendor Source License.",
]
#: Sentences that share words with licences and are none.
LOOK_ALIKES = [
    "He renewed his driving license at the public office.", "The software was released in version 3.", "Permission was granted to enter the building.", "All rights reserved.", "The general public was invited to the foundation.",
    "The apache helicopter landed.", "A gnu crossed the river.", "The free person obtained a copy of the file.", "The court is governed by applicable law.", "She studied at MIT for any purpose.",
    "The work of the creative commons attracted the public.", "A fishing license is required by law.", "The source and the binary forms of the noun.", "In compliance with the rules you may use this door.", "Copyright law protects the author.",
    "The doctor is licensed to practise.", "The film was released under a new title.", "Version 2.0 of the game is out.", "Mozilla released a browser.", "The conditions are met and the fee is paid.",
    "License plates are checked here.", "The original copy of the notice was in the file.", "It is distributed in the region by the foundation.", "The terms of the agreement are subject to change.", "The international attribution of the painting is unclear.",
]
STOP = frozenset("a an and any are as at be by for form from has have in is it its may not of on only or other provided shall that the this to use used was were who will with without you your no v new all".split())


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


#: No template is longer, and a run that stands across a line break reaches no farther.
LONGEST = max(len(words_of(t)) for ts in TEMPLATES.values() for t in ts)


def grams_of(words: list[str]) -> set[str]:
    return {" ".join(words[k : k + n]) for n in range(1, GRAMS + 1) for k in range(len(words) - n + 1)} - STOP


@dataclass
class LicenceModel:
    families: list[str]  # unknown among them; one class more is none
    features: list[str]
    weights: np.ndarray  # features x classes, over the temperature
    bias: np.ndarray

    def anchors(self) -> list[str]:
        """Words at least one of which is in every feature that speaks for a family against none.

        A text without them has no more for any family than the empty text.
        """
        speaks = (self.weights[:, :-1] > self.weights[:, -1:]).any(1)
        return sorted({w for f, yes in zip(self.features, speaks) if yes for w in f.split(" ") if w not in STOP})

    def pattern(self) -> str:
        """A regular expression that finds an anchor, branching on its first letter."""
        by_first: dict[str, list[str]] = {}
        for a in self.anchors():
            by_first.setdefault(a[0], []).append(re.escape(a[1:]))
        return "(?<![a-z0-9])(?:" + "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in by_first.items()) + ")(?![a-z0-9])"

    def probabilities(self, text: str) -> np.ndarray:
        at = {f: k for k, f in enumerate(self.features)}
        z = self.bias + sum((self.weights[at[g]] for g in grams_of(words_of(text)) if g in at), np.zeros(len(self.bias)))
        e = np.exp(z - z.max())
        return e / e.sum()


def _variants(rng: random.Random, text: str, label: int, fillers: list[str], times: int) -> list[tuple[list[str], int]]:
    words = words_of(text)
    out = [(words, label)] * 3
    for _ in range(times):
        kept = [w for w in words if rng.random() > 0.04]
        out.append((rng.sample(fillers, rng.randint(0, 8)) + kept + rng.sample(fillers, rng.randint(0, 8)), label))
    return out


@lru_cache(maxsize=1)
def train(seed: int = 11, steps: int = 150, rate: float = 4.0, shrink: float = 2e-4) -> LicenceModel:
    """Softmax regression by proximal descent; every third variant is held out to fit the temperature."""
    rng, families = random.Random(seed), [*sorted(TEMPLATES), "unknown"]
    none = len(families)
    fillers = sorted({w for s in LOOK_ALIKES for w in words_of(s)} | STOP)
    rows = [v for k, f in enumerate(families) for t in TEMPLATES.get(f, OTHERS) for v in _variants(rng, t, k, fillers, 12)]
    for s in LOOK_ALIKES:
        rows += _variants(rng, s, none, fillers, 12)
    pool = sorted({w for ts in (*TEMPLATES.values(), OTHERS) for t in ts for w in words_of(t)})
    rows += [(rng.sample(pool, rng.randint(1, 6)), none) for _ in range(600)] + [([], none)] * 30
    grams = [grams_of(w) for w, _ in rows]
    labels = np.array([y for _, y in rows])
    held = np.arange(len(rows)) % 3 == 2
    seen: dict[str, int] = {}
    for g in grams:
        for x in g:
            seen[x] = seen.get(x, 0) + 1
    features = sorted(x for x, n in seen.items() if n >= 4 and any(w not in STOP for w in x.split(" ")))
    at = {f: k for k, f in enumerate(features)}
    x = np.zeros((len(rows), len(features)), np.float32)
    for r, g in enumerate(grams):
        x[r, [at[f] for f in g if f in at]] = 1
    y = np.eye(none + 1, dtype=np.float32)[labels]
    w, b, speed = np.zeros((len(features), none + 1), np.float32), np.zeros(none + 1, np.float32), np.float32(0)
    xt, yt = x[~held], y[~held]
    for _ in range(steps):
        p = _softmax(xt @ w + b)
        speed = 0.9 * speed + xt.T @ (p - yt) / len(xt)
        w -= rate * 0.1 * speed
        w = np.sign(w) * np.maximum(0, np.abs(w) - rate * 0.1 * shrink)
        b -= rate * (p - yt).mean(0)
    z = x[held] @ w + b
    loss = {t: -np.log(_softmax(z / t)[np.arange(len(z)), labels[held]] + 1e-12).mean() for t in np.geomspace(0.2, 5, 33)}
    t = min(loss, key=loss.get)
    live = np.abs(w).max(1) > 0
    return LicenceModel(families, [f for f, keep in zip(features, live) if keep], w[live] / t, b / t)


def reliability(model: LicenceModel, texts: list[tuple[str, bool]], bins: int = 5) -> tuple[float, float]:
    """How well "is a licence notice" is calibrated: the mean gap between probability and share by bin, and the share decided rightly at SURE."""
    p = np.array([1 - model.probabilities(t)[-1] for t, _ in texts])
    y = np.array([is_notice for _, is_notice in texts], float)
    at = np.minimum((p * bins).astype(int), bins - 1)
    gap = sum(abs(p[at == k].sum() - y[at == k].sum()) for k in range(bins)) / len(p)
    return float(gap), float(((p >= SURE) == (y > 0)).mean())


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _constant(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table as one literal of the plan."""
    fields = ", ".join(f.replace(" ", ": ", 1) for f in schema.split(", "))
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{fields}>>")))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def _opening(line: Column) -> Column:
    """Length of a line and its first words, as many as the longest template has."""
    start = F.regexp_extract(F.lower(line), f"^(?:[^a-z0-9]*{WORD}){{0,{LONGEST}}}", 0)
    return F.struct(F.length(line).alias("length"), _words(start).alias("words"))


def _runs() -> Column:
    """The runs of two lines and more that begin at a line (length, words, after): lines, length, words."""
    begin = F.struct(F.lit(0).alias("lines"), F.lit(0).alias("between"), F.lit(True).alias("open"))

    def reach(at: Column, line: Column) -> Column:
        n = F.size(line["words"])
        on = at["open"] & (n > 0) & (at["between"] <= LONGEST - 2)
        return F.struct((at["lines"] + on.cast("int")).alias("lines"), (at["between"] + n).alias("between"), on.alias("open"))

    most = F.coalesce(F.aggregate("after", begin, reach)["lines"], F.lit(0))

    def run(k: Column) -> Column:
        lines = F.slice("after", F.lit(1), k)
        tail = F.when(F.size("words") < LONGEST, F.col("words")).otherwise(F.slice("words", -(LONGEST - 1), LONGEST - 1))
        length = F.col("length") + F.aggregate(lines, F.lit(0), lambda n, line: n + 1 + line["length"])
        return F.struct((k + 1).alias("lines"), length.alias("length"), F.concat(tail, F.flatten(F.transform(lines, lambda line: line["words"]))).alias("words"))

    some = F.when((most > 0) & (F.size("words") > 0), F.transform(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), run))
    return F.coalesce(some, F.array().cast("array<struct<lines:int,length:int,words:array<string>>>"))


def _near_a_template(vocabulary: list[str]) -> Column:
    """Whether words hold enough of a template for it to be contained in them; no other run can name a family."""
    shapes = sorted({tuple(sorted(set(words_of(t)) - STOP)) for ts in TEMPLATES.values() for t in ts})
    least = min(CONTAINED * len(s) for s in shapes)
    each = F.array(*(F.array(*map(F.lit, s)) for s in shapes))
    contained = F.exists(each, lambda t: F.size(F.array_intersect(t, F.col("words"))) >= CONTAINED * F.size(t))
    return (F.size(F.array_intersect(F.col("words"), F.array(*map(F.lit, vocabulary)))) >= least) & contained


def scan_paragraphs(docs: DataFrame, text: str = "text", model: LicenceModel | None = None) -> DataFrame:
    """(__row, doc_id, n_paragraphs) of every document, with paragraph, lines, length, family, probability and overlap of each licence paragraph or run of lines (null in documents without).

    Words and n-grams are looked up one a row, and only sums of weights and bits of template words are carried on: a
    paragraph's own words stay where they are.
    """
    model, spark = model or train(), docs.sparkSession
    classes = [*model.families, "none"]
    vocabulary = sorted({w for ts in TEMPLATES.values() for t in ts for w in words_of(t)} - STOP)
    masks = range(-(-len(vocabulary) // 60))  # template words as bits of a few numbers

    def bits(words: list[str]) -> list[int]:
        at = [vocabulary.index(w) for w in words]
        return [sum(1 << (k - 60 * m) for k in at if k // 60 == m) for m in masks]

    body, anchored = F.coalesce(F.col(text), F.lit("")), model.pattern()
    rows = docs.select(F.monotonically_increasing_id().alias("__row"), "doc_id", body.alias("__body"))
    rows = rows.select("__row", "doc_id", F.split("__body", "\n").alias("__lines"), F.lower("__body").rlike(anchored).alias("__any"))
    numbered = F.transform("__lines", lambda line, k: F.struct(k.alias("paragraph"), line.alias("line")))
    some = F.when(F.col("__any"), F.filter(numbered, lambda s: F.lower(s["line"]).rlike(anchored)))
    some = F.transform(some, lambda s: F.struct(s["paragraph"].alias("paragraph"), s["line"].alias("line"), F.slice("__lines", s["paragraph"] + 2, LONGEST - 1).alias("after")))
    rows = rows.select("__row", "doc_id", F.size("__lines").alias("n_paragraphs"), F.explode_outer(some).alias("s"))
    rows = rows.select("__row", "doc_id", "n_paragraphs", F.explode(F.array(F.struct("s.paragraph", F.length("s.line").alias("length"), _words(F.col("s.line")).alias("words"), F.transform("s.after", _opening).alias("after")))).alias("s"))
    rows = rows.select("__row", "doc_id", "n_paragraphs", "s.*").select("__row", "doc_id", "n_paragraphs", "paragraph", F.explode(F.concat(F.array(F.struct(F.lit(1).alias("lines"), "length", "words")), _runs())).alias("s"))
    rows = rows.select("__row", "doc_id", "n_paragraphs", "paragraph", "s.*").where((F.col("lines") == 1) | _near_a_template(vocabulary))

    def grams(n: int) -> Column:
        most = F.size("words") - n
        return F.when(most >= 0, F.transform(F.sequence(F.lit(1), most + 1), lambda k: F.array_join(F.slice("words", k, n), " "))).otherwise(F.array().cast("array<string>"))

    all_grams = F.array_distinct(F.concat(*(grams(n) for n in range(1, GRAMS + 1))))
    parts = rows.select("__row", "doc_id", "n_paragraphs", "paragraph", "lines", "length", F.explode_outer(all_grams).alias("gram"))
    weights = {w: [0.0] * len(classes) for w in vocabulary} | {f: [float(v) for v in w] for f, w in zip(model.features, model.weights)}
    table = [{"gram": g, "w": w, "bits": bits([g] if g in vocabulary else [])} for g, w in weights.items()]
    parts = parts.join(F.broadcast(_constant(spark, table, "gram string, w array<double>, bits array<bigint>")), "gram", "left")  # a row a feature: bounded by the templates
    sums = [F.sum(F.coalesce(F.col("w")[k], F.lit(0.0))).alias(f"z{k}") for k in range(len(classes))]
    found = [F.bit_or(F.coalesce(F.col("bits")[m], F.lit(0))).alias(f"b{m}") for m in masks]
    scored = parts.groupBy("__row", "paragraph", "lines").agg(F.first("doc_id").alias("doc_id"), F.first("n_paragraphs").alias("n_paragraphs"), F.first("length").alias("length"), *sums, *found)
    z = [F.col(f"z{k}") + float(model.bias[k]) for k in range(len(classes))]
    best = F.greatest(*(F.struct(v.alias("z"), F.lit(c).alias("family")) for v, c in zip(z, classes)))
    scored = scored.withColumn("best", best).withColumn("total", sum((F.exp(v - F.col("best.z")) for v in z), F.lit(0.0)))
    scored = scored.withColumns({"probability": 1 / F.col("total"), "none": F.exp(z[-1] - F.col("best.z")) / F.col("total"), "family": F.col("best.family")})
    shapes = [{"family": f, "templates": [bits(sorted(set(words_of(t)) - STOP)) for t in TEMPLATES[f]]} for f in sorted(TEMPLATES)]
    scored = scored.join(F.broadcast(_constant(spark, shapes, "family string, templates array<array<bigint>>")), "family", "left")  # a row a family
    ones = lambda t, mask: sum((F.bit_count(mask(t, m)) for m in masks), F.lit(0))
    overlap = F.array_max(F.transform("templates", lambda t: ones(t, lambda t, m: t[m].bitwiseAND(F.col(f"b{m}"))) / ones(t, lambda t, m: t[m])))
    scored = scored.withColumn("overlap", F.coalesce(overlap, F.lit(0.0)))
    sure = ~F.col("family").isin("none", "unknown") & (F.col("probability") >= SURE) & (F.col("overlap") >= CONTAINED)
    named = F.when(F.col("paragraph").isNotNull() & (F.col("none") < SURE), F.when(sure, F.col("family")).when(F.col("lines") == 1, "unknown"))
    return scored.select("__row", "doc_id", "n_paragraphs", F.when(named.isNotNull(), F.col("paragraph")).alias("paragraph"), "lines", "length", named.alias("family"), F.when(named == "unknown", 1 - F.col("none")).otherwise(F.col("probability")).alias("probability"), "overlap")


def scan_licences(docs: DataFrame, text: str = "text", model: LicenceModel | None = None) -> DataFrame:
    """One row per document: doc_id, n_paragraphs, families (sorted, unknown among them) and licences: its licence paragraphs with their family, probability, overlap with the nearest template."""
    found = scan_paragraphs(docs, text, model)
    one = F.when(F.col("family").isNotNull(), F.struct("lines", "paragraph", "length", "family", F.round("probability", 6).alias("probability"), F.round("overlap", 6).alias("overlap")))
    spans = found.groupBy("__row").agg(F.first("doc_id").alias("doc_id"), F.first("n_paragraphs").alias("n_paragraphs"), F.array_sort(F.collect_list(one)).alias("found"))
    meet = lambda a, b: (a["paragraph"] < b["paragraph"] + b["lines"]) & (b["paragraph"] < a["paragraph"] + a["lines"])
    again = lambda kept, s: F.exists(kept, lambda a: (a["family"] == s["family"]) & meet(a, s))
    kept = F.aggregate(F.filter("found", lambda s: s["lines"] > 1), F.filter("found", lambda s: s["lines"] == 1), lambda kept, s: F.when(again(kept, s), kept).otherwise(F.concat(kept, F.array(s))))
    spans = spans.withColumn("kept", kept).withColumn("runs", F.filter("kept", lambda s: s["lines"] > 1))
    named = F.filter("kept", lambda s: (s["family"] != "unknown") | ~F.exists("runs", lambda r: meet(r, s)))
    licences = F.array_sort(F.transform(named, lambda s: F.struct(*(s[c].alias(c) for c in ("paragraph", "length", "family", "probability", "overlap")))))
    spans = spans.withColumn("licences", licences)
    return spans.select("doc_id", "n_paragraphs", F.array_sort(F.array_distinct(F.transform("licences", lambda s: s["family"]))).alias("families"), "licences")
