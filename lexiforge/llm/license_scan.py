"""Licence scans by a trained paragraph classifier.

A paragraph is a line, since notices stand in single lines of a text as often as in blocks of
their own; those of a notice that is wrapped over several lines are recognised one by one. Paragraphs are
sparse bags of hashed word 1- and 2-grams. A multinomial logistic regression, fitted to whole and
wrapped templates of licence families and a bounded sample of the corpus's other
paragraphs, tells families and an unknown class apart; a temperature fitted on data left
out calibrates it. A prediction counts only if the paragraph also compares well with a
template of its family.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, batch, chunks, mixed, releasing, running, span_hash, words

# Public licence notices and their usual short forms, by family.
TEMPLATES = {
    "mit": [
        "MIT License", "The MIT License (MIT)", "SPDX-License-Identifier: MIT", "Released under the MIT License.", "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "apache-2.0": [
        "Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0", "Licensed under the Apache License, Version 2.0.", "Released under the Apache 2.0 license.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ],
    "gpl": [
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "GNU Lesser General Public License", "GNU Affero General Public License", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-2.0-only",
        "Published under the GPL v3.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License version 2 or later.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    ],
    "bsd": [
        "BSD 3-Clause License", "BSD 2-Clause License", "SPDX-License-Identifier: BSD-3-Clause", "Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "mpl": [
        "Mozilla Public License Version 2.0", "SPDX-License-Identifier: MPL-2.0", "Licensed under the Mozilla Public License 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "isc": [
        "ISC License", "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "public-domain": [
        "SPDX-License-Identifier: Unlicense", "SPDX-License-Identifier: CC0-1.0", "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "cc": [
        "Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0.", "Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Published under the Creative Commons Attribution-ShareAlike license.",
        "You are free to share, copy and redistribute the material in any medium or format, and to adapt, remix, transform, and build upon the material for any purpose, under the following terms: you must give appropriate credit, provide a link to the license, and indicate if changes were made.",
    ],
    "proprietary": [
        "All rights reserved.", "Copyright 2020 the authors. All rights reserved.", "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means, including photocopying, recording, or other electronic or mechanical methods, without the prior written permission of the publisher.",
    ],
}
FAMILIES = ["unknown", *TEMPLATES]
BITS = 14
_CLEAN = LOWER.copy()
_CLEAN[[b for b in range(33, 128) if not chr(b).isalnum()]] = 32


def grams(column: pa.Array):
    """For runs of texts: (first row, feature ids, paragraph bounds in them, text and line of each paragraph with words)."""
    for row, data, off in chunks(column):
        data = _CLEAN[data]
        start, end, doc = words(data, off)
        n = len(start)
        if not n:
            continue
        breaks = np.concatenate([[0], np.cumsum(data == 10, dtype=np.int64)])
        line = breaks[start] - breaks[off[doc]]
        new = np.ones(n, bool)
        new[1:] = (doc[1:] != doc[:-1]) | (line[1:] != line[:-1])
        h = span_hash(running(data), start, end)
        two = np.zeros(n, np.uint64)
        two[1:] = mixed(h[:-1] * np.uint64(3) + h[1:])
        two[new] = mixed(h[new])  # a paragraph's first word, marked as such
        ids = np.empty((n, 2), np.int64)
        ids[:, 0], ids[:, 1] = h >> np.uint64(64 - BITS), two >> np.uint64(64 - BITS)
        edge = np.flatnonzero(new)
        yield row, ids.reshape(-1), np.append(edge, n) * 2, doc[edge], line[edge]


class Model:
    def __init__(self, weights, bias, temperature, templates):
        self.weights, self.bias, self.temperature, self.templates = weights, bias, temperature, templates

    def logits(self, ids: np.ndarray, bound: np.ndarray) -> np.ndarray:
        size = np.diff(bound)
        return np.add.reduceat(self.weights[ids], bound[:-1], axis=0) / np.sqrt(size)[:, None] + self.bias

    def probabilities(self, ids, bound) -> np.ndarray:
        e = self.logits(ids, bound) / self.temperature
        e = np.exp(e - e.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def likeness(self, family: int, ids: np.ndarray) -> float:
        """How like the paragraph is to a template of the family, at best: a share of 1- and 2-grams in common.

        Of a template of at least ``LEAST`` grams: the share of it that the paragraph holds; of a shorter one, such as
        a bare title: the share of the larger of the two. Of a paragraph of at least ``LEAST``: also
        the share of it that the template holds, as a wrapped notice's lines are parts of it.
        """
        s, best = set(ids.tolist()), 0.0
        for t in self.templates[family]:
            both = len(s & t)
            best = max(best, both / (len(t) if len(t) >= LEAST else max(len(s), len(t))), both / len(s) if len(s) >= LEAST else 0.0)
        return best


#: Grams (about two a word) from which on one side may be a part of the other.
LEAST = 10


def _bags(texts: list[str]) -> list[np.ndarray]:
    out = [np.zeros(0, np.int64)] * len(texts)
    for row, ids, bound, doc, _ in grams(pa.array([t.replace("\n", " ") for t in texts], pa.string())):
        for i, d in enumerate(doc):
            out[row + d] = ids[bound[i] : bound[i + 1]]
    return out


def fit(others: list[str], rounds: int = 40, rate: float = 0.5, copies: int = 24, seed: int = 11) -> Model:
    """Learn families from the templates, varied by lost and added words and by wrapping, against paragraphs of no licence."""
    rng = np.random.default_rng(seed)
    texts, label = [], []
    pool = [w for t in others[:500] for w in t.split()][:5000] or ["the"]
    some = lambda least, most: [str(x) for x in rng.choice(pool, int(rng.integers(least, most)))]
    for k, ts in enumerate(TEMPLATES.values(), 1):
        for t in ts:
            for c in range(copies):
                w = t.split()
                if len(w) > 14 and c % 2:  # a line of the wrapped notice
                    a = int(rng.integers(0, len(w) - 7))
                    w = w[a : a + int(rng.integers(7, 18))]
                if c:
                    w = [x for x in w if rng.random() > 0.08 * (len(w) > 5)] or w
                    if c % 3 == 0:
                        w = some(1, 8) + w
                    if c % 3 == 1:
                        w = w + some(1, 8)
                texts.append(" ".join(w))
                label.append(k)
    every = [w for ts in TEMPLATES.values() for t in ts for w in t.split()]
    mixed_up = [" ".join([*(str(x) for x in rng.choice(every, int(rng.integers(1, 4)))), *some(4, 30)]) for _ in range(600)]
    # Words of licences in another order are no licence.
    mixed_up += [" ".join(str(x) for x in rng.choice(every, int(rng.integers(3, 16)))) for _ in range(300)]
    texts += others + mixed_up
    label += [0] * (len(others) + len(mixed_up))
    bags = _bags(texts)
    ok = [i for i, b in enumerate(bags) if len(b)]
    bags, y = [bags[i] for i in ok], np.array(label)[ok]
    aside = rng.random(len(bags)) < 0.2
    w, b, g = np.zeros((1 << BITS, len(FAMILIES))), np.zeros(len(FAMILIES)), np.full((1 << BITS, 1), 1e-2)
    train = np.flatnonzero(~aside)
    for _ in range(rounds):
        order = rng.permutation(train)
        for i in range(0, len(order), 256):
            pick = order[i : i + 256]
            ids, bound = _joined(bags, pick)
            p = Model(w, b, 1.0, None).probabilities(ids, bound)
            p[np.arange(len(pick)), y[pick]] -= 1
            size = np.diff(bound)
            d = np.repeat(p / np.sqrt(size)[:, None], size, axis=0) / 16
            # Only the grams of these paragraphs move.
            o = np.argsort(ids, kind="stable")
            edge = np.flatnonzero(np.append(True, np.diff(ids[o]) != 0))
            at, grad = ids[o][edge], np.add.reduceat(d[o], edge, axis=0)
            g[at] += (grad**2).sum(1, keepdims=True)
            w[at] -= rate * grad / np.sqrt(g[at])
            b -= 0.02 * p.mean(0)
    ids, bound = _joined(bags, np.flatnonzero(aside))
    losses = []
    for t in (grid := np.geomspace(0.3, 4, 25)):
        p = Model(w, b, t, None).probabilities(ids, bound)
        losses.append(-np.log(np.maximum(p[np.arange(len(p)), y[aside]], 1e-9)).mean())
    model = Model(w.astype(np.float32), b, float(grid[int(np.argmin(losses))]), _template_sets())
    model.losses = dict(zip(grid.tolist(), losses))  # by temperature, on what was left out
    return model


def _template_sets() -> list[list[set]]:
    return [[], *[[set(x.tolist()) for x in _bags(ts)] for ts in TEMPLATES.values()]]


def _joined(bags, pick):
    bound = np.concatenate([[0], np.cumsum([len(bags[i]) for i in pick])])
    return np.concatenate([bags[i] for i in pick]), bound


#: Words of a sampled paragraph: of a longer one a stretch from anywhere in it teaches the unknown class.
STRETCH = 200


def _plain_paragraphs(docs: DataFrame, sample: int, text_col: str) -> list[str]:
    """A sample, bounded and by hash, of the paragraphs of all whole texts, without those that are like a template.

    Paragraphs that only speak of licences stay: the unknown class has to know them.
    """
    text = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("t"))
    lines = text.agg(F.sum(F.regexp_count("t", F.lit("\n")) + 1)).first()[0] or 0
    p = text.select(F.explode(F.split("t", "\n")).alias("p")).where(F.pmod(F.xxhash64("p"), F.lit(max(1, lines // (4 * sample)))) == 0)
    words_of = F.split(F.trim("p"), r"[\x20\x09-\x0D]+")
    start = F.pmod(F.xxhash64("p", F.lit(1)), F.greatest(F.size("w") - STRETCH, F.lit(1))).cast("int") + 1
    p = p.where("length(trim(p)) > 0").distinct().withColumn("w", words_of).select("p", F.array_join(F.slice("w", start, STRETCH), " ").alias("s"))
    some = [r["s"] for r in p.select(F.xxhash64("p").alias("h"), "s").orderBy("h", "s").limit(sample).collect()]
    model = Model(None, None, 1.0, _template_sets())
    like = lambda ids: len(ids) and max(model.likeness(k, ids) for k in range(1, len(FAMILIES))) >= 0.4
    return [t for t, ids in zip(some, _bags(some)) if not like(ids)]


_FOUND = pa.schema([("id", pa.int64()), ("n_paragraphs", pa.int64()), ("found", pa.list_(pa.struct([
    ("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("likeness", pa.float64())])))])


def scan_licenses(docs: DataFrame, sample: int = 3000, probability: float = 0.5, likeness: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: the id, ``n_paragraphs`` (lines with words) and ``found``, its licence paragraphs.

    ``found`` lists (paragraph, family, probability, likeness), by line number, for paragraphs whose
    calibrated probability of a family is at least ``probability`` and whose
    ``Model.likeness`` to a template of that family is at least ``likeness``. ``sample`` bounds the
    corpus paragraphs that the unknown class is learnt from; all whole texts are scanned.
    Null or empty text: no paragraphs. Null and repeated ids: each row on its own. Empty input: no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(_plain_paragraphs(docs, sample, text_col)))

    def run(batches):
        model = shared.value
        for b in batches:
            count, found = np.zeros(b.num_rows, np.int64), [[] for _ in range(b.num_rows)]
            for row, ids, bound, doc, line in grams(b.column(1)):
                count += np.bincount(row + doc, minlength=b.num_rows)
                p = model.probabilities(ids, bound)
                best = p.argmax(1)
                for i in np.flatnonzero((best > 0) & (p.max(1) >= probability)):
                    like = model.likeness(int(best[i]), ids[bound[i] : bound[i + 1]])
                    if like >= likeness:
                        found[row + doc[i]].append({"paragraph": int(line[i]), "family": FAMILIES[best[i]], "probability": round(float(p[i].max()), 6), "likeness": round(like, 6)})
            yield batch({"id": b.column(0).cast(pa.int64()), "n_paragraphs": count, "found": found}, _FOUND)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(releasing(run), "id long, n_paragraphs long, found array<struct<paragraph int, family string, probability double, likeness double>>")
    return out.withColumnRenamed("id", id_col)
