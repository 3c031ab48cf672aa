"""Operator 2: licence families of paragraphs, by a trained classifier and a comparison with templates."""

from __future__ import annotations

import itertools
import re
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, LOWER, Carried, documents

# By family, the names that notices give a licence.  The forms of notices are in `FORMS`.
NAMES = {
    "agpl-3.0": ["GNU Affero General Public License", "GNU AGPL", "AGPL-3.0", "AGPLv3", "GNU Affero General Public License version 3"],
    "apache-2.0": ["Apache License", "Apache 2.0", "Apache-2.0", "Apache License 2.0", "Apache License, Version 2.0", "ASL 2.0"],
    "boost": ["Boost Software License", "BSL-1.0", "Boost Software License, Version 1.0", "Boost License"],
    "bsd": ["BSD License", "BSD-3-Clause", "BSD-2-Clause", "3-clause BSD license", "2-clause BSD license", "new BSD license", "BSD-style license"],
    "cc-by": ["CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License", "CC BY 3.0"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike License"],
    "cc-by-sa": ["CC BY-SA 4.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike License", "CC BY-SA 3.0"],
    "cc0": ["CC0", "CC0 1.0 Universal", "CC0-1.0", "Creative Commons Zero", "CC0 public domain dedication"],
    "epl": ["Eclipse Public License", "EPL-2.0", "Eclipse Public License 2.0", "EPL 1.0", "Eclipse Public License v2.0"],
    "gpl-2.0": ["GNU General Public License version 2", "GPLv2", "GPL-2.0", "GPL version 2", "GPL-2.0-or-later", "GNU GPL v2", "GNU General Public License, version 2"],
    "gpl-3.0": ["GNU General Public License version 3", "GPLv3", "GPL-3.0", "GPL version 3", "GPL-3.0-or-later", "GNU GPL v3", "GNU General Public License, version 3"],
    "isc": ["ISC License", "ISC", "ISC licence", "Internet Systems Consortium License"],
    "lgpl": ["GNU Lesser General Public License", "LGPL", "LGPL-2.1", "GNU LGPL", "LGPLv3", "GNU Library General Public License", "GNU Lesser General Public License version 2.1"],
    "mit": ["MIT License", "MIT", "MIT licence", "Expat License", "MIT/X11 license"],
    "mpl-2.0": ["Mozilla Public License", "MPL-2.0", "MPL 2.0", "Mozilla Public License Version 2.0", "Mozilla Public License 2.0"],
    "unlicense": ["Unlicense", "The Unlicense", "Unlicense (public domain)"],
    "wtfpl": ["WTFPL", "Do What The Fuck You Want To Public License", "WTFPL version 2"],
    "zlib": ["zlib License", "Zlib", "zlib/libpng license"],
    "proprietary": [],
}
# Forms of notices that name a licence.
FORMS = [
    "Distributed under the {}.", "{} licensed.", "SPDX-License-Identifier: {}", "License: {}", "This file is part of a project under the {}.", "Licensed under the terms of the {}.", "This software is licensed under the {}, see LICENSE.",
    "You may use this code under the {}.", "Available under the {}; see the file COPYING.", "The source code is made available under {} terms.", "This package is free software and may be copied under the {}.", "Published under {}.",
    "Use of this work is governed by the {}.", "Copyright (c) 2020 The Authors. Licensed under {}.", "The content of this page is under the {}.", "Its license is the {}.", "Subject to the {}, a copy of which comes with this file.", "Covered by the {} or any later version.",
]
# Names that mean other things as well, and what they stand beside in a notice.
AMBIGUOUS = ["MIT", "ISC", "Zlib"]
BESIDE = ["{} licensed", "{} license", "license {}", "identifier {}", "licensed under {}"]
# Sentences of the licences and notices themselves.
TEXTS = {
    "agpl-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "You should have received a copy of the GNU Affero General Public License along with this program."],
    "apache-2.0": ["you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "See the License for the specific language governing permissions and limitations under the License."],
    "boost": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."],
    "cc-by": ["You are free to share and adapt the material for any purpose, even commercially, under the following terms: Attribution"],
    "cc-by-nc": ["You may not use the material for commercial purposes. Attribution-NonCommercial"],
    "cc-by-sa": ["If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original. ShareAlike"],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License which accompanies this distribution"],
    "gpl-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston"],
    "gpl-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE"],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "wtfpl": ["Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."],
    "zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.", "This notice may not be removed or altered from any source distribution."],
    "proprietary": ["Copyright 2019 by the company. All rights reserved.", "All rights reserved worldwide.", "Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.", "No part of this publication may be reproduced or transmitted in any form without the prior written permission of the publisher.", "This software is the confidential and proprietary information of the company.", "All rights are reserved by the owner."],
}


def notices() -> dict[str, list[str]]:
    """The notices of each family that are learned from: its own sentences, and each of its names in each form."""
    return {f: [*TEXTS[f], *(form.format(name) for name in NAMES[f] for form in FORMS)] for f in NAMES}


# Paragraphs of no licence.
OTHERS = [
    "The driver showed his license to the officer and went on.", "You need a fishing licence for this river.", "The school was granted a licence to teach in the city.",
    "She reserved a table for the evening.", "All seats are reserved for members.", "Civil rights were debated in the parliament.", "Human rights and public law are taught in the first year.",
    "The public library opens at nine.", "The general public was not admitted.", "The software was updated last week.", "This work took three years to complete.", "Version 2.0 brings a new menu.",
    "Version 3 of the report was sent to the office.", "The course is free of charge.", "Please read the terms and the conditions of sale.", "No warranty is given for used cars.", "The works were published by the foundation in two volumes.",
    "He released the ball under the arch.", "The film was released under another title.", "The commons are open to everyone.", "Creative writing is taught on Mondays.", "It is distributed by mail and by hand.",
    "The source of the river is in the mountains.", "A binary star has two components.", "The copyright debate went on for years.", "They obtained a copy of the letter.", "The following list has all the names of the contributors.",
    "Permission to enter was granted by the guard.", "The law of the sea applies in writing.", "The author waived the fee.", "In the beginning of the year it was cold and the snow was deep.", "That is what they said to him and to her at the time.",
    "The licence plate was stolen.", "Your copy of the book is at the desk.", "A public domain of science is the weather.", "The general was a man of the public.", "Under the terms of the treaty the war ended.", "They distributed the food under the trees.", "Terms and conditions apply to this offer.",
    "The software is provided by the school.", "See the file on the table.", "The mit in the drawer is old.", "The boost in sales was small.", "An eclipse of the sun is seen in public.", "A version of this story was published in 2020.", "The authors of the study are named below.", "Free software was the theme of the talk.", "The foundation published a general report.", "The code of the door is on the page.", "All the material is used in the course.",
    "For any purpose of this kind there is a better tool.", "It may be that the rest is of use to someone.", "The apache helicopters flew over the mit campus.", "The domain was sold to a public company.",
]
# Words that say nothing by themselves.
STOP = "a an and any are as at be by for from has have if in is it its of on one or such that the their they this to was were which with you".split()
UNKNOWN = "unknown"
FAMILIES = [*NAMES, UNKNOWN]
#: Characters that part words besides white space.
PARTING = ".,;:!?()[]{}<>\"'`/\\|-_*#&%$@+=~"
#: Probability from which a family is believed, part of the paragraph's or template's word pairs that must agree,
#: weights below which an n-gram is dropped.
BELIEVED, CONFIRMED, KEPT = 0.5, 0.6, 0.05
SEED = 42
#: What ends a paragraph: a blank line, or a line's end behind a sentence's.
ENDING = r"(?<=[.!?:;)\"])[\x20\x09\x0B-\x0D]*\n|\n(?=[\x20\x09\x0B-\x0D]*\n)"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _hash(word: str) -> int:
    return _signed(xxhash.xxh64_intdigest(word.encode(), SEED))


def _hash_pair(a: str, b: str) -> int:
    """As xxhash64(xxhash64(a), xxhash64(b)) in SQL: the hash of the one seeds that of the other."""
    first = xxhash.xxh64_intdigest(_hash(a).to_bytes(8, "little", signed=True), SEED)
    return _signed(xxhash.xxh64_intdigest(_hash(b).to_bytes(8, "little", signed=True), first))


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(" " if c in PARTING else c for c in text.translate({ord(a): b for a, b in zip(UPPER, LOWER, strict=True)}))) if w]


def _grams(found: list[str]) -> set[tuple[str, ...]]:
    """Words and pairs of words, those without any but stop words left out."""
    every = [(w,) for w in found] + list(itertools.pairwise(found))
    return {g for g in every if any(w not in STOP for w in g)}


#: Steps of the training, rows made of each notice, the part of the notices that is held back for the calibration.
STEPS, VARIANTS, HELD = 250, 3, 4


@lru_cache
def trained() -> tuple[dict[tuple[str, ...], np.ndarray], np.ndarray]:
    """Weights of each n-gram and the bias, for every family: multinomial logistic regression.

    The rows are the notices and other paragraphs, each as it is, with words left out, and amid others' words.  Every fourth notice is held
    back with all its rows, and the temperature that suits those best is divided out of the weights, so that the probabilities, that of the
    unknown class among them, are calibrated on wording that was not learned.  Small weights are dropped.  A function of the fixed values alone.
    """
    rng = np.random.default_rng(SEED)
    other_words = [w for t in OTHERS for w in _words(t)]
    rows: list[tuple[set, int, bool]] = []
    known = notices()
    for k, f in enumerate(FAMILIES):
        some = list(rng.permutation(known.get(f, OTHERS)))
        for i, t in enumerate(some):
            base = _words(t)
            for n in range(VARIANTS if f in known else 4 * VARIANTS):
                w = [x for x in base if not n or rng.random() > 0.1]
                if n % 3 == 2 or (f not in known and n % 2):
                    extra = list(rng.choice(other_words, rng.integers(3, 15)))
                    w = w + extra if rng.random() < 0.5 else extra + w
                rows.append((_grams(w), k, i % HELD == HELD - 1))
    names = sorted({g for x, _, held in rows for g in x if not held})
    at = {g: i for i, g in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1), np.float32)
    for i, (g, _, _) in enumerate(rows):
        x[i, [at[n] for n in g if n in at]] = 1
        x[i, -1] = 1
    y = np.eye(len(FAMILIES), dtype=np.float32)[[k for _, k, _ in rows]]
    fold = np.array([held for *_, held in rows])
    w = np.zeros((x.shape[1], y.shape[1]), np.float32)
    learn, want = np.ascontiguousarray(x[~fold]), y[~fold]
    turned = np.ascontiguousarray(learn.T)
    weigh = 1 / np.sqrt(want.sum(0)[want.argmax(1)])
    weigh /= weigh.mean()
    for step in range(STEPS):
        z = learn @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = turned @ ((p - want) * weigh[:, None]) / len(p)
        w -= 8.0 / (1 + step / 100) * g
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - 1e-4, 0)
    w = w.astype(float)
    w[:-1][np.abs(w[:-1]) < KEPT] = 0
    z = x[fold] @ w

    def loss(t: float) -> float:
        q = z / t
        return float(-(y[fold] * (q - np.log(np.exp(q - q.max(1, keepdims=True)).sum(1, keepdims=True)) - q.max(1, keepdims=True))).sum())

    w /= min(np.linspace(0.3, 3, 28), key=loss)
    return {g: w[i] for g, i in at.items() if np.abs(w[i]).any()}, w[-1]


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(`id_col`, `paragraph`, `family`, `probability`, `agreement`): the paragraphs that state a licence.

    A paragraph ends at a blank line, and at the end of a line that ends a sentence (`ENDING`); so a notice that is wrapped over lines is one paragraph, and one
    that stands alone in a line of prose is one, too.  `paragraph` counts them from 0.  A-Z are lower-cased, punctuation parts words.  A paragraph's n-grams (words and pairs) are exploded as
    hashes and met with the model's, a table of fixed size; what meets is summed by paragraph.  The
    likeliest family is taken if it isn't the unknown class and has a probability of `BELIEVED` (of equal ones the first of `FAMILIES`), and if a
    template confirms it: of the words and word pairs of a sentence of the licence or of one of its names, or of the paragraph if that is shorter, `CONFIRMED` must be
    in the other.  A paragraph of several licences has one of them.

    Null and empty texts have no licences, nor has an empty table.  Repeated rows count once.  Rows with a null id take part.  Long texts are scanned whole.
    Only the two columns named are read; texts are never shuffled, only lines that share an n-gram with the model.
    """
    c = Carried(docs)
    spark = docs.sparkSession
    weights, bias = trained()
    n = len(FAMILIES)
    model = spark.createDataFrame([(_hash(g[0]) if len(g) == 1 else _hash_pair(*g), [float(x) for x in w]) for g, w in weights.items()], "gram long, w array<double>")
    lines = c.df.select(c.col(id_col).alias("id"), F.posexplode(F.split(c.col(text_col), ENDING)).alias("paragraph", "line"))
    flat = F.translate("line", UPPER + PARTING, LOWER + " " * len(PARTING))
    hashes = lines.select("id", "paragraph", F.transform(F.filter(F.split(flat, r"[\x20\x09-\x0D]+"), lambda x: x != ""), lambda x: F.xxhash64(x)).alias("h"))
    pairs = _pairs(F.col("h"))
    grams = hashes.where(F.size("h") > 0).select("id", "paragraph", "h", F.explode(F.array_distinct(F.concat("h", pairs))).alias("gram"))
    met = grams.join(F.broadcast(model), "gram")
    # A repeated row sums up once more.  Each of its n-grams comes once a row, so the count of any one is that of the rows.
    rows = F.count("*") / F.count_distinct("gram")
    sums = [(F.sum(F.get("w", k)) / rows).alias(f"s{k}") for k in range(n)]
    met = met.groupBy("id", "paragraph", "h").agg(*sums)
    met = met.withColumn("scores", F.array(*[F.col(f"s{k}") + float(bias[k]) for k in range(n)])).withColumn("family", F.element_at(F.array(*map(F.lit, FAMILIES)), F.array_position("scores", F.array_max("scores")).cast("int")))
    met = met.withColumn("probability", 1 / F.aggregate("scores", F.lit(0.0), lambda acc, s: acc + F.exp(s - F.array_max("scores"))))
    met = met.where((F.col("family") != UNKNOWN) & (F.col("probability") >= BELIEVED))
    mine = F.array_distinct(F.concat("h", _pairs(F.col("h"))))
    told = met.withColumn("mine", mine).join(F.broadcast(spark.createDataFrame(_templates(), "family string, template array<long>")), "family")
    told = told.withColumn("part", F.size(F.array_intersect("mine", "template")) / F.greatest(F.lit(1), F.least(F.size("mine"), F.size("template"))))
    out = told.groupBy("id", "paragraph", "h", "family", "probability").agg(F.max("part").alias("agreement")).where(F.col("agreement") >= CONFIRMED)
    return out.select(F.col("id").alias(id_col), "paragraph", "family", "probability", "agreement").distinct()


def confirming(family: str) -> list[str]:
    """What a paragraph of the family is compared with: sentences and names; a name that is a word of other meanings goes with one of licences."""
    names = [form.format(n) if n in AMBIGUOUS else n for n in NAMES[family] for form in (BESIDE if n in AMBIGUOUS else ("{}",))]
    return [*TEXTS[family], *names]


def _templates() -> list[tuple[str, list[int]]]:
    """(family, words and word pairs) of the licences' sentences and names."""
    out = []
    for f in NAMES:
        for t in confirming(f):
            found = _words(t)
            out.append((f, sorted({_hash(w) for w in found} | {_hash_pair(*x) for x in itertools.pairwise(found)})))
    return out


def _pairs(h: Column) -> Column:
    none = F.array().cast("array<long>")
    return F.when(F.size(h) < 2, none).otherwise(F.transform(F.sequence(F.lit(0), F.size(h) - 2), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1))))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, with its number of licence paragraphs, their families and the least probability."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = scan_licences(docs).groupBy(F.col("doc_id").alias("id")).agg(
        F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"), F.min("probability").alias("probability")
    )
    rows = docs.select("doc_id").join(found, F.col("doc_id").eqNullSafe(F.col("id")), "left")
    return rows.select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_licences"), F.coalesce("families", F.lit("")).alias("families"), F.coalesce("probability", F.lit(0.0)).alias("probability"))
