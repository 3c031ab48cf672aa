import itertools
import math
import re

import pytest

from tallyspark.llm.license_scan import BELIEVED, CONFIRMED, ENDING, FAMILIES, UNKNOWN, _grams, _words, confirming, notices, op2_license_scan, scan_licences, trained

# Wording that is in no form and no sentence that was learned, by family; lines are wrapped as they stand.
UNSEEN = {
    "mit": ["Released under the MIT License.", "This is MIT licensed software.", "/* code: mit license */", "All code here may be used under the MIT license.", "Code under MIT license terms, docs excluded."],
    "isc": ["ISC license applies to the files below.", "Released under the ISC License.", "Permission to use, copy, modify, and distribute this software\nfor any purpose with or without fee is hereby granted"],
    "epl": ["The code is EPL-2.0 licensed unless stated otherwise.", "Released under the Eclipse Public License 2.0.", "This work is licensed under the Eclipse Public License, version 2."],
    "boost": ["Released under the Boost Software License 1.0.", "Use, modification and distribution are subject to the\nBoost Software License, Version 1.0."],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0 (the License);", "Released under Apache 2.0.", "/* Licensed to the public under the Apache License 2.0 */"],
    "bsd": ["Released under the 3-clause BSD license.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "gpl-2.0": ["This work is licensed under the GNU General Public License, version 2.", "Free software under GPL version 2 or later."],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Released under the GPLv3.", "GPL-3.0 applies to all files here."],
    "lgpl": ["Released under the LGPL.", "This library is under the GNU Lesser General Public License, version 3."],
    "agpl-3.0": ["Released under the GNU Affero General Public License.", "This server is AGPLv3 software."],
    "mpl-2.0": ["Released under the Mozilla Public License 2.0.", "MPL-2.0 is the license of this code."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Text is available under the Creative Commons Attribution-ShareAlike License.", "Images are CC BY-SA 4.0."],
    "cc-by": ["This article is licensed under a Creative Commons Attribution 4.0 International License.", "The data are CC BY 4.0."],
    "cc0": ["Released into the public domain under CC0 1.0 Universal.", "Data: CC0-1.0"],
    "zlib": ["Released under the zlib license.", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software."],
    "unlicense": ["Released under the Unlicense.", "This software is free and unencumbered and released into the public domain."],
    "proprietary": ["All rights reserved.", "Copyright by the authors. All rights reserved.", "This document is proprietary and confidential."],
}
# Notices that were learned, wrapped over lines.
WRAPPED = [
    ("bsd", "Redistribution and use in source and binary forms, with or\nwithout modification, are permitted provided that the\nfollowing conditions are met:"),
    ("gpl-2.0", "# This program is free software; you can redistribute it and/or\n# modify it under the terms of the GNU General Public License\n# as published by the Free Software Foundation; either version 2\n# of the License, or (at your option) any later version."),
]
# Prose that has the words of notices.
PROSE = [
    "He showed his driving licence to the public officer.", "The MIT campus was open to visitors from the foundation.", "Version 3 of the software is free.", "We reserved two rooms with all rights to the pool.", "The library opened its doors to the general public.", "Apache is the name of a people and of a helicopter.",
    "A new BSD drive was sold.", "The terms of the loan are given below.", "She granted him permission to copy the key.", "The book was published under another title in 2010.", "Software of this kind is sold without any warranty in the shop.", "An eclipse was seen in public by many.", "The source of the river is free of charge.", "You may use the pool at any time.", "Creative people share a common language.",
    "The author of this work was born in 1950.", "They distribute food under the bridge.", "The mozilla of the story is a dragon.", "He has a license to fish.", "The boost was felt by all.",
]


def found(df):
    return sorted((r.doc_id, r.paragraph, r.family) for r in scan_licences(df).collect())


def test_unseen_wording_amid_prose(docs, prose):
    """Recall and precision of 0.9 or more on wording that was not learned, and on prose with a notice's words."""
    cases = [(f, t) for f, ts in UNSEEN.items() for t in ts]
    learned = {tuple(_words(t)) for ts in notices().values() for t in ts}
    assert not [t for _, t in cases if tuple(_words(t)) in learned]
    rows = [(i, prose(30, i) + ".\n" + t + "\n\n" + prose(20, i)) for i, (_, t) in enumerate(cases)] + [(1000 + i, prose(30, i) + ".\n" + t + "\n" + prose(20, i)) for i, t in enumerate(PROSE)]
    got = scan_licences(docs(rows)).collect()
    right = {r.doc_id for r in got if r.doc_id < 1000 and r.family == cases[r.doc_id][0]}
    missed = [c for i, c in enumerate(cases) if i not in right]
    print(f"recall {len(right)} of {len(cases)}, precision {len(right)} of {len(got)}", missed)
    assert len(right) >= 0.9 * len(cases), missed
    assert len(right) >= 0.9 * len(got), [(r.family, dict(rows)[r.doc_id]) for r in got if r.doc_id not in right]


def test_wrapped_notices(docs, prose):
    rows = [(i, prose(30, i) + ".\n\n" + t + "\n" + prose(5, i)) for i, (_, t) in enumerate(WRAPPED)]
    assert [(i, f) for i, _, f in found(docs(rows))] == [(i, f) for i, (f, _) in enumerate(WRAPPED)]


def brute(text):
    """(paragraph, family, probability, agreement) by the model's weights, paragraph by paragraph."""
    weights, bias = trained()
    out = []
    for n, p in enumerate(re.split(ENDING, text or "")):
        w = _words(p)
        z = bias + sum((weights[g] for g in _grams(w) if g in weights), 0 * bias)
        q = [math.exp(v - max(z)) / sum(math.exp(u - max(z)) for u in z) for v in z]
        best = max(range(len(q)), key=lambda k: (q[k], -k))
        mine = set(w) | set(itertools.pairwise(w))
        if not any(g in weights for g in _grams(w)) or FAMILIES[best] == UNKNOWN or q[best] < BELIEVED:
            continue
        templates = [set(x) | set(itertools.pairwise(x)) for x in map(_words, confirming(FAMILIES[best]))]
        part = max(len(mine & t) / max(1, min(len(mine), len(t))) for t in templates)
        if part >= CONFIRMED:
            out.append((n, FAMILIES[best], q[best], part))
    return out


def test_matches_brute_force(docs, prose):
    texts = [prose(20, k) + "\n" + t + "\n" + prose(5, k) for k, t in enumerate(t for ts in UNSEEN.values() for t in ts)] + PROSE + ["All rights reserved.\nAll rights reserved.\n\n\nMIT licensed.", "", None, "x\n\n", "\n\nreleased under GPLv3\n"]
    got = {(r.doc_id, r.paragraph): r for r in scan_licences(docs(list(enumerate(texts)))).collect()}
    want = {(i, n): rest for i, t in enumerate(texts) for n, *rest in brute(t)}
    assert got.keys() == want.keys()
    for k, (family, probability, part) in want.items():
        assert got[k].family == family and got[k].probability == pytest.approx(probability) and got[k].agreement == pytest.approx(part)


def test_notices(docs):
    rows = [(1, "Released under the MIT License."), (2, "code\nLICENSED UNDER THE APACHE LICENSE, VERSION 2.0.\nmore"), (3, "Licensed under CC BY-NC 4.0."), (4, "All rights reserved."), (5, "This work is licensed under the GNU General Public License, version 3.")]
    assert found(docs(rows)) == [(1, 0, "mit"), (2, 0, "apache-2.0"), (3, 0, "cc-by-nc"), (4, 0, "proprietary"), (5, 0, "gpl-3.0")]


def test_other_paragraphs_are_unknown(docs):
    rows = [(1, "He showed his driving licence to the public officer."), (2, "The MIT campus was open to visitors from the foundation."), (3, "Version 3 of the software is free."), (4, "We reserved two rooms with all rights to the pool.")]
    assert found(docs(rows)) == []


def test_training_repeats(docs):
    a = trained()
    trained.cache_clear()
    b = trained()
    assert a[0].keys() == b[0].keys() and (a[1] == b[1]).all()


def test_odd_rows(spark, odd, tmp_path):
    assert scan_licences(odd).count() == 0
    assert scan_licences(odd.limit(0)).count() == 0
    t = "Released under the MIT License."
    rows = spark.createDataFrame([(1, t, 0), (1, t, 0), (None, t, 1), (2, None, 2)], "doc_id long, text string, family int")
    got = scan_licences(rows).collect()
    assert sorted((str(r.doc_id), r.family) for r in got) == [("1", "mit"), ("None", "mit")]
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    per = op2_license_scan(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.n_licences, r.families) for r in per) == [("1", 1, "mit"), ("1", 1, "mit"), ("2", 0, ""), ("None", 1, "mit")]
