
from __future__ import annotations

import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from rosterlake.llm import decontaminate, kernels, license_scan, substring_dedup

SF = "/root/testdata/sf0.001"


def test_row_repeated_in_one_partition_keeps_its_text(spark):
    rng = random.Random(8)
    text, other = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(80)) for _ in range(2))
    rows = [(1, text), (2, other), (1, text), (3, other)]
    for parts in (1, 3):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = sorted((r.doc_id, r.text) for r in substring_dedup.substring_dedup(docs).collect())
        assert [g for g in got if g[0] == 1] == [(1, text), (1, text)]
        assert sorted(len(t) for k, t in got if k != 1)[1] == len(other)  # of two documents one keeps the text


def test_passages_of_51_words_are_found():
    rng = random.Random(9)
    words = [w for r in pq.read_table(f"{SF}/documents.parquet", columns=["text"]).column(0).to_pylist() for w in (r or "").split()]
    kept = []
    for _ in range(3000):
        passage = rng.choices(words, k=51)
        before = [rng.choices(words, k=20) for _ in range(2)]
        data = [np.frombuffer(" ".join([*b, *passage, *rng.choices(words, k=20)]).encode(), dtype=np.uint8) for b in before]
        (one, _, _), (two, start, end) = map(substring_dedup.chunks, data)
        at = len((" ".join(before[1]) + " ").encode())
        left = np.ones(len(" ".join(passage).encode()), dtype=bool)
        for a, b in zip(start[np.isin(two, one)] - at, end[np.isin(two, one)] - at, strict=True):
            left[max(a, 0) : max(b, 0)] = False
        kept.append(left.mean())
    assert max(kept) < 0.5 and np.mean(kept) < 0.12


def edited(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        at = rng.randrange(len(w))
        w[at : at + rng.choice([0, 1, 1])] = [f"edit{rng.random()}"] * rng.choice([0, 1])
    return w


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 16, 20, 24, 25, 32, 45, 59])
def test_leaks_recall_of_each_length_at_all_allowed_edits(n):
    rng = random.Random(n)
    words = [w for r in pq.read_table(f"{SF}/documents.parquet", columns=["text"]).column(0).to_pylist() for w in (r or "").split()]
    hashes = lambda ws: kernels.words(d := np.frombuffer(" ".join(ws).encode(), dtype=np.uint8), np.array([0, len(d)]))[0]
    items = [rng.choices(words, k=n) for _ in range(250)]
    index = decontaminate.Index([(k, hashes(i)) for k, i in enumerate(items)])
    found = 0
    for k, item in enumerate(items):
        doc = hashes(rng.choices(words, k=40) + edited(rng, item, int(0.2 * n + 1e-9)) + rng.choices(words, k=40))
        found += (0, k) in index.matches(doc, np.zeros(len(doc), dtype=np.int64))
    assert found / len(items) >= (1.0 if n < 5 else 0.95), found / len(items)


GPL = """    This program is free software{0} you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation{1} either version {2} of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */
"""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


def test_wrapped_licence_texts(spark):
    texts = {"GPL-3.0-or-later": GPL.format(":", ",", 3), "GPL-2.0-or-later": GPL.format(";", ";", 2), "MPL-2.0": MPL, "MIT": MIT, "BSD-3-Clause": BSD, "LicenseRef-All-Rights-Reserved": "Some prose here\nAll rights reserved.\n"}
    rows = [(n, form(t)) for n, t in texts.items() for form in (str, lambda t: t.replace("\n", "\r\n"), lambda t: "Prose before\n" + t + "prose after")]
    docs = spark.createDataFrame([*rows, ("none", "the mit\nlicense of this")], "doc_id string, text string")
    got = sorted((r.doc_id, r.primary_licence) for r in license_scan.licence_scan(docs).collect())
    assert got == sorted((n, n) for n, _ in rows)
