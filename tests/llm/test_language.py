"""Language identification against plain sums over segmentations."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterlake.llm import language
from rosterlake.llm.language import Pieces, default_path, fit, identify, language_predictions

DOC = "doc_id long, text string, lang string, score string, lang_pred int"


@pytest.fixture(scope="module")
def pieces():
    return Pieces(default_path())


def segmentations(word: bytes, names: dict[bytes, int], longest: int) -> list[list[int]]:
    if not word:
        return [[]]
    return [[names[word[:k]], *rest] for k in range(1, min(longest, len(word)) + 1) if word[:k] in names for rest in segmentations(word[k:], names, longest)]


def plain_forward(word: bytes, names: dict[bytes, int], longest: int, chance: np.ndarray) -> float:
    """The log of the sum over all segmentations of a word of any length, scaled at every byte."""
    held, total = [1.0], 0.0
    for i in range(1, len(word) + 1):
        a = sum(held[-k] * chance[names[word[i - k : i]]] for k in range(1, min(longest, i) + 1) if word[i - k : i] in names)
        total += math.log(a)
        held = [x / a for x in [*held, a][-longest:]]
    return total


def words_of(text: str) -> list[bytes]:
    return [b" " + w for w in text.lower().encode().split() if any(65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in w)]


def test_words_of_any_length_are_summed_whole(pieces):
    rng = random.Random(1)
    chance = np.random.default_rng(3).random((len(pieces), 2)) / len(pieces)
    names = {x: k for k, x in enumerate(pieces.names)}
    data = [b" " + x for x in (b"a" * 3000, b"the" * 500, "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(900)).encode(), b"internationalisation" * 30, b"x", b"\xff" * 90, b"for")]
    size = np.array([len(d) for d in data])
    flat, begin = np.frombuffer(b"".join(data), dtype=np.uint8), np.cumsum(size) - size
    got = pieces.forward(flat, begin, size, chance * (16.0**pieces.length)[:, None])
    for d, g in zip(data, got, strict=True):
        for k in range(2):
            assert g[k] == pytest.approx(plain_forward(d, names, pieces.longest, chance[:, k]), rel=1e-9)
    even = 16.0**pieces.length / len(pieces)
    counts = pieces.expected(flat, begin, size, np.eye(len(size)), even)
    assert (counts @ pieces.length).tolist() == pytest.approx(size.tolist())  # every byte of each is covered once


def test_fit_and_identify_equal_sums_over_all_segmentations(spark, pieces):
    texts = [(1, "the cat", "en"), (2, "der Hund 12", "de"), (4, "a THE the", "en"), (5, "und er", "de"), (6, "la vie", None), (7, None, "fr")]
    names = {x: k for k, x in enumerate(pieces.names)}
    counts = {}
    for _, text, lang in texts:
        if lang and text:
            own = counts.setdefault(lang, Counter())
            for w in words_of(text):
                found = segmentations(w, names, pieces.longest)
                weight = np.array([float(len(pieces)) ** -len(s) for s in found])
                for s, p in zip(found, weight / weight.sum(), strict=True):
                    own.update({k: 0 for k in s})
                    for k in s:
                        own[k] += p
    df = spark.createDataFrame([(*t, "x", 3) for t in texts], DOC)
    model = fit(df)
    assert model.languages == ["de", "en"]
    chance = {}
    for c, lang in enumerate(model.languages):
        want = np.full(len(pieces), 0.1)
        for k, n in counts[lang].items():
            want[k] += n
        chance[lang] = want / want.sum()
        assert np.allclose(model.chance[:, c], chance[lang], rtol=1e-9)
    asked = [(1, "the hund", None), (2, "er", None), (3, "12 !!", None), (4, "", None), (5, None, None), (6, "the", None), (6, "the", None)]
    got = sorted((r.doc_id, r.lang_pred, r.score) for r in identify(spark.createDataFrame([(*t, "x", 3) for t in asked], DOC), model).collect())
    want = []
    for k, text, _ in asked:
        logs = {lang: sum(plain_forward(w, names, pieces.longest, p) for w in words_of(text or "")) for lang, p in chance.items()}
        best = max(logs, key=logs.get)
        want.append((k, best, pytest.approx(1 / sum(math.exp(v - logs[best]) for v in logs.values()))) if words_of(text or "") else (k, "und", 0.0))
    assert got == sorted(want, key=lambda x: x[0])


def test_ties_go_to_the_first_language(spark):
    rows = [(1, "hello there", "zz"), (2, "hello there", "aa"), (4, "hello there", None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], DOC)
    assert {(r.lang_pred, r.score) for r in identify(df, fit(df)).collect()} == {("aa", 0.5)}


def test_held_out_rows_teach_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = [r.doc_id for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    changed = docs.withColumn("lang", F.when(F.col("doc_id").isin(held), F.lit("xx")).otherwise(F.col("lang")))
    assert sorted(map(tuple, language_predictions(docs).collect())) == sorted(map(tuple, language_predictions(changed).collect()))


def test_word_types_count_equal_words_once():
    data = np.frombuffer("one 12 ONE two ... one".encode(), dtype=np.uint8)
    flat, at, size, row, which = language._word_types(data, np.array([0, len(data)]))
    assert sorted(flat[a : a + n].tobytes() for a, n in zip(at, size, strict=True)) == [b" one", b" two"]
    assert len(row) == 4 and sorted(np.bincount(which).tolist()) == [1, 3]
