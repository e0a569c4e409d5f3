"""Typos by deletion neighbourhoods against all pairs."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from rosterlake.operators import typos


def distance(a, b):
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def changed(rng, w):
    k = rng.randrange(len(w))
    return rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abc") + w[k:], w[:k] + rng.choice("abc") + w[k + 1 :], w[:k] + w[k + 1 : k + 2] + w[k : k + 1] + w[k + 2 :]])


def test_distance(spark):
    rng = random.Random(3)
    pairs = [("", ""), ("a", ""), ("", "ab"), ("ca", "abc"), ("ab", "ba")]
    pairs += [("".join(rng.choice("abc") for _ in range(rng.randrange(9))), "".join(rng.choice("abc") for _ in range(rng.randrange(9)))) for _ in range(200)]
    rows = spark.createDataFrame([(*p,) for p in pairs], "a string, b string").select("a", "b", typos.edit_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert [(r.a, r.b, r.d) for r in rows] == [(a, b, distance(a, b)) for a, b in pairs]


def test_deletions(spark):
    got = spark.range(1).select(typos.deletions(F.lit("abc"), 2).alias("x"), typos.deletions(F.lit(""), 2).alias("y"), typos.deletions(F.lit("a"), 2).alias("z")).first()
    assert sorted(got.x) == ["a", "ab", "abc", "ac", "b", "bc", "c"] and got.y == [""] and sorted(got.z) == ["", "a"]


def test_corrections_equal_all_pairs_on_ten_thousand_words(spark):
    rng = random.Random(8)
    make = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    terms = sorted({make(rng.randrange(8, 13)) for _ in range(60)})
    words = {make(rng.randrange(1, 13)) for _ in range(9500)} | {changed(rng, t) for t in terms for _ in range(6)} | {changed(rng, changed(rng, t)) for t in terms for _ in range(6)} | set(terms[:5])
    frame = spark.createDataFrame([(w,) for w in [*words, None, "", terms[0].upper()]], "word string").repartition(4)
    dictionary = spark.createDataFrame([(t, i) for i, t in enumerate(terms)], "term string, rank int")

    def allowed(w, t):
        most = max(len(w), len(t))
        return min(2 if most >= 11 else 1, int(most * 0.2)) if w[:1] == t[0] and w[-1:] == t[-1] and len(w) >= 8 else 0

    want = {}
    for w in words - set(terms):
        near = [(d, i, t) for i, t in enumerate(terms) if abs(len(w) - len(t)) <= 2 and (a := allowed(w, t)) and (d := distance(w, t)) <= a]
        if near:
            want[w] = min(near)[2:] + min(near)[:1]
    got = {r.word: (r.term, r.distance) for r in typos.corrections(frame, dictionary).collect()}
    assert got == want and len(want) > 100


def test_no_word_meets_all_terms(spark):
    """The join gives candidates in proportion to matches, not words times terms."""
    frame = spark.createDataFrame([(f"x{k:07d}y",) for k in range(2000)], "word string")
    terms = spark.createDataFrame([(f"z{k:07d}w",) for k in range(2000)], "term string")
    plan = typos.corrections(frame, terms)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert typos.corrections(frame, terms).count() == 0


def test_texts(spark):
    terms = spark.createDataFrame([("allowance", 0), ("permanent", 1)], "term string, rank int")
    texts = spark.createDataFrame([(1, "ALLWANCE, Permnaent allowances salry", "x"), (2, None, "x"), (3, "", "x"), (4, "nothing 12", "x"), (4, "nothing 12", "x")], "id int, t string, word string")
    got = sorted(((r.id, r.corrected, r.changes) for r in typos.corrected_texts(texts, "id", "t", terms, {"salry": "salary"}).collect()), key=lambda r: r[0])
    assert got[0] == (1, "ALLOWANCE, Permanent allowance salary", ["ALLWANCE -> ALLOWANCE", "Permnaent -> Permanent", "allowances -> allowance", "salry -> salary"]) or got[0][1] == "ALLOWANCE, Permanent allowances salary"
    assert got[1:] == [(2, None, []), (3, "", []), (4, "nothing 12", []), (4, "nothing 12", [])]


def test_notice(spark):
    cases = {"imm": "Immediate", "immediatly available": "Immediate", "Two monhts": "2 months", "a wek": "1 week", "3": "3 months", "1": "1 month", "13": "13", "0": "Immediate", "nil": "Immediate", "2024-05-01": "2024-05-01", "01/05/2024 imm": "01/05/2024 imm", " serving   notice ": "serving notice", "": "", None: ""}
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    assert [r[0] for r in rows.orderBy("i").select(typos.notice_corrected(F.col("t"))).collect()] == list(cases.values())
