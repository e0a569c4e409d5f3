"""Masking by an automaton against a plain longest-first search, on texts and nested columns."""

from __future__ import annotations

import random
import re
import time

from pyspark.sql import functions as F

from rosterlake.functions import masking
from rosterlake.functions.masking import Masker, mask_columns, terms


def plain(text, found):
    """Longest term first, each replaced from the left where nothing was replaced yet (without marks of emphasis)."""
    spans = []
    for term, mark, cased, proper, _ in sorted(found, key=lambda t: -len(t[0])):
        for m in re.finditer(r"(?<![A-Za-z0-9])" + re.escape(term) + r"(?![A-Za-z0-9])", text, 0 if cased else re.I):
            if proper and m[0].islower() or any(m.start() < b and a < m.end() for a, b, _ in spans):
                continue
            spans.append((m.start(), m.end(), mark))
    for a, b, mark in sorted(spans, reverse=True):
        text = text[:a] + mark + text[b:]
    return text


def test_equals_longest_first():
    rng = random.Random(1)
    words = ["Acme", "Hong", "Leong", "Bank", "of", "C++", "R&D", "x1", "(Pty)", "É"]
    for _ in range(1500):
        found, seen = [], set()
        for _ in range(rng.randrange(0, 6)):
            term = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 4)))
            if term.lower() not in seen:
                seen.add(term.lower())
                found.append((term, f"[{len(found)}]", rng.random() < 0.2, rng.random() < 0.2, False))
        text = rng.choice(["", " ", ". "]).join(rng.choice([*words, "acme", "bank", "ACME"]) + rng.choice([" ", " ", ",", ""]) for _ in range(rng.randrange(0, 14)))
        assert Masker(found).mask(text) == plain(text, found), (text, found)


def test_emphasis_prefixes_and_case():
    m = Masker([("Jane Example", "[name]", False, False, False), ("Grab", "[company]", False, True, True), ("Maxis", "[company]", False, False, True), ("Li", "[name]", True, False, False)])
    assert m.mask("**Jane** Example and _jane_  x") == "[name] and _jane_  x"
    assert m.mask("GrabFood, Grab2u, grabbing, Grabbing, GRABFOOD, grab") == "[company]Food, [company]2u, grabbing, Grabbing, GRABFOOD, grab"
    assert m.mask("MaxisOne maxisfoo Maxisx Maximum") == "[company]One [company]foo Maxisx Maximum"
    assert m.mask("Li li LI LiLi") == "[name] li LI LiLi"
    assert m.mask("İ Jane EXAMPLE İ") == "İ [name] İ"
    own = Masker([("a_b c", "[x]", False, False, False), ("**", "[y]", False, False, False)])
    assert own.mask("A_B c, ab c, _a_b c_ a**") == "[x], ab c, [x] a**"
    assert Masker([]).mask("x") == "x" and Masker([("", "y", False, False, False)]).mask("x") == "x"


def test_time_does_not_grow_with_terms():
    text = "lorem ipsum dolor " * 20_000
    few, many = ([(f"name{k} of{k}", "[x]", False, False, False) for k in range(n)] for n in (10, 5000))
    took = []
    for found in (few, many):
        m = Masker(found)
        began = time.perf_counter()
        assert m.mask(text) == text
        took.append(time.perf_counter() - began)
    assert took[1] < 20 * took[0] + 0.2


def test_nested_columns_and_own_terms(spark):
    rows = [
        (1, ["Acme", "acme", " ", None], {"a": "Acme", "b": [{"c": "at ACME.", "d": {"k": "Acme"}}, {"c": None, "d": None}]}, [["Acme", None], None, []]),
        (2, ["Other"], {"a": "Acme", "b": []}, [["other"]]),
        (3, None, None, None),
        (4, [], {"a": None, "b": None}, []),
    ]
    df = spark.createDataFrame(rows, "id int, names array<string>, r struct<a: string, b: array<struct<c: string, d: map<string, string>>>>, l array<array<string>>").repartition(2)
    df = df.withColumn("n", F.lit(5)).withColumn("terms", terms(F.col("names"), "[x]"))
    got = {r.id: (r.r.asDict(True) if r.r else None, r.l, r.n) for r in mask_columns(df, "terms", ["r", "l", "n"]).collect()}
    assert got == {
        1: ({"a": "[x]", "b": [{"c": "at [x].", "d": {"k": "[x]"}}, {"c": None, "d": None}]}, [["[x]", None], None, []], 5),
        2: ({"a": "Acme", "b": []}, [["[x]"]], 5),
        3: (None, None, 5),
        4: ({"a": None, "b": None}, [], 5),
    }


def test_names_of_organisations(spark):
    text = F.lit("Built for Maxis at Northwind Traders Sdn Bhd and Acme Ltd. then grab it")
    got = spark.range(1).select(masking.organisation_names(F.array(F.lit("Hong Leong Bank"), F.lit("ab"), F.lit(None)), text, ("Maxis", "Celcom")).alias("n")).first().n
    assert got == ["Northwind Traders Sdn Bhd", "Hong Leong Bank", "Acme Ltd.", "Maxis"]


def test_own_number_and_identifiers(spark):
    texts = ["call +60 12-345 6789 or 0123456789", "processed 123456789 records", "60123456789", "id 99123456789", "vinay_lariya_job max_size vinay_x li_x", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    number = masking.own_number_masked(F.col("t"), F.lit("+60123456789"), "[p]")
    words = masking.name_identifiers_masked(F.col("t"), F.array(*map(F.lit, ("Vinay", "Lariya", "li"))), "[n]")
    got = df.orderBy("i").select(number, words, masking.own_number_masked(F.col("t"), F.lit("12"), "[p]")).collect()
    assert [r[0] for r in got] == ["call [p] or [p]", texts[1], "[p]", texts[3], texts[4], None]
    assert got[4][1] == "[n] max_size [n] li_x"
    assert [r[2] for r in got] == texts
