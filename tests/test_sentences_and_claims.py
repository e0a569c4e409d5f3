"""Sentence spans, removal of statements of pay, and claims between two lists."""

from __future__ import annotations

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from rosterlake.functions import sentences
from rosterlake.operators import claims


def of(spark, texts, made):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(made(F.col("t"))).collect()]


def test_pieces_make_up_the_text(spark):
    rng = random.Random(2)
    signs = ["Dr.", "A.", "e.g.", "Ltd", "Co.", "x", "Y", "9", ".", "!", "?", "…", '"', ")", " ", "  ", "\n", "\r\n", "\t", "é", "日", "", "", "Expected", "$0", "\\"]
    texts = ["", " ", ".", *("".join(rng.choice(signs) for _ in range(rng.randrange(1, 30))) for _ in range(600))]
    for text, found in zip(texts, of(spark, texts, sentences.pieces), strict=True):
        assert "".join(found) == text
    for text, found in zip(texts, of(spark, texts, sentences.spans), strict=True):
        assert [text[s.start : s.stop] for s in found] == [s.sentence for s in found]
        last = 0
        for s in found:
            assert text[last : s.start].strip() == "" and s.start >= last
            last = s.stop
        assert text[last:].strip() == ""


def test_where_sentences_end(spark):
    cases = {
        "Dr. Lim led it. Joined Acme Co. Ltd. Then left.": ["Dr. Lim led it.", "Joined Acme Co. Ltd.", "Then left."],
        "J. Smith agreed! \"Yes.\" he said": ["J. Smith agreed!", "\"Yes.\" he said"],
        "Skilled in C. Expected salary RM 9k.": ["Skilled in C.", "Expected salary RM 9k."],
        "e.g. Python. 5 years": ["e.g. Python.", "5 years"],
        "a 5.5% rise. ok": ["a 5.5% rise. ok"],
        "one\n\ntwo": ["one", "two"],
        None: None,
    }
    got = of(spark, list(cases), sentences.spans)
    assert [None if g is None else [s.sentence for s in g] for g in got] == list(cases.values())


AMOUNTS = ["RM 9,000", "RM9k", "MYR 12,500", "SGD 8,000", "$85,000", "USD 90k", "12 LPA", "PHP 60,000"]


def test_own_pay_goes_and_work_stays(spark):
    own = ["Current salary", "Expected salary", "Last drawn salary", "My current salary", "Expected CTC", "Salary", "Monthly salary", "Basic salary", "Take-home pay", "Current package"]
    told = [f"{h}{j}{a}{p}." for h, j, a, p in itertools.product(own, [": ", " of ", " is ", " - "], AMOUNTS, ["", " per month", "/yr"])]
    told += [f"{v} {a} monthly." for v, a in itertools.product(["Earning", "Currently drawing", "The candidate is paid", "She receives", "Seeking", "Takes home"], AMOUNTS)]
    done = [f"{v} {o} of {a}." for v, o, a in itertools.product(["Managed", "Oversaw", "Reconciled", "Benchmarked"], ["payroll for 400 staff", "a salary budget", "compensation costs"], AMOUNTS)]
    done += [f"Expert in {w} {n} salary and HR systems." for w, n in itertools.product(["PHP", "Form"], [7, 16])]
    assert [t for t, g in zip(told, of(spark, told, sentences.states_pay), strict=True) if not g] == []
    assert [t for t, g in zip(done, of(spark, done, sentences.states_pay), strict=True) if g] == []


def test_only_statements_go(spark):
    facts = ["Proficient in Python and C.", "Based in the U.S.", "Worked at Acme Co.", "Joined Contoso Ltd.", "Manages a team of 8.", "Improved margin by 5.5%.", "Holds a B.Sc.", "Joined in Sept."]
    pay = ["Expected salary RM 9k.", "Current salary RM 12,000.", "Last drawn salary MYR 8,500."]
    texts = [f"{a}  {b}" for a, b in itertools.product(facts, pay)] + [f"{b}\n{a} " for a, b in itertools.product(facts, pay)] + [None, "", "RM 5"]
    want = [(a, 1) for a, _ in itertools.product(facts, pay)] + [(f"{a} ", 1) for a, _ in itertools.product(facts, pay)] + [None, ("", 0), ("RM 5", 0)]
    assert [g and tuple(g) for g in of(spark, texts, sentences.pay_removed)] == want


@pytest.mark.parametrize("text", ["1," * 10_000, "9" * 20_000, "RM " * 7000, "$" * 20_000, "." * 40_000, "!?" * 20_000, "Sr. " * 20_000, "A. " * 20_000, "e.g. " * 20_000, "Managed salary RM 9k with " * 1000, "expected salary of new hires and " * 1000, "Led HR and the candidate receives " * 1500, "." + " " * 30_000 + "a"])
def test_hostile_texts_are_quick(spark, text):
    of(spark, ["warm"], sentences.pay_removed)
    began = time.perf_counter()
    of(spark, [text], sentences.pay_removed)
    assert time.perf_counter() - began < 4


def test_redaction(spark):
    texts = ["Languages: [REDACTED]", "withheld" + "." * 200 + " language", "withheld" + "." * 300 + " language", "██ languages", None, "languages: Malay"]
    assert of(spark, texts, lambda t: sentences.redacted_near(t, "languages?")) == [True, True, False, True, False, False]


def names(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, employer string")


def test_claims(spark):
    source = names(spark, [(1, "Hays Recruitment (Petronas)"), (1, "Petronas"), (2, "Hays Recruitment (Petronas)"), (3, "Acme Sdn Bhd"), (3, "ACME SDN. BHD."), (3, "Gone"), (None, "Null Co Ltd"), (4, None), (4, " | "), (5, "Left (Brand)")])
    parsed = names(spark, [(1, "PETRONAS"), (2, "Petronas Bhd"), (3, "acme"), (None, "null co"), (5, "Other"), (6, "Extra")])
    got = sorted(((r.doc_id, r.name, r.kept) for r in claims.claimed_employers(source, parsed).collect()), key=str)
    assert got == sorted(
        [(1, "Hays Recruitment (Petronas)", "missing"), (1, "Petronas", "own"), (2, "Hays Recruitment (Petronas)", "bracket"), (3, "ACME SDN. BHD.", "own"), (3, "Gone", "missing"), (None, "Null Co Ltd", "own"), (5, "Left (Brand)", "missing")], key=str
    )
    assert claims.claimed_employers(source.limit(0), parsed).collect() == []


def test_claims_equal_all_pairs(spark):
    rng = random.Random(6)
    words = ["Acme", "Hays", "Petronas", "Bank", "Global", "Sdn", "Bhd"]
    name = lambda: " ".join(rng.sample(words, rng.randrange(1, 4))) + (f" ({rng.choice(words[:4])} {rng.choice(words[:5])})" if rng.random() < 0.4 else "")
    source = sorted({(d, name()) for d in range(30) for _ in range(5)})
    parsed = sorted({(d, name().split(" (")[0]) for d in range(30) for _ in range(4)})
    keys = lambda rows: {(d, k): min(n for e, n in rows if e == d and claims_key(n) == k) for d, m in rows if (k := claims_key(m))}
    ours, theirs = keys(source), keys(parsed)
    tests = [(d, k, own, said, pk, pn) for (d, k), n in ours.items() for own, said in readings(n) for (e, pk), pn in theirs.items() if e == d]
    frame = spark.createDataFrame(tests, "d int, k string, own boolean, said string, pk string, pn string")
    matched = [(r.d, r.k, r.own, r.pk) for r in frame.filter(claims.names_match(F.col("said"), F.col("pn"))).collect()]
    claimed = {(d, pk) for d, _, own, pk in matched if own}
    want = {(d, n): "own" if any(m[:2] == (d, k) and m[2] for m in matched) else "bracket" if any(m[:2] == (d, k) and (d, m[3]) not in claimed for m in matched) else "missing" for (d, k), n in ours.items()}
    got = {(r.doc_id, r.name): r.kept for r in claims.claimed_employers(names(spark, source).repartition(3), names(spark, parsed)).collect()}
    assert got == want and len(set(want.values())) == 3


def claims_key(n):
    return "".join(c for c in n.lower() if c.isalnum())


def readings(n):
    return [(True, n), (True, n.split(" (")[0]), (False, n.split(" (")[1][:-1])] if "(" in n else [(True, n)]


def test_fidelity(spark):
    source, parsed = names(spark, [(1, "A Ltd"), (1, "B Ltd"), (2, "C Ltd")]), names(spark, [(1, "A"), (1, " ｜ "), (2, "C")])
    bullets = spark.createDataFrame([(1, 10, 5), (2, None, 0), (3, 7, 0)], "doc_id long, source_bullets int, parsed_bullets int")
    got = {r.doc_id: (r.source_employers, r.parsed_employers, r.missing, r.unnamed, r.shortfall, r.ok) for r in claims.fidelity(source, parsed, bullets).collect()}
    assert got == {1: (2, 1, ["B Ltd"], 1, True, False), 2: (1, 1, [], 0, False, True), 3: (0, 0, [], 0, False, True)}
