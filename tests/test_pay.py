"""The pay grammar: kinds of numbers, ranges, months, fixed and expected pay."""

from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from rosterlake.functions import pay


def column(spark, texts, made, *more):
    rows = spark.createDataFrame([(i, t, *(m[i] for m in more)) for i, t in enumerate(texts)], ", ".join(["i int, t string", *(f"x{k} double" for k in range(len(more)))]))
    return [r[0] for r in rows.orderBy("i").select(made(F.col("t"), *(F.col(f"x{k}") for k in range(len(more)))).alias("v")).collect()]


AMOUNTS = {
    "RM120k annual + RM500 monthly allowance": [10000, 500],
    "15-30% raise": [],
    "3 months": [],
    "": [],
    None: [],
    "RM 1,200,000 p.a.": [100000],
    "RM8000.": [8000],
    "5000": [5000],
    "13th month": [],
    "RM5k + 13th month": [5000],
    "RM5k x 13": [5000],
    "RM5k × 13.5": [5000],
    "14th bonus": [],
    "40th bonus": [40],
    "32sllowance": [32],
    "32kallowance": [32000],
    "16epf; RM3k": [16, 3000],
    "5abc": [],
    "1.2m": [],
    "SGD 1.2m": [1200000],
    "2m bonus, usd 4k": [4000],
    "12 lakh": [1200000],
    "INR 12l": [1200000],
    "12l": [],
    "12lpa": [100000],
    "INR 1.2cr per annum": [1000000],
    "day 5 of month 3, 4000": [4000],
    "10 percent": [],
    "10 - 15 pct": [],
    "13-15k": [13, 15000],
    "s$4.5k/year": [375],
    "9 days\n4,500": [4500],
    "rm13k": [13000],
    "6000myr": [6000],
    "6kmyr": [6000],
}


def test_amounts(spark):
    assert dict(zip(AMOUNTS, column(spark, list(AMOUNTS), pay.amounts), strict=True)) == AMOUNTS
    assert column(spark, ["x", "a 5k b 6k"], pay.first_amount) == [None, 5000]
    assert column(spark, ["5k", "1,234", "123", None], pay.has_amount) == [True, True, False, False]


def test_grid_of_components(spark):
    """Every number form with every scale, currency and period: the amount follows from the parts."""
    texts, want = [], []
    for n, scale, money, period in itertools.product(("7", "1,250", "2.5"), ("", "k", " k", "lakh", " million"), ("", "RM", "SGD "), ("", " per annum", " per month", "/year")):
        factor = {"": 1, "k": 10**3, "lakh": 10**5, "million": 10**6}[scale.strip()]
        value = float(n.replace(",", "")) * factor / (12 if "annum" in period or "year" in period else 1)
        texts.append(f"{money}{n}{scale}{period}")
        want.append([x] if (x := int(value + 0.5)) > 0 else [])
    got = column(spark, texts, pay.amounts)
    assert {t: g for t, g, w in zip(texts, got, want, strict=True) if g != w} == {}


def test_ranges(spark):
    cases = {
        "RM 13-15k": (13000, 15000), "8,000 to 7,000": (7000, 8000), "10% more": None, "": None, None: None, "RM5k": (5000, 5000), "5k and 6k": (5000, 5000), "RM 5k - RM 6k": (5000, 6000), "5k, 10%": (5000, 5000), "20% then 5k": None, "13 ~ 15 k": (13000, 15000),
    }
    got = column(spark, list(cases), pay.pay_range)
    assert [None if g is None else tuple(g) for g in got] == list(cases.values())
    percents = {"15-30%": (15, 30), "10% to 20%": (10, 20), "30 percent": (30, 30), "+5%": (5, 5), "-150%": None, "900%": None, "5k": None, None: None, "20 % - 10": (10, 20)}
    assert [None if g is None else tuple(g) for g in column(spark, list(percents), pay.percent_range)] == list(percents.values())


def test_months(spark):
    cases = {
        "": (12, False), None: (12, False), "13 months": (13, True), "13.5th bonus": (13.5, True), "x14": (14, True), "AWS": (13, True), "RM5k + AWS + 2 months guaranteed bonus": (15, True), "14 months including 2 months guaranteed bonus": (14, True),
        "2 months performance bonus": (12, False), "guaranteed bonus of 3 mths": (15, True), "24 months": (24, True), "36 months": (12, False), "24 months; 11 months fixed bonus; 11 months fixed bonus": (36, True),
    }
    got = column(spark, list(cases), pay.guaranteed_months)
    assert [(g.months, g.stated) for g in got] == list(cases.values())


def test_fixed_pay(spark):
    cases = {
        "RM8000": (8000, 8000, 12, 0),
        "Basic RM8,000 + RM500 transport allowance + 13th month": (9167, 8000, 13, 500),
        "5k + 300": (5300, 5000, 12, 300),
        "bonus 20k; 5k": (5000, 5000, 12, 0),
        "current salary RM8000 (excludes bonus)": (8000, 8000, 12, 0),
        "500 allowance": None,
        "base 900": (900, 900, 12, 0),
        "10% epf": None,
        None: None,
        "RM120k annual, phone 100, EPF 1200": (10100, 10000, 12, 100),
        "5k + 40": (5000, 5000, 12, 0),
    }
    got = column(spark, list(cases), pay.fixed_pay)
    assert [None if g is None else tuple(g) for g in got] == list(cases.values())


def test_expected_pay(spark):
    cases = [
        ("RM 9k", 5000.0, ("fixed", 9000, 9000)), ("8-9k or 10%", 5000.0, ("range", 8000, 9000)), ("same as current", 5000.0, ("same_as_current", 5000, 5000)), ("no change", None, ("same_as_current_unresolved", None, None)), ("10-20%", 5001.0, ("percent_range", 5501, 6001)),
        ("20%", None, ("percent_unresolved", None, None)), ("negotiable", 5000.0, ("open", None, None)), ("hello", 5000.0, ("unparsed", None, None)), (" ", 5000.0, ("blank", None, None)), (None, None, ("blank", None, None)),
    ]
    got = column(spark, [c[0] for c in cases], pay.expected_pay, [c[1] for c in cases])
    assert [tuple(g)[:3] for g in got] == [c[2] for c in cases]


@pytest.mark.parametrize(
    ("base", "months", "added", "text", "trusted", "want"),
    [(5000.0, 12.0, 0.0, "RM5k", False, None), (5001.0, None, 0.0, "RM5k", False, None), (6000.0, 12.0, 0.0, "RM5k", True, "base"), (5000.0, 13.0, 0.0, "RM5k", True, "months"), (5000.0, 13.0, 0.0, "RM5k AWS", True, None), (5000.0, 12.0, 500.0, "RM5k + 400", True, "additions"), (5000.0, 12.0, 401.0, "RM5k + 400", True, None), (5000.0, 12.0, -1.0, "", True, "additions"), (5000.0, 12.0, 0.0, "", False, "evidence"), (None, 12.0, 0.0, "RM5k", True, "missing")],
)
def test_components_against_the_note(spark, base, months, added, text, trusted, want):
    made = lambda x: F.lit(x).cast("double")
    got = spark.range(1).select(pay.base_confirmed(made(base), made(months), made(added), F.lit(text), F.lit(trusted)).alias("v")).first().v
    assert got == want


def test_record(spark):
    row = spark.range(1).select(pay.pay_record(F.lit("RM5k + AWS"), F.lit("20%"), pay.chosen_currency(F.array().cast("array<string>"), F.array(F.lit("MYR")), F.lit("sgd"))).alias("r")).first().r
    assert (row.currency, row.value, row.months, row.type, row.low) == ("MYR", 5417, 13.0, "percent", 6500)
    assert len(row.fingerprint) == 64
