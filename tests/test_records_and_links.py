"""Nulls, blanks, odd texts and empty tables in records, links of leads and rules."""

from __future__ import annotations

import json
import random
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rosterlake.functions import json_records, lead_urls, vectorised
from rosterlake.operators import quarantine

LEAD = "company string, matched_role string, title string, job_url string, source_url string, company_url string, job_url_quality string, source_note string"


def test_leads_without_anything(spark):
    rows = spark.createDataFrame([(None,) * 8, (None,) * 8], LEAD)
    got = lead_urls.with_one_link(rows).select("job_url", "source_url", "job_url_quality", "source_note").collect()
    assert [tuple(r) for r in got] == [("", "", lead_urls.NO_DIRECT, "")] * 2
    assert lead_urls.with_one_link(rows.limit(0)).count() == 0
    assert lead_urls.direct_job_leads(rows, "company").count() == 0


def test_records_of_odd_texts(spark):
    rows = spark.createDataFrame([(None,), ("",), ("[",), ("[]",), ("null",), ('{"a":' * 30 + "1" + "}" * 30,)], "t string")
    t = F.col("t")
    got = rows.select(json_records.field_texts(t, ["a"]), json_records.residency_text(t), json_records.option_values(t), json_records.resume_files(t), json_records.location_identity(t, ["SG"])["codes"], json_records.card_pay(t)["current"]).collect()
    assert all((r[1], r[2], r[3], r[4], r[5]) == ("", [], [], [], None) for r in got)
    assert [r[0] for r in got[:5]] == [""] * 5


def test_hostile_records_fail_no_reader(spark):
    odd = ["[" * 200_000 + "]" * 200_000, '{"a":' * 5000 + "1" + "}" * 5000, '{"a":"\\ud800","resume\\udfff":["x\\ud800"]}', '[{"id":"\\udc00"}]', "NaN", '{"a":1e999}', "9" * 5000]
    rows = spark.createDataFrame([(t,) for t in odd], "t string")
    t = F.col("t")
    made = [json_records.field_texts(t, ["a"]), json_records.location_identity(t, ["SG"]), json_records.residency_text(t), json_records.option_values(t), json_records.resume_files(t), json_records.filled_json(t, F.lit('{"b":1}')), json_records.united_json(t, t, ("id",), ("name",)), vectorised.json_flatten(t), vectorised.json_sanitised(t), vectorised.json_object(t)]
    got = rows.select(*(c.alias(f"c{k}") for k, c in enumerate(made))).collect()
    assert len(got) == len(odd)
    assert got[0].c0 == "" and got[0].c7 is None and got[0].c8 is None and got[1].c5 == '{"b":1}'
    assert got[2].c7 == ["a", "\ufffd", "resume\ufffd", "x\ufffd"] and got[3].c6 == '[{"id":"\ufffd"}]'


def test_unions_take_time_in_proportion():
    one, other = [{"id": k, "v": [k]} for k in range(20_000)], [{"id": k + 10_000, "v": [0, k], "w": k} for k in range(20_000)]
    began = time.perf_counter()
    got = json_records.united(one, other, ("id",), ())
    assert len(got) == 30_000 and got[10_000] == {"id": 10_000, "v": [10_000, 0], "w": 0}
    assert len(json_records.filled(list(range(20_000)), list(range(10_000, 40_000)))) == 40_000
    assert time.perf_counter() - began < 4


def plain_filled(own, other, level=0):
    """By recursion, for small values."""
    if own in (None, "", [], {}) and own is not False and own != 0:
        return other
    if isinstance(own, dict) and isinstance(other, dict):
        return {k: plain_filled(own[k], other[k], level + 1) if k in own and k in other else own.get(k, other.get(k)) for k in [*own, *(k for k in other if k not in own)]}
    if isinstance(own, list) and isinstance(other, list):
        texts = {json.dumps(v, sort_keys=True) for v in own}
        out = list(own)
        for v in other:
            if (t := json.dumps(v, sort_keys=True)) not in texts:
                texts.add(t)
                out.append(v)
        return out
    return own


def test_filled_equals_recursion():
    rng = random.Random(9)

    def value(level):
        kind = rng.randrange(7 if level < 4 else 4)
        if kind < 4:
            return rng.choice([None, "", "x", 1, 0, False, [], {}])
        if kind == 4:
            return [value(level + 1) for _ in range(rng.randrange(4))]
        return {rng.choice("abc"): value(level + 1) for _ in range(rng.randrange(4))}

    for _ in range(3000):
        own, other = value(0), value(0)
        assert json_records.filled(own, other) == plain_filled(own, other), (own, other)


def test_filled_and_united():
    assert json_records.filled({"a": "", "b": [1], "c": 0}, {"a": 2, "b": [1, 3], "c": 5, "d": None}) == {"a": 2, "b": [1, 3], "c": 0, "d": None}
    assert json_records.filled(None, [1]) == [1] and json_records.filled([1], None) == [1]
    assert json_records.united(None, [{"id": 1}, {"id": "1 ", "v": 2}, 4, 4], ("id",), ()) == [{"id": 1, "v": 2}, 4]


def test_years_said(spark):
    said = ["3 yrs exp", "18 months experience", "10 years overall experience", "20 years in Malaysia", "graduated 12 years ago", None, "61 years experience"]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, t string")
    got = [r[0] for r in rows.orderBy("i").select(json_records.years_said(F.col("t"))).collect()]
    assert got == [3.0, 1.5, 10.0, None, None, None, None]


def test_limits():
    assert quarantine.limit_of(None) == 60 and quarantine.limit_of(" OFF ") is None and quarantine.limit_of("0.5") == Decimal("0.5")
    for wrong in ("0", "-1", "10001", "nan", "inf", "x", "1" * 200, "0.0000000000000000001"):
        with pytest.raises(ValueError):
            quarantine.limit_of(wrong)


def test_rejected_rows_are_kept(spark):
    rows = spark.createDataFrame([("a",), (None,), ("*",), ("*",)], "name string")
    fine, rejected = quarantine.split(rows, quarantine.folder_reason(F.col("name")))
    assert [r[0] for r in fine.collect()] == ["a"]
    assert {(r["reason"], r["n"]) for r in quarantine.rejected_counts(rejected).collect()} == {("missing", 1), ("reserved", 2)}


def test_profile_pages(spark):
    link, text = "https://www.linkedin.com/in/x", "an engineer"
    rows = [("ok", "p1", link, text), ("twice", "p1", link, text), ("twice", "p1", link, text), ("bad", "p1", link, text), ("bad", "p2", link, " "), (None, "p1", link, text)]
    rows += [("many", f"p{i}", link, text) for i in range(41)]
    df = spark.createDataFrame([(*r, None, "Engineer", None) for r in rows], "page string, id string, url string, text string, name string, title string, location string")
    assert {r["page"] for r in quarantine.clean_profile_pages(df, "page").collect()} == {"ok"}
    assert quarantine.clean_profile_pages(df.limit(0), "page").count() == 0
