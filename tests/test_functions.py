"""Columns and operators against stated values."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rosterlake.functions import boolquery, dates, money, pay, people, redact, text, vectorised, web
from rosterlake.operators import intervals, jobs, match, rank, score, store


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def search(spark, words, rule, **kw):
    return value(spark, boolquery.compile_rule(F.lit(words), rule, **kw).matched)


@pytest.mark.parametrize(
    ("words", "rule", "want"),
    [
        ("sap consultant", "sap oracle", True),
        ("mobile", "BI", False),
        ("senior C++ developer", "C++ AND senior", True),
        ("java", "NOT java", False),
        ("java", "java AND", False),
        ("java", "OR java", True),
        ("x", "NOT", True),
        ("a b", "(a AND b) OR c", True),
        ("a", "a AND (b OR c", False),
        ("python", "“python”", True),
        ("aws", "aws; gcp | azure", True),
        ("data  engineer", '"data engineer"', True),
        ("", "a", False),
        ("a", "", True),
    ],
)
def test_boolean_rules(spark, words, rule, want):
    assert search(spark, words, rule) is want


def test_terms_under_not_exclude_first(spark):
    rule = "java OR NOT (cobol AND fortran)"
    assert value(spark, boolquery.search(F.lit("java cobol"), rule).matched) is False
    assert search(spark, "java cobol", rule) is True
    assert boolquery.not_terms(rule) == ["cobol", "fortran"]
    assert boolquery.positive_terms('a1 AND "b two" NOT c3') == ["b two", "a1"]
    assert boolquery.unique_terms("sap OR SAP OR x OR hana") == ["sap", "hana"]


def test_rule_checks():
    assert boolquery.check_query('a AND "b c"') == []
    assert boolquery.check_query("(a OR b") == ["unclosed parenthesis"]
    assert "missing operand at the end" in boolquery.check_query("a AND")
    assert boolquery.check_query("a OR b OR c", 1) == ["more than 1 operators"]


def test_coverage_and_fit(spark):
    assert value(spark, score.term_coverage(F.lit("aws and rds"), "AWS RDS")) == 0.75
    assert value(spark, score.term_coverage(F.lit("aws only"), "AWS RDS")) == 0.0
    assert value(spark, score.term_coverage(F.lit("big data platform"), "big data platforms team")) == 0.75
    assert value(spark, score.fit_percent(F.lit("nothing"), must=["Python"], confirmed=F.lit(True))) == 60
    assert value(spark, score.fit_percent(F.lit("nothing"), role=["Python"], discovered=F.lit(True))) == 10
    assert [score.term_weight(t) for t in ("data engineer", "SAP", "python")] == [2.0, 1.6, 1.0]


def test_months_and_dates(spark):
    at = date(2026, 8, 1)
    index = lambda t, end=False: value(spark, dates.month_index(F.lit(t), at, end))
    assert index("2020-03") == 2020 * 12 + 2
    assert index("2020") == 2020 * 12 and index("2020", True) == 2020 * 12 + 11
    assert index("present") == 2026 * 12 + 7
    assert index("") is None and index("1900") is None
    assert value(spark, dates.clean_date(F.lit("2026-08-03T10:30:00Z"))) == "2026-08-03"
    assert [value(spark, dates.clean_date(F.lit(x))) for x in ("", None, "not-a-date")] == ["", "", ""]
    posted = lambda t: tuple(value(spark, c) for c in dates.posted_date(F.lit(t), at))
    assert posted("2026-07-30") == ("2026-07-30", 2)
    assert posted("Posted 30/07/2026") == ("2026-07-30", 2)
    assert posted("3 weeks ago") == ("2026-07-11", 21)
    assert posted("yesterday") == ("2026-07-31", 1)
    assert posted("N/A") == ("", None) and posted("some day") == ("some day", None)
    made = lambda t: value(spark, dates.date_range(F.lit(t)))
    assert made("2020-06-15 - 2025-07-11") == "Jun 2020 to Jul 2025"
    assert made("Apr 2022-11 Jul 2026") == "Apr 2022 to Jul 2026"
    assert made("2018 - 2018") == "2018" and made("2020 - now") == "2020 to Present" and made("to") == ""
    assert value(spark, dates.sort_point(F.lit("Jan 2019 to Present")))["year"] == 9999
    assert tuple(value(spark, dates.sort_point(F.lit("Mar 2019 to 2021"), True))) == (2021, 12)


def test_brackets_and_scenario(spark):
    table = money.brackets([(0, 100, 0), (100, 200, "0.10"), (200, None, "0.20")])
    assert value(spark, money.progressive_tax(F.lit(Decimal(250)), table)) == Decimal(20)
    assert value(spark, money.marginal_rate(F.lit(Decimal(200)), table)) == Decimal("0.10")
    for bad in ([(0, 100, 0)], [(10, None, 0)], [(0, 5, 2), (5, None, 0)], []):
        with pytest.raises(ValueError, match="bracket"):
            money.brackets(bad)
    assert money.month_weighted_rate([(1, 6, "0.1"), (7, 12, "0.2")]) == Decimal("0.15")
    flat = money.brackets([(0, None, "0.25")])
    s = money.scenario(F.lit(Decimal(12000)), table=flat, allowance=F.lit(Decimal(500)), guaranteed_months=1, variable_share="0.1", employee_rate="0.11", employer_rate="0.12")
    row = spark.range(1).select(*(c.alias(n) for n, c in s.items())).first()
    assert (row.gross_annual_cash, row.gross_monthly_cash, row.employee_contribution, row.total_employer_cost) == (Decimal("176400.00"), Decimal("13500.00"), Decimal("19404.00"), Decimal("197568.00"))
    assert row.net_annual_cash == row.gross_annual_cash - row.employee_contribution - row.estimated_income_tax


def test_pay_texts(spark):
    assert value(spark, pay.amounts(F.lit("RM120k annual + RM500 monthly allowance"))) == [10000, 500]
    assert value(spark, pay.amounts(F.lit("15-30% raise"))) == [] and value(spark, pay.amounts(F.lit("3 months"))) == []
    assert [value(spark, money.salary_bound(F.lit(t))) for t in ("1,200.5", "x", "-1", ".5")] == [1200.5, None, None, 0.5]
    assert value(spark, money.currency_of(F.lit("usd or RM 5k"), [("RM", "MYR"), ("USD", "USD")])) == "USD"
    assert value(spark, money.salary_match(F.lit(None).cast("double"), F.lit(None).cast("double"), 1, 2, True)) == "match_missing"


def test_redaction(spark):
    assert value(spark, redact.external_text(F.lit("Authorization: Bearer abc.def, a@b.co password=xyz sk-abcdefgh12"))) == "Authorization: Bearer [redacted], [redacted-email] password=[redacted] [redacted]"
    assert value(spark, redact.job_text(F.lit("see /home/ann/x\nand C:\\a\\b"))) == "see [private path] and [private path]"
    assert value(spark, redact.phone_in(F.lit("in 2019-2021 call +60 12-345 6789"))) == "+60 12-345 6789"
    assert value(spark, redact.without_phones(F.lit("2019 - 2021, 012-345 6789"))) == "2019 - 2021, [redacted-phone]"
    assert [value(spark, redact.email_state(F.lit(x))) for x in ("a@b.co", "a..b@c.de", "é@b.co", "x")] == ["ok", "invalid", "unsupported", "invalid"]


def test_names_and_text(spark):
    assert value(spark, text.companies_match(F.lit("ACME Sdn. Bhd."), F.lit("acme holdings"))) is True
    assert value(spark, text.companies_match(F.lit("ab"), F.lit("abc"))) is False
    assert vectorised.name_score("Dr. Ana López", "Lopez, Ana", False) == 100
    assert vectorised.name_score("Ana", "Ana Lopez", True) == 65 and vectorised.name_score("Ana", "Ana Lopez", False) is None
    assert vectorised.passages("a" * 300) == ["a" * 250, "a" * 50]
    assert vectorised.first_object('hi ```json\n{"a": 1,}\n```') == '{"a":1}'
    assert vectorised.json_leaves({"a": [1, {"_x": 2, "b": None}], "c": "d"}) == ["a", "1", "b", "c", "d"]
    assert vectorised.title_case("SENIOR SAP LEAD", frozenset({"SAP"})) == "Senior SAP Lead"
    assert vectorised.parsed_text("<p>a&amp;b</p><script>x</script><p>c<br>d") == "a&b\n\nc\nd"
    assert value(spark, text.corrected_term(F.lit("Pythn"), {"pythn": "python"}, [])) == "python"
    assert value(spark, text.corrected_term(F.lit("commision"), {}, ["commission"])) == "commission"
    assert value(spark, text.cased_like(F.lit("COMISION"), F.lit("commission"))) == "COMMISSION"
    assert value(spark, people.residency_classes(F.lit("Malaysian citizen"))) == ["citizen"]
    assert value(spark, people.notice(F.lit("2 months"))[1]) == 60.0
    masked = spark.createDataFrame([("Acme Corp and Target met a target",)], "t string").select(vectorised.masker(("Acme Corp", "Target"), ("Target",), "*")("t").alias("x")).first().x
    assert masked == "* and * met a target"


def test_web(spark):
    assert value(spark, web.canonical_url(F.lit("HTTP://www.Example.com:80/A/b/?q#f"))) == "https://example.com/a/b"
    assert value(spark, web.host_allowed(F.lit("https://a.ok.com"), ["ok.com"])) is True
    assert value(spark, web.host_allowed(F.lit("http://ok.com"), ["ok.com"])) is False
    assert value(spark, web.filename_of(F.lit("attachment; filename*=UTF-8''a%20b.pdf"))) == "a b.pdf"
    assert value(spark, web.html_text(F.lit("<div>a<b>b</b></div><!-- x -->&lt;"))) == "ab\n<"


def test_intervals(spark):
    rows = spark.createDataFrame([(1, 0, 2), (1, 2, 3), (1, 5, 6), (1, 1, 2)], "k int, a int, b int")
    assert intervals.union_length(rows, ["k"], "a", "b").first().length == 4
    assert intervals.islands(rows, ["k"], "a", "b", gap=2).count() == 1


def test_ranks(spark):
    rows = spark.createDataFrame([(1, "b9"), (2, ""), (3, "b10"), (4, None), (5, "Á")], "i int, t string")
    assert [r.i for r in rows.orderBy(*rank.blanks_last("t", True, ["i"])).collect()][-2:] == [2, 4]
    assert [r.i for r in rows.filter("t <> ''").orderBy(rank.natural_key(F.col("t"))).collect()] == [5, 1, 3]
    assert [r.i for r in rows.filter("t <> ''").orderBy(vectorised.natural_key("t")).collect()] == [5, 1, 3]
    slots = spark.createDataFrame([(1, 1, 3), (1, 2, None), (1, 3, 9)], "k int, s int, d int")
    assert {(r.s, r.new_slot) for r in rank.dated_in_dated_slots(slots, ["k"], "s", "d").collect()} == {(1, 3), (2, 2), (3, 1)}


def test_stores(spark):
    base = spark.createDataFrame([(1, "a")], "k int, v string")
    ledger = spark.createDataFrame([], "fingerprint string")
    batch = spark.createDataFrame([(1, "x"), (2, "b"), (2, "c")], "k int, v string")
    one, ledger = store.import_once(base, batch, ledger, "f1", ["k"], ["v"])
    again, ledger2 = store.import_once(one, batch.withColumn("k", F.col("k") + 10), ledger, "f1", ["k"], ["v"])
    assert sorted(map(tuple, one.collect())) == [(1, "a"), (2, "b")] == sorted(map(tuple, again.collect()))
    assert ledger2.count() == 1
    merged = match.merge_missing(base, spark.createDataFrame([(1, "z"), (3, "c")], "k int, v string"), "k", ["v"])
    assert sorted(map(tuple, merged.collect())) == [(1, "a"), (3, "c")]


def test_job_fold_equals_the_plain_rules(spark):
    import random

    rng = random.Random(2)
    rows = [(k, t, rng.choice(["begin", "progress", "complete", "fail", "cancel", "odd"])) for k in range(20) for t in range(15)]
    got = {r.j: r for r in jobs.fold(spark.createDataFrame(rows, "j int, t int, e string"), "j", "t", "e").collect()}
    for k in range(20):
        state, attempts, refused = "", 0, 0
        for _, _, e in (r for r in rows if r[0] == k):
            state, ok = jobs.next_state(state, e)
            attempts += ok and e == "begin"
            refused += not ok
        assert (got[k].state, got[k].attempts, got[k].refused) == (state, attempts, refused)


def test_job_pruning(spark):
    rows = spark.createDataFrame([("a", "running", 1.0), ("b", "failed", 2.0), ("c", "succeeded", 3.0), ("d", "cancelled", 4.0)], "id string, state string, updated_at double")
    assert {r.id for r in jobs.prune(rows, 2).collect()} == {"a", "d"}
    assert {r.id for r in jobs.prune(rows, 9).collect()} == {"a", "b", "c", "d"}


def test_terms_by_the_number_of_nots():
    assert boolquery.signed_terms('a NOT (b AND NOT "c d") OR NOT e') == (["a", "c d"], ["b", "e"])
    assert boolquery.signed_terms("") == ([], []) and boolquery.signed_terms("NOT NOT x)") == (["x"], [])


def test_pay_ranges(spark):
    assert tuple(value(spark, pay.pay_range(F.lit("RM 13-15k")))) == (13000, 15000)
    assert tuple(value(spark, pay.pay_range(F.lit("8,000 to 7,000")))) == (7000, 8000)
    assert [value(spark, pay.pay_range(F.lit(t).cast("string"))) for t in ("10% more", "", None)] == [None] * 3


def test_leads_and_cvs(spark):
    from rosterlake.functions import cv, leads

    assert value(spark, leads.is_job_page(F.lit("https://x.com/job/kl/123"))) is True
    assert value(spark, leads.is_job_page(F.lit(None).cast("string"))) is False
    assert value(spark, leads.contact_key(F.lit(None).cast("string"), F.lit("Ann  Bo"), F.lit("Acme"))) == "nc:ann bo|acme"
    assert tuple(value(spark, c) for c in leads.percent_increase(F.lit("raise of 10 to 15 percent"))) == (10.0, 15.0)
    assert value(spark, leads.pay_display(F.lit(""), F.lit(5000), F.lit(5000))) == "5,000/month"
    text = "Intro\nExperience\n- one\n2) two\nplain\nSkills\n- x"
    assert value(spark, cv.bullet_count(cv.section_lines(F.lit(text), "Experience", "Skills"))) == 2
    assert value(spark, cv.section_lines(F.lit("none"), "Experience", "Skills")) is None
    assert value(spark, cv.languages(F.lit("Native Klingon, english"))) == ["English", "Klingon"]
    assert value(spark, cv.in_date_range(F.lit("2024-01-01"), F.lit(None).cast("string"), "2024-01-01", "")) is True


def test_arrays_of_structs(spark):
    from rosterlake.operators import nested

    rows = spark.sql("""SELECT array(named_struct('t', 'a', 'd', named_struct('year', 2019, 'month', 1)), named_struct('t', 'b', 'd', NULL), named_struct('t', 'c', 'd', named_struct('year', 2020, 'month', 5))) AS r,
      array(named_struct('heading', 'H', 'text', ''), named_struct('heading', '', 'text', 'x'), named_struct('heading', NULL, 'text', 'y'), named_struct('heading', 'I', 'text', 'z'), named_struct('heading', 'J', 'text', '')) AS b,
      array(named_struct('fieldId', 4, 'name', 'Currency', 'value', ' MYR '), named_struct('fieldId', NULL, 'name', 'currency', 'value', 'SGD'), named_struct('fieldId', 5, 'name', 'x', 'value', 'y')) AS f""")
    got = rows.select(nested.newest_first(F.col("r"), "d").alias("r"), nested.absorb_labels(F.col("b")).alias("b"), nested.custom_values(F.col("f"), 4, ["Currency"]).alias("f"), nested.update_element(F.col("f"), "fieldId", F.lit(5), value=F.lit("new")).alias("u"), nested.span(F.col("r"), "d", "d").alias("s"), nested.without_sections(F.col("b"), "heading", "^I$").alias("w")).first()
    assert [x.t for x in got.r] == ["c", "a", "b"]
    assert [(x.heading, x.text) for x in got.b] == [("H", "x"), ("H", "y"), ("I", "z")]
    assert got.f == ["MYR", "SGD"] and got.u[2].value == "new" and got.u[0].value == " MYR "
    assert tuple(got.s.start) == (2019, 1) and tuple(got.s.end) == (2020, 5) and len(got.w) == 4
    grid = nested.search_grid(spark.createDataFrame([(1, "s1"), (2, "s2")], "source_n int, source string"), spark.createDataFrame([(1, "t1"), (2, "t2")], "title_n int, title string"), 3)
    assert [tuple(r) for r in grid.collect()] == [("s1", "t1"), ("s1", "t2"), ("s2", "t1")]


def test_availability(spark):
    at = date(2026, 8, 1)
    read = lambda t: value(spark, dates.availability(F.lit(t), at))
    dated = lambda t: str(read(t).date)
    assert (dated("from 2026-08-15"), dated("15/09/2026"), dated("3 Jan"), dated("20 Dec"), dated("March 5, 2027")) == ("2026-08-15", "2026-09-15", "2027-01-03", "2026-12-20", "2027-03-05")
    relative = lambda t: (read(t).period, read(t).unit)
    assert [relative(t) for t in ("1.5 months", "0.5 month", "two weeks", "6 wks", "10 days", "45 days", "a mth")] == [(1, "Month"), (2, "Week"), (2, "Week"), (2, "Month"), (2, "Week"), (2, "Month"), (1, "Month")]
    assert read("Immediately").kind == "immediate" and read("none").kind == "immediate" and read("0 days").kind == "immediate"
    assert read("2026-13-40") is None and read("ask") is None and read("") is None and read(None) is None


def test_greedy_assignment(spark):
    rows = spark.createDataFrame([(1, "a", "x", 5.0), (1, "a", "y", 9.0), (1, "b", "y", 8.0), (1, "b", "x", 4.5), (1, "c", "z", 1.0), (2, "a", "x", 4.0)], "g int, l string, r string, s double")
    got = sorted(tuple(r) for r in match.greedy_assignment(rows, "g", "l", "r", "s", 4.0).collect())
    assert got == [(1, "a", "y", 9.0), (1, "b", "x", 4.5), (2, "a", "x", 4.0)]
