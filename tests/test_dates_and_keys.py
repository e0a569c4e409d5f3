"""Date ranges in the house style, natural order, job pages, sections and scanners on stated cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rosterlake.functions import boolquery, cv, dates, leads, redact
from rosterlake.operators import rank
from rosterlake.plans.cv_queries import DATE_RANGES


def test_date_ranges(spark):
    rows = spark.createDataFrame(list(DATE_RANGES), "said string, want string").select("said", "want", dates.date_range(F.col("said")).alias("got")).collect()
    assert [(r.said, r.got) for r in rows] == [(r.said, r.want) for r in rows]


def test_natural_order_of_long_numbers(spark):
    names = ["1234567890123", "9", "A10 b", "a9 b", "Øre 1", "orf", "x 007", "x 7a", "Łódź", "lodz"]
    got = [r.t for r in spark.createDataFrame([(n,) for n in names], "t string").orderBy(rank.natural_key(F.col("t")), "t").collect()]
    assert got == ["9", "1234567890123", "a9 b", "A10 b", "lodz", "Łódź", "Øre 1", "orf", "x 007", "x 7a"]


JOB_PAGES = {
    "https://www.google.com/about/careers/applications/jobs/results/123-eng": True,
    "https://www.google.com/search?q=jobs": False,
    "https://www.linkedin.com/jobs/collections/recommended?currentJobId=5": True,
    "https://www.linkedin.com/jobs/search?keywords=x": False,
    "https://my.jobstreet.com/sap-consultant-jobs/in-KL?jobId=87401944": True,
    "https://my.jobstreet.com/sap-consultant-jobs/in-KL": False,
    "https://my.indeed.com/rc/clk?jk=ab12": True,
    "https://my.hiredly.com/jobs/data-engineer": True,
}


def test_job_pages(spark):
    rows = spark.createDataFrame([(u,) for u in JOB_PAGES], "u string").select("u", leads.is_job_page(F.col("u")).alias("x")).collect()
    assert {r.u: r.x for r in rows} == JOB_PAGES


def test_section_lines(spark):
    texts = ["a\n Head.\nx\ny\nThe end\nz", "Head.\n\nlast", "none", "", None, "Head.", "Head.\nThe end", "x Head.\nHead.\r\n b \r\nOf it\n"]
    got = [r.x for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(cv.section_lines(F.col("t"), r"[A-Z][a-z]{0,5}\.", r"(?:The|Of)\b.*").alias("x")).collect()]
    assert got == [["x", "y"], ["", "last"], None, None, None, [], [], ["b"]]


def test_scanner():
    assert [(s.kind, s.text) for s in boolquery.spans('a AND-x "b c" NOT(d) ANDY "" \'')] == [("BARE", "a"), ("AND", "AND"), ("BARE", "-x"), ("QUOTED", "b c"), ("NOT", "NOT"), ("OPEN", "("), ("BARE", "d"), ("CLOSE", ")"), ("BARE", "ANDY"), ("BARE", '""'), ("BARE", "'")]
    assert boolquery.not_terms('java NOT "big data" NOT (x OR yy) NOT sales,hr not  ab') == ["big data", "yy", "sales", "ab"]
    assert boolquery.positive_terms('senior engineer AND "data lake" NOT (x OR yy) OR spark, scala/java') == ["data lake", "senior engineer", "spark", "scala", "java"]


@pytest.mark.parametrize(("said", "want"), [("candidate id: ab.12, x", "candidate id: [candidate redacted], x"), ('"access_token": tok; y', '"access_token": [redacted]; y'), ("D:\\a b\\c", "[private path]")])
def test_journal_marks(spark, said, want):
    assert spark.range(1).select(redact.job_text(F.lit(said))).first()[0] == want
