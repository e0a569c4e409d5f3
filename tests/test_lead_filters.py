"""Lead filters, record keys and folders on stated cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterlake.functions import cv, lead_filters, records
from rosterlake.operators import folders


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_filter_texts():
    f = {"must_have": "spark, SQL\nspark", "seniority": "senior", "exclude_keywords": "night shift; x", "company_exclude": "Acme Ltd"}
    assert lead_filters.query_terms(f) == "spark SQL senior"
    assert lead_filters.excluded_terms(f) == "-night-shift -Acme-Ltd"
    assert lead_filters.query_terms({}) == lead_filters.excluded_terms({}) == ""
    assert lead_filters.region_aliases([" Malaysia ", "", "Malaysia"], {"Malaysia": ["MY", "KL"]}) == ["malaysia", "my", "kl"]


def test_regions(spark):
    places = lambda text, regions, wide=(): one(spark, lead_filters.location_allowed(F.lit(text), regions, {"Malaysia": ["my", "kuala lumpur"]}, wide))
    assert places("office in kuala lumpur", ["Malaysia"]) and places("remote, my", ["Malaysia"]) and not places("army base", ["Malaysia"])
    assert not places("remote, asean", ["Malaysia"]) and places("remote, asean", ["Malaysia"], ["Malaysia"]) and not places("office, asean", ["Malaysia"], ["Malaysia"])
    assert places("", ["APAC"]) and places("x", []) and not places(" ", ["Malaysia"])


def test_role_families(spark):
    fits = lambda text, *titles: one(spark, lead_filters.in_role_family(F.lit(text), titles))
    assert fits("hr officer") and fits("hr officer", "manager", "Senior Analyst") and not fits("hr officer", "Data Engineer")
    assert fits("big data steward", "Data Engineer") and not fits("database steward", "Data Engineer") and fits("c++ coder", "C++ Developer") and fits("x", "engineer")


def test_employers(spark):
    names = F.array(F.lit(" Acme Sdn"), F.lit("ACME-SDN"), F.lit(None).cast("string"), F.lit("--"), F.lit("Beta"))
    assert one(spark, cv.distinct_employers(names)) == ["Acme Sdn", "Beta"]
    same = lambda a, b: one(spark, cv.employers_match(F.lit(a), F.lit(b)))
    assert same("Acme, Inc", "acme inc") and same("acme data labs", "acme data") is False and same("acme data labs x", "acme data labs") and not same("", "")


def test_records_with_null_fields(spark):
    r = F.create_map(F.lit("fieldId"), F.lit(""), F.lit("label"), F.lit(" Notice Period "), F.lit("type"), F.lit("Part-time"))
    assert one(spark, F.array(records.field_key(r), records.work_key(r), records.preview_name(r, F.lit(7)))) == ["label:noticeperiod", "work:parttime", "Candidate 7"]


def test_folders(spark):
    s = spark.createDataFrame([(1, "a", False, "", 0), (2, "a", True, "x", 3), (3, "b", False, "", 1)], "k int, folder string, deleted boolean, deleted_at string, revision int")
    pick = lambda *rows: spark.createDataFrame(list(rows), "k int, revision int")
    state = lambda df: [(r.k, r.folder, r.deleted, r.revision) for r in df.orderBy("k").collect()]
    names = spark.createDataFrame([("a",), ("b",)], "name string")
    assert state(folders.move(s, pick((1, 0), (3, 1)), ["k"], "b", names)) == [(1, "b", False, 1), (2, "a", True, 3), (3, "b", False, 2)]
    for bad in (folders.move(s, pick((1, 0), (2, 3)), ["k"], "b"), folders.move(s, pick((1, 9)), ["k"], "b"), folders.move(s, pick((1, 0)), ["k"], "none", names), folders.trash(s, pick((8, 0)), ["k"], F.lit("t"))):
        assert state(bad) == state(s)
    back = folders.trash(s, pick((2, 3)), ["k"], F.lit("t"), deleted=False)
    assert back.filter("k = 2").first().asDict() == {"k": 2, "folder": "a", "deleted": False, "deleted_at": "", "revision": 4}
    after, left = folders.delete_folder(s, names, pick((1, 0), (2, 3)), ["k"], "a")
    assert state(after) == [(1, "", False, 1), (2, "", True, 4), (3, "b", False, 1)] and [r.name for r in left.collect()] == ["b"]
    same, all_names = folders.delete_folder(s, names, pick((1, 0)), ["k"], "a")
    assert state(same) == state(s) and all_names.count() == 2
    assert folders.size_check(s.limit(0), "folder").first().asDict() == {"n": 0, "characters": 0}
