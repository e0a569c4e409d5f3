"""Headings as anchors, regions between them, and values restored from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterlake.operators import anchors

DOC = "doc_id long, text string, name string, line int"
ITEM = "doc_id long, name string, award string, id int"
TEXT = "Lead of Acme in text\nACME, Sdn. Bhd. | Jan 2020 - Present\n- one\nAward: Gold\nBeta (2019)\nworked at Acme\naward - Silver\n\nBeta Plus 2018\nx\nGamma\nAward: a\nGamma 2001\nAward: b"


def test_headings_and_regions(spark):
    docs = spark.createDataFrame([(1, TEXT, "x", 1), (2, None, "x", 1), (3, "", "x", 1), (4, "Acme", "x", 1)], DOC)
    items = spark.createDataFrame([(1, "acme", "", 1), (1, "Beta", "", 1), (1, "Beta", "", 2), (1, "Gamma", "", 1), (1, " ", "", 1), (1, None, "", 1), (2, "Acme", "", 1), (None, "Acme", "", 1), (1, "Lead", "", 1)], ITEM)
    got = sorted((r.doc_id, r.name, r.line) for r in anchors.headings(docs, items).collect())
    assert got == [(1, "Beta", 4), (1, "Gamma", 10), (1, "Gamma", 12), (1, "acme", 1)]
    found = {(r.doc_id, r.name): (r.line, r.lines) for r in anchors.regions(docs, items).collect()}
    assert found == {(1, "acme"): (1, ["- one", "Award: Gold"]), (1, "Beta"): (4, ["worked at Acme", "award - Silver", "Beta Plus 2018", "x"])}
    assert anchors.regions(docs.limit(0), items).collect() == []


def test_restored(spark):
    docs = spark.createDataFrame([(1, TEXT, "x", 1)], DOC)
    items = spark.createDataFrame([(1, "acme", " ", 1), (1, "Beta", None, 2), (1, "Beta", "own", 3), (1, "Gamma", "", 4), (1, None, "", 5), (7, "acme", "", 6)], ITEM)
    got = {r.id: r.award for r in anchors.restored_from_regions(docs, items, "award", "award").collect()}
    assert got == {1: "Gold", 2: "Silver", 3: "own", 4: "", 5: "", 6: ""}


def test_flattened(spark):
    texts = ["a  b\n\n c\td \r\ne", "", None, "\n", "x"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in rows.orderBy("i").select(anchors.flattened(F.col("t"))).collect()]
    assert [(g.flat, g.starts) for g in got] == [("a b c d e", [0, 4, 8]), ("", []), ("", []), ("", []), ("x", [0])]
    assert all(g.flat[s - 1] == " " for g in got for s in g.starts if s)
