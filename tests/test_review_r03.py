"""Findings of the third review."""

from __future__ import annotations

import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rosterlake.functions import json_text
from rosterlake.operators import anchors, claims, match, phrases, set_blocks, work_history
from rosterlake.plans.all_queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_claims_are_not_broadcast(spark):
    for name in ("claimed_employers_orders", "fidelity_customers"):
        assert "Broadcast" not in plan(QUERIES[name](spark, SF))


def test_names_meet_by_their_keys_without_legal_forms(spark):
    source = spark.createDataFrame([(1, "Acme Bank Ltd"), (2, "Acme Bank Ltd")], "doc_id long, employer string")
    parsed = spark.createDataFrame([(1, "AcmeBank"), (2, "Acme")], "doc_id long, employer string")
    assert {r.doc_id: r.kept for r in claims.claimed_employers(source, parsed).collect()} == {1: "own", 2: "missing"}


def same_as_sql(spark, name, folder, **tables):
    for table, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    for table in tables:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    df = QUERIES[name](spark, str(folder))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE[name]})").fetchall()
    assert Counter(map(tuple, df.collect())) == Counter(want)
    return want


def test_section_sizes_of_odd_lines(spark, tmp_path):
    texts = ["Les.\na\nLaé b\nc", "Les.\na\nLa é", "Les.\na\nOf x\nb", "Les.\r\na\nThe", "Les.\na\r\nThe x\r\nb", "x\rLes.\ny", "x\n Les.  \ny", "Les.\n", "Les.", " Les.  \n\n  The  \nb", "Les.\nThe_\nLaw\nLa-", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert (0, 1) in same_as_sql(spark, "section_sizes_docs", tmp_path, documents=docs)


def test_best_of_long_alike_texts(spark, tmp_path):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.sample(words, rng.choice([2, 5, 20, 40, 55]))) for _ in range(300)] + ["a b c", "A, b; c", "", None, "!"]
    docs = spark.createDataFrame([(k, rng.choice(["en", "de", None]), t) for k, t in enumerate(texts)], "doc_id long, lang string, text string").filter("lang is not null")
    assert len(same_as_sql(spark, "jaccard_best", tmp_path, documents=docs)) > 50


def test_pairs_of_texts_are_never_rows(spark):
    assert "FlatMapGroupsInArrow" in plan(QUERIES["jaccard_best"](spark, SF))


@pytest.mark.parametrize("sparse, listed", [(128, 2**22), (1, 7), (10**9, 5)])
def test_intersections(monkeypatch, sparse, listed):
    monkeypatch.setattr(set_blocks, "SPARSE", sparse)
    monkeypatch.setattr(set_blocks, "LISTED", listed)
    rng = random.Random(1)
    sets = lambda k: [np.array(rng.sample(range(-3000, 3000), rng.choice([1, 3, 500]))) for _ in range(k)]
    a, b = sets(40), sets(25)
    assert set_blocks.intersections(a, b).tolist() == [[len(set(x.tolist()) & set(y.tolist())) for y in b] for x in a]
    assert set_blocks.intersections([np.array([1])], [np.array([2])]).tolist() == [[0.0]]


@pytest.mark.parametrize("name", ["pay_fixed_orders", "pay_components_orders", "pay_sentences_orders", "posted_date_parse"])
def test_notes_are_read_once(spark, name):
    # what is read from a text is made in one place and not again in a filter or for another field
    text = plan(QUERIES[name](spark, SF))
    assert "Filter isnotnull(element_at" not in text and "Generate explode(array(struct(" in text


def test_lines_are_looked_up_by_few_beginnings(spark):
    docs = spark.createDataFrame([(1, "Acme Bank Berhad, Jan 2001 to Present\n" + "one two three four five six\n" * 3)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "Acme Bank Berhad"), (1, "one two"), (1, "Acme Bank Berhad Jan")], "doc_id long, name string")
    assert {(r.name, r.line) for r in anchors.headings(docs, items).collect()} == {("Acme Bank Berhad", 0), ("Acme Bank Berhad Jan", 0)}
    assert [r.lines for r in anchors.regions(docs, items).filter("name = 'Acme Bank Berhad'").collect()] == [["one two three four five six"] * 3]
    assert plan(anchors.regions(docs, items)).count("SortMergeJoin") + plan(anchors.regions(docs, items)).count("BroadcastHashJoin") <= 1


def test_headings_are_read_by_their_letters_in_one_pass(spark):
    """F6, F8: no text is rewritten to find its headings, and no cast fails on dates that begin with a month's name."""
    words = work_history.WORK_HEADINGS + work_history.OTHER_HEADINGS
    lines = [*words, "E D U C A T I O N ___", "WorK Experience:", "SKİLLS", "1. Référees", "experienced", "xskills", "", "日", "projectsı"]
    said = spark.createDataFrame([(x, f"a\n{x} b", f"a{x}\nb") for x in lines], "line string, text string, other string")
    key = F.regexp_replace(F.lower("line"), "[^a-z]", "")
    rows = said.select("line", key.isin(*words).alias("want"), work_history._reads(F.col("line"), words).alias("got"), work_history._has_heading(F.col("text"), words).alias("held"), work_history._has_heading(F.col("other"), words).alias("no")).collect()
    assert [r.line for r in rows if not r.want == r.got == r.held or r.no] == []
    docs = spark.createDataFrame([(1, "EXPERIENCE\nAug 2011 - 05/2015 | Firm Ltd | Analyst")], "doc_id long, text string")
    made = work_history.work_rows(docs)
    assert [(r.start, r.stop) for r in made.collect()] == [("Aug 2011", "May 2015")]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "lower(text" not in plan and "lower(line" not in plan


def test_one_writer_of_json(monkeypatch):
    """no encoder is made for each text."""
    monkeypatch.setattr(json_text.json, "dumps", None)
    assert json_text.canonical({"b": [1, "é\ud800"], "a": None}) == '{"a":null,"b":[1,"é�"]}'


def test_texts_meet_all_quotes_in_one_scan(spark):
    """the documents are read once and only what was found is shuffled."""
    text = plan(QUERIES["grounded_quotes"](spark, SF))
    assert text.count("MapInArrow") == 1 and text.count("FileScan parquet") == 2 and "Generate" not in text


def test_quotes_of_odd_texts(spark, tmp_path):
    """each row of the documents counts, repeated ids and null ids too; on both ways the same."""
    texts = ["the cat sat", "the\u00a0cat", "the\x1ccat", " the \x0b\f\r\n cat\t", "cat", None, "", " \n", "日本 語", "concat " * 3000 + "end", "a" * 3000]
    docs = spark.createDataFrame([(i, t) for t in texts for i in (1, 1, None, len(t or ""))], "doc_id long, text string")
    said = ["the cat", "the  cat", "e c", "c", "cat sat", "本 語", "本", "", None, " ", "concat concat concat end", "concat end x", "a" * 2999, "a" * 3001, "\x1c", "zz"]
    quotes = spark.createDataFrame(list(enumerate(said)) + [(3, "cat")], "item_id long, text string")
    assert len(same_as_sql(spark, "grounded_quotes", tmp_path, documents=docs, benchmark=quotes)) > 50
    ways = [Counter(map(tuple, match.evidence_anywhere(quotes.withColumnRenamed("text", "q"), docs, "q", "doc_id", "text", **most).collect())) for most in ({}, {"most": 0})]
    assert ways[0] == ways[1]


@pytest.mark.parametrize("size, places, listed", [(2**20, 2**18, 2**20), (50, 7, 3), (1, 1, 1)])
def test_phrases(monkeypatch, size, places, listed):
    for name, value in (("BYTES", size), ("PLACES", places), ("LISTED", listed)):
        monkeypatch.setattr(phrases, name, value)
    rng = random.Random(1)
    flat = lambda s: " ".join((s or "").split())
    for letters in ["a b", "ab", "aé\n\t x", "the cat"] * 5:
        some = lambda n: "".join(rng.choice(letters) for _ in range(n))
        texts = [rng.choice([None, "", some(70)]) for _ in range(10)] + [some(rng.randrange(80)) for _ in range(20)]
        sought = sorted({flat(some(rng.randrange(1, 30))) for _ in range(50)} | {flat(t)[3:].strip() for t in texts})
        sought = [p for p in sought if p]
        batch = pa.RecordBatch.from_arrays([pa.array([k or None for k in range(30)], pa.int64()), pa.array([t if t is None else t.encode() for t in texts], pa.binary())], names=["id", "t"])
        got = Counter((r["__q"], r["__id"]) for found in phrases.held(sought)([batch]) for r in found.to_pylist())
        assert got == Counter((p, k or None) for k, t in enumerate(texts) for p in sought if p in flat(t))
