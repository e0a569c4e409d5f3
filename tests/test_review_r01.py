
from __future__ import annotations

import re

import pyarrow.parquet as pq

from rosterlake.operators import match
from rosterlake.plans.all_queries import QUERIES

SF = "/root/testdata/sf0.001"


def rows_of(name: str, *columns: str, sf: str = SF) -> list[tuple]:
    t = pq.read_table(f"{sf}/{name}.parquet", columns=list(columns))
    return list(zip(*(t.column(c).to_pylist() for c in columns), strict=True))


def tokens(text: str) -> set[str]:
    return set(re.findall("[a-z0-9]+", (text or "").lower()))


def test_jaccard_best_over_all_documents(spark):
    docs = [(d, lang, tokens(t)) for d, lang, t in rows_of("documents", "doc_id", "lang", "text")]
    want = {}
    for d, lang, s in docs:
        near = [(-len(s & x) / len(s | x), o) for o, other, x in docs if o != d and other == lang and s | x]
        if near and -min(near)[0] >= 0.6:
            want[d] = (min(near)[1], round(-min(near)[0], 9))
    got = {r.doc_id: (r.other_id_best, round(r.similarity, 9)) for r in QUERIES["jaccard_best"](spark, SF).collect()}
    assert got == want


def test_token_sets_of_whole_texts(spark):
    want = {d: sorted(tokens(t) - {"the", "of", "and"}) for d, t in rows_of("documents", "doc_id", "text")}
    assert {r.doc_id: r.x for r in QUERIES["token_sets_docs"](spark, SF).collect()} == want


def test_blanks_first_sort_gives_all_rows(spark):
    sf = SF.replace("0.001", "0.01")
    labels = [("" if k % 4 == 0 else kind, k) for k, kind in rows_of("events", "event_id", "event_type", sf=sf)]
    got = [(r.label, r.event_id) for r in QUERIES["blanks_first_sort"](spark, sf).collect()]
    assert got == sorted(labels)


def test_usage_counters_of_all_events(spark):
    want = {}
    for (k,) in rows_of("events", "event_id"):
        i = 0 if k % 4 == 0 else k % 100
        state = "inconsistent" if i > 0 and k % 50 + k % 30 > i else "missing" if k % 7 == 0 else "complete"
        want[k] = (i or k % 50 + k % 30, state)
    assert {r.event_id: (r.input_tokens, r.state) for r in QUERIES["usage_counters_events"](spark, SF).collect()} == want


def test_quotes_are_grounded_in_all_documents(spark):
    flat = lambda t: re.sub(r"\s+", " ", t or "").strip()
    docs = [(d, flat(t)) for d, t in rows_of("documents", "doc_id", "text")]
    want = set()
    for i, q in rows_of("benchmark", "item_id", "text"):
        want |= {(i, d, True) for d, t in docs if flat(q) and flat(q) in t} or {(i, None, False)}
    got = [tuple(r) for r in QUERIES["grounded_quotes"](spark, SF).collect()]
    assert len(got) == len(want) and set(got) == want
    q = spark.createDataFrame([(1, "b c"), (2, "a  b\nc d"), (3, " "), (4, "x y z"), (5, "b")], "k int, q string")
    t = spark.createDataFrame([(1, "aa b c dd"), (None, "a b c d"), (3, None)], "d int, t string")
    found = {(r.k, r.d, r.grounded) for r in match.evidence_anywhere(q, t, "q", "d", "t").collect()}
    assert found == {(1, 1, True), (1, None, True), (2, 1, True), (2, None, True), (3, None, False), (4, None, False), (5, 1, True), (5, None, True)}
