"""Joins on hostile data: what they match equals all pairs, and no join makes many more rows than there are rows and matches."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from rosterlake.functions import cv, vectorised
from rosterlake.operators import match


def join_rows(df):
    """Output rows of the largest join of a DataFrame that was run."""
    seen, most = [df._jdf.queryExecution().executedPlan()], 0
    while seen:
        plan = seen.pop()
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            seen.append(plan.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            seen.append(plan.plan())
            continue
        if "Join" in name and plan.metrics().contains("numOutputRows"):
            most = max(most, plan.metrics().get("numOutputRows").get().value())
        children = plan.children()
        seen += [children.apply(k) for k in range(children.size())]
    return most


def test_names_with_one_beginning(spark):
    left = [(k, f"customer {k:05d}") for k in range(3000)] + [(9000, None), (9001, ""), (9002, "cust"), (9003, "abc")]
    right = [(f"Customer {k:05d} Ltd",) for k in range(0, 3000, 50)] + [("customer 00007 of many",), ("abc",), (None,), ("xab",)]
    df = match.fuzzy_semi_join(spark.createDataFrame(left, "id int, name string"), spark.createDataFrame(right, "other string"), "name", "other")
    got = sorted(r.id for r in df.collect())
    assert got == sorted([*range(0, 3000, 50), 7, 9002, 9003])
    assert join_rows(df) <= 3 * 30_000  # runs of four of the names that are asked for


def sets_of(rng, n, words, size):
    return [(k, rng.choice("ab") if k % 11 else None, sorted(rng.sample(words, rng.randrange(1, size)))) for k in range(n)]


@pytest.mark.parametrize("same_rows", [True, False])
def test_best_jaccard_equals_all_pairs(spark, same_rows):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(14)]
    left = sets_of(rng, 150, words, 7) + [(1000, "a", None), (1001, "a", []), (1002, "b", ["z"]), (1003, None, ["w1", "w1"])]
    right = left if same_rows else [(k + 5, f, s) for k, f, s in sets_of(rng, 150, words, 7)]
    names = lambda rows: spark.createDataFrame([(f"id{k:05d}", f, s) for k, f, s in rows], "id string, fam string, s array<string>")
    a, b = names(left), names(right).select(F.col("id").alias("rid"), "fam", F.col("s").alias("s2"))
    got = {r.id: (r.rid_best, round(r.similarity, 9)) for r in match.best_jaccard(a, b, family="fam", left_id="id", right_id="rid", left_tokens="s", right_tokens="s2", least=0.6, same_rows=same_rows).collect()}
    want = {}
    for k, f, s in left:
        found = [(-len(set(s) & set(t)) / len(set(s) | set(t)), f"id{m:05d}") for m, g, t in right if g == f and s and t and not (same_rows and m == k)]
        found = [x for x in found if -x[0] >= 0.6]
        if found:
            want[f"id{k:05d}"] = (min(found)[1], round(-min(found)[0], 9))
    assert got == want


def test_equal_sets_do_not_meet(spark):
    rows = [(k, "f", [f"t{j}" for j in range(40)]) for k in range(4000)] + [(9000 + k, "f", [f"t{j}" for j in range(39)] + [f"u{k}"]) for k in range(5)]
    a = spark.createDataFrame(rows, "id int, fam string, s array<string>")
    df = match.best_jaccard(a, a.select(F.col("id").alias("rid"), "fam", F.col("s").alias("s2")), family="fam", left_id="id", right_id="rid", left_tokens="s", right_tokens="s2", least=0.6, same_rows=True)
    got = {r.id: r.rid_best for r in df.collect()}
    assert got[0] == 1 and all(got[k] == 0 for k in range(1, 4000)) and all(got[9000 + k] == 0 for k in range(5))
    assert join_rows(df) <= 3 * len(rows)


def test_contacts_of_one_common_name(spark):
    people = [(k, "Tan Wei Ming", f"Firm {k}") for k in range(600)] + [(700, "Ann Bo", None), (701, None, "x")]
    contacts = [(k, "Wei Ming Tan", f"Firm {k} Sdn Bhd") for k in range(600)] + [(800, "Ann Bo", "Firm 1"), (801, "Ann Bo", None), (802, None, None)]
    p, c = spark.createDataFrame(people, "pid int, name string, company string"), spark.createDataFrame(contacts, "cid int, name string, company string")
    df = match.contact_matches(p, c, "pid", "cid", vectorised.name_match, best=3)
    got: dict = {}
    for r in df.collect():
        got.setdefault(r.pid, []).append((r.cid, r.score, r.company_matches))
    want: dict = {}
    for pid, n, co in people:
        if n:
            within = lambda x, y: bool(x and y) and (x.lower() in y.lower().removesuffix(" sdn bhd") or y.lower().removesuffix(" sdn bhd") in x.lower())
            scored = [(-min(100, s + 5 * same), not same, (m or "").lower(), cid, same) for cid, m, cc in contacts if m for same in [within(co, cc)] if (s := vectorised.name_score(n, m, same)) is not None]
            if scored:
                want[pid] = sorted((cid, -s, same) for s, _, _, cid, same in sorted(scored)[:3])
    assert {k: sorted(v) for k, v in got.items()} == want
    assert join_rows(df) <= 600 * 3 * 4 + 600 * 12  # not 360,000


def test_quotes_of_any_length(spark):
    rng = random.Random(7)
    words = ["a", "ab", "abc", "the", "then", "cat", "concat", "x.y"]
    texts = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 9)))) for k in range(120)] + [(500, None), (501, " the   cat\n")]
    quotes = [(k, q) for k, q in enumerate(["", None, "a", "b", "ab", "nca", "conca", "the cat", "he c", "n ab", "t the cat", "the cat co", "x.y", "zz", "zzzz", "zz the", "a a a", "the  cat "])] + [(3, "b")]
    df = match.evidence_anywhere(spark.createDataFrame(quotes, "k int, q string"), spark.createDataFrame(texts, "d int, t string"), "q", "d", "t")
    flat = lambda s: " ".join((s or "").split())
    want = []
    for k, q in quotes:
        hits = [d for d, t in texts if flat(q) and flat(q) in flat(t)]
        want += [(k, d, True) for d in hits] or [(k, None, False)]
    assert sorted(((r.k, r.d, r.grounded) for r in df.collect()), key=str) == sorted(want, key=str)
    assert "CartesianProduct" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_employers_in_proportion(spark):
    def took(n):
        df = spark.createDataFrame([([f"Firm {k % (n // 2)} Ltd" for k in range(n)],)], "names array<string>")
        began = time.perf_counter()
        assert len(df.select(cv.distinct_employers(F.col("names")).alias("e")).first().e) == n // 2
        return time.perf_counter() - began

    took(100)
    assert took(20_000) < 4
    rows = spark.createDataFrame([("s", 2, "ACME"), ("s", 1, "Acme"), ("s", 3, "Beta"), ("t", 1, " "), ("t", 2, None), (None, 1, "x")], "g string, o int, n string")
    got = {tuple(r) for r in cv.first_spellings(rows, "g", "o", "n").collect()}
    assert got == {("s", 1, "Acme"), ("s", 3, "Beta"), (None, 1, "x")}
