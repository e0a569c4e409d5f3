"""Narrowed searches by truth tables, and quotas against a plain greedy fill."""

from __future__ import annotations

import itertools
import random

from pyspark.sql import functions as F

from rosterlake.functions.narrow import narrowed, operators
from rosterlake.operators.rank import filled_under_quotas


def of(spark, texts, made):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(made(F.col("t"))).collect()]


def test_stated_cases(spark):
    cases = {
        "a AND b": "a AND b",
        "a OR b OR c OR d OR e": "a OR b OR c OR d",
        "(a OR b OR c OR d OR e)": "(a OR b OR c OR d)",
        "(a OR b OR c) AND (d OR e OR f)": "(a OR b) AND (d OR e)",
        "a AND b AND c AND (d OR e)": "a AND b AND c AND d",
        "a AND b AND c AND d AND e": None,
        "(a OR A OR b OR c) AND x AND y": "(a OR b) AND x AND y",
        '("data AND sql" OR b) AND (c OR d) AND e AND f': '"data AND sql" AND c AND e AND f',
        "a AND NOT b AND c AND d": None,
        "(a OR (b AND c)) AND d AND e": None,
        "(a OR b) AND (c OR d": "(a OR b) AND (c OR d",
        "(a OR b OR c) AND (d OR e": None,
        'a OR "b OR c OR d OR e': None,
        "big data OR sql dev OR c OR d OR e": "big data OR sql dev OR c OR d",
        "": "",
        None: None,
    }
    assert of(spark, list(cases), narrowed) == list(cases.values())
    assert of(spark, ['"a AND b" OR c', None, "NOT x"], operators) == [1, 0, 1]


def test_truth_tables(spark):
    rng = random.Random(4)
    names = ["a", "b", "c", "d", "e", "f"]
    queries, wholes = [], []
    for _ in range(150):
        groups = [rng.sample(names, rng.randrange(1, 5)) for _ in range(rng.randrange(1, 5))]
        wholes.append(groups)
        queries.append(" AND ".join("(" + " OR ".join(g) + ")" if len(g) > 1 else g[0] for g in groups))
    for groups, query, short in zip(wholes, queries, of(spark, queries, narrowed), strict=True):
        kept = [part.strip("()").split(" OR ") for part in short.split(" AND ")] if short != query else groups
        assert len(kept) == len(groups) and all(k and set(k) <= set(g) and k[0] == g[0] for k, g in zip(kept, groups, strict=True))
        total = sum(len(k) for k in kept) - 1
        assert total <= 3 and total == min(3, sum(len(g) for g in groups) - 1)
        for truth in itertools.product([False, True], repeat=len(names)):
            held = dict(zip(names, truth, strict=True))
            holds = lambda gs: all(any(held[t] for t in g) for g in gs)  # noqa: B023, E731
            assert not holds(kept) or holds(groups)


def test_quotas_equal_greedy(spark):
    rng = random.Random(6)
    rows = [(k, rng.randrange(4), rng.randrange(5), p, rng.choice(["x", "y", None])) for k in range(40) for p in range(rng.randrange(1, 14))]
    want = []
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[2], r[3]))
        firsts = {}
        for r in own:
            firsts.setdefault(r[1], r)
        order = sorted(firsts.values(), key=lambda r: (-r[2], r[3])) + [r for r in own if firsts[r[1]] != r]
        room, taken = {"x": 2, "y": 3, None: 99}, 0
        for r in order:
            if taken < 6 and room[r[4]]:
                room[r[4]] -= 1
                taken += 1
                want.append((*r[:4], taken))
    df = spark.createDataFrame(rows, "k int, line int, priority int, place int, g string")
    got = filled_under_quotas(df, ["k"], "line", "priority", "place", "g", {"x": 2, "y": 3}, 6)
    assert sorted((r.k, r.line, r.priority, r.place, r.nth) for r in got.collect()) == sorted(want)
