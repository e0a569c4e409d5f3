"""Ranked search against a plain scorer."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from rosterlake.llm import lexical_search
from rosterlake.llm.lexical_search import ranked_search

DOC = "doc_id long, text string, h long, bag binary, cid long, rank int"
ITEM = "item_id long, text string, score long"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(UPPER))


def plain(docs, items, top):
    held = [(k, Counter(ws), len(ws)) for k, t, *_ in docs if (ws := words(t))]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item_id, text in {(k, t) for k, t, *_ in items}:
        scored = []
        for k, c, n in held:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in words(text) if c[t])
            if score > 0:
                scored.append((-score, k is None, k))
        out += [(item_id, r, k, -s) for r, (s, _, k) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return sorted(out, key=str)


def table(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


def corpus():
    rng = random.Random(11)
    vocabulary = ["the", "of", "Über", "ÄB", "naïve", "日本", "x1", "A", "zeta", "tail"] + [f"w{k}" for k in range(30)]
    texts = [None, "", "...", "日本 日本", "the", "THE the, The.", "a" * 3000, "under_score snake-case", "É é", " ".join(rng.choice(vocabulary) for _ in range(20_000))]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    texts += ["the zeta copies"] * 60  # one class of more members than a list has places
    docs = [(k * 7 % 1009, t, 1, b"", 2, 3) for k, t in enumerate(texts)]
    docs += [docs[4], docs[-1], (None, "the zeta copies", 1, b"", 2, 3), (None, "naïve", 1, b"", 2, 3)]
    items = [(1, "The zeta of naïve naïve"), (2, "nothing-known qqq"), (3, None), (4, "..."), (5, "zeta zeta zeta copies"), (5, "w1 w2"), (1, "The zeta of naïve naïve"), (None, "日本 x1"), (6, "the " * 40), (7, "ÉÄ É é über")]
    return docs, [(*x, 9) for x in items]


@pytest.mark.parametrize(("top", "entries", "large"), [(20, 500_000, 64 << 20), (3, 6, 0)])
def test_equals_plain(spark, monkeypatch, top, entries, large):
    monkeypatch.setattr(lexical_search, "BLOCK_ENTRIES", entries)
    monkeypatch.setattr(lexical_search, "BROADCAST_BYTES", large)
    docs, items = corpus()
    got = ranked_search(spark.createDataFrame(docs, DOC).repartition(6), spark.createDataFrame(items, ITEM), top=top)
    assert table(got) == plain(docs, items, top)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "int", "bigint", "bigint"]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "the")], "doc_id long, text string"), spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert ranked_search(docs.limit(0), items).collect() == []
    assert ranked_search(docs, items.limit(0)).collect() == []
    assert ranked_search(spark.createDataFrame([(1, None), (2, "!")], "doc_id long, text string"), items).collect() == []


def test_winners_keep_what_all_rows_would():
    np = lexical_search.np
    rng = np.random.default_rng(2)
    scores, first = rng.integers(0, 6, (400, 3)), rng.permutation(400)
    null = rng.random(400) < 0.1
    best = lexical_search._Winners(5, 3)
    for lo in range(0, 400, 37):
        at = slice(lo, lo + 37)
        best.add(scores[at], first[at], null[at], [(k,) for k in range(lo, min(lo + 37, 400))])
    for item in range(3):
        want = sorted((-s, bool(z), f, k) for k, (s, f, z) in enumerate(zip(scores[:, item].tolist(), first.tolist(), null.tolist(), strict=True)) if s > 0)[:5]
        assert [r[0] for r, i in zip(best.row, best.item.tolist(), strict=True) if i == item] == [x[3] for x in want]
