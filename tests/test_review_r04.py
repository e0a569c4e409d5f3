"""Findings of the fourth review."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rosterlake.operators import anchors, match, set_blocks
from rosterlake.plans.all_queries import QUERIES

_TAIL = re.compile(rf"(?: (?:\d{{1,4}}|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*|{'|'.join(anchors.TAIL_WORDS)}))*")


def in_any_order(batches):
    """The rows, in another order each time that they are read."""
    for batch in batches:
        at = list(range(batch.num_rows))
        random.SystemRandom().shuffle(at)
        yield batch.take(pa.array(at))


def test_documents_may_come_in_another_order_each_time(spark):
    """the order of documents after a join is not fixed, so nothing may number them twice."""
    docs = spark.createDataFrame([(k, f"Firm {k}\nAward: {k}") for k in range(200)], "doc_id long, text string").coalesce(2)
    docs = docs.mapInArrow(in_any_order, docs.schema)
    items = spark.createDataFrame([(k, f"firm {k}", "") for k in range(200)], "doc_id long, name string, award string")
    got = anchors.restored_from_regions(docs, items, "award", "award").collect()
    assert len(got) == 200 and all(r.award == str(r.doc_id) for r in got)


def test_a_line_of_many_dates(spark):
    """no line is too long to be read."""
    many = " ".join(str(k % 3000) for k in range(30_000))
    docs = spark.createDataFrame([(1, f"Acme {many}\nAward: a\nBeta {many} x\n{many}")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "Acme"), (1, "Beta")], "doc_id long, name string")
    assert [(r.name, r.line) for r in anchors.headings(docs, items).collect()] == [("Acme", 0)]


@pytest.mark.parametrize("most", [12, 2])
def test_headings_and_regions_of_odd_documents(spark, monkeypatch, most):
    """repeated and null ids, names that begin alike or have many words, lines of signs only."""
    monkeypatch.setattr(anchors, "MOST_WORDS", most)
    rng = random.Random(most)
    words = ["acme", "Acme", "bank", "2001", "Jan", "ltd", "20011", "é", "present", "x", "日本", "—"]
    some = lambda n: rng.choice([" ", ", ", "  - "]).join(rng.choice(words) for _ in range(rng.randrange(n)))
    names = [(rng.choice([0, 1, 2, None]), rng.choice([some(4), some(20), None])) for _ in range(90)]
    texts = [(rng.choice([0, 1, 2, 3, None]), rng.choice(["\n", "\r\n", " "]).join(rng.choice([some(6), some(25), *((rng.choice(names)[1] or "") + tail for tail in ("", " - 2001 to Present", " x")), "!", " \t"]) for _ in range(40))) for _ in range(40)] + [(1, None), (2, "")]
    texts += texts[:3]
    docs, items = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(names, "doc_id long, name string")
    form = lambda s: " ".join(re.findall(r"[^\W_]+", s.lower()))
    want, areas = Counter(), Counter()
    for i, text in texts:
        lines = re.split("\r\n|[\n ]", text or "")
        heads = {n: [name for name in {name for j, name in names if j == i and i is not None and name and form(name)} if form(line).startswith(form(name)) and _TAIL.fullmatch(form(line)[len(form(name)) :])] for n, line in enumerate(lines)}
        want.update((i, name, n) for n, found in heads.items() for name in found)
        times = Counter(name for found in heads.values() for name in found)
        ends = [n for n, found in heads.items() if found] + [len(lines)]
        for n, end in zip(ends, ends[1:]):
            areas.update((i, name, n, tuple(x.strip(" ") for x in lines[n + 1 : end] if x.strip(" \t"))) for name in heads[n] if times[name] == 1)
    assert len(want) > 20 and len(areas) > 5
    assert Counter((r.doc_id, r.name, r.line) for r in anchors.headings(docs, items).collect()) == want
    assert Counter((r.doc_id, r.name, r.line, tuple(r.lines)) for r in anchors.regions(docs, items).collect()) == areas


def some_sets(rng, count):
    """Sets of 64-bit numbers of many sizes; some are like an earlier one."""
    sets = []
    for _ in range(count):
        base = list(rng.choice(sets)) if sets and rng.random() < 0.6 else []
        base = base[: rng.randrange(len(base) + 1)] if rng.random() < 0.3 else [x for x in base if rng.random() < 0.95]
        sets.append(set(base) | {rng.randrange(-(2**63), 2**63) for _ in range(rng.choice([1, 2, 5, 40, 300]) if rng.random() < 0.5 or not base else 1)})
    return sets


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("least", [0.3, 0.6, 0.95, 1.0])
def test_signatures_rule_out_no_similar_pair(least):
    """what differs in the signatures differs in the sets, in any width."""
    sets = some_sets(random.Random(3), 150)
    flat, n = np.array([x for s in sets for x in s]), np.array([len(s) for s in sets])
    ends = np.concatenate([[0], np.cumsum(n)])
    similar = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if jaccard(a, b) >= least}
    ruled_out = []
    for words in (1, 8, 2048):
        sig = set_blocks.signatures(flat, ends, words)
        assert (set_blocks.folded(set_blocks.signatures(flat, ends, 2 * words), words) == sig).all()
        near = set(zip(*(x.tolist() for x in set_blocks.near(n, sig, n, sig, least)), strict=True))
        assert similar <= near
        ruled_out.append(len(sets) ** 2 - len(near))
    assert ruled_out == sorted(ruled_out) and ruled_out[-1] > 0.9 * (len(sets) ** 2 - len(similar))


@pytest.mark.parametrize("rows, columns, chunk", [(128, 4096, 1024), (3, 5, 4), (1, 1, 1)])
def test_blocks_meet_by_signatures_first(monkeypatch, rows, columns, chunk):
    """of two blocks only the sets with a similar one are left, and their best are the best of all."""
    for name, value in (("ROWS", rows), ("COLUMNS", columns), ("CHUNK", chunk)):
        monkeypatch.setattr(set_blocks, name, value)
    rng = random.Random(rows)
    band = lambda s: int(np.floor(np.log(len(s)) / -np.log(0.6)))
    sets = {frozenset(s) for s in some_sets(rng, 400)}
    met = ruled_out = 0
    for first, second in ((10, 10), (10, 11), (3, 4), (1, 2)):
        side = lambda s: 0 if band(s) == first else 1
        here = [s for s in sets if band(s) in (first, second)]
        asks, answers = ([rng.random() < 0.8 for _ in here] for _ in range(2))
        table = pa.table({"fam": ["f"] * len(here), **{m: pa.array([0] * len(here), pa.int32()) for m in ("m1", "m2", "m3", "m4")}, "cls": [str(k) for k in range(len(here))], "asks": asks, "answers": answers, "first": list(range(len(here))), "n": pa.array([len(s) for s in here], pa.int32()), "band": pa.array(map(band, here), pa.int32()), "side": pa.array(map(side, here), pa.int32()), "t": pa.array([list(s) for s in here], pa.list_(pa.int64()))})
        allowed = lambda i, j: i != j and asks[i] and answers[j] and (first == second or side(here[i]) != side(here[j]))  # noqa: B023, E731
        want = {}
        for i, a in enumerate(here):
            found = [(-jaccard(a, b), j) for j, b in enumerate(here) if allowed(i, j) and jaccard(a, b) >= 0.6]
            if found:
                want[str(i)] = (-min(found)[0], min(found)[1])
        signed = pa.Table.from_batches(list(set_blocks.signed(0.6)(table.to_batches())))
        left = set(set_blocks.likely(0.6)(signed)["cls"].to_pylist())
        assert set(want) <= left
        met, ruled_out = met + len(here), ruled_out + len(here) - len(left)
        some = table.filter(pa.array([str(k) in left for k in range(len(here))]))
        got = {r["cls"]: (r["similarity"], r["other"]) for r in set_blocks.best(0.6)(some).to_pylist()}
        assert got == want
    assert ruled_out > 0.1 * met


@pytest.mark.parametrize("same", [True, False])
def test_best_of_many_small_blocks(spark, monkeypatch, same):
    """sets are dealt to blocks without loss, on one side or on two."""
    monkeypatch.setattr(set_blocks, "TOKENS", 60)
    monkeypatch.setattr(set_blocks, "SETS", 5)
    rng = random.Random(5)
    rows = [(k % 90, rng.choice(["a", "b", None]), sorted({f"w{x % 97}" for x in s})) for k, s in enumerate(some_sets(rng, 100))] + [(200, "a", []), (201, "a", None)]
    left, right = rows, rows if same else [(k, f, s and s[: rng.randrange(len(s)) + 1]) for k, f, s in rows[::2]]
    frame = lambda r, i, s: spark.createDataFrame(r, f"{i} long, fam string, {s} array<string>")
    got = match.best_jaccard(frame(left, "id", "s"), frame(right, "id2", "s2"), family="fam", left_id="id", right_id="id2", left_tokens="s", right_tokens="s2", least=0.6, same_rows=same).collect()
    want = Counter()
    for i, f, a in left:
        found = [(-jaccard(set(a), set(b)), j) for j, g, b in right if f == g and a and b and not (same and i == j) and jaccard(set(a), set(b)) >= 0.6]
        want.update([(i, min(found)[1], -min(found)[0])] if found else [])
    assert Counter(map(tuple, got)) == want and len(want) > 20


def test_texts_are_read_a_few_times_only(spark):
    """for the rows, the least ids of equal sets, and the sets; on small tables once more where a join is broadcast."""
    query = QUERIES["jaccard_best"](spark, "/root/testdata/sf0.001")
    query.collect()
    final = query._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("FileScan parquet") <= 4
