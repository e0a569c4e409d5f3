"""The training-data operators against brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterlake.llm import decontaminate, kernels, license_scan, mixing, ngram_join, quality, substring_dedup, url_filter
from rosterlake.llm.bpe import ByteBpe, default_path, token_counts
from rosterlake.llm.common import components
from rosterlake.llm.language import Pieces, language_predictions
from rosterlake.llm.language import default_path as pieces_path
from rosterlake.llm.media import from_wav, media_columns, to_wav
from rosterlake.llm.ngram_join import Trie, linked, ngram_components

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, cid long, tok string"
WORD = re.compile("[^\x20\x09-\x0d]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: str) -> list[str]:
    return WORD.findall((text or "").translate(UPPER))


def odd_rows() -> list[tuple]:
    rng = random.Random(3)
    vocabulary = ["the", "of", "and"] + [f"w{k}é" for k in range(60)]
    long = " ".join(rng.choice(vocabulary) for _ in range(30_000))
    base = [rng.choice(vocabulary) for _ in range(120)]
    near = base[:50] + ["changed"] + base[51:]
    texts = [None, "", "   \n\t", "one", "one two", "one two three", "日本語テキスト", "!!! ???", " ".join(base), " ".join(base), " ".join(near), " ".join(base).upper(), long, long + " more", "a" * 5000]
    rows = [(k, t, "en" if k % 3 else None, None if k % 4 == 0 else f"s{k % 3}", None if k % 5 == 0 else len(t or ""), 7, "x") for k, t in enumerate(texts)]
    return [*rows, rows[8], (None, " ".join(base), "en", "s1", 3, 7, "x"), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOC)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def brute_components(rows, n, percent):
    sets = []
    for r in rows:
        w = words_of(r[1])
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups: dict[int, list] = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(rows[k][0])
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return sorted(((rows[k][0], len(sets[k]), least[find(k)]) for k in range(len(rows))), key=str)


@pytest.mark.parametrize(("n", "percent", "crowd"), [(4, 85, 64), (5, 80, 1), (2, 50, 1)])
def test_ngram_components_equal_brute_force(spark, odd, monkeypatch, n, percent, crowd):
    monkeypatch.setattr(ngram_join, "CROWD", crowd)
    monkeypatch.setattr(ngram_join._crowds, "__defaults__", (2,))
    got = sorted((tuple(r) for r in ngram_components(odd, n=n, percent=percent, bundle=2).collect()), key=str)
    assert got == brute_components(odd_rows(), n, percent)


def test_ngram_components_on_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute_components(rows, 4, 85)


def test_classes_whose_digests_begin_alike_stay_apart(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    got = ngram_components(spark.createDataFrame(rows * 2, "doc_id long, text string"), bits=3)
    want = {k: (n, c) for k, n, c in brute_components(rows, 4, 85)}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == want


def test_ngram_components_of_nothing(empty):
    assert ngram_components(empty).collect() == []


def test_trie_links_random_sets():
    rng = np.random.default_rng(1)
    for _ in range(20):
        base = np.sort(rng.choice(300, 60, replace=False))
        sets = [np.sort(np.unique(np.concatenate([base[rng.random(60) > 0.12], rng.choice(300, 4)]))) for _ in range(12)]
        trie = Trie(sets)
        for k in range(12):
            want = {j for j in range(12) if j != k and 100 * len(np.intersect1d(sets[k], sets[j])) >= 70 * len(np.union1d(sets[k], sets[j]))}
            assert set(trie.similar(k, 300, 70)) == want
        pairs = {(a, b) for a in range(12) for b in trie.similar(a, 300, 70)}
        for known in (None, [0] * 5 + list(range(5, 12))):
            parent = list(range(12))
            for a, b in [*linked(sets, 70, 3, known), *((0, k) for k in range(5) if known)]:
                parent = [parent[b] if x == parent[a] else x for x in parent]
            for a, b in pairs:
                assert parent[a] == parent[b]


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (103, 101), (5, 5), (None, 3), (200, 199), (199, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 103: 100, 199: 199, 200: 199}


def test_words_and_shingles_of_blocks(monkeypatch):
    import pyarrow as pa

    texts = ["A b\tc\n\n d", "", "  x", "é ü", "one two three four five " * 400]
    wanted = [list(s) for _, s in kernels.distinct_sets(pa.array(texts), 3)]
    monkeypatch.setattr(kernels, "BLOCK", 64)
    assert [list(s) for _, s in kernels.distinct_sets(pa.array(texts), 3)] == wanted
    assert [len(s) for s in wanted] == [2, 0, 1, 1, 5]


def test_quality_is_learned(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality_scores(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").filter("held_out").collect()
    assert len(got) > 80
    assert sum(r.predicted == r.quality for r in got) / len(got) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_quality_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, None), (None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int")
    assert quality.quality_scores(odd, labels).count() == odd.count()
    assert {r.score for r in quality.quality_scores(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(empty, labels).collect() == []


def test_machine_equals_all_pairs():
    rng = np.random.default_rng(0)
    m = quality.FactorisationMachine(0.3, rng.normal(size=quality.SIZE), rng.normal(size=(quality.SIZE, quality.RANK)))
    ix, x = np.array([3, 70, 9000]), np.array([0.5, 1.0, 2.0])
    pairs = sum(float(m.factors[ix[a]] @ m.factors[ix[b]]) * x[a] * x[b] for a in range(3) for b in range(a))
    assert m.logits(np.array([0, 3]), ix, x)[0] == pytest.approx(0.3 + float(m.linear[ix] @ x) + pairs)


def test_language_is_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 250
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.98


def test_language_of_odd_rows(spark, odd, empty):
    got = language_predictions(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[0].lang_pred == by[1].lang_pred == by[2].lang_pred == by[7].lang_pred == "und"
    assert by[3].lang_pred == "en"
    assert {r.lang_pred for r in language_predictions(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_predictions(empty).collect() == []


def test_forward_sums_all_segmentations():
    p = Pieces(pieces_path())
    chance = np.random.default_rng(2).random((len(p), 3)) / len(p)
    index = {x: k for k, x in enumerate(p.names)}
    data = [b" the", " für".encode(), b" internationalisation", b"\xff\x00"]
    flat = np.frombuffer(b"".join(data), dtype=np.uint8)
    size = np.array([len(d) for d in data])
    got = p.forward(flat, np.cumsum(size) - size, size, chance * (16.0 ** p.length)[:, None])
    for d, g in zip(data, got, strict=True):
        total = np.zeros((len(d) + 1, 3))
        total[0] = 1
        for i in range(len(d)):
            for j in range(i + 1, min(len(d), i + p.longest) + 1):
                if d[i:j] in index:
                    total[j] += total[i] * chance[index[d[i:j]]]
        assert np.allclose(g, np.log(total[-1]))
    even = 16.0 ** p.length / len(p)
    counts = p.expected(flat, np.cumsum(size) - size, size, np.ones((4, 1)), even)[0]
    assert float(counts @ p.length) == pytest.approx(len(flat))  # every byte is covered once


def test_licences(spark):
    docs = spark.createDataFrame([(1, "Intro.\nReleased under the MIT License.\nMore", 1), (2, "apache license\nVersion 2.0, January 2004\nx", 1), (3, "Apache License", 1), (4, None, 1), (5, "", 1), (1, "Licensed under CC BY-NC 4.0.", 1), (None, "MIT License! Licensed under the Apache License, Version 2.0.", 1)], "doc_id long, text string, sentence_ids int")
    got = sorted((r.doc_id or 0, r.licences) for r in license_scan.licence_scan(docs).collect())
    assert got == [(0, ["Apache-2.0"]), (1, ["CC-BY-NC-4.0"]), (1, ["MIT"]), (2, ["Apache-2.0"])]


def test_mixing_draws_poisson(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "'t' AS text", "CASE WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 1 THEN 'b' ELSE 'a' END AS source", "1 AS copy")
    got = mixing.poisson_mix(docs, spark.createDataFrame([("a", 1.0), (None, 2.0), ("zz", 5.0)], "source string, weight double"))
    n = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    assert "b" not in n and n["a"] == pytest.approx(20_000 / 3, rel=0.05) and n[None] == pytest.approx(40_000 / 3, rel=0.05)
    times = [r["count"] for r in got.filter("source is null").groupBy("doc_id").count().collect()]
    mean = 40_000 / 3 / 5000
    for k in (1, 2, 4):
        assert sum(t == k for t in times) / 5000 == pytest.approx(np.exp(-mean) * mean**k / math.factorial(k), abs=0.03)
    assert got.select("shuffle_key").distinct().count() == got.count()
    again = mixing.poisson_mix(docs.repartition(7), spark.createDataFrame([("a", 1.0), (None, 2.0)], "source string, weight double"))
    assert sorted(map(tuple, got.select("doc_id", "copy").collect())) == sorted(map(tuple, again.select("doc_id", "copy").collect()))


def test_mixing_of_odd_rows(odd, empty, monkeypatch):
    wide = sorted(map(str, mixing.poisson_mix(odd, scale=3.0).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, mixing.poisson_mix(odd, scale=3.0).collect())) == wide
    assert mixing.poisson_mix(empty).collect() == []


def test_mixing_with_a_large_rate(spark):
    docs = spark.createDataFrame([(1, "x", "a"), (2, "y", "b")], "doc_id long, text string, source string")
    n = mixing.poisson_mix(docs, spark.createDataFrame([("a", 1.0)], "source string, weight double"), scale=2000.0).count()
    assert 3500 < n < 4500


def brute_dedup(rows):
    first: dict[int, tuple] = {}
    found = {}
    for rid, text in rows:
        data = np.frombuffer((text or "").encode(), dtype=np.uint8)
        found[rid] = [(int(d), int(a), int(b)) for d, a, b in zip(*substring_dedup.chunks(data), strict=True)]
        for d, a, _ in found[rid]:
            first[d] = min(first.get(d, (rid, a)), (rid, a))
    out = {}
    for rid, text in rows:
        raw = (text or "").encode()
        keep = np.ones(len(raw), dtype=bool)
        for d, a, b in found[rid]:
            if first[d] != (rid, a):
                keep[a:b] = False
        out[rid] = None if text is None else bytes(np.frombuffer(raw, dtype=np.uint8)[keep]).decode()
    return out


def test_substring_dedup_equals_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghiéü") for _ in range(rng.randint(2, 9)))
    passage = " ".join(word() for _ in range(60))
    texts = [" ".join([*(word() for _ in range(rng.randint(0, 150))), passage, *(word() for _ in range(rng.randint(0, 150)))]) for _ in range(12)]
    texts += [texts[0], None, "", "short", "same words here " * 100, "".join(word() for _ in range(500)), " ".join(word() for _ in range(300))]
    docs = spark.createDataFrame([(k, t, "z") for k, t in enumerate(texts)], "doc_id long, text string, cut_bytes string").repartition(5)
    ids = {r.doc_id: r.rid for r in docs.select("doc_id", F.xxhash64("doc_id", "text").alias("rid")).collect()}
    want = brute_dedup([(ids[k], t) for k, t in enumerate(texts)])
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(docs).collect()}
    assert {k: r.text for k, r in got.items()} == {k: want[ids[k]] for k in range(len(texts))}
    assert sum(passage in (r.text or "") for r in got.values()) == 1
    assert got[len(texts) - 1].text == texts[-1] and got[len(texts) - 1].cut_spans == []


def test_substring_dedup_of_odd_rows(odd, empty):
    got = substring_dedup.substring_dedup(odd)
    assert got.count() == odd.count()
    assert len({r.text for r in got.filter("doc_id = 8").collect()}) == 1  # a repeated row is cut alike
    base = odd_rows()[8][1]  # in rows 8 (twice), 9 and one of null id: one of these keeps it
    assert {r.text for r in got.filter(F.col("doc_id").isin(8, 9) | F.col("doc_id").isNull()).collect()} == {base, "", None}
    assert substring_dedup.substring_dedup(empty).collect() == []


def test_chunks_resist_shifts():
    text = " ".join(f"word{k * 7919 % 1000}" for k in range(200)).encode()
    a = {int(d) for d in substring_dedup.chunks(np.frombuffer(text, dtype=np.uint8))[0]}
    b = {int(d) for d in substring_dedup.chunks(np.frombuffer(b"inserted " + text, dtype=np.uint8))[0]}
    assert len(a & b) > 0.9 * len(a)


def test_token_counts_equal_the_library(spark, odd, empty):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(default_path()), ByteBpe(default_path(), keep=50)
    rng = random.Random(1)
    texts = [r[1] or "" for r in odd_rows()] + ["don't I'LL", " <|endoftext|>a<|endoftext|>", "<|endof", "\x00\x1f\x85  x", "ab" * 500]
    texts += ["".join(rng.choice(" \n\tabcdeéü'st12.,!$<|>endoftext日𝔘́ \x1c​") for _ in range(rng.randrange(60))) for _ in range(500)]
    for t in texts:
        assert own.count(t) == len(library.encode(t, add_special_tokens=False).ids), t
    got = token_counts(odd)
    assert got.count() == odd.count()
    assert {(r.n_bytes, r.n_tokens, r.over_limit) for r in got.filter("doc_id in (0, 1)").collect()} == {(0, 0, False)}
    assert token_counts(empty).collect() == []


def brute_distance(item, part):
    row = [0] * (len(part) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(part, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_nearest_piece():
    rng = np.random.default_rng(4)
    for _ in range(200):
        item, part = rng.integers(0, 5, rng.integers(1, 9)).astype(np.uint64), rng.integers(0, 5, rng.integers(1, 14)).astype(np.uint64)
        d, a, b = decontaminate.nearest(item, part)
        assert d == brute_distance(item.tolist(), part.tolist())
        assert 0 <= a <= b <= len(part)
        assert brute_distance(item.tolist(), part[a:b].tolist()) == d


def test_leaks_recall_and_cleanness(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    hosts = [r.text.split() for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    rng = random.Random(6)
    rows, want = [], set()
    for k, (item, text) in enumerate(items * 5):
        w = text.split()
        for _ in range(int(0.1 * len(w))):
            at = rng.randrange(len(w))
            w[at : at + rng.choice([0, 1, 1])] = [f"edit{rng.random()}"] * rng.choice([0, 1])
        host = rng.choice(hosts)[:150]
        at = rng.randrange(len(host) + 1)
        rows.append((k, " ".join(host[:at] + w + host[at:])))
        want.add((k, item))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    assert len(got & want) / len(want) >= 0.95
    w = {k: words_of(t) for k, t in items}
    for k, item in got - want:  # whatever else is found is verified
        assert brute_distance(w[item], words_of(rows[k][1])) <= int(0.2 * len(w[item]) + 1e-9)
    exact = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame([(k, f"a b {t} c") for k, t in items], "doc_id long, text string"), bench).collect()}
    assert exact >= {(k, k) for k, _ in items}


def test_leaks_of_odd_rows(spark, odd, empty, monkeypatch):
    bench = spark.createDataFrame([(1, "one two three"), (2, None), (3, ""), (4, odd_rows()[8][1]), (4, odd_rows()[8][1]), (None, "one")], "item_id long, text string")
    rows = sorted({(str(r.doc_id), str(r.item_id)) for r in decontaminate.leaks(odd, bench).collect()})
    assert ("5", "1") in rows and ("8", "4") in rows and ("10", "4") in rows and ("None", "4") in rows and ("3", "None") in rows
    clean = decontaminate.without_leaks(odd, bench)
    kept = {str(r.doc_id) for r in clean.collect()}
    assert {"11", "12"} <= kept and not kept & {"3", "5", "8", "10"}
    monkeypatch.setattr(decontaminate, "ITEMS", 2)  # several passes
    assert sorted({(str(r.doc_id), str(r.item_id)) for r in decontaminate.leaks(odd, bench).collect()}) == rows
    assert {str(r.doc_id) for r in decontaminate.without_leaks(odd, bench).collect()} == kept
    assert decontaminate.leaks(empty, bench).collect() == [] and decontaminate.leaks(odd, bench.limit(0)).collect() == []
    assert decontaminate.without_leaks(odd, bench.limit(0)).count() == odd.count()


def test_url_verdicts_follow_aliases(spark):
    link = lambda href: f'<html><link rel="canonical" href="{href}"></html>'
    pages = [
        (1, "https://a.example.com/en/x", ""),  # blocked by rule
        (2, "http://other.org/p?q=1", link("https://a.example.com/en/x")),  # alias of it
        (3, "http://far.org/z", '<META http-equiv=refresh content="0; url=http://other.org/p?q=1">'),
        (4, "http://x.net/es/1", link("/plain")),  # blocked; its alias has no rule
        (5, "https://x.net/plain", ""),
        (6, "http://free.org/1", link("http://b.com/")),  # an allow stands in the group
        (7, "http://B.com/", link("http://x.net/es/2")),
        (8, None, None), (9, "no scheme", ""), (10, "http://WWW.Example.com/en/1#x", ""), (11, "http://example.com", ""), (5, "https://x.net/plain", ""),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.url_verdicts(df).collect()}
    assert got == {1: ("example.com/en/", "block"), 2: (None, "block"), 3: (None, "block"), 4: ("net/es/", "block"), 5: (None, "block"), 6: (None, "allow"), 7: ("com/", "allow"), 8: (None, "allow"), 9: (None, "allow"), 10: ("www.example.com/en/", "allow"), 11: (None, "allow")}
    rules = spark.createDataFrame([*url_filter.RULES], "host string, path string, action string")
    assert {r.page_id: (r.rule, r.verdict) for r in url_filter.url_verdicts(df, rules).collect()} == got
    hop = spark.createDataFrame([("http://new.org/", "http://far.org/z"), (None, "x")], "src string, dst string")
    assert url_filter.url_verdicts(df.union(spark.createDataFrame([(20, "http://new.org/", "")], df.schema)), redirects=hop).filter("page_id = 20").first().verdict == "block"
    assert url_filter.url_verdicts(df.limit(0)).collect() == []


def test_media_round_trip(odd, empty):
    got = media_columns(odd, keep_media=True).collect()
    assert len(got) == odd.count()
    texts = {k: r[1] for k, r in enumerate(odd_rows()) if r[0] is not None}
    for r in got:
        if r.doc_id is None:
            continue
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        back = from_wav(bytes(r.media))
        assert back == payload and bytes(r.media) == to_wav(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:]) and r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest() and r.media_bytes == len(r.media)
    by_text: dict = {}
    for r in got:
        by_text.setdefault(r.payload_sha256, set()).add(r.feature)
    assert all(len(v) == 1 for v in by_text.values()) and len({r.feature for r in got}) > 3
    assert media_columns(empty).collect() == []


def test_peaks_equal_a_plain_search():
    from rosterlake.llm import media

    x = np.frombuffer(b"".join(bytes([65 + k * k % 60]) for k in range(20_000)), dtype=np.uint8)
    t, f = media.peaks(x)
    whole, media._BLOCK = media._BLOCK, 7
    t2, f2 = media.peaks(x)
    media._BLOCK = whole
    assert t.tolist() == t2.tolist() and f.tolist() == f2.tolist() and len(t) > 10
