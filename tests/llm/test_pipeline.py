"""The pipeline's stages against brute force on a small corpus."""

from __future__ import annotations

import random

import corpus_pipeline
from tests.llm.test_operators import brute_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus() -> list[tuple]:
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 8)))
    make = lambda n: " ".join(word() for _ in range(n))
    passage, item = make(70), make(30)
    rows = [(k, make(100), "en", f"s{k % 3}", 0) for k in range(30)]
    rows += [(30, rows[0][1], "en", "s0", 0), (31, rows[1][1] + " tail", "en", "s1", 0)]
    rows += [(40 + k, f"{make(60)} {passage} {make(60)}", "en", "s2", 0) for k in range(4)]
    rows += [(50, f"{make(40)} {item} {make(40)}", "en", "s2", 0), (51, "123 456", "en", "s1", 0), (52, None, "en", "s1", 0)]
    return [(a, b, c, d, len(b or "")) for a, b, c, d, _ in rows], passage, item


def test_stages(spark, tmp_path):
    rows, passage, item = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)

    kept = stage["language_id"](spark, docs, sf)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()} == {51, 52}

    single = stage["ngram_jaccard_join"](spark, kept, sf)
    want = {i for i, _, c in brute_components([r for r in rows if r[0] not in (51, 52)], 5, 80) if i == c}
    assert single.columns == docs.columns and {r.doc_id for r in single.collect()} == want
    assert not {30, 31} & want

    cut = stage["substring_dedup"](spark, single, sf)
    assert cut.columns == docs.columns and cut.count() == single.count()
    assert sum(passage in r.text for r in cut.collect()) == 1
    assert all(r.n_chars == len(r.text) for r in cut.collect())

    clean = stage["benchmark_decontamination"](spark, cut, sf)
    assert {r.doc_id for r in cut.collect()} - {r.doc_id for r in clean.collect()} == {50}

    mixed = stage["source_mixing"](spark, clean, sf)
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in clean.collect()}

    whole = corpus_pipeline.run(spark, sf)
    assert sorted(map(str, whole.collect())) == sorted(map(str, mixed.collect()))


def test_repeated_rows_leave_one(spark):
    rows, _, _ = corpus()
    docs = spark.createDataFrame([*rows[:5], rows[0], rows[0]], SCHEMA)
    got = dict(corpus_pipeline.STAGES)["ngram_jaccard_join"](spark, docs, "")
    assert sorted(r.doc_id for r in got.collect()) == [0, 1, 2, 3, 4]


def test_stages_of_nothing(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, fn in corpus_pipeline.STAGES:
        assert fn(spark, docs, str(tmp_path)).collect() == []
