"""Alignment against the libraries on whole texts and a plain count of links."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rosterlake.llm import alignment
from rosterlake.llm.bpe import default_path
from rosterlake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "  ", "a", "a ", " a", "a  b", "a\n b", "a \nb", "a\n\n  b\n", "\n", "\t\n x", "word,word. Word;x!?\n", "naïve 日本語 𒀀x 𒀀", "ﬁne ① ² x². 2².", "<0x41> <s> </s> <unk> <|endoftext|>", "x▁y", "▁", "a\0b",
    "don't we'll they'Re x's.", "é é é, ́.", "  a　b  c\u0085 d", "\x1c a\x1d b\x1e", "a" * 3000, "日" * 500, "… — “x”", "12,345.67 3.", "🙂👩‍👩‍👧 ok", "﻿bom", "​z w​ .", "a .b , c ;d", "ａｂｃ，", "_x_ x_,y",
]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(default_path())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=alignment.piece_path())


def plain_groups(text, a, b):
    """[(a ids, b ids)] by decoded bytes alone."""
    letters = alignment._byte_letters()
    if not text:
        return []
    raw = (" " + text).encode()
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    bytes_a = [bytes(letters.index(c) for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
        return []
    out, ga, gb, i, j, pa, pb = [], [], [], 0, 0, 0, 0
    while i < len(ids_a) or j < len(ids_b):
        if pa <= pb:
            ga.append(ids_a[i])
            pa += len(bytes_a[i])
            i += 1
        else:
            gb.append(ids_b[j])
            pb += len(bytes_b[j])
            j += 1
        if pa == pb:
            out.append((ga, gb))
            ga, gb = [], []
    return out


def plain_table(rows, a, b):
    found = [(k, plain_groups(t, a, b)) for k, t in rows]
    counts = Counter((g[0][-1], g[1][-1]) for _, gs in found for g in gs)
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    out = []
    for k, gs in found:
        links = [(g[0][-1], g[1][-1]) for g in gs]
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in gs)
        out.append((k, sum(len(x) for x, _ in gs), sum(len(y) for _, y in gs), len(gs), hashlib.sha256(said.encode()).hexdigest() if gs else "", len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links)))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.groups_sha256, r.n_links, r.n_best, r.count_sum) for r in df.collect()), key=str)


def hostile(n):
    rng = random.Random(5)
    signs = ["a", "Zb", "é", "日", "𒀀", " ", "  ", "\n", "\t", ".", ",", "'s", "'", "²", "12", "▁", " ", "\x1c", "🙂", "-", "_", "<s>", "́", ";", "!", "?", "the", "ing"]
    return ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 40))) for _ in range(n)]


def test_parts_equal_whole_texts(libraries):
    texts = ODD + hostile(3000)
    got = alignment.Aligner(default_path(), alignment.piece_path(), keep=400).many(texts)
    for k, text in enumerate(texts):
        want = plain_groups(text, *libraries)
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in want)
        links = dict(zip(got.pair[got.start[k] : got.start[k + 1]].tolist(), got.times[got.start[k] : got.start[k + 1]].tolist(), strict=True))
        assert (got.groups[k].decode(), got.n_a[k], got.n_b[k]) == (said, sum(len(x) for x, _ in want), sum(len(y) for _, y in want)), repr(text)
        assert links == Counter(x[-1] << 32 | y[-1] for x, y in want), repr(text)


def test_refined_spans():
    np = alignment.np
    spans = np.array([[0, 2], [2, 4], [2, 4], [4, 4], [4, 4], [4, 7]])
    size = np.array([2, 1, 1, 1, 1, 1])
    assert alignment.refined(spans[:, 0], spans[:, 1], size).tolist() == [2, 3, 4, 5, 6, 7]
    assert alignment.refined(spans[:, 0], spans[:, 1], size + 1) is None


@pytest.mark.parametrize("pairs", [alignment.BROADCAST_PAIRS, 7, 0])
def test_statistics_by_broadcast_and_shuffle(spark, libraries, pairs):
    texts = ODD + hostile(60) + ["the the the cat"] * 20
    rows = [(k if k % 9 else None, t, 1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pairs int").repartition(5)
    aligned = alignment.settle(alignment.align_tokens(docs).withColumn("groups", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")).withColumnRenamed("groups", "groups_sha256"))
    assert rows_of(alignment.link_statistics(aligned, pairs)) == plain_table([(k, t) for k, t, _ in rows], *libraries)


def test_query_equals_plain(spark, libraries):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows_of(QUERIES["op12_token_alignment"](spark, SF)) == plain_table(rows, *libraries)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.alignment_digests(docs).collect() == []
    none = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    assert rows_of(alignment.alignment_digests(none)) == [(1, 0, 0, 0, "", 0, 0, 0), (None, 0, 0, 0, "", 0, 0, 0)]


def test_parts_of_a_word_are_joined_and_ids_said():
    """Two parts of a word are joined at once; one that no tokenizer keeps leaves the word without tokens."""
    x, none = alignment.Aligned(2, 1, b"1,2|3", (4,)), alignment._DIFFERS
    assert alignment._joined([x, x]) == alignment.Aligned(4, 2, b"1,2|3;1,2|3", (4, 4))
    assert alignment._joined([x, none]) == alignment._joined([none, x]) == alignment._joined([x, x, none]) == none
    aligner = alignment.Aligner(default_path(), alignment.piece_path())
    assert len(aligner.said) == 3 * aligner.many_ids and aligner.said[aligner.many_ids + 7] == b"7|"
