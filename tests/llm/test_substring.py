"""Substring dedup against a version written out with plain loops, which compares bytes instead of digests."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterlake.llm import substring_dedup as sd

SPACE = b" \t\n\v\f\r"


def plain_mix(h: int) -> int:
    m = (1 << 64) - 1
    h ^= h >> 30
    h = h * 0xBF58476D1CE4E5B9 & m
    h ^= h >> 27
    h = h * 0x94D049BB133111EB & m
    return h ^ h >> 31


GEAR = [plain_mix(b + 1) >> 32 for b in range(256)]


def plain_boundaries(raw: bytes, window: int = sd.WINDOW) -> list[int]:
    places, blank = [], -1
    for i in range(1, len(raw)):
        h = 0
        for b in raw[:i]:
            h = (h << 4) + GEAR[b] & 0xFFFFFFFF
        if raw[i - 1] in SPACE:
            blank = i - 1
        word = raw[i - 1] in SPACE and raw[i] not in SPACE
        wide = raw[i] >= 0xE0 and h < 1 << 30
        deep = raw[i] not in SPACE and i - blank > sd.RUN and raw[i] & 0xC0 != 0x80 and h < 1 << 29
        if word or wide or deep:
            places.append((i, h))
    found = set()
    for k in range(max(1, len(places) - window + 1)):
        part = places[k : k + window]
        found |= {i for i, h in part if h == min(x for _, x in part)}
    return [0, *sorted(found), len(raw)]


def plain_dedup(rows: list[tuple[int, str | None]]) -> list[str | None]:
    """rows: (order, text); rows of one order are one row."""
    held: dict[bytes, tuple[int, int]] = {}
    cuts = []
    for rid, text in rows:
        raw = (text or "").encode()
        at = plain_boundaries(raw) if len(raw) > 1 else [0, len(raw)]
        own = []
        for k, a in enumerate(at[:-1]):
            ends = [b for b in at[k + 1 :] if b >= a + sd.MIN_BYTES]
            if ends:
                own.append((a, ends[0]))
                chunk = raw[a : ends[0]]
                held[chunk] = min(held.get(chunk, (rid, a)), (rid, a))
        cuts.append(own)
    out = []
    for (rid, text), own in zip(rows, cuts, strict=True):
        raw = (text or "").encode()
        gone = {i for a, b in own if held[raw[a:b]] != (rid, a) for i in range(a, b)}
        out.append(None if text is None else bytes(x for i, x in enumerate(raw) if i not in gone).decode())
    return out


def texts() -> list[str | None]:
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghiéü") for _ in range(rng.randint(2, 9)))
    make = lambda n: " ".join(word() for _ in range(n))
    passage = make(60)
    out: list[str | None] = [" ".join([make(rng.randint(0, 60)), passage, make(rng.randint(0, 60))]) for _ in range(6)]
    unbroken = "".join(rng.choice("0123456789abcdefXYZ+/") for _ in range(700))
    letters = "".join(chr(rng.randrange(0x4E00, 0x4F00)) for _ in range(250))
    out += [f"{make(5)} {unbroken} {make(9)}", f"{make(30)}\n{unbroken}", f"{make(3)}{letters}", letters, "same words here " * 40, None, "", "short", "z" * 400, make(80)]
    return out


@pytest.mark.parametrize("parts", [1, 2, 211])
def test_substring_dedup_equals_the_plain_version_however_partitioned(spark, parts):
    rows = [(k, t) for k, t in enumerate(texts())]
    rows += [rows[0], rows[6], rows[15], rows[15], (None, rows[1][1]), (None, rows[1][1]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    ids = {(r.doc_id, r.text): r.rid for r in docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("rid")).collect()}
    want = plain_dedup([(ids[r], r[1]) for r in rows])
    got = sd.substring_dedup(docs).select("doc_id", "text").collect()
    assert sorted(map(str, got)) == sorted(f"Row(doc_id={k!r}, text={t!r})" for (k, _), t in zip(rows, want, strict=True))
    assert want.count(rows[15][1]) == 3  # a row that is only read again keeps all its text


def test_unbroken_text_has_boundaries_wherever_it_stands():
    rng = random.Random(4)
    run = "".join(rng.choice("0123456789abcdef") for _ in range(3000)).encode()
    one, two = (np.frombuffer(x + run, dtype=np.uint8) for x in (b"a few words ", b"x"))
    a, b = ({int(d) for d in sd.chunks(x)[0]} for x in (one, two))
    assert len(a) > 50 and len(a & b) > 0.9 * len(a)


def test_least_of_each_window():
    rng = np.random.default_rng(1)
    for n in (0, 1, 4, 5, 6, 40):
        h = rng.integers(0, 9, n).astype(np.uint32)
        want = np.zeros(n, dtype=bool)
        for k in range(max(1, n - 4)):
            part = h[k : k + 5]
            if len(part):
                want[k : k + 5] |= part == part.min()
        assert sd._least(h, 5).tolist() == want.tolist()


def test_a_cut_needs_the_rows_own_digest():
    """Spans of another row under the same row hash do nothing."""
    raw = " ".join(f"word{k}" for k in range(60)).encode()
    _, check, start, _ = sd._digests(np.frombuffer(raw, dtype=np.uint8), sd.MIN_BYTES, sd.WINDOW)
    at = (check << np.uint64(32) | start.astype(np.uint64)).view(np.int64)
    assert sd._left(raw, at, sd.MIN_BYTES, sd.WINDOW)[0] == b""
    assert sd._left(raw, at ^ (1 << 40), sd.MIN_BYTES, sd.WINDOW) == (raw, [])
