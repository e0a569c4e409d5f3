"""CGK walks against plain loops, and recall by length, kind and share of edits."""

from __future__ import annotations

import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from rosterlake.llm import decontaminate, kernels

SF = "/root/testdata/sf0.001"
MASK = (1 << 64) - 1


def hashes(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
    return kernels.words(data, np.array([0, len(data)]))[0]


def vocabulary() -> list[str]:
    return [w for r in pq.read_table(f"{SF}/documents.parquet", columns=["text"]).column(0).to_pylist() for w in (r or "").split()]


def plain_mix(h: int) -> int:
    h ^= h >> 30
    h = h * 0xBF58476D1CE4E5B9 & MASK
    h ^= h >> 27
    h = h * 0x94D049BB133111EB & MASK
    return h ^ h >> 31


def plain_walk(words: list[int], at: int, walk: int, steps: int) -> list[int]:
    """The words that a CGK walk notes: it moves on where the random bit of (word, step) is set; past the end stands 0."""
    out = []
    for j in range(steps):
        w = words[at] if at < len(words) else 0
        out.append(w)
        at += plain_mix(w + 0x632BE59BD9B4E019 * (walk + 1) & MASK) >> (j & 63) & 1
    return out


def test_keys_are_samples_of_plain_walks():
    w = hashes(vocabulary()[:60])
    words = [int(x) for x in w]
    for least in (1, 2, 4, 8, 16, 32):
        wanted = [s for s in decontaminate.samples(least) if s.walk == 0]
        got = decontaminate.walk_keys(w, len(w), wanted)
        for k, s in enumerate(wanted):
            for at in (0, 7, 59):
                notes = plain_walk(words, at, 0, max(s.steps) + 1)
                key = 0
                for j in s.steps:
                    key = (key ^ notes[j]) * 0x9FB21C651E98DF25 & MASK
                assert int(got[k][at]) == plain_mix(key ^ k)


def edited(rng: random.Random, words: list[str], n: int, kind: str) -> list[str]:
    w = list(words)
    for at in sorted(rng.sample(range(len(w)), n), reverse=True):
        how = rng.choice(["replace", "insert", "delete"]) if kind == "mixed" else kind
        w[at : at + (how != "insert")] = [f"edit{rng.random()}"] * (how != "delete")
    return w


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 18, 22, 25, 31, 40, 64, 100, 200, 400])
@pytest.mark.parametrize("share", [0.1, 0.2])
def test_recall_by_length_and_kind_of_edit(n, share):
    rng, words = random.Random(n), vocabulary()
    items = [rng.choices(words, k=n) for _ in range(150 if n < 100 else 50)]
    index = decontaminate.Index([(k, hashes(i)) for k, i in enumerate(items)])
    for kind in ("replace", "insert", "delete", "mixed"):
        found = 0
        for k, item in enumerate(items):
            doc = hashes(rng.choices(words, k=40) + edited(rng, item, int(share * n + 1e-9), kind) + rng.choices(words, k=40))
            found += (0, k) in index.matches(doc, np.zeros(len(doc), dtype=np.int64))
        assert found / len(items) >= (1.0 if int(share * n + 1e-9) == 0 else 0.94), kind


def test_plans_follow_the_target():
    windows = [decontaminate.plan(64, e, 0.98)[0] for e in (0, 3, 6, 12)]
    assert windows == sorted(windows, reverse=True) and windows[0] == max(decontaminate.CLASSES)  # more edits, shorter windows
    least, apart = decontaminate.plan(40, 8, 0.5)
    assert (least, apart) > decontaminate.plan(40, 8, 0.99)  # less recall, fewer or longer windows
    assert decontaminate.plan(3, 0) == (2, 2) and decontaminate.plan(1, 0) == (1, 1)
