"""The transform, peaks and pairs of media columns against plain loops over a plain Fourier sum."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from rosterlake.llm import media


def plain_levels(payload: bytes) -> list[list[int]]:
    """Whole steps of the magnitudes of each frame's Fourier sum, bins of the mean silenced."""
    x = [b - 128.0 for b in payload]
    x += [0.0] * max(0, media.FRAME - len(x))
    angle = np.outer(np.arange(media.FRAME // 2 + 1), np.arange(media.FRAME)) * (-2j * math.pi / media.FRAME)
    turn = np.exp(angle)
    window = np.array([0.5 - 0.5 * math.cos(2 * math.pi * k / (media.FRAME - 1)) for k in range(media.FRAME)])
    out = []
    for at in range(0, len(x) - media.FRAME + 1, media.HOP):
        level = [math.floor(abs(v)) for v in turn @ (np.array(x[at : at + media.FRAME]) * window)]
        out.append([0] * 3 + level[3:])
    return out


def plain_peaks(levels: list[list[int]]) -> list[tuple[int, int]]:
    """Of each frame the strongest bin above the one before it and not under its other neighbours; the lowest of equal ones."""
    get = lambda t, f: levels[t][f] if 0 <= t < len(levels) and 0 <= f < len(levels[t]) else 0
    found = []
    for t, row in enumerate(levels):
        best = (0, 0)
        for f, v in enumerate(row):
            if v > get(t, f - 1) and v >= get(t, f + 1) and v >= get(t - 1, f) and v >= get(t + 1, f) and v > best[0]:
                best = (v, f)
        if best[0]:
            found.append((t, best[1]))
    return found


def plain_pairs(peaks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out = []
    for k, (t, f) in enumerate(peaks):
        for t2, f2 in peaks[k + 1 : k + 1 + media.FANOUT]:
            if t2 - t <= media.REACH:
                out.append((t, f * 2**16 + f2 * 2**6 + t2 - t))
    return sorted(out)


def payloads() -> list[bytes]:
    rng = random.Random(5)
    prose = " ".join(rng.choice(["the", "of", "rosters", "and", "lake", "9"]) for _ in range(900)).encode()
    tone = bytes(int(128 + 100 * math.sin(k / 3) + 20 * math.sin(k / 1.7)) for k in range(4000))
    quiet = prose[:600] + b" " * 20_000 + prose[:600]  # peaks too far apart to pair
    return [b" " * 192, prose[:100], prose, tone, quiet, bytes(rng.randrange(256) for _ in range(5000))]


@pytest.mark.parametrize("k", range(6))
def test_fingerprints_equal_a_plain_transform(k):
    raw = payloads()[k]
    raw += b" " * (-len(raw) % media.UNIT)
    levels = plain_levels(raw)
    want = plain_peaks(levels)
    t, f = media.peaks(np.frombuffer(raw, dtype=np.uint8))
    got = list(zip(t.tolist(), f.tolist(), strict=True))
    # Steps are taken of magnitudes in 32-bit numbers: where two are within rounding of a step, a peak may differ.
    assert len(set(got) ^ set(want)) <= 0.01 * len(want)
    time, code = media.fingerprint(np.frombuffer(raw, dtype=np.uint8))
    assert list(zip(time.tolist(), code.tolist(), strict=True)) == plain_pairs(got)


def test_the_query_gives_arrays_that_its_feature_spells(spark):
    docs = spark.createDataFrame([(1, payloads()[2].decode()), (2, None), (3, "")], "doc_id long, text string")
    for r in media.media_columns(docs).collect():
        assert r.feature == " ".join(f"{t:x}:{c:x}" for t, c in zip(r.peak_times, r.peak_codes, strict=True))
        assert list(r.peak_times) == sorted(r.peak_times)
