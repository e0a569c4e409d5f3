"""Media columns: texts as WAV samples, short-time Fourier transforms, spectral-peak pairs.

Each row is worked on alone, one row's audio at a time, long ones in blocks of
frames; there is no shuffle.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .kernels import buffers

#: Bytes to whose positive multiple a payload is filled up.
UNIT = 192
FRAME, HOP = 384, 192
#: Each peak is paired with so many next ones, at most so many frames on.
FANOUT, REACH = 2, 31
_BLOCK = 2048
_WINDOW = np.hanning(FRAME).astype(np.float32)


def to_wav(payload: bytes, rate: int = 16_000) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of each frame's strongest local peak in time and frequency.

    Level steps of the spectrum are compared, so silence has no peak.
    """
    x = samples.astype(np.float32) - 128
    if len(x) < FRAME:
        x = np.pad(x, (0, FRAME - len(x)))
    n = 1 + (len(x) - FRAME) // HOP
    frames = np.lib.stride_tricks.as_strided(x, (n, FRAME), (HOP * x.itemsize, x.itemsize))
    at, bins = [], []
    for lo in range(0, n, _BLOCK):
        hi = min(n, lo + _BLOCK)
        a, b = max(0, lo - 1), min(n, hi + 1)
        m = np.abs(np.fft.rfft(frames[a:b] * _WINDOW, axis=1))
        level = np.zeros((b - a + 2, FRAME // 2 + 3), dtype=np.int32)
        level[1:-1, 1:-1] = np.floor(m)
        level[1:-1, 1:4] = 0  # the mean of the samples tells nothing
        mid = level[1:-1, 1:-1]
        top = (mid > level[1:-1, :-2]) & (mid >= level[1:-1, 2:]) & (mid >= level[:-2, 1:-1]) & (mid >= level[2:, 1:-1])
        best = np.where(top, mid, 0)[lo - a : hi - a]
        k = best.argmax(axis=1)
        has = best[np.arange(len(k)), k] > 0
        at.append(lo + np.flatnonzero(has))
        bins.append(k[has])
    return np.concatenate(at), np.concatenate(bins)


def fingerprint(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(time, code) of pairs of neighbouring peaks; code = bin1 * 2**16 + bin2 * 2**6 + frames between."""
    t, f = peaks(samples)
    times, codes = [], []
    for k in range(1, FANOUT + 1):
        gap = t[k:] - t[:-k] if len(t) > k else np.zeros(0, np.int64)
        near = gap <= REACH
        times.append(t[: len(gap)][near])
        codes.append((f[: len(gap)][near] << 16) + (f[k : k + len(gap)][near] << 6) + gap[near])
    time, code = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((code, time))
    return time[order].astype(np.int32), code[order].astype(np.int32)


def media_columns(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """One row for each row: its text as 8-bit mono WAV, and what the stored bytes read back give.

    doc_id, n_bytes (UTF-8 length), payload_bytes (after spaces up to a
    positive multiple of 192), payload_sha256 and tail_crc32 (of the payload
    read back; the latter of its last 16 bytes), media_bytes, media_sha256,
    peak_times and peak_codes (arrays of int), feature (their pairs as text,
    `time:code` in hexadecimal), and media (binary) if keep_media.

    A null text counts as empty: 192 spaces. Equal texts have equal values.
    Repeated rows stay; null ids stay null; other columns are ignored. Empty
    table: no rows.
    """

    ship(docs.sparkSession)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                yield _converted(batch.slice(lo, 512), keep_media)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, peak_times array<int>, peak_codes array<int>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(convert, schema + (", media binary" if keep_media else ""))


def _converted(batch: pa.RecordBatch, keep_media: bool) -> pa.RecordBatch:
    data, offsets = buffers(batch.column(1))
    out: list[list] = [[] for _ in range(10 + keep_media)]
    for r in range(batch.num_rows):
        raw = data[offsets[r] : offsets[r + 1]].tobytes()
        media = to_wav(raw + b" " * (-len(raw) % UNIT if raw else UNIT))
        back = from_wav(media)
        time, code = fingerprint(np.frombuffer(back, dtype=np.uint8))
        feature = " ".join(f"{t:x}:{c:x}" for t, c in zip(time.tolist(), code.tolist(), strict=True))
        row = [len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, time, code]
        for k, v in enumerate([*row, media] if keep_media else row, 1):
            out[k].append(v)
    kinds = [None, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "peak_times", "peak_codes", "media"]
    return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, kinds[k]) for k, v in enumerate(out) if k)], names[: len(out)])
