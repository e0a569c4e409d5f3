"""Substring dedup by content-defined chunks under a gear rolling hash.

The gear hash of the bytes before a word start ranks it; a word start that is
the least of some WINDOW of them in a row is a boundary. So boundaries move with
the text that they lie in, and any WINDOW word starts of a passage hold one.
Each boundary opens a chunk that ends at the first boundary at least
`min_bytes` on: chunks have all lengths, overlap, and need no common start, so a
repeated passage has the same chunks wherever it stands. Chunks are compared by
digest; of equal ones the first in a fixed order stays, and what all others
cover is cut out.

At scale: a chunk is three numbers in one shuffle by digest; equal chunks of one
Arrow batch are found before the shuffle, so that a passage in a third of all
rows sends one row a batch to its digest's task and spreads the rest; the
sorted stream keeps one digest in memory. Cuts go back to the rows by a join.
Digests have 96 bits, and a cut is made only where the row's own chunk there has
the digest that asked for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .common import ship
from .kernels import _SPACE, BLOCK, blocks, buffers, mix

#: Chunks cover at least so many bytes; a boundary is the least of so many places in a row.
MIN_BYTES, WINDOW = 100, 5
#: In a run without white space, letters this many bytes in are places too, one in eight; of letters of three bytes and more one in four is.
RUN = 32
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_FIRST, _SECOND = np.arange(1, 257, dtype=np.uint64), mix(np.arange(1001, 1257, dtype=np.uint64))
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_BACK = tuple(pow(b, -1, 1 << 64) for b in _BASES)
_FLAG = np.uint64(1 << 31)


def _least(h: np.ndarray, window: int) -> np.ndarray:
    """Which are the least of some `window` in a row (equal ones all are)."""
    n = len(h)
    if n <= window:
        return h == h.min(initial=(1 << 32) - 1)
    low = h[: n - window + 1].copy()
    for k in range(1, window):
        np.minimum(low, h[k : k + len(low)], out=low)
    wide = np.concatenate((np.zeros(window - 1, h.dtype), low, np.zeros(window - 1, h.dtype)))
    high = wide[:n].copy()
    for k in range(1, window):
        np.maximum(high, wide[k : k + n], out=high)
    return high == h


def boundaries(data: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Boundaries of one text: 0, its end, and content-defined starts of words or letters."""
    n = len(data)
    if n < 2:
        return np.array([0, n])
    h = _GEAR[data]
    for k in (1, 2, 4):  # h[i] = sum of gear[data[i - j]] << 4 j for j < 8
        h[k:] = h[k:] + (h[:-k] << np.uint32(4 * k))
    h = h[:-1]
    space = _SPACE[data]
    place = (space[:-1] & ~space[1:]) | ((data[1:] >= 0xE0) & (h < np.uint32(1 << 30)))
    blank = np.flatnonzero(space)
    if np.diff(blank, prepend=-1, append=n).max() > RUN:
        deep = np.arange(n) - np.maximum.accumulate(np.where(space, np.arange(n), -1)) > RUN
        place |= deep[1:] & ((data[1:] & 0xC0) != 0x80) & (h < np.uint32(1 << 29))
    at = np.flatnonzero(place)
    return np.concatenate(([0], at[_least(h[at], window)] + 1, [n]))


def _digests(data: np.ndarray, min_bytes: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(digest, check, start, end) of all chunks of one text, by start; none if it is shorter than min_bytes."""
    at = boundaries(data, window)
    stop = np.searchsorted(at, at[:-1] + min_bytes)
    start = at[:-1][stop < len(at)]
    end = at[stop[stop < len(at)]]
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), start, end
    both = []
    for base, back, values in zip(_BASES, _BACK, (_FIRST, _SECOND), strict=True):
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(values[data] * _power(base, len(data)), out=total[1:])
        both.append(mix((total[end] - total[start]) * _power(back, len(data))[start] + (end - start).astype(np.uint64)))
    return both[0], both[1] >> np.uint64(32), start, end


def chunks(data: np.ndarray, min_bytes: int = MIN_BYTES, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digest, start, end) of all chunks of one text, by start; none if it is shorter than min_bytes."""
    digest, _, start, end = _digests(data, min_bytes, window)
    return digest, start, end


_KEPT: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _KEPT.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, BLOCK), np.uint64(base), dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if len(have) <= 8 * BLOCK:
            _KEPT[base] = have
    return have[:n]


def _row_chunks(min_bytes: int, window: int):
    """(key, rid, at) of the chunks: at holds, from the top, 32 bits of check, a flag, 31 bits of start."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = batch.column(0).to_numpy()
            data, offsets = buffers(batch.column(1))
            for lo, hi in blocks(offsets, 4 << 20):
                found = [_digests(data[offsets[r] : offsets[r + 1]], min_bytes, window) for r in range(lo, hi)]
                digest = np.concatenate([x[0] for x in found])
                at = np.concatenate([x[1] for x in found]) << np.uint64(32) | np.concatenate([x[2] for x in found]).astype(np.uint64)
                row = np.repeat(rid[lo:hi], [len(x[0]) for x in found])
                tag = at >> np.uint64(31)
                order = np.lexsort((at, row, tag, digest))
                digest, at, row, tag = digest[order], at[order], row[order], tag[order]
                again = np.zeros(len(digest), dtype=bool)
                again[1:] = (digest[1:] == digest[:-1]) & (tag[1:] == tag[:-1])
                # The very same row read again (repeated rows) is no repeat of itself.
                once = np.ones(len(digest), dtype=bool)
                once[1:] = ~(again[1:] & (row[1:] == row[:-1]) & (at[1:] == at[:-1]))
                # Of one digest here, all but the first are repeats wherever the corpus' first is; they need not meet it.
                key = np.where(again, mix(row.view(np.uint64) + at), digest)
                at = np.where(again, at | _FLAG, at)
                yield pa.RecordBatch.from_arrays([pa.array(x[once].view(np.int64)) for x in (key, row, at)], ["key", "rid", "at"])

    return find


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, at) of the flagged rows and of all but the first of those of a digest; the rows come by (key, check and flag, rid, at)."""
    last: tuple[int, int, int, int] | None = None
    for batch in batches:
        key, rid, at = (batch.column(k).to_numpy() for k in range(3))
        at = at.view(np.uint64)
        tag = at >> np.uint64(31)
        flagged = (tag & np.uint64(1)).astype(bool)
        again = np.zeros(len(key), dtype=bool)
        again[1:] = (key[1:] == key[:-1]) & (tag[1:] == tag[:-1])
        if len(key):
            again[0] = last is not None and last[:2] == (key[0], tag[0])
            # The very same row read again (repeated rows) is no repeat of itself.
            head = np.maximum.accumulate(np.where(again, 0, np.arange(len(key))))
            head_rid, head_at = rid[head], at[head]
            if again[0]:
                own = (head == 0) & (key == key[0]) & (tag == tag[0])
                head_rid, head_at = np.where(own, last[2], head_rid), np.where(own, np.uint64(last[3]), head_at)
            last = (int(key[-1]), int(tag[-1]), int(head_rid[-1]), int(head_at[-1]))
            again &= (rid != head_rid) | (at != head_at)
        keep = again | flagged
        yield pa.RecordBatch.from_arrays([pa.array(rid[keep]), pa.array((at[keep] & ~_FLAG).view(np.int64))], ["rid", "at"])


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES, window: int = WINDOW) -> DataFrame:
    """(rid, spans): for rows with repeats, the chunks to cut as array<long> of check << 32 | start byte; rid is a hash of id and text."""
    ship(docs.sparkSession)
    rows = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("rid"), F.col(text_col).alias("text")).filter("text is not null")
    found = rows.mapInArrow(_row_chunks(min_bytes, window), "key long, rid long, at long")
    again = found.repartition("key").sortWithinPartitions("key", F.shiftrightunsigned("at", 31), "rid", "at").mapInArrow(_repeats, "rid long, at long")
    return again.groupBy("rid").agg(F.collect_set("at").alias("spans"))  # at most the chunks of one text


def _left(raw: bytes, spans: np.ndarray, min_bytes: int, window: int) -> tuple[bytes, list[int]]:
    """What stays of one text, and (start, end, start, ...) of what does not."""
    _, check, start, end = _digests(np.frombuffer(raw, dtype=np.uint8), min_bytes, window)
    own = np.isin(check << np.uint64(32) | start.astype(np.uint64), spans.astype(np.int64).view(np.uint64))
    joined: list[int] = []
    for a, b in zip(start[own].tolist(), end[own].tolist(), strict=True):
        if joined and a <= joined[-1]:
            joined[-1] = max(joined[-1], b)
        else:
            joined += (a, b)
    edges = [0, *joined, len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)), joined


def substring_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES, window: int = WINDOW) -> DataFrame:
    """All rows and columns of `docs`, repeats cut out of the text, with cut_bytes and cut_spans (array<int>: start, end, start, ...).

    Of equal chunks the first in the order of (hash of id and text, place)
    stays. Chunks start and end at word starts (in long runs without white
    space, and among letters of three bytes, at letter starts), so no letter is
    cut in two. Rows stay even if nothing is left of the text (then it is
    empty); null and empty texts and those under min_bytes are unchanged. Rows
    with the same id and text count as one and are cut alike, however they are
    partitioned; rows with a null id and equal texts are such. Columns named
    cut_bytes or cut_spans are replaced. Empty table: no rows.
    """
    spans = repeated_spans(docs, id_col=id_col, text_col=text_col, min_bytes=min_bytes, window=window)
    rows = docs.drop("cut_bytes", "cut_spans")
    at = rows.columns.index(text_col)
    schema = StructType([*rows.schema.fields, StructField("cut_bytes", IntegerType()), StructField("cut_spans", ArrayType(IntegerType()))])
    width = len(rows.columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                texts, found = batch.column(at), batch.column(width)
                out, bytes_, places = [], [], []
                for k in range(batch.num_rows):
                    text, own = texts[k].as_py(), found[k].as_py()
                    if own:
                        raw = text.encode("utf-8")
                        left, joined = _left(raw, np.array(own, dtype=np.int64), min_bytes, window)
                        out.append(left.decode("utf-8"))
                        bytes_.append(len(raw) - len(left))
                        places.append(joined)
                    else:
                        out.append(text)
                        bytes_.append(0)
                        places.append([])
                columns = list(batch.columns[:width])
                columns[at] = pa.array(out, pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(bytes_, pa.int32()), pa.array(places, pa.list_(pa.int32()))], names=schema.names)

    marked = rows.withColumn("__rid", F.xxhash64(F.col(id_col), F.col(text_col)))
    met = marked.join(spans.select(F.col("rid").alias("__rid"), F.col("spans").alias("__spans")), "__rid", "left")
    return met.select(*rows.columns, "__spans").mapInArrow(cut, schema)
