"""Vectorised byte kernels shared by the training-data operators.

They work on the value buffer of an Arrow string column with numpy, a few MB
at a time, so a task's memory is bounded by one Arrow batch plus a constant.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: ASCII white space: space, \t \n \v \f \r.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Each byte's value in the word hash, white space 0; folded: A-Z as a-z.
_VALUE = (np.arange(256) + 1).astype(np.uint64)
_VALUE[_SPACE] = 0
_FOLDED = np.where(_SPACE, 0, _LOWER.astype(np.uint64) + 1).astype(np.uint64)

_MULT = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULT, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}
#: Bytes of text worked on at a time.
BLOCK = 1 << 18


def _powers(kind: str, base: int, n: int) -> np.ndarray:
    """base ** (0 .. n-1) modulo 2**64, kept between calls."""
    have = _POWERS.get(kind)
    if have is None or len(have) < n:
        size = max(n, BLOCK)
        have = np.full(size, np.uint64(base), dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 8 * BLOCK:
            _POWERS[kind] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64, so that nearby inputs differ in all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null has the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    values = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return values[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `size` bytes; a longer text is alone in its range."""
    n, row = len(offsets) - 1, 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
        yield row, min(end, n)
        row = min(end, n)


def _word_bounds(data: np.ndarray, starts_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    space = _SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    last = ~space
    last[:-1] &= space[1:]
    inner = starts_at[(starts_at > 0) & (starts_at < len(data))]
    first[inner] = ~space[inner]
    last[inner - 1] = ~space[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, row) of each word `[^\\x20\\x09-\\x0D]+` of the rows, in order.

    fold: A-Z count as a-z. The hash is a polynomial modulo 2**64 through a
    finaliser. Rows longer than a block are cut at white space.
    """
    begin, end = _word_bounds(data, offsets[:-1])
    row = np.searchsorted(offsets, begin, side="right") - 1
    return hash_spans(data, begin, end, fold), begin, end, row


def hash_spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray, fold: bool = True) -> np.ndarray:
    """Hashes of ordered spans that do not overlap, with nothing but white space between them."""
    table = _FOLDED if fold else _VALUE
    hashes = np.empty(len(begin), dtype=np.uint64)
    i = 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(end, begin[i] + BLOCK, side="right")))
        lo, hi = begin[i], end[j - 1]
        value = table[data[lo:hi]] * _powers("up", _MULT, hi - lo)
        at = begin[i:j] - lo
        hashes[i:j] = np.add.reduceat(value, at) * _powers("down", _INVERSE, hi - lo)[at]
        i = j
    return mix(hashes)


#: A word's factor by its place in a shingle: unrelated odd numbers, so that orders of the same words differ.
_FACTORS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, offsets by row) of the n-word shingles of each row, repeats included.

    A row with fewer than n words (but some) has its whole sequence as its only shingle.
    """
    count = np.bincount(rows, minlength=n_rows)
    begin = np.concatenate(([0], np.cumsum(count)))
    m = len(hashes)
    total = np.zeros(max(0, m - n + 1), dtype=np.uint64)
    for k in range(n):
        total += hashes[k : k + len(total)] * _FACTORS[k]
    own = np.maximum(count - n + 1, 0)
    keep = rows[: len(total)] == rows[n - 1 :] if m >= n else np.zeros(0, bool)
    full = mix(total[keep] + np.uint64(n))
    short = np.flatnonzero((count > 0) & (count < n))
    sizes = own.copy()
    sizes[short] = 1
    at = np.concatenate(([0], np.cumsum(sizes)))
    out = np.empty(at[-1], dtype=np.uint64)
    is_short = np.zeros(at[-1], dtype=bool)
    is_short[at[short]] = True
    out[~is_short] = full
    for r in short:
        part = hashes[begin[r] : begin[r + 1]]
        h = sum(int(w) * int(f) for w, f in zip(part, _FACTORS, strict=False)) + len(part)
        out[at[r]] = mix(np.array([h & (1 << 64) - 1], dtype=np.uint64))[0]
    return out, at


def distinct_sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each row; empty without words."""
    data, offsets = buffers(column)
    for lo, hi in blocks(offsets):
        own = offsets[lo : hi + 1] - offsets[lo]
        h, _, _, rows = words(data[offsets[lo] : offsets[hi]], own)
        s, at = shingles(h, rows, hi - lo, n)
        for r in range(hi - lo):
            part = np.sort(s[at[r] : at[r + 1]])
            if len(part) > 1:
                part = part[np.concatenate(([True], part[1:] != part[:-1]))]
            yield lo + r, part


def digest(values: np.ndarray) -> tuple[int, int]:
    """128 bits, as two signed 64-bit numbers, of a sequence of uint64."""
    place = mix(np.arange(1, len(values) + 1, dtype=np.uint64))
    first = int(np.bitwise_xor.reduce(mix(values * np.uint64(3) + place))) if len(values) else 0
    second = int(np.add.reduce(mix(values ^ (place << np.uint64(1)))) & np.uint64((1 << 64) - 1)) if len(values) else 0
    pair = mix(np.array([first ^ len(values), (second + len(values)) & (1 << 64) - 1], dtype=np.uint64)).view(np.int64)
    return int(pair[0]), int(pair[1])
