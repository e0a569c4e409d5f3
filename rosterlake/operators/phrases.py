"""Phrases looked for in texts, all at once: Numpy inside a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text that are searched together, places that are looked up at once, and pairs of a place or a text and a phrase that are listed at once.
BYTES, PLACES, LISTED = 2**20, 2**18, 2**20
#: Bytes of a key: what is looked up of a phrase; all of a shorter one.
KEY = 8
MIX = np.uint64(0x9E3779B97F4A7C15)


class Keys(NamedTuple):
    """The keys of one length; phrases and where the key stands in them, by key."""

    mask: np.uint64
    shift: np.uint64
    seen: np.ndarray
    key: np.ndarray
    start: np.ndarray
    phrase: np.ndarray
    before: np.ndarray


def _words(text: bytes) -> np.ndarray:
    """The eight bytes from each place on; of the last places, with line ends."""
    return np.ndarray(len(text), "<u8", text + b"\n" * KEY, strides=(1,))


def _spread(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count in turn."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _keys(phrases: list[bytes], length: int) -> Keys:
    """A phrase is looked up by its key that the fewest phrases have, the first of these."""
    own = np.array([k for k, p in enumerate(phrases) if min(len(p), KEY) == length])
    mask = np.uint64(2 ** (8 * length) - 1)
    sizes = np.array([len(phrases[k]) for k in own])
    places = sizes - length + 1
    owner, before = np.repeat(np.arange(len(own)), places), _spread(places)
    words = _words(b"".join(phrases[k] for k in own))[np.repeat(np.cumsum(sizes) - sizes, places) + before] & mask
    _, at, counts = np.unique(words, return_inverse=True, return_counts=True)
    order = np.lexsort((before, counts[at], owner))
    best = order[np.cumsum(places) - places]
    best = best[np.argsort(words[best], kind="stable")]
    key, start = np.unique(words[best], return_index=True)
    bits = min(max(16, (64 * len(key)).bit_length()), 24)
    shift = np.uint64(64 - bits)
    seen = np.zeros(2**bits, bool)
    seen[(key * MIX) >> shift] = True
    return Keys(mask, shift, seen, key, np.append(start, len(best)), own[owner[best]], before[best])


def _places(text: bytes, tables: list[Keys], sizes: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, phrases) where the key and the last eight bytes are those of the phrase: with up to eight bytes all of it."""
    words = _words(text)
    for t in tables:
        for a in range(0, len(text), PLACES):
            w = words[a : a + PLACES] & t.mask
            at = np.flatnonzero(t.seen[(w * MIX) >> t.shift])
            k = np.minimum(np.searchsorted(t.key, w[at]), len(t.key) - 1)
            same = t.key[k] == w[at]
            at, k = at[same] + a, k[same]
            each = t.start[k + 1] - t.start[k]
            ends = np.append(0, np.cumsum(each))
            lo = 0
            while lo < len(at):
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + LISTED, "right")) - 1)
                i = _spread(each[lo:hi]) + np.repeat(t.start[k[lo:hi]], each[lo:hi])
                phrase, place = t.phrase[i], np.repeat(at[lo:hi], each[lo:hi]) - t.before[i]
                inside = (place >= 0) & (place + sizes[phrase] <= len(text))
                phrase, place = phrase[inside], place[inside]
                if t.mask == np.uint64(2**64 - 1):
                    same = words[place + sizes[phrase] - KEY] == last[phrase]
                    phrase, place = phrase[same], place[same]
                yield place, phrase
                lo = hi


def held(phrases: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For batches of (id, text in UTF-8): a row (phrase, id) for each phrase that each text holds, white space of the text squeezed.

    Phrases are distinct, squeezed and not empty. Keys only find places; what is found there is compared byte by byte.
    """
    sought = [p.encode() for p in phrases]
    tables = [_keys(sought, n) for n in sorted({min(len(p), KEY) for p in sought})]
    sizes = np.array([len(p) for p in sought])
    last = np.array([int.from_bytes(p[-KEY:], "little") for p in sought], np.uint64)

    def search(rows: list[int], texts: list[bytes], ids: pa.Array) -> pa.RecordBatch:
        text = b"\n".join(texts)  # neither a text nor a phrase has a line end now
        starts = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        found: set[tuple[int, int]] = set()
        for place, phrase in _places(text, tables, sizes, last):
            for pair, at in zip(zip((np.searchsorted(starts, place, "right") - 1).tolist(), phrase.tolist()), place.tolist()):
                if pair not in found and text.startswith(sought[pair[1]], at):
                    found.add(pair)
        pairs = sorted(found)
        return pa.RecordBatch.from_arrays([pa.array([phrases[p] for _, p in pairs], pa.string()), ids.take(pa.array([rows[r] for r, _ in pairs], pa.int64()))], names=["__q", "__id"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.columns
            rows, texts, size = [], [], 0
            for row in range(len(column)):
                text = column[row].as_py()
                if text:
                    rows.append(row)
                    texts.append(b" ".join(text.split()))  # splits at the bytes that \s means in a pattern
                    size += len(texts[-1])
                if texts and (size >= BYTES or len(texts) * len(sought) >= LISTED or row == len(column) - 1):
                    yield search(rows, texts, ids)
                    rows, texts, size = [], [], 0

    return of
