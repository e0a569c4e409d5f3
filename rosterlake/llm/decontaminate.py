"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

The CGK walk reads a word sequence by random bits: at each step it notes the
word it stands on and moves on or stays by a random bit of that word and step,
so a small edit distance becomes a small Hamming distance of the notes. Some
steps are sampled to a key, in several walks and samples. Walks start at every
word of a document, and in each item at as many places, over windows of as many
words, as the wanted recall needs: the window is as long as the item where no
edits are allowed, and shorter, repeated along the item, the more are. What
shares a key is verified by the exact edit distance of the item to the best part
of the document there.

At scale: one map over the documents, no shuffle of texts. Items are taken in
blocks of ITEMS, so what is broadcast is bounded whatever the benchmark's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .kernels import blocks, buffers, mix, words

#: Items in one pass over the documents.
ITEMS = 20_000
#: Random walks, samples from each, words in a sample.
WALKS, SAMPLES, WORDS = 2, 4, 4
#: Walks of the classes of under 4 words, whose samples are few.
SHORT_WALKS = 8
#: Words of the shortest item of a class, in order: an item's walks stay in it.
CLASSES = (1, 2, 4, 8, 16, 32)
#: An item is found where at least this share of its words needs no edit, with this chance at the most edits allowed.
SIMILARITY, RECALL = 0.8, 0.98
#: Random placements of edits that a plan is tried on.
TRIALS = 400
_PART = 1 << 14
_TABLE = 20


@dataclass(frozen=True)
class Sample:
    """A class's key: the walk's seed, the class's first size, the sampled steps."""

    walk: int
    least: int
    steps: tuple[int, ...]


def samples(least: int, walks: int | None = None, each: int = SAMPLES, n_words: int = WORDS) -> list[Sample]:
    """Steps up to 3/2 of the least size (a walk moves on at every second step on average), one from each equal part."""
    length = max(1, least * 3 // 2) if least > 1 else 1
    walks = walks or (1 if least == 1 else SHORT_WALKS if least < 4 else WALKS)
    found = set()
    for w in range(walks):
        rng = np.random.default_rng([least, w])
        for _ in range(each):
            edges = np.linspace(0, length, min(n_words, length) + 1).astype(int)
            found.add((w, tuple(int(rng.integers(a, b)) for a, b in zip(edges[:-1], edges[1:], strict=True))))
    return [Sample(w, least, s) for w, s in sorted(found)]


def walk_keys(word_hash: np.ndarray, starts: int, wanted: list[Sample]) -> np.ndarray:
    """Keys (samples x starts) of the walks from each of the first `starts` words; past the end stands the word 0.

    All of `wanted` belong to one walk.
    """
    last = max(max(s.steps) for s in wanted)
    w = np.concatenate([word_hash, np.zeros(last + 2, dtype=np.uint64)])
    bits = mix(w + np.uint64(0x632BE59BD9B4E019 * (wanted[0].walk + 1) & (1 << 64) - 1))
    pos = np.arange(starts)
    keys = np.zeros((len(wanted), starts), dtype=np.uint64)
    for j in range(last + 1):
        for k, s in enumerate(wanted):
            if j in s.steps:
                keys[k] = (keys[k] ^ w[pos]) * np.uint64(0x9FB21C651E98DF25)
        if j < last:
            pos = pos + ((bits[pos] >> np.uint64(j & 63)) & np.uint64(1)).astype(np.int64)
    return mix(keys ^ np.arange(len(wanted), dtype=np.uint64)[:, None])


def walk_spans(word_hash: np.ndarray, starts: int, sample: Sample) -> np.ndarray:
    """How many words a sample depends on, from each of the first `starts` words: up to where its last sampled step stands."""
    last = max(sample.steps)
    w = np.concatenate([word_hash, np.zeros(last + 2, dtype=np.uint64)])
    bits = mix(w + np.uint64(0x632BE59BD9B4E019 * (sample.walk + 1) & (1 << 64) - 1))
    pos = np.arange(starts)
    for j in range(last):
        pos = pos + ((bits[pos] >> np.uint64(j & 63)) & np.uint64(1)).astype(np.int64)
    return pos - np.arange(starts) + 1


class Index:
    """The keys of a block of items; `items` are (id, words) with at least a word each."""

    def __init__(self, items: list[tuple[int, np.ndarray]], similarity: float = SIMILARITY, target: float = RECALL):
        self.items = items
        self.most_edits = [int(np.floor((1 - similarity) * len(w) + 1e-9)) for _, w in items]
        plans = [_starts(len(w), e, target) for (_, w), e in zip(items, self.most_edits, strict=True)]
        self.classes = sorted({c for p in plans for c, _ in p} | ({1} if any(len(w) < 5 for _, w in items) else set()))
        every = [s for c in self.classes for s in samples(c)]
        self.wanted = {walk: [s for s in every if s.walk == walk] for walk in range(max((s.walk for s in every), default=-1) + 1)}
        keys: dict[int, list[np.ndarray]] = {walk: [] for walk in self.wanted}
        owners: dict[int, list[np.ndarray]] = {walk: [] for walk in self.wanted}
        for number, (_, w) in enumerate(items):
            found = False
            for least, starts in [*plans[number], (1, np.zeros(1, dtype=np.int64))]:
                if least == 1 and found:
                    continue  # a single word is the key only of an item that no walk stays in
                for walk, wanted in self.wanted.items():
                    if not any(s.least == least for s in wanted):
                        continue
                    got = walk_keys(w, len(w), wanted)
                    for k, s in enumerate(wanted):
                        if s.least == least:
                            span = walk_spans(w, len(w), s)[starts]
                            own = starts[(starts + span <= len(w)) & (span >= min(2, least))]
                            found = found or len(own) > 0
                            keys[walk].append(got[k][own])
                            owners[walk].append(np.stack([np.full(len(own), number), own], 1))
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for walk in self.wanted:
            key = np.concatenate([np.zeros(0, dtype=np.uint64), *keys[walk]])
            whose = np.concatenate([np.zeros((0, 2), dtype=np.int64), *owners[walk]])
            order = np.argsort(key, kind="stable")
            bitmap = np.zeros(1 << _TABLE, dtype=bool)
            bitmap[(key >> np.uint64(64 - _TABLE)).astype(np.int64)] = True
            self.tables[walk] = (key[order], whose[order], bitmap)

    def candidates(self, w: np.ndarray) -> np.ndarray:
        """Distinct (item, word where it would start) of walks that share a key with the word sequence."""
        found = [np.zeros(0, dtype=np.int64)]
        for lo in range(0, len(w), _PART):
            hi = min(len(w), lo + _PART)
            for walk, wanted in self.wanted.items():
                if not wanted:
                    continue
                key, whose, bitmap = self.tables[walk]
                got = walk_keys(w[lo : hi + 64], hi - lo, wanted)
                for row in got:
                    hit = np.flatnonzero(bitmap[(row >> np.uint64(64 - _TABLE)).astype(np.int64)])
                    a = np.searchsorted(key, row[hit])
                    b = np.searchsorted(key, row[hit], side="right")
                    times = b - a
                    if times.any():
                        own = np.repeat(a, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                        found.append((whose[own, 0] << 40) + (1 << 39) + lo + np.repeat(hit, times) - whose[own, 1])
        code = np.unique(np.concatenate(found))
        return np.stack([code >> 40, (code & (1 << 40) - 1) - (1 << 39)], 1)

    def matches(self, w: np.ndarray, row: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
        """{(row, item): (edits, first word, words)} of the verified items, the best place of each, of the rows' joined words."""
        out: dict[tuple[int, int], tuple[int, int, int]] = {}
        found = self.candidates(w)
        begin = np.searchsorted(row, np.arange((row[-1] if len(row) else -1) + 2))
        numbers, first = np.unique(found[:, 0], return_index=True)
        for number, at in zip(numbers.tolist(), np.split(found[:, 1], first[1:]), strict=False):
            item, edits = self.items[number][1], self.most_edits[number]
            # Starts near each other are one place to look at, from the first to past the end of the last.
            new = np.flatnonzero(np.concatenate(([True], np.diff(at) > edits + 1)))
            lo = np.maximum(at[new] - 2 * edits, 0)
            hi = np.minimum(at[np.append(new[1:], len(at)) - 1] + len(item) + 2 * edits, len(w))
            for k in self._holds_most(item, edits, w, lo, hi).tolist():
                for r in range(int(row[lo[k]]), int(row[hi[k] - 1]) + 1):
                    a, b = max(int(lo[k]), int(begin[r])), min(int(hi[k]), int(begin[r + 1]))
                    if b - a < len(item) - edits:
                        continue
                    d, x, y = nearest(item, w[a:b])
                    if d <= edits:
                        best = (d, a + x - int(begin[r]), y - x)
                        out[(r, number)] = min(out.get((r, number), best), best)
        return out

    @staticmethod
    def _holds_most(item: np.ndarray, edits: int, w: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The ranges of w that hold all but `edits` of the item's different words: no others can match."""
        kinds = np.unique(item)
        size = hi - lo
        keep = np.flatnonzero(size > 0)
        place = np.repeat(keep, size[keep])
        pos = np.arange(len(place)) - np.repeat(np.cumsum(size[keep]) - size[keep], size[keep]) + lo[place]
        which = np.minimum(np.searchsorted(kinds, w[pos]), len(kinds) - 1)
        same = kinds[which] == w[pos]
        has = np.zeros((len(lo), len(kinds)), dtype=bool)
        has[place[same], which[same]] = True
        return np.flatnonzero(has.sum(axis=1) >= len(kinds) - edits)


#: Lengths that have a plan of their own; those between have that of the next lower one.
PLANNED = (*range(1, 25), 25, 28, 32, 36, 40, 45, 50, 57, 64, 72, 80, 90, 100, 114, 128)


@lru_cache(maxsize=4096)
def plan(n: int, edits: int, target: float = RECALL) -> tuple[int, int]:
    """(class, words between starts) of an item of n words: the longest window, started as seldom, that reaches the target.

    Recall is worked out on TRIALS random placements of the edits: the item is
    found if a sample of some start reads a stretch without one. A sample reads
    as many words as its walk has moved on at its last step, at every second
    step by chance. Where no plan reaches the target: the one of most recall.
    """
    rng = np.random.default_rng([n, edits])
    edited = np.ones((TRIALS, 3 * n + 64), dtype=np.int32)  # what lies past the end is no match either
    edited[:, :n] = rng.random((TRIALS, n)).argsort(axis=1).argsort(axis=1) < edits
    before = np.concatenate([np.zeros((TRIALS, 1), np.int32), np.cumsum(edited, axis=1, dtype=np.int32)], axis=1)
    best = (0.0, 1, 1)
    for least in sorted((c for c in CLASSES if c <= n), reverse=True):
        wanted = samples(least)
        for apart in sorted({least, max(1, least // 2), max(1, least // 4), 1}, reverse=True):
            starts = np.arange(0, n if edits else 1, apart)
            found = np.zeros(TRIALS, dtype=bool)
            for walk in {s.walk for s in wanted}:
                steps = sorted({max(s.steps) for s in wanted if s.walk == walk})
                moved = rng.binomial(np.diff([0, *steps]), 0.5, (TRIALS, len(starts), len(steps))).cumsum(axis=2)
                for k in range(len(steps)):
                    found |= (np.take_along_axis(before, starts + 1 + moved[:, :, k], 1) == before[:, starts]).any(axis=1)
            best = max(best, (float(found.mean()), least, -apart))
            if found.mean() >= target:
                return least, apart
    return best[1], abs(best[2])


def _starts(n: int, edits: int, target: float) -> list[tuple[int, np.ndarray]]:
    """(class, places where its walks start) in an item of n words."""
    like = max(x for x in PLANNED if x <= n)
    least, apart = plan(like, edits * like // n, target)
    return [(least, np.arange(0, n if edits else 1, apart))]


def nearest(item: np.ndarray, part: np.ndarray) -> tuple[int, int, int]:
    """(edit distance in words, start, end) of the piece of `part` nearest to `item`; the first of equal ones."""
    n = len(part)
    cost = np.zeros(n + 1, dtype=np.int64)
    start = np.arange(n + 1)
    place = np.arange(n + 1)
    for i, x in enumerate(item.tolist(), 1):
        change = cost[:-1] + (part != np.uint64(x))
        drop = cost[1:] + 1
        new = np.concatenate(([i], np.minimum(change, drop)))
        come = np.concatenate(([0], np.where(change <= drop, start[:-1], start[1:])))
        level = new - place
        best = np.minimum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == best, place, 0))
        source = np.where(level == best, place, source)
        cost, start = best + place, come[source]
    end = int(cost.argmin())
    return int(cost[end]), int(start[end]), end


def _indexes(benchmark: DataFrame, item_col: str, text_col: str, similarity: float, target: float) -> Iterator[Index]:
    ship(benchmark.sparkSession)
    rows = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    parts = max(1, -(-rows.count() // ITEMS))
    for k in range(parts):
        items = []
        for r in rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == k).toLocalIterator():
            data = np.frombuffer(r.text.encode("utf-8"), dtype=np.uint8)
            w, *_ = words(data, np.array([0, len(data)]))
            if len(w):
                items.append((r.id, w))
        if items:
            yield Index(items, similarity, target)


def _found(index: Index, column: pa.Array) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item number, edits, first word, words)."""
    data, offsets = buffers(column)
    for lo, hi in blocks(offsets, 1 << 19):
        w, _, _, row = words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        if len(w):
            for (r, number), best in index.matches(w, row).items():
                yield lo + r, number, *best


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", similarity: float = SIMILARITY, target_recall: float = RECALL) -> DataFrame:
    """(doc_id, item_id, edits, first_word, n_words): a row for each item in a row of docs, at its best place.

    An item is in a document if some run of its words (split at white space,
    A-Z lower-cased) has a word edit distance of at most (1 - similarity) times
    the item's words to it, as far as the sampled keys find it: each such item
    with a chance of about target_recall or more, and surely where nothing is
    edited.

    Null and empty texts, and items without words, match nothing. Items of
    equal words match alike; a repeated row or item gives its rows again. Null
    ids are kept as null. Other columns are ignored. Without documents or
    items: no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, item_id long, edits int, first_word int, n_words int"
    total = None
    for index in _indexes(benchmark, item_col, "text", similarity, target_recall):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def find(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            items = held.value.items
            for batch in batches:
                ids = batch.column(0)
                got = [(ids[r].as_py(), items[k][0], d, a, n) for r, k, d, a, n in _found(held.value, batch.column(1))]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array([g[c] for g in got], kinds[c]) for c in range(5)], ["doc_id", "item_id", "edits", "first_word", "n_words"])

        part = rows.mapInArrow(find, schema)
        total = part if total is None else total.union(part)
    if total is None:
        total = docs.sparkSession.createDataFrame([], schema)
    return total


def without_leaks(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", similarity: float = SIMILARITY, target_recall: float = RECALL) -> DataFrame:
    """The rows of `docs`, all columns, that hold no item; see leaks. Null texts hold none."""
    at = docs.columns.index(text_col)
    out = docs
    for index in _indexes(benchmark, item_col, "text", similarity, target_recall):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def keep(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                clean[[x[0] for x in _found(held.value, batch.column(at))]] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(keep, out.schema)
    return out
