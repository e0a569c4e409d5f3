"""Language identification by segmentation-marginalised unigrams.

A fixed public vocabulary of pieces is shared by all languages. A language is a
unigram distribution over the pieces; the probability of a word (its space and
bytes) is the sum over all its segmentations, by a forward algorithm; that of a
text is the product over its words. Words of any length are summed whole; where
no piece reaches over a place, the sum is a product of two and is worked out in
units. Distributions are learned in one expectation step: expected piece counts
over all the labelled rows that may be used, all pieces taken as equally likely.

At scale: learning reads the corpus once, each task gives at most (languages x
pieces) partial sums, and the model has that size, however much text there is;
scoring is one map without a shuffle. Equal words of a block are worked out once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ship
from .kernels import blocks, buffers, words

#: Bytes of text worked on at a time.
BLOCK = 3 << 20
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_ASCII_LETTER = _LETTER & (np.arange(256) < 128)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Factor a byte, which keeps products of probabilities in the range of doubles for _RESCALE bytes, after which they are scaled anew.
_STEP, _RESCALE = 16.0, 32
#: Numbers in the forward table of one group of units.
_TABLE = 1 << 22


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows never learned from: crc32 of the id as text, modulo 3, is 1. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(True))


class Pieces:
    """The vocabulary as a byte trie: all pieces that a word can hold, A-Z folded, a space for the word mark, and all single bytes."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names = {bytes([b]) for b in range(256)}
        for k in range(sp.get_piece_size()):
            if not (sp.is_unknown(k) or sp.is_control(k) or sp.is_byte(k)):
                raw = bytes(_FOLD[list(sp.id_to_piece(k).replace("▁", " ").encode("utf-8"))])
                if raw and b" " not in raw[1:]:
                    names.add(raw)
        self.names = sorted(names)
        self.longest = max(map(len, self.names))
        self.length = np.array([len(x) for x in self.names])
        paths = sorted({x[:k] for x in self.names for k in range(1, len(x) + 1)})
        number = {x: k + 1 for k, x in enumerate(paths)}
        self.piece = np.full(len(paths) + 1, -1, dtype=np.int32)
        for k, x in enumerate(self.names):
            self.piece[number[x]] = k
        self.child = np.zeros((len(paths) + 1, 256), dtype=np.uint16 if len(paths) < 65_000 else np.int32)
        for x, k in number.items():
            self.child[number.get(x[:-1], 0), x[-1]] = k

    def __len__(self) -> int:
        return len(self.names)

    def lattice(self, flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> Lattice:
        """Every piece in every word; words lie back to back in `flat`."""
        n = len(flat)
        start = np.arange(n)
        left = np.repeat(begin + size, size) - start
        node = np.zeros(n, dtype=np.int64)
        reach = start + 1  # where the longest piece from each place ends
        got: list[tuple[np.ndarray, np.ndarray, int]] = []
        k = 0
        while len(start):
            node = self.child[node, flat[start + k]].astype(np.int64)
            k += 1
            p = self.piece[node]
            hit = p >= 0
            got.append((start[hit], p[hit], k))
            reach[start[hit]] = start[hit] + k
            on = (node > 0) & (left > k)
            start, left, node = start[on], left[on], node[on]
        head = np.ones(n, dtype=bool)
        head[1:] = np.maximum.accumulate(reach)[:-1] <= np.arange(1, n)  # no piece reaches over the place
        first = np.flatnonzero(head)
        at = np.concatenate([np.zeros(0, np.int64), *(g[0] for g in got)])
        piece = np.concatenate([np.zeros(0, np.int32), *(g[1] for g in got)])
        length = np.repeat([g[2] for g in got], [len(g[0]) for g in got])
        unit = np.cumsum(head)[at] - 1
        return Lattice(np.diff(first, append=n), np.searchsorted(first, begin), unit, piece, at - first[unit], length)

    def forward(self, flat: np.ndarray, begin: np.ndarray, size: np.ndarray, chance: np.ndarray) -> np.ndarray:
        """log P(word) for each column of chance (pieces x languages, times _STEP ** length)."""
        lattice = self.lattice(flat, begin, size)
        logs = np.empty((len(lattice.size), chance.shape[1]))
        for own, units, pieces, steps in lattice.groups(chance.shape[1]):
            longest = int(lattice.size[own[-1]])
            alpha = np.zeros((longest + 1, len(own), chance.shape[1]))
            alpha[0] = 1
            scale = np.zeros(alpha.shape[1:])
            done = 0
            for a, b, at, n in steps:
                if at - done >= _RESCALE:
                    done = at
                    scale += _rescaled(alpha[at : at + self.longest])
                u = units[a:b]
                alpha[at + n][u] += alpha[at][u] * chance[pieces[a:b]]
            logs[own] = np.log(alpha[lattice.size[own], np.arange(len(own))]) + scale
        logs -= (lattice.size * np.log(_STEP))[:, None]
        return np.add.reduceat(logs, lattice.words) if len(size) else np.zeros((0, chance.shape[1]))

    def expected(self, flat: np.ndarray, begin: np.ndarray, size: np.ndarray, times: np.ndarray, chance: np.ndarray) -> np.ndarray:
        """Expected piece counts (groups x pieces) where each word occurs times[word, group] times, under one distribution."""
        lattice = self.lattice(flat, begin, size)
        word = np.repeat(np.arange(len(size)), np.diff(lattice.words, append=len(lattice.size)))
        out = np.zeros((times.shape[1], len(self)))
        for own, units, pieces, steps in lattice.groups(1):
            longest = int(lattice.size[own[-1]])
            alpha = np.zeros((longest + 1, len(own)))
            alpha[0] = 1
            scales = [np.zeros(len(own))]
            for a, b, at, n in steps:
                if at // _RESCALE == len(scales):
                    scales.append(scales[-1] + _rescaled(alpha[at : at + self.longest]))
                u = units[a:b]
                alpha[at + n][u] += alpha[at][u] * chance[pieces[a:b]]
            # gamma: how likely a piece ends at a place; its pieces share it as they made alpha there.
            gamma = np.zeros_like(alpha)
            gamma[lattice.size[own], np.arange(len(own))] = 1
            share = np.empty(len(units))
            for a, b, at, n in reversed(steps):
                u, x, y = units[a:b], at // _RESCALE, min((at + n) // _RESCALE, len(scales) - 1)
                share[a:b] = gamma[at + n][u] * alpha[at][u] * chance[pieces[a:b]] / alpha[at + n][u]
                if x != y:
                    share[a:b] *= np.exp(scales[x][u] - scales[y][u])
                gamma[at][u] += share[a:b]
            whose = word[own][units]
            out += np.stack([np.bincount(pieces, share * times[whose, g], minlength=len(self)) for g in range(times.shape[1])])
        return out


def _rescaled(rows: np.ndarray) -> np.ndarray:
    """Divides the rows of a forward table by their greatest values, of which it gives the logs."""
    top = rows.max(axis=0)
    top[top == 0] = 1
    rows /= top
    return np.log(top)


@dataclass(frozen=True)
class Lattice:
    """Units' sizes, each word's first unit, and arcs: unit, piece, start in the unit, length."""

    size: np.ndarray
    words: np.ndarray
    unit: np.ndarray
    piece: np.ndarray
    start: np.ndarray
    length: np.ndarray

    def groups(self, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int, int]]]]:
        """Units by size, as many as _TABLE allows at once: (units, arcs' places in them, arcs' pieces, ranges of arcs of one (start, length) in order)."""
        by_size = np.argsort(self.size, kind="stable")
        place = np.empty(len(by_size), dtype=np.int64)
        place[by_size] = np.arange(len(by_size))
        sizes = self.size[by_size]
        lo = 0
        while lo < len(by_size):
            # Of 32 bytes and less together, then of up to twice the least.
            hi = int(np.searchsorted(sizes, max(32, 2 * int(sizes[lo])), side="right"))
            hi = lo + max(1, min(hi - lo, _TABLE // (width * (int(sizes[hi - 1]) + 1))))
            own = np.flatnonzero((place[self.unit] >= lo) & (place[self.unit] < hi)) if hi - lo < len(by_size) else np.arange(len(self.unit))
            key = self.start[own] * 256 + self.length[own]
            if hi and sizes[hi - 1] < 127:
                key = key.astype(np.int16)
            own = own[np.argsort(key, kind="stable")]
            start, length = self.start[own], self.length[own]
            cut = np.flatnonzero(np.concatenate(([True], (start[1:] != start[:-1]) | (length[1:] != length[:-1]))))
            ends = np.append(cut[1:], len(own))
            yield by_size[lo:hi], place[self.unit[own]] - lo, self.piece[own], list(zip(cut.tolist(), ends.tolist(), start[cut].tolist(), length[cut].tolist(), strict=True))
            lo = hi


_LOADED: dict[str, Pieces] = {}


def _pieces(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def _word_types(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(flat bytes, begin, size) of the distinct words with a letter, each after a space; for each occurrence its row and word."""
    h, begin, end, row = words(data, offsets)
    if len(begin):
        has = np.logical_or.reduceat(_LETTER[data], np.stack([begin, end], 1).reshape(-1)[: 2 * len(begin) - (end[-1] == len(data))])[::2]
        h, begin, end, row = h[has], begin[has], end[has], row[has]
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    size = end[first] - begin[first] + 1
    at = np.cumsum(size) - size
    total = int(size.sum())
    source = np.arange(total) - np.repeat(at + 1, size) + np.repeat(begin[first], size)
    flat = _FOLD[data[np.maximum(source, 0)]] if total else np.zeros(0, np.uint8)
    flat[at] = 32
    return flat, at, size, row, which


def _slices(size: np.ndarray, n: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of words of about n bytes; a longer word is alone in its range."""
    return blocks(np.concatenate(([0], np.cumsum(size))), n)


@dataclass(frozen=True)
class LanguageModel:
    """Languages in order and log-probabilities (pieces x languages)."""

    languages: list[str]
    chance: np.ndarray
    path: str


def fit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", path: str | None = None, smoothing: float = 0.1) -> LanguageModel:
    """Learns from every row with a language and a text: expected piece counts under equal piece probabilities, plus `smoothing`."""
    ship(docs.sparkSession)
    where = path or default_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(where)
        chance = _STEP ** pieces.length / len(pieces)
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            data, offsets = buffers(batch.column(0))
            for lo, hi in blocks(offsets, BLOCK):
                flat, at, size, row, which = _word_types(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                names = sorted(set(langs[lo:hi]))
                code = np.array([names.index(x) for x in langs[lo:hi]])
                times = np.bincount(which * len(names) + code[row], minlength=len(size) * len(names)).reshape(len(size), len(names))
                for a, b in _slices(size):
                    x, y = at[a], at[b - 1] + size[b - 1]
                    for name, c in zip(names, pieces.expected(flat[x:y], at[a:b] - x, size[a:b], times[a:b].astype(np.float64), chance), strict=True):
                        total[name] = total[name] + c if name in total else c
        for name, c in total.items():
            used = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * (len(used) + 1), pa.string()), pa.array(np.append(used, -1), pa.int32()), pa.array(np.append(c[used], 0.0))], ["lang", "piece", "n"])

    usable = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("lang is not null and text is not null")
    sums = usable.mapInArrow(count, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
    counts: dict[str, np.ndarray] = {}
    pieces = _pieces(where)
    with Scratch(docs.sparkSession) as scratch:
        for r in scratch.settle(sums).toLocalIterator():  # languages x pieces rows at most
            c = counts.setdefault(r.lang, np.zeros(len(pieces)))
            if r.piece >= 0:
                c[r.piece] = r.n
    langs = sorted(counts)
    table = np.stack([(counts[x] + smoothing) / (counts[x].sum() + smoothing * len(pieces)) for x in langs], 1) if langs else np.zeros((len(pieces), 0))
    return LanguageModel(langs, table, where)


def identify(docs: DataFrame, model: LanguageModel, *, text_col: str = "text") -> DataFrame:
    """All columns of `docs` with lang_pred and score (0 to 1, the language's share of all languages' probability).

    `und` with score 0 for null and empty texts, texts without a letter, and
    where the model knows no language. Ties go to the first language in order.
    Repeated rows stay. Columns named lang_pred or score are replaced. Empty
    table: no rows.
    """
    ship(docs.sparkSession)
    rows = docs.drop("lang_pred", "score")
    at = rows.columns.index(text_col)
    names, where = model.languages, model.path
    held = docs.sparkSession.sparkContext.broadcast(model.chance * (_STEP ** _pieces(where).length)[:, None])
    letter = regex.compile(r"\p{L}")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(where)
        for batch in batches:
            data, offsets = buffers(batch.column(at))
            n = batch.num_rows
            best, score = np.full(n, -1), np.zeros(n)
            for lo, hi in blocks(offsets, BLOCK):
                part, own = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                flat, begin, size, row, which = _word_types(part, own)
                if not len(size) or not names:
                    continue
                logs = np.empty((len(size), len(names)))
                for a, b in _slices(size):
                    x, y = begin[a], begin[b - 1] + size[b - 1]
                    logs[a:b] = pieces.forward(flat[x:y], begin[a:b] - x, size[a:b], held.value)
                total = np.stack([np.bincount(row, logs[which, k], minlength=hi - lo) for k in range(len(names))], 1)
                has = np.bincount(row, minlength=hi - lo) > 0
                plain = np.bincount(np.searchsorted(own, np.flatnonzero(_ASCII_LETTER[part]), side="right") - 1, minlength=hi - lo) > 0
                for r in np.flatnonzero(has & ~plain):
                    has[r] = letter.search(part[own[r] : own[r + 1]].tobytes().decode("utf-8", "replace")) is not None
                top = total.argmax(axis=1)
                share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                best[lo:hi] = np.where(has, top, -1)
                score[lo:hi] = np.where(has, share, 0.0)
            out = [names[k] if k >= 0 else "und" for k in best]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string()), pa.array(score)], [*batch.schema.names, "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    schema = StructType([*rows.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return rows.mapInArrow(predict, schema)


def language_predictions(docs: DataFrame, *, path: str | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), learned from the rows that are not held out; see fit and identify."""
    model = fit(docs.select("doc_id", "text", "lang").filter(~held_out()), path=path)
    return identify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text"), model).drop("text")
