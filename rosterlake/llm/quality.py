"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2]),
the second sum being all pairwise interactions in time linear in the features.

It is fitted on a bounded sample of labelled rows (`max_rows`, in the order of
a hash of the id; only their features reach the driver). Scoring is one map
without a shuffle; the model, of fixed size, is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, ship
from .kernels import blocks, buffers, hash_spans, words
from .language import held_out

#: Buckets of the hashed words, bins of each statistic, factors of an interaction.
BUCKETS, BINS, RANK = 1 << 16, 10, 8
#: Labelled rows that the model is fitted on at most.
MAX_ROWS = 8_000
_BLOCK = 1 << 20


def _class(*codes: int) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(codes)] = True
    return table


_UPPER = _class(*range(65, 91))
_LETTER = _class(*range(65, 91), *range(97, 123), *range(128, 256))
_DIGIT = _class(*range(48, 58))
_SIGN = _class(*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127))
_STOP = _class(*map(ord, ".,;:?"))
#: (name, lower edges of the bins after the first).
STATISTICS: tuple[tuple[str, tuple[float, ...]], ...] = (
    ("log2 of characters", (5, 6, 7, 8, 9, 10, 11, 12, 14)),
    ("capitals of letters", (0.005, 0.01, 0.02, 0.04, 0.08, 0.15, 0.3, 0.5, 0.8)),
    ("signs of bytes", (0.005, 0.01, 0.02, 0.04, 0.06, 0.1, 0.15, 0.25, 0.4)),
    ("other signs than stops of bytes", (0.0005, 0.001, 0.002, 0.005, 0.01, 0.03, 0.06, 0.12, 0.25)),
    ("digits of bytes", (0.0005, 0.001, 0.003, 0.006, 0.01, 0.02, 0.05, 0.1, 0.3)),
    ("bytes of a word", (2, 3, 4, 4.5, 5, 5.5, 6, 8, 12)),
    ("different words of words", (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.75, 0.9)),
    ("words without letters of words", (0.001, 0.003, 0.01, 0.03, 0.06, 0.12, 0.25, 0.4, 0.6)),
    ("repeated lines of lines", (0.01, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.7, 0.9)),
    ("words of a line", (1, 2, 4, 7, 12, 20, 40, 80, 160)),
)
SIZE = BUCKETS + len(STATISTICS) * BINS


def features(column: pa.Array, n_chars: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row, offsets, indices, values) of a block of rows as a sparse matrix.

    n_chars is the rows' metadata; where it is negative (unknown) the text's own count is taken.
    """
    data_all, offsets_all = buffers(column)
    for lo, hi in blocks(offsets_all, _BLOCK):
        data, at, n = data_all[offsets_all[lo] : offsets_all[hi]], offsets_all[lo : hi + 1] - offsets_all[lo], hi - lo

        def share(table: np.ndarray, data: np.ndarray = data, at: np.ndarray = at) -> np.ndarray:
            total = np.concatenate(([0], np.cumsum(table[data], dtype=np.int64)))
            return total[at[1:]] - total[at[:-1]]

        size = np.maximum(at[1:] - at[:-1], 1)
        h, begin, end, row = words(data, at)
        bucket = (h >> np.uint64(48)).astype(np.int64)
        key, times = np.unique(row * BUCKETS + bucket, return_counts=True)
        word_row = key // BUCKETS
        n_words, n_types = np.bincount(row, minlength=n), np.bincount(word_row, minlength=n)
        value = np.log1p(times)
        norm = np.sqrt(np.bincount(word_row, value**2, minlength=n))
        value = value / norm[word_row]
        letters = np.concatenate(([0], np.cumsum(_LETTER[data], dtype=np.int64)))
        bare = np.bincount(row[letters[end] == letters[begin]], minlength=n)
        newline = data == 10
        inner = np.concatenate((np.flatnonzero(newline) + 1, at[:-1]))
        starts = np.unique(inner[inner < len(data)])
        line_row = np.searchsorted(at, starts, side="right") - 1
        stops = np.append(starts[1:], len(data))
        line = hash_spans(data, starts, stops) if len(starts) else np.zeros(0, np.uint64)
        filled = (stops - starts) > 1
        pair = np.stack([line_row[filled].astype(np.uint64), line[filled]], 1)
        n_lines = np.bincount(line_row[filled], minlength=n)
        kinds = np.unique(pair, axis=0)[:, 0].astype(np.int64) if len(pair) else np.zeros(0, np.int64)
        n_kinds = np.bincount(kinds, minlength=n)
        chars = np.where(n_chars[lo:hi] >= 0, n_chars[lo:hi], share(~_class(*range(128, 192))))
        stats = (
            np.log2(chars + 1.0),
            share(_UPPER) / np.maximum(share(_LETTER), 1),
            share(_SIGN) / size,
            share(_SIGN & ~_STOP) / size,
            share(_DIGIT) / size,
            np.bincount(row, end - begin, minlength=n) / np.maximum(n_words, 1),
            n_types / np.maximum(n_words, 1),
            bare / np.maximum(n_words, 1),
            1 - n_kinds / np.maximum(n_lines, 1),
            n_words / np.maximum(n_lines, 1),
        )
        bins = np.stack([BUCKETS + k * BINS + np.searchsorted(edges, s, side="right") for k, ((_, edges), s) in enumerate(zip(STATISTICS, stats, strict=True))], 1)
        indices = np.concatenate([key % BUCKETS, bins.reshape(-1)])
        values = np.concatenate([value, np.full(bins.size, 0.5)])
        order = np.argsort(np.concatenate([word_row, np.repeat(np.arange(n), bins.shape[1])]), kind="stable")
        yield lo, hi, np.concatenate(([0], np.cumsum(n_types + bins.shape[1]))), indices[order], values[order]


@dataclass(frozen=True)
class FactorisationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logits(self, offsets: np.ndarray, indices: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Each row has a feature at least (its statistics), so that reduceat sums rows."""
        vx = self.factors[indices] * values[:, None]
        total = np.add.reduceat(vx, offsets[:-1], axis=0)
        squares = np.add.reduceat((vx * vx).sum(axis=1), offsets[:-1])
        return self.bias + np.add.reduceat(self.linear[indices] * values, offsets[:-1]) + 0.5 * ((total * total).sum(axis=1) - squares)


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, *, epochs: int = 6, step: float = 0.1, decay: float = 1e-5, seed: int = 0) -> FactorisationMachine:
    """Logistic loss by AdaGrad over batches of 64 rows."""
    rng = np.random.default_rng(seed)
    bias, linear, factors = 0.0, np.zeros(SIZE), rng.normal(0, 0.02, (SIZE, RANK))
    g_linear, g_factors, g_bias = np.full(SIZE, 1e-6), np.full((SIZE, RANK), 1e-4), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), 64):
            part = order[lo : lo + 64]
            indices = np.concatenate([rows[k][0] for k in part])
            values = np.concatenate([rows[k][1] for k in part])
            at = np.concatenate(([0], np.cumsum([len(rows[k][0]) for k in part])))
            vx = factors[indices] * values[:, None]
            total = np.add.reduceat(vx, at[:-1], axis=0)
            logit = bias + np.add.reduceat(linear[indices] * values, at[:-1]) + 0.5 * ((total**2).sum(1) - np.add.reduceat((vx**2).sum(1), at[:-1]))
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[part]) / len(part)
            row = np.repeat(np.arange(len(part)), np.diff(at))
            used, where = np.unique(indices, return_inverse=True)
            one = error[row] * values
            d_linear = np.bincount(where, one, minlength=len(used)) + decay * linear[used]
            many = one[:, None] * (total[row] - vx)
            d_factors = np.stack([np.bincount(where, many[:, f], minlength=len(used)) for f in range(RANK)], 1) + decay * factors[used]
            g_linear[used] += d_linear**2
            linear[used] -= step * d_linear / np.sqrt(g_linear[used])
            g_factors[used] += d_factors**2
            factors[used] -= 0.5 * step * d_factors / np.sqrt(g_factors[used])
            g_bias += float(error.sum()) ** 2
            bias -= step * float(error.sum()) / g_bias**0.5
    return FactorisationMachine(bias, linear.astype(np.float32), factors.astype(np.float32))


def _known(column: pa.Array) -> np.ndarray:
    return column.fill_null(-1).to_numpy(zero_copy_only=False)


def fit(docs: DataFrame, labels: DataFrame, *, max_rows: int = MAX_ROWS) -> FactorisationMachine:
    """docs: doc_id, text, n_chars; labels: doc_id, quality. Learns from at most max_rows labelled rows.

    A null quality or id is no label; of several labels of a document the mean
    decides. Without any label every score is 0.5.
    """
    marked = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    chosen = settle(marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    sample = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("n_chars").cast("long").alias("n_chars"), "y")  # max_rows bounds it

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ix, vs = [], []
            for _, _, at, indices, values in features(batch.column(1), _known(batch.column(2))):
                ix += [indices[a:b].astype(np.int32).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                vs += [values[a:b].astype(np.float32).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(ix, pa.binary()), pa.array(vs, pa.binary())], ["doc_id", "y", "ix", "vs"])

    found: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
    for r in sample.mapInArrow(gather, "doc_id long, y int, ix binary, vs binary").toLocalIterator():
        own = (r.y, np.frombuffer(r.ix, np.int32), np.frombuffer(r.vs, np.float32).astype(np.float64))
        if r.doc_id not in found or own[1].tobytes() < found[r.doc_id][1].tobytes():  # repeated ids: the same one in any order
            found[r.doc_id] = own
    if not found:
        return FactorisationMachine(0.0, np.zeros(SIZE, np.float32), np.zeros((SIZE, RANK), np.float32))
    rows = [found[k] for k in sorted(found)]
    return train([(r[1], r[2]) for r in rows], np.array([r[0] for r in rows], dtype=np.float64))


def quality_scores(docs: DataFrame, labels: DataFrame, *, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs.

    Rows that are held out are not learned from; labels, lang, source and id
    are no inputs of a score. Null and empty texts are scored by their
    statistics alone, and a null n_chars is counted from the text. Repeated rows
    stay and score alike. Other columns are ignored. Empty table: no rows.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("n_chars").cast("long").alias("n_chars"))
    model = fit(rows, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").filter(~held_out()), max_rows=max_rows)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logit = np.zeros(batch.num_rows)
            for lo, hi, at, indices, values in features(batch.column(2), _known(batch.column(3))):
                logit[lo:hi] = held.value.logits(at, indices, values)
            p = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.select("doc_id", held_out().alias("held_out"), "text", "n_chars").mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
