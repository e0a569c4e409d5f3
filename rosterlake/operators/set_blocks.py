"""Blocks of sets against blocks: the most similar set by Jaccard, from counted intersections. Numpy inside a task.

A set's signature has a bit for the parity of its tokens of each hash: of two
sets the bits that differ are at most as many as the tokens that only one has,
so most pairs are ruled out without their tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Most tokens and sets that a block is planned for, sets that are counted at once, and pairs that are listed at once.
TOKENS, SETS, CHUNK, LISTED = 2**22, 2**14, 2**10, 2**22
#: Signatures that are compared at once, of either side, and bits that are made at once.
ROWS, COLUMNS, BITS = 2**7, 2**12, 2**22
#: Tokens that more than one in so many pairs of sets share are counted by a product of matrices, others by listing the pairs.
SPARSE = 128


def _ends(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


def intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many tokens each set of a shares with each of b; sets are arrays of distinct numbers."""
    shape = (len(a), len(b))
    ta, tb = np.concatenate(a), np.concatenate(b)
    ra, rb = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b))
    words = np.intersect1d(ta, tb)  # other tokens are shared by none

    def placed(t: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.searchsorted(words, t)
        at[at == len(words)] = 0
        here = words[at] == t if len(words) else np.zeros(len(t), bool)
        order = np.argsort(at[here], kind="stable")
        return at[here][order], r[here][order], np.bincount(at[here], minlength=len(words))

    (wa, ra, da), (wb, rb, db) = placed(ta, ra), placed(tb, rb)
    out = np.zeros(shape, np.float32)
    often = da * db * SPARSE > shape[0] * shape[1]
    sa, sb = _ends(da), _ends(db)
    at = np.cumsum(often) - 1
    for first in range(0, int(often.sum()), CHUNK):
        x, y = np.zeros((shape[0], CHUNK), np.float32), np.zeros((shape[1], CHUNK), np.float32)
        for m, w, r in ((x, wa, ra), (y, wb, rb)):
            in_chunk = often[w] & (at[w] >= first) & (at[w] < first + CHUNK)
            m[r[in_chunk], at[w[in_chunk]] - first] = 1
        out += x @ y.T
    rare = np.flatnonzero(~often)
    listed = _ends(da[rare] * db[rare])
    begin = 0
    while begin < len(rare):
        end = max(begin + 1, int(np.searchsorted(listed, listed[begin] + LISTED, "right")) - 1)
        here = rare[begin:end]
        mine = np.zeros(len(words), bool)
        mine[here] = True
        rows, w = ra[mine[wa]], wa[mine[wa]]
        each = db[w]
        at_b = np.arange(each.sum()) - np.repeat(_ends(each)[:-1], each) + np.repeat(sb[w], each)
        np.add.at(out, (np.repeat(rows, each), rb[at_b]), 1)
        begin = end
    return out


def signatures(flat: np.ndarray, ends: np.ndarray, words: int) -> np.ndarray:
    """A row of `words` (a power of two) 64-bit numbers for each set: bit h is set if an odd number of its tokens is h modulo the bits."""
    bits, count = 64 * words, len(ends) - 1
    out = np.empty((count, words), "<u8")
    step = max(1, BITS // bits)
    for i in range(0, count, step):
        at = ends[i : min(i + step, count) + 1]
        rows = len(at) - 1
        bit = (flat[at[0] : at[-1]] & (bits - 1)) + np.repeat(np.arange(rows) * bits, np.diff(at))
        odd = (np.bincount(bit, minlength=rows * bits) & 1).astype(np.uint8)
        out[i : i + rows] = np.packbits(odd.reshape(rows, bits), axis=1, bitorder="little").view("<u8")
    return out


def folded(s: np.ndarray, words: int) -> np.ndarray:
    """Signatures as of fewer words."""
    while s.shape[1] > words:
        half = s.shape[1] // 2
        s = s[:, :half] ^ s[:, half:]
    return s


def width(n: int, least: float) -> int:
    """Words of the signatures of a band that has a set of n tokens: two bits and more for each token of its largest."""
    top = (1 / least) ** (np.floor(np.log(n) / -np.log(least)) + 1)
    return 1 << max(0, int(np.ceil(np.log2(2 * top / 64))))


def near(nx: np.ndarray, sx: np.ndarray, ny: np.ndarray, sy: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of sets, by their sizes and signatures of one width, that can have the similarity: places in x and in y."""
    share = (1 - least) / (1 + least)
    apart = np.zeros((len(nx), len(ny)), np.uint16 if sx.shape[1] < 1024 else np.uint32)
    differ, count = np.empty(apart.shape, np.uint64), np.empty(apart.shape, np.uint8)
    for x, y in zip(np.ascontiguousarray(sx.T), np.ascontiguousarray(sy.T), strict=True):
        np.bitwise_xor(x[:, None], y[None, :], out=differ)
        np.bitwise_count(differ, out=count)
        np.add(apart, count, out=apart)
    at_x, at_y = np.nonzero(apart <= share * (int(nx.max()) + int(ny.max())) + 1e-6)
    fits = apart[at_x, at_y] <= share * (nx[at_x].astype(np.int64) + ny[at_y]) + 1e-6
    return at_x[fits], at_y[fits]


def _by_size(n: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return rows[np.argsort(n[rows], kind="stable")]


def _sizes(n: np.ndarray, x: np.ndarray, ys: np.ndarray, least: float) -> np.ndarray:
    """Where in ys (by size) the sizes begin and end that allow x (by size) the similarity, with a little more."""
    return np.searchsorted(n[ys], [n[x[0]] * least - 1e-6, n[x[-1]] / least + 1e-6])


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(ends, values) of a column of lists."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    return lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)


def signed(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches with the signatures (`sig`) of the sets instead of their tokens (`t`)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, flat = _lists(batch["t"])
            band, n = batch["band"].to_numpy(), np.diff(ends)
            sig: list[bytes] = [b""] * len(n)
            for b in np.unique(band):
                rows = np.flatnonzero(band == b)
                own = np.concatenate([flat[ends[k] : ends[k + 1]] for k in rows])
                for k, s in zip(rows, signatures(own, _ends(n[rows]), width(int(n[rows[0]]), least)), strict=True):
                    sig[k] = s.tobytes()
            yield batch.drop_columns(["t"]).append_column("sig", pa.array(sig, pa.binary()))

    return of


def likely(least: float) -> Callable[[pa.Table], pa.Table]:
    """Of the rows of two blocks that meet (as for `best`, with signatures): those of sets that can have the similarity to one that they may meet."""

    def of(table: pa.Table) -> pa.Table:
        n, side = table["n"].to_numpy(), table["side"].to_numpy()
        asks, answers = (table[c].to_numpy().astype(bool) for c in ("asks", "answers"))
        reached = np.zeros(len(n), bool)
        one = not side.any()
        xs, ys = (_by_size(n, np.flatnonzero(side == k)) for k in ((0, 0) if one else (0, 1)))
        if len(xs) and len(ys):
            sig = table["sig"].to_pylist()
            sx, sy = (np.frombuffer(b"".join(sig[k] for k in rows), "<u8").reshape(len(rows), -1) for rows in (xs, ys))
            words = min(sx.shape[1], sy.shape[1])
            sx, sy = folded(sx, words), folded(sy, words)
            for i in range(0, len(xs), ROWS):
                x = xs[i : i + ROWS]
                y0, y1 = _sizes(n, x, ys, least)
                for j in range(max(y0, i) if one else y0, y1, COLUMNS):
                    y = ys[j : min(j + COLUMNS, y1)]
                    at_x, at_y = near(n[x], sx[i : i + ROWS], n[y], sy[j : j + len(y)], least)
                    p, q = x[at_x], y[at_y]
                    meet = (p != q) & ((asks[p] & answers[q]) | (asks[q] & answers[p]))
                    reached[p[meet]] = reached[q[meet]] = True
        return table.filter(pa.array(reached)).select(["fam", "m1", "m2", "m3", "m4", "side", "cls"])

    return of


def best(least: float) -> Callable[[pa.Table], pa.Table]:
    """Of the rows of two blocks that meet (side 0 and 1; of one block alone, side 0): for each asking set the most similar answering one, from `least` on; the least `first` of equals."""

    def of(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table.select(["first"]), sort_keys=[("first", "ascending")]))
        n, side = table["n"].to_numpy(), table["side"].to_numpy()
        asks, answers = (table[c].to_numpy().astype(bool) for c in ("asks", "answers"))
        ends, flat = _lists(table["t"])
        sig = signatures(flat, ends, width(int(n.min()), least)) if len(n) else None
        top, other = np.full(len(n), -1.0), np.full(len(n), -1)
        one = not side.any()
        for own, theirs in ((0, 0),) if one else ((0, 1), (1, 0)):
            xs, ys = _by_size(n, np.flatnonzero(asks & (side == own))), _by_size(n, np.flatnonzero(answers & (side == theirs)))
            for i in range(0, len(xs), CHUNK):
                block = xs[i : i + CHUNK]
                y0, y1 = _sizes(n, block, ys, least)
                for j in range(y0, y1, CHUNK):
                    y = np.sort(ys[j : min(j + CHUNK, y1)])  # in the order of `first`
                    at_x, at_y = near(n[block], sig[block], n[y], sig[y], least)
                    others = block[at_x] != y[at_y]
                    x, y = block[np.unique(at_x[others])], y[np.unique(at_y[others])]
                    if not len(x):
                        continue
                    shared = intersections([flat[ends[k] : ends[k + 1]] for k in x], [flat[ends[k] : ends[k + 1]] for k in y]).astype(np.float64)
                    similar = shared / (n[x][:, None] + n[y][None, :] - shared)
                    similar[x[:, None] == y[None, :]] = -1
                    k = similar.argmax(1)
                    value, at = similar[np.arange(len(x)), k], y[k]
                    better = (value > top[x]) | ((value == top[x]) & (at < other[x]))
                    top[x[better]], other[x[better]] = value[better], at[better]
        found = np.flatnonzero(top >= least)
        # of equal `first` there is one class only, so places tell which is less
        return pa.table({"cls": table["cls"].take(pa.array(found)), "similarity": pa.array(top[found]), "other": table["first"].take(pa.array(other[found]))})

    return of
