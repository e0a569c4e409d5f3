"""Cross-tokenizer alignment: where tokens of two tokenizers end at the same byte.

Character offsets of the one library and spans of the other are coarse cuts;
tokens that share a character or carry single bytes are refined by their
decoded bytes.

Texts are cut where neither tokenizer can join what stands on both sides, and
parts met before are not encoded again.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain, count
from operator import attrgetter, itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _byte_letters, default_path
from .common import settle, ship

#: Parts, and stretches between spaces, that a task keeps, and the longest kept: bounds its memory.
KEEP = 500_000
KEEP_CHARS = 64
#: Text that is aligned at once: words that repeat in it are looked up once.
RUN_BYTES = 2 << 20
#: Pairs that are broadcast, 24 bytes each; rarer ones are joined by a shuffle.
BROADCAST_PAIRS = 1 << 20
#: Signs before which a letter may be cut off, where no piece holds a letter and the sign.
_SIGNS = ".,;!?"
_SPACE = "\u2581"


def piece_path() -> str:
    """piece_bpe_32k.model, of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Aligned(NamedTuple):
    """Tokens, `a1,a2|b1;a3|b2,b3` of the groups (ASCII), and the (a << 32 | b) of each link; n_a 0 where the bytes differ."""

    n_a: int
    n_b: int
    groups: bytes
    pairs: tuple[int, ...]


_DIFFERS = Aligned(0, 0, b"", ())


def refined(begin: np.ndarray, end: np.ndarray, size: np.ndarray) -> np.ndarray | None:
    """Byte ends of tokens: coarse spans where tokens share no character, decoded sizes between; None if the two disagree."""
    fine = np.cumsum(size)
    coarse = (end > begin) & np.r_[end[:-1] <= begin[1:], np.ones(min(len(end), 1), dtype=bool)]
    return fine if (fine[coarse] == end[coarse]).all() else None


class Aligner:
    """Aligns a byte-level BPE (tokenizers) with a piece model (sentencepiece), special strings taken as text."""

    def __init__(self, path_a: str, path_b: str, keep: int = KEEP):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        sign = {c: b for b, c in enumerate(_byte_letters())}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for entry, k in self.a.get_vocab().items():
            self.bytes_a[k] = bytes(sign[c] for c in entry) if all(c in sign for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(_SPACE, " ").encode() for k, p in enumerate(pieces)]
        self.break_ = self.b.piece_to_id("<0x0A>")  # a line end is a byte: it joins nothing
        if not self.b.is_byte(self.break_) or any("\n" in p for p in pieces):
            raise ValueError("the piece model must know line ends as bytes only")
        if any(x != _SPACE and y == _SPACE for p in pieces for x, y in zip(p, p[1:], strict=False)):
            raise ValueError("the piece model must not join words")
        odd = {x for p in pieces for x, y in zip(p, p[1:], strict=False) if y in _SIGNS and (x.isalpha() or x.isnumeric())}
        self.cut = re.compile(rf"(?<=[^\W\d_{re.escape(''.join(sorted(odd)))}])(?=[{re.escape(_SIGNS)}])")
        self.wide = re.compile(r"(?<=\S)(?= )")
        self.many_ids = max(len(self.bytes_a), len(self.bytes_b))
        self.said = [b"%d%s" % (k, sign) for sign in (b",", b"|", b";") for k in range(self.many_ids)]
        self.parts, self.words = Kept(keep), Kept(keep // 2)

    def _tokens_a(self, text: str, raw: bytes) -> tuple[list[int], np.ndarray] | None:
        got = self.a.encode(text, add_special_tokens=False)
        ids, spans = got.ids, np.fromiter(chain.from_iterable(got.offsets), np.int64, 2 * len(got.ids)).reshape(-1, 2)
        if len(raw) != len(text):  # offsets count characters
            code = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
            place = np.r_[0, np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))]
            spans = place[spans]
        held = list(map(self.bytes_a.__getitem__, ids))
        ends = refined(spans[:, 0], spans[:, 1], np.fromiter(map(len, held), np.int64, len(held)))
        return None if ends is None or b"".join(held) != raw else (ids, ends)

    def _tokens_b(self, text: str, raw: bytes) -> tuple[list[int], np.ndarray] | None:
        """Of a text that begins with a line end; the space that the library puts before it has no bytes of it."""
        got = self.b.encode(text, return_type="proto").pieces
        ids, begin, end = (list(map(attrgetter(c), got))[1:] for c in ("id", "begin", "end"))
        held = list(map(self.bytes_b.__getitem__, ids))
        ends = refined(np.array(begin, np.int64), np.array(end, np.int64), np.fromiter(map(len, held), np.int64, len(held)))
        return None if ends is None or b"".join(held) != raw else (ids, ends)

    def _align(self, parts: list[str]) -> list[Aligned]:
        """Of parts without white space at either end but a space in front."""
        text = "\n" + "\n".join(parts)
        raw = text.encode()
        a, b = self._tokens_a(text, raw), self._tokens_b(text, raw)
        if a is None or b is None:
            return [self._alone(p) for p in parts]
        size = [1 + len(p) for p in parts] if text.isascii() else [1 + len(p.encode()) for p in parts]
        return self._matched(*a, *b, np.cumsum(size), 1)  # the line end before each part is a token of both

    def _alone(self, part: str) -> Aligned:
        raw = part.encode()
        a, b = self._tokens_a(part, raw), self._tokens_b("\n" + part, b"\n" + raw)
        if a is None or b is None:
            return _DIFFERS
        return self._matched(*a, b[0][1:], b[1][1:] - 1, np.array([len(raw)]), 0)[0]

    def _matched(self, a: list[int], end_a: np.ndarray, b: list[int], end_b: np.ndarray, stops: np.ndarray, skip: int) -> list[Aligned]:
        """Groups and links of tokens that cover the same bytes, for each part up to its stop, without its first `skip` groups (of a token each)."""
        shared = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(shared, end_a), np.searchsorted(shared, end_b)
        last_a, last_b = end_a == shared[group_a], end_b == shared[group_b]
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        ids = np.array([*a, *b], dtype=np.int64)
        said = list(map(self.said.__getitem__, (np.concatenate([last_a, 2 * last_b]) * self.many_ids + ids)[order].tolist()))
        links = (ids[: len(a)][last_a] << 32 | ids[len(a) :][last_b]).tolist()
        n_a, n_b, n_groups = (np.searchsorted(e, stops, side="right").tolist() for e in (end_a, end_b, shared))
        out, i, j, g = [], 0, 0, 0
        for k, m, h in zip(n_a, n_b, n_groups, strict=True):
            out.append(Aligned(k - i - skip, m - j - skip, b"".join(said[i + j + 2 * skip : k + m])[:-1], tuple(links[g + skip : h])))
            i, j, g = k, m, h
        return out

    def _missing(self, words: list[str]) -> dict[str, Aligned]:
        """Of stretches that follow a space."""
        cut = {w: self.cut.split(" " + w) for w in words}
        known, new = self.parts.held({p for ps in cut.values() for p in ps})
        odd = [p for p in new if p == " " or p[0].isspace() and (p[0] != " " or p[1].isspace()) or p[-1].isspace()]
        made = {p: self._alone(p) for p in odd}
        clean = [p for p in new if p not in made]
        for lo in range(0, len(clean), 512):
            made |= dict(zip(clean[lo : lo + 512], self._align(clean[lo : lo + 512]), strict=True))
        self.parts.keep(made)
        known |= made
        out = {w: known[ps[0]] if len(ps) == 1 else _joined([known[p] for p in ps]) for w, ps in cut.items()}
        self.words.keep(out)
        return out

    def many(self, texts: list[str | None]) -> Run:
        """The alignment of texts: each distinct stretch between spaces is looked up once, all else is counted in arrays."""
        split = [t.split(" ") if t else [] for t in texts]
        place: dict[str, int] = defaultdict(count().__next__)
        number = [list(map(place.__getitem__, s)) for s in split]
        wide = {k for w, k in place.items() if not w or w[-1].isspace()}
        if wide:  # white space runs over the cuts of some
            for k, ids in enumerate(number):
                if not wide.isdisjoint(ids):
                    number[k] = [place[p[1:]] for p in self.wide.split(" " + texts[k])]
        used = set().union(*number) if wide else place.values()
        known, new = self.words.held({w for w, k in place.items() if k in used} if len(used) < len(place) else place.keys())
        known |= self._missing(new)
        of = [known.get(w, _DIFFERS) for w in place]

        counts = np.fromiter(map(len, number), np.int64, len(number))
        text_of = np.repeat(np.arange(len(texts)), counts)
        word = np.fromiter(chain.from_iterable(number), np.int64, len(text_of))
        n_a, n_b = (np.fromiter(map(itemgetter(c), of), np.int64, len(of)) for c in (0, 1))
        whole = np.bincount(text_of, weights=n_a[word] == 0, minlength=len(texts)) == 0
        total = lambda n: np.bincount(text_of, weights=n[word], minlength=len(texts)).astype(np.int64) * whole
        groups, pairs = (list(map(itemgetter(c), of)) for c in (2, 3))
        said = [b";".join([groups[k] for k in ids]) if w else b"" for ids, w in zip(number, whole.tolist(), strict=True)]

        links = np.fromiter(map(len, pairs), np.int64, len(of))
        code, pair = np.unique(np.fromiter(chain.from_iterable(pairs), np.int64, int(links.sum())), return_inverse=True)
        first = np.cumsum(links) - links
        word, text_of = word[whole[text_of]], text_of[whole[text_of]]
        n = links[word]
        at = np.repeat(first[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        key, times = np.unique(np.repeat(text_of, n) * max(len(code), 1) + pair[at], return_counts=True)
        row, which = key // max(len(code), 1), key % max(len(code), 1)
        return Run(total(n_a), total(n_b), said, np.searchsorted(row, np.arange(len(texts) + 1)), code[which], times)


class Run(NamedTuple):
    """Of texts in a row: tokens, groups, and the links by pair: those of text k are pair[start[k]:start[k + 1]], `times` each."""

    n_a: np.ndarray
    n_b: np.ndarray
    groups: list[bytes]
    start: np.ndarray
    pair: np.ndarray
    times: np.ndarray


class Kept:
    """What was worked out for the texts met last: two generations, of which the older goes."""

    def __init__(self, most: int):
        self.half = max(most // 2, 1)
        self.new: dict[str, Aligned] = {}
        self.old: dict[str, Aligned] = {}

    def held(self, keys: Iterable[str]) -> tuple[dict[str, Aligned], list[str]]:
        """Those known, and the keys of the others."""
        new, old = self.new, self.old
        found, again, missing = {}, {}, []
        for k in keys:
            v = new.get(k)
            if v is None:
                v = old.get(k)
                if v is None:
                    missing.append(k)
                    continue
                again[k] = v
            found[k] = v
        self.keep(again)
        return found, missing

    def keep(self, made: dict[str, Aligned]) -> None:
        if len(self.new) + len(made) > self.half:
            self.old, self.new = self.new, {}
        self.new |= made if max(map(len, made), default=0) <= KEEP_CHARS else {k: v for k, v in made.items() if len(k) <= KEEP_CHARS}


def _joined(parts: list[Aligned]) -> Aligned:
    if len(parts) == 2:  # a word and its sign
        x, y = parts
        return Aligned(x[0] + y[0], x[1] + y[1], b"%b;%b" % (x[2], y[2]), x[3] + y[3]) if x[0] and y[0] else _DIFFERS
    if not all(p.n_a for p in parts):
        return _DIFFERS
    return Aligned(sum(p.n_a for p in parts), sum(p.n_b for p in parts), b";".join([p.groups for p in parts]), sum((p.pairs for p in parts), ()))


_LOADED: dict[tuple[str, str], Aligner] = {}


def _aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _LOADED:
        _LOADED[path_a, path_b] = Aligner(path_a, path_b)
    return _LOADED[path_a, path_b]


def align_tokens(docs: DataFrame, *, digest: bool = False, path_a: str | None = None, path_b: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups, pairs) of every row: tokens, groups as `a1,a2|b1;a3|b2,b3`, links as (pair, links) with pair a << 32 | b.

    With `digest`, groups_sha256 (hex; empty without tokens) takes the place of groups, so that they need not leave the task.

    The text stands with a space before it, which B's library adds itself.
    Offsets where tokens of both end cut them into groups; as every token has
    bytes, one A and one B token end there, and they are the link. Null and empty
    texts, and those whose bytes a tokenizer changes, have no tokens (zeros, an
    empty string). Texts of any length are aligned whole. Repeated rows stay,
    null ids stay null, other columns are ignored. Empty table: no rows. The
    paths must exist on every executor.
    """
    ship(docs.sparkSession)
    a, b = path_a or default_path(), path_b or piece_path()
    column = "groups_sha256" if digest else "groups"
    schema = f"doc_id long, n_a long, n_b long, n_groups long, {column} string, pairs array<struct<pair: long, links: long>>"
    pair = pa.struct([("pair", pa.int64()), ("links", pa.int64())])

    def said(groups: bytes) -> bytes | str:
        return hashlib.sha256(groups).hexdigest() if digest and groups else groups

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a, b)
        for batch in batches:
            for part in _runs(batch):
                # nothing here makes reference cycles; walking the memos for them costs more than the work
                gc.disable()
                try:
                    found = aligner.many(part.column(1).to_pylist())
                finally:
                    gc.enable()
                flat = pa.StructArray.from_arrays([pa.array(found.pair), pa.array(found.times)], fields=list(pair))
                links = np.r_[0, np.cumsum(found.times)][found.start]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(found.n_a), pa.array(found.n_b), pa.array(np.diff(links)), pa.array(map(said, found.groups), pa.string()), pa.ListArray.from_arrays(pa.array(found.start, pa.int32()), flat)],
                    ["doc_id", "n_a", "n_b", "n_groups", column, "pairs"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(convert, schema)


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of some RUN_BYTES of text, or one row."""
    size = np.cumsum([n or 0 for n in pa.compute.binary_length(batch.column(1)).to_pylist()])
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + RUN_BYTES)))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): links of a pair over all rows, and whether no pair of its B token has more."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            flat = batch.column(0).flatten()
            at, where = np.unique(np.r_[pair, flat.field("pair").to_numpy()], return_inverse=True)
            n = np.bincount(where, weights=np.r_[n, flat.field("links").to_numpy()], minlength=len(at)).astype(np.int64)
            pair = at
            if len(pair) > BROADCAST_PAIRS:  # bounds the task's memory
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], ["pair", "n"])
                pair, n = pair[:0], n[:0]
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], ["pair", "n"])

    counts = settle(aligned.select("pairs").mapInArrow(tally, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))  # not more rows than B has tokens
    return counts.withColumn("b", b).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def link_statistics(aligned: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """`aligned` (written: it is read twice) without pairs, with n_links, n_best and count_sum.

    count_sum adds the corpus-wide count of each link's pair; n_best counts
    links whose pair is (one of) the most frequent of its B token. The
    `broadcast_pairs` most frequent pairs are looked up in place; if there are
    more, the rest, rare by then, is joined by a shuffle.
    """
    spark = aligned.sparkSession
    ship(spark)
    counts = settle(_pair_counts(aligned))
    rest = counts.count() > broadcast_pairs
    frequent = counts.orderBy(F.desc("n"), "pair").limit(broadcast_pairs) if rest else counts
    table = frequent.toArrow().sort_by("pair")
    sent = spark.sparkContext.broadcast([table.column(c).to_numpy() for c in ("pair", "n", "best")])
    pair = pa.struct([("pair", pa.int64()), ("links", pa.int64())])
    keep = [c for c in aligned.columns if c != "pairs"]
    fields = [f for f in aligned.schema.fields if f.name != "pairs"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "n_links long, n_best long, count_sum long"] + ["rare array<struct<pair: long, links: long>>"] * rest)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = sent.value
        for batch in batches:
            lists = batch.column(len(keep))
            flat = lists.flatten()
            code, links = flat.field("pair").to_numpy(), flat.field("links").to_numpy()
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            at = np.minimum(np.searchsorted(known, code), max(len(known) - 1, 0))
            hit = known[at] == code if len(known) else np.zeros(len(code), dtype=bool)

            def summed(row: np.ndarray, x: np.ndarray, rows: int = batch.num_rows) -> pa.Array:
                out = np.zeros(rows, dtype=np.int64)
                np.add.at(out, row, x)
                return pa.array(out)

            hits = links[hit]
            cols = [*batch.columns[: len(keep)], summed(row, links), summed(row[hit], hits * best[at[hit]]), summed(row[hit], hits * n[at[hit]])]
            names = [*keep, "n_links", "n_best", "count_sum"]
            if rest:
                left = ~hit
                size = np.bincount(row[left], minlength=batch.num_rows)
                cols.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), pa.StructArray.from_arrays([pa.array(code[left]), pa.array(links[left])], fields=list(pair))))
                names.append("rare")
            yield pa.RecordBatch.from_arrays(cols, names)

    found = aligned.select(*keep, "pairs").mapInArrow(look_up, schema)
    if not rest:
        return found
    found = settle(found.withColumn("__row", F.monotonically_increasing_id()))
    rare = found.select("__row", F.inline("rare")).join(counts, "pair").groupBy("__row").agg(F.sum(F.col("links") * F.col("best").cast("long")).alias("__best"), F.sum(F.col("links") * F.col("n")).alias("__sum"))
    more = found.drop("rare").join(rare, "__row", "left")
    plus = lambda c, x: (F.col(c) + F.coalesce(F.col(x), F.lit(0))).alias(c)
    return more.select(*keep, "n_links", plus("n_best", "__best"), plus("count_sum", "__sum"))


def alignment_digests(docs: DataFrame, **paths: str | None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256); '' for rows without tokens."""
    return link_statistics(settle(align_tokens(docs, digest=True, **paths)))
