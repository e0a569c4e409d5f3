"""Token counts by byte-pair merging with a heap and a linked list.

A pre-token's symbols form a doubly linked list; a heap holds the ranks of its
adjacent pairs. The lowest-rank pair (the leftmost of equal ones) is popped
and merged again and again; the count is the initial symbols minus the merges,
and no identifier is made. Pre-tokens recur, so counts are kept in a bounded
table of the worker.

Each row is worked on alone; there is no shuffle, and the merge table has the
fixed size of the vocabulary file, which every worker reads once.
"""

from __future__ import annotations

import heapq
import json
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: The split of the byte-level format: contractions, letters, numbers, other signs, white space. Fixed values.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens of at most so many bytes are kept, at most so many of them.
KEEP_BYTES, KEEP = 32, 800_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(extra)) for b in range(256)]


class ByteBpe:
    """A byte-level BPE vocabulary file (tokenizers JSON) that only counts."""

    def __init__(self, path: str, keep: int = KEEP):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = [t["content"] for t in spec.get("added_tokens", []) if t["content"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        ids: dict[str, int] = dict(spec["model"]["vocab"])
        letters = _byte_letters()
        self.first = [ids.get(c) for c in letters]
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            if a in ids and b in ids:
                self.pairs.setdefault(ids[a] << 32 | ids[b], (rank, ids[a + b]))
        self.split = regex.compile(SPLIT)
        self.keep = keep
        self.known: dict[str, int] = {}

    def merged(self, raw: bytes) -> int:
        """The tokens of one pre-token."""
        sym = [s for b in raw if (s := self.first[b]) is not None]
        n = len(sym)
        if n < 2:
            return n
        get = self.pairs.get
        heap = [(p[0], i, p[1]) for i in range(n - 1) if (p := get(sym[i] << 32 | sym[i + 1]))]
        if not heap:
            return n
        heapq.heapify(heap)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        merges = 0
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            rank, i, new = pop(heap)
            left = sym[i]
            if left < 0:
                continue
            j = after[i]
            if j >= n:
                continue
            p = get(left << 32 | sym[j])
            if p is None or p[0] != rank:  # an older pair's entry
                continue
            sym[i] = new
            sym[j] = -1
            merges += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if p := get(new << 32 | sym[k]):
                    push(heap, (p[0], i, p[1]))
            h = before[i]
            if h >= 0 and (p := get(sym[h] << 32 | new)):
                push(heap, (p[0], h, p[1]))
        return n - merges

    def _plain(self, text: str) -> int:
        known, total = self.known, 0
        for piece, times in Counter(self.split.findall(text)).items():
            n = known.get(piece)
            if n is None:
                raw = piece.encode("utf-8")
                n = self.merged(raw)
                if len(raw) <= KEEP_BYTES and len(known) < self.keep:
                    known[piece] = n
            total += n * times
        return total

    def count(self, text: str) -> int:
        """Tokens of a text; a special token's string in it is one token."""
        if self.special is None or not any(s in text for s in self.specials):
            return self._plain(text)
        return sum(map(self._plain, self.special.split(text))) + len(self.special.findall(text))


_LOADED: dict[str, ByteBpe] = {}


def _bpe(path: str) -> ByteBpe:
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def token_counts(docs: DataFrame, *, path: str | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row, as the vocabulary's library counts without added begin and end.

    A null text counts as empty: 0 bytes, 0 tokens. Texts of any length are
    counted whole. Repeated rows stay; null ids stay null; other columns are
    ignored. Empty table: no rows. `path` must exist on every executor.
    """
    ship(docs.sparkSession)
    where = path or default_path()

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(where)
        for batch in batches:
            texts = batch.column(1)
            bytes_, tokens = [], []
            for lo in range(0, batch.num_rows, 256):
                for text in texts.slice(lo, 256).to_pylist():
                    text = text or ""
                    bytes_.append(len(text.encode("utf-8")))
                    tokens.append(bpe.count(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bytes_, pa.int64()), pa.array(tokens, pa.int64()), pa.array([t > limit for t in tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(convert, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
