"""Ranked lexical search over classes of equal term bags.

Documents are cut down to the terms of the items. Those with the same counts of
these terms and the same length measure m score alike for every item, so each
such class is scored once; the classes that win are expanded into their members
in the order of doc_id.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, merged_sketch, settle, ship, sketch_rows

#: Documents of an item's list.
TOP = 20
#: Distinct (item, term) pairs of one block of items: bounds what is broadcast. One larger item is a block of its own.
BLOCK_ENTRIES = 500_000
#: Documents for which one scoring task is worth its list of winners.
DOCS_A_TASK = 20_000
#: Winning classes are broadcast up to so many bytes, joined by a shuffle beyond.
BROADCAST_BYTES = 64 << 20
#: Cells of the matrix of classes by items (and of its summands) that a task holds at once.
_CELLS = 8_000_000
_WORD = b"0123456789abcdefghijklmnopqrstuvwxyz"
_TERMS = bytes(c if c >= 0x80 or c in _WORD else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def terms(raw: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and signs beyond ASCII of UTF-8, A-Z lower-cased."""
    return raw.translate(_TERMS).split()


class Block:
    """Items with the postings of their terms: items of term t are item[start[t]:start[t + 1]], q times each."""

    def __init__(self, ids: list[int | None], counts: list[Counter]):
        self.ids = ids
        self.term = {t: k for k, t in enumerate(sorted(set().union(*counts)))}
        entries = sorted((self.term[t], i, q) for i, c in enumerate(counts) for t, q in c.items())
        self.item = np.array([e[1] for e in entries], dtype=np.int64)
        self.q = np.array([e[2] for e in entries], dtype=np.int64)
        self.start = np.searchsorted([e[0] for e in entries], np.arange(len(self.term) + 1))

    def bag(self, words: list[bytes]) -> bytes:
        """(term, times) pairs of the block's terms, by term, as little-endian 32-bit numbers."""
        known = self.term
        held = sorted((known[t], n) for t, n in Counter(words).items() if t in known)
        return np.array(held, dtype="<i4").tobytes()


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[Block]:
    """Items without terms are left out; rows repeated whole count once."""
    ids, counts, size = [], [], 0
    for row in items.select(F.col(id_col).cast("long"), text_col).distinct().toLocalIterator():
        found = Counter(terms((row[1] or "").encode()))
        if not found:
            continue
        if ids and size + len(found) > BLOCK_ENTRIES:
            yield Block(ids, counts)
            ids, counts, size = [], [], 0
        ids.append(row[0])
        counts.append(found)
        size += len(found)
    if ids:
        yield Block(ids, counts)


class _Winners:
    """The k best classes of each item so far: highest score, then least first member (null last)."""

    def __init__(self, k: int, n_items: int):
        self.k, self.least = k, np.zeros(n_items, dtype=np.int64)
        self.item = self.score = self.first = np.zeros(0, dtype=np.int64)
        self.null = np.zeros(0, dtype=bool)
        self.row: list[tuple] = []

    def add(self, scores: np.ndarray, first: np.ndarray, null: np.ndarray, rows: list[tuple]) -> None:
        at, item = np.nonzero((scores > 0) & (scores >= self.least))
        if not len(at):
            return
        item, score = np.concatenate([self.item, item]), np.concatenate([self.score, scores[at, item]])
        first, null = np.concatenate([self.first, first[at]]), np.concatenate([self.null, null[at]])
        order = np.lexsort((first, null, -score, item))
        head = np.flatnonzero(np.r_[True, np.diff(item[order]) != 0])
        rank = np.arange(len(order)) - np.repeat(head, np.diff(np.r_[head, len(order)]))
        keep, old = order[rank < self.k], self.row
        self.least[item[order[rank == self.k - 1]]] = score[order[rank == self.k - 1]]
        self.item, self.score, self.first, self.null = item[keep], score[keep], first[keep], null[keep]
        self.row = [old[r] if r < len(old) else rows[at[r - len(old)]] for r in keep.tolist()]


def _scores(block: Block, weight: np.ndarray, bags: list[bytes], m: np.ndarray) -> np.ndarray:
    """Scores of classes (rows) for items (columns), in 64-bit integers."""
    n = len(block.ids)
    out = np.zeros(len(bags) * n, dtype=np.int64)
    held = np.frombuffer(b"".join(bags), dtype="<i4").reshape(-1, 2).astype(np.int64)
    row = np.repeat(np.arange(len(bags)), [len(b) // 8 for b in bags])
    t, tf = held[:, 0], held[:, 1]
    part = weight[t] * (1_000_000_000 * tf // (1000 * tf + 12 * m[row]))
    uses = block.start[t + 1] - block.start[t]
    at = np.repeat(block.start[t] - (np.cumsum(uses) - uses), uses) + np.arange(uses.sum())
    np.add.at(out, np.repeat(row, uses) * n + block.item[at], np.repeat(part, uses) * block.q[at])
    return out.reshape(len(bags), n)


def _nulls_last(score: str | Column, doc: str) -> list[Column]:
    return [F.desc(score), F.col(doc).asc_nulls_last()]


def _ranked_block(docs: DataFrame, block: Block, k: int, scratch: Scratch) -> DataFrame | None:
    """(item int, doc_id, score, rank) of a block; None if no document has a term."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    sent = sc.broadcast(block)

    def cut_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = sent.value
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            n, bags = [], []
            for lo in range(0, batch.num_rows, 256):
                for raw in texts.slice(lo, 256).to_pylist():
                    words = terms(raw or b"")
                    n.append(len(words))
                    bags.append(b.bag(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(bags, pa.binary())], ["doc_id", "n", "bag"])

    bags = scratch.settle(docs.mapInArrow(cut_down, "doc_id long, n long, bag binary").filter("n > 0"))
    total = bags.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    if not total.docs:
        return None
    slots = -(-len(block.term) // (1 << 15)) << 15

    def holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(slots, dtype=np.uint32)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                held = b"".join(batch.column(0).slice(lo, 1024).to_pylist())
                df += np.bincount(np.frombuffer(held, dtype="<i4")[::2], minlength=slots).astype(np.uint32)
        at, packed = sketch_rows(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(packed, pa.binary())], ["piece", "packed"])

    held_by = bags.filter("length(bag) > 0")
    df = merged_sketch(held_by.select("bag").mapInArrow(holding, "piece int, packed binary"), slots, lambda c: c, np.uint64)
    weight = np.array([math.floor(1000 * math.log((2 * total.docs + 2) / (2 * int(n) + 1))) for n in df[: len(block.term)]], dtype=np.int64)
    weighed = sc.broadcast(weight)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, w = sent.value, weighed.value
        best = _Winners(k, len(b.ids))
        step = max(1, min(512, _CELLS // max(len(b.ids), len(b.item))))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                h, m, bag, first = (part.column(c) for c in range(4))
                bag = bag.to_pylist()
                got = _scores(b, w, bag, m.to_numpy())
                best.add(got, first.fill_null(0).to_numpy(), first.is_null().to_numpy(zero_copy_only=False), list(zip(h.to_pylist(), m.to_pylist(), bag, first.to_pylist(), strict=True)))
        for lo in range(0, len(best.row), 4096):
            rows = best.row[lo : lo + 4096]
            cols = [[r[c] for r in rows] for c in range(4)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(best.item[lo : lo + 4096], pa.int32()), pa.array(best.score[lo : lo + 4096]), *(pa.array(v, kind) for v, kind in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.int64()), strict=True))],
                ["item", "score", "h", "m", "bag", "first"],
            )

    # the hash brings equal bags together, the grouping on the bag itself verifies them
    classed = held_by.withColumn("m", F.expr(f"100 - 25 + (25 * n * {total.docs}L) div {total.terms}L")).withColumn("h", F.xxhash64("m", "bag"))
    classes = classed.groupBy("h", "m", "bag").agg(F.min("doc_id").alias("first")).select("h", "m", "bag", "first")
    tasks = max(sc.defaultParallelism, -(-total.docs // DOCS_A_TASK))
    best = Window.partitionBy("item").orderBy(*_nulls_last("score", "first"), "h", "m", "bag")
    won = classes.coalesce(tasks).mapInArrow(score, "item int, score long, h long, m long, bag binary, first long")
    won = scratch.settle(won.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).drop("rank", "first"))
    class_ids = scratch.settle(won.select("h", "m", "bag").distinct().withColumn("cid", F.monotonically_increasing_id()))
    size = class_ids.agg(F.sum(F.length("bag") + 24)).first()[0] or 0
    small = F.broadcast if size <= BROADCAST_BYTES else lambda x: x
    members = classed.join(small(class_ids), ["h", "m", "bag"]).select("cid", "doc_id")
    members = members.withColumn("nth", F.row_number().over(Window.partitionBy("cid").orderBy(F.col("doc_id").asc_nulls_last()))).filter(F.col("nth") <= k)
    lists = won.join(class_ids, ["h", "m", "bag"]).select("item", "score", "cid").join(members, "cid")
    final = Window.partitionBy("item").orderBy(*_nulls_last("score", "doc_id"))
    out = scratch.settle(lists.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k).select("item", "doc_id", "score", "rank"))
    sent.unpersist()
    weighed.unpersist()
    return out


def ranked_search(docs: DataFrame, items: DataFrame, *, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` best documents of each item with a score above 0.

    Ties go by ascending doc_id, null ids last. Null and empty texts have no
    terms: such documents count for nothing, such items have no list. Rows that
    repeat a document are documents of their own; items repeated whole count
    once, one item_id with two texts has a list for each. Other columns are
    ignored, whatever their names. Empty tables: no rows. Every document is
    scored; a class needs no more than its `top` least members, since all of
    them score alike.

    Items go in blocks of BLOCK_ENTRIES terms; each block is one pass.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "item_id long, rank int, doc_id long, score long"
    out = spark.createDataFrame([], schema)
    for block in _blocks(items, item_id_col, item_text_col):
        with Scratch(spark) as scratch:
            found = _ranked_block(docs, block, top, scratch)
            if found is not None:
                names = spark.createDataFrame(list(enumerate(block.ids)), "item int, item_id long")
                out = out.unionByName(settle(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")))
    return out


_SIGNS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ORACLE_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SIGNS}') AS ws FROM documents),
s AS (SELECT count(*)::BIGINT AS nd, sum(len(ws))::BIGINT AS nl FROM d WHERE len(ws) > 0),
b AS (
  SELECT row_number() OVER () AS iid, item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SIGNS}') AS ws
  FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS (SELECT iid, t, count(*)::BIGINT AS q FROM (SELECT iid, unnest(ws) AS t FROM b) GROUP BY iid, t),
v AS (SELECT DISTINCT t FROM q),
f AS (
  SELECT rid, any_value(doc_id) AS doc_id, any_value(m) AS m, t, count(*)::BIGINT AS tf
  FROM (SELECT rid, doc_id, 100 - 25 + (25 * len(ws)::BIGINT * nd) // nl AS m, unnest(ws) AS t FROM d, s WHERE len(ws) > 0) JOIN v USING (t) GROUP BY rid, t),
w AS (SELECT t, floor(1000 * ln((2 * any_value(nd) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, s GROUP BY t),
r AS (
  SELECT q.iid, f.rid, any_value(f.doc_id) AS doc_id, sum(q.q * w.w * ((1000000000 * f.tf) // (1000 * f.tf + 12 * f.m)))::BIGINT AS score
  FROM q JOIN w USING (t) JOIN f USING (t) GROUP BY q.iid, f.rid),
k AS (SELECT iid, doc_id, score, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM r WHERE score > 0)
SELECT b.item_id, k.rank, k.doc_id, k.score FROM k JOIN b USING (iid) WHERE k.rank <= {TOP}
"""
