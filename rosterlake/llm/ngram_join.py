"""N-gram Jaccard join by a prefix tree.

Every document's set of distinct n-word shingles is put in one global order,
rare shingles first. Two sets of the wanted similarity must share a shingle of
their prefixes, so prefixes alone are dealt out by shingle. What shares one is
brought together, a bounded bundle at a time, and stored in a trie in the
global order; each set walks the trie, shares the overlaps of common stems and
leaves a subtree as soon as the lengths that remain cannot give the overlap.

At scale: a row of the first shuffle is 24 bytes and only about (1 - threshold)
of the shingles are dealt; equal sets are one class and each task deals a class
once; the order comes from a sketch of fixed size over all shingles; links are
first looked for from each class to its commonest partner only, so that a group
of m near copies costs m links and not m * m; only pairs that these leave in
different components are looked at again.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import Scratch, components, membership, merged_sketch, settle, shared_dir, ship, sketch_rows, slot_of, sorted_groups

#: Counters of the frequency sketch: powers of two from the first to the second, one for each TEXT bytes of text; 1 byte each once broadcast.
LEAST_SLOTS, MOST_SLOTS, TEXT = 1 << 16, 1 << 25, 128
#: Sets in one bundle besides the set that all were found with.
BUNDLE = 256
#: Where more classes share a prefix shingle they are compared as a crowd, block against block, instead of pair by pair; classes in a block.
CROWD, BLOCK = 64, 1024


def _levels(counts: np.ndarray) -> np.ndarray:
    return np.minimum(255, np.floor(6 * np.log2(counts + 1.0))).astype(np.uint8)


def _in_order(tokens: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The sorted tokens in the global order: by frequency level, then by value."""
    return tokens[np.argsort(level[(tokens & np.uint64(len(level) - 1)).astype(np.int64)], kind="stable")]


def _prefix(n: int, percent: int) -> int:
    """Shingles of a set of n of which a similar other set must have one; 0: only an equal set is similar."""
    return 0 if 100 * n < percent * (n + 1) else n - (percent * n + 99) // 100 + 1


class Trie:
    """Sorted integer sequences with shared stems; nodes are (segment, end depth, least and largest size below, leaf, children)."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        order = sorted(range(len(sets)), key=lambda k: sets[k].astype(">u4").tobytes())
        self.root: list = [np.zeros(0, np.int64), 0, 0, 0, [], []]
        todo = [(self.root, order, 0)]
        while todo:
            node, members, depth = todo.pop()
            sizes = [len(sets[k]) for k in members]
            node[2], node[3] = min(sizes, default=0), max(sizes, default=0)
            first = 0
            while first < len(members) and len(sets[members[first]]) == depth:
                node[4].append(members[first])
                first += 1
            while first < len(members):
                head = sets[members[first]][depth]
                last = first
                while last + 1 < len(members) and sets[members[last + 1]][depth] == head:
                    last += 1
                x, y = sets[members[first]], sets[members[last]]
                m = min(len(x), len(y))
                apart = np.flatnonzero(x[depth:m] != y[depth:m])
                end = depth + int(apart[0]) if len(apart) else m
                child: list = [x[depth:end], end, 0, 0, [], []]
                node[5].append(child)
                todo.append((child, members[first : last + 1], end))
                first = last + 1

    def similar(self, k: int, universe: int, percent: int) -> Iterator[int]:
        """The members whose Jaccard similarity with member k is at least percent / 100."""
        x = self.sets[k]
        n = len(x)
        has = np.zeros(universe, dtype=bool)
        has[x] = True
        stack = [(self.root, 0)]
        while stack:
            (segment, end, least, most, leaves, children), overlap = stack.pop()
            left = n
            if len(segment):
                overlap += int(np.count_nonzero(has[segment]))
                left = n - int(np.searchsorted(x, segment[-1], side="right"))
            smallest = max(least, -(-percent * n // 100))
            if 100 * min(n, most) < percent * max(n, least) or (100 + percent) * (overlap + min(left, most - end)) < percent * (n + smallest):
                continue
            for y in leaves:
                if y != k and 100 * overlap >= percent * (n + len(self.sets[y]) - overlap):
                    yield y
            stack += [(c, overlap) for c in children]


def linked(sets: list[np.ndarray], percent: int, first: int = 0, known: list[int] | None = None) -> list[tuple[int, int]]:
    """Similarity links between the rank sequences `sets` that span their components.

    known: labels of sets that are already linked (equal labels). Sets linked
    with the most common label, or else with the first set, need not look for
    partners: whatever they could find looks for them.
    """
    parent = list(range(len(sets)))

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    base = first
    if known is not None:
        seen: dict[int, int] = {}
        for k, label in enumerate(known):
            parent[k] = seen.setdefault(label, k)
        common = Counter(known).most_common(1)[0]
        base = seen[common[0]]
    left = sum(parent[k] == k for k in range(len(sets)))
    trie = Trie(sets)
    universe = 1 + max((int(s[-1]) for s in sets if len(s)), default=0)
    links = []
    looks = known is None or left == len(sets)  # nothing is known of the base: it looks first
    for k in [base, *(k for k in range(len(sets)) if k != base)]:
        if left == 1:
            break
        if find(k) == find(base) and not (k == base and looks):
            continue
        for y in trie.similar(k, universe, percent):
            if find(y) != find(k):
                parent[find(y)] = find(k)
                links.append((k, y))
                left -= 1
    return links


def ngram_components(docs: DataFrame, *, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", bundle: int = BUNDLE, bits: int = 64) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of `docs`.

    Two documents link when 100 * |intersection| >= percent * |union| of their
    distinct n-word shingles (words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased; a
    text of fewer words is one shingle). component_id is the least doc_id that
    links reach, itself included. Shingles are compared by 64-bit hashes, whole
    sets by 128-bit digests (bits: how many of their first half are used).

    Null and empty texts, and texts without words: n_shingles 0, linked with
    nothing. Repeated rows stay, each with its component. A null doc_id never is
    a component_id unless all of its component are null. Empty table: no rows.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    shared_dir(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slots = min(MOST_SLOTS, max(LEAST_SLOTS, 1 << int(size // TEXT).bit_length()))

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(slots, dtype=np.uint32)
        seen: set[int] = set()
        mask = np.uint64(slots - 1)
        names = ["doc_id", "n", "cid", "chk", "piece", "packed"]
        for batch in batches:
            size, cid, chk = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for r, s in K.distinct_sets(batch.column(1), n):
                size[r] = len(s)
                if len(s):
                    cid[r], chk[r] = _halves(s, bits)
                    if cid[r] not in seen:
                        seen.add(int(cid[r]))
                        np.add.at(counts, (s & mask).astype(np.int64), np.uint32(1))
            blank = pa.nulls(batch.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(cid, mask=size == 0), pa.array(chk, mask=size == 0), blank, pa.nulls(batch.num_rows, pa.binary())], names)
        k, packed = sketch_rows(counts)
        none = pa.nulls(len(k), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(k, pa.int32()), pa.array(packed, pa.binary())], names)

    with Scratch(spark) as scratch:
        prep = scratch.keep(rows.mapInArrow(first_pass, "doc_id long, n long, cid long, chk long, piece int, packed binary"), "prep")
        level = spark.sparkContext.broadcast(merged_sketch(prep.filter("piece is not null"), slots, _levels))
        own = prep.filter("piece is null").select("doc_id", "n", "cid", "chk")
        # Different sets of one cid: of m sets m * m / 2**65 are to be expected, so some hundreds of 10**11. They are classes by the digest's other half.
        met = own.filter("cid is not null").groupBy("cid").agg(F.min("chk").alias("a"), F.max("chk").alias("b")).filter("a <> b").select("cid")
        twins = frozenset(r.cid for r in met.toLocalIterator())
        own = own.select("doc_id", "n", (F.when(F.col("cid").isin(*twins), F.col("chk")).otherwise(F.col("cid")) if twins else F.col("cid")).alias("cid"))
        links = _class_links(rows, level, scratch, n, percent, bundle, (twins, bits))
        roots = components(links)
        classes = own.filter("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
        joined = classes.join(roots, F.col("cid") == F.col("node"), "left").select("cid", "rep", "copies", F.coalesce("root", "cid").alias("root"), F.col("root").isNotNull().alias("linked"))
        # Only classes of several rows or with links need more than their own row.
        joined = scratch.settle(joined.filter("linked or copies > 1"))
        least = joined.groupBy("root").agg(F.min("rep").alias("component_id"))
        found = joined.join(least, "root").select("cid", "component_id")
        out = own.join(found, "cid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
        return settle(out)


def _halves(tokens: np.ndarray, bits: int) -> tuple[int, int]:
    """The halves of the digest of a set, of the first one the upper bits."""
    first, second = K.digest(tokens)
    return first >> (64 - bits), second


def _class(tokens: np.ndarray, twins: frozenset[int], bits: int) -> int:
    """What names the class of equal sets: the digest's first half, or where that is not one set's alone its second."""
    first, second = _halves(tokens, bits)
    return second if first in twins else first


def _class_links(rows: DataFrame, level, scratch: Scratch, n: int, percent: int, bundle: int, naming: tuple[frozenset[int], int]) -> DataFrame:
    """(a, b) links between classes with the same components as all links."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        table = level.value
        for batch in batches:
            parts: list[tuple] = []
            for _, s in K.distinct_sets(batch.column(1), n):
                if p := _prefix(len(s), percent):
                    cid = _class(s, *naming)
                    if cid not in seen:
                        seen.add(cid)
                        parts.append((_in_order(s, table)[:p].view(np.int64), cid, len(s)))
            sizes = [len(x[0]) for x in parts]
            if parts:
                arrays = [np.concatenate([x[0] for x in parts]), np.repeat(np.array([x[1] for x in parts], np.int64), sizes), np.repeat(np.array([x[2] for x in parts], np.int32), sizes), np.concatenate([np.arange(k, dtype=np.int32) for k in sizes])]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["tok", "cid", "n", "pos"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the rows in order of (tok, n, cid), those of tokens with two classes at least, once each."""
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held is not None and held.num_rows else table
            tok = held.column(0).to_numpy()
            end = int(np.searchsorted(tok, tok[-1])) if len(tok) else 0  # the last token may go on
            if end:
                yield from _shared(held.slice(0, end))
                held = held.slice(end)
        if held is not None:
            yield from _shared(held)

    with_prefix = rows.mapInArrow(prefixes, "tok long, cid long, n int, pos int")
    live = scratch.keep(with_prefix.repartition("tok").sortWithinPartitions("tok", "n", "cid").mapInArrow(shared, "tok long, cid long, n int, pos int"), "live")

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each class with the first of its token whose size allows a link."""
        found = _Met()
        for batch in batches:
            tok, cid, size, pos = (batch.column(k).to_numpy() for k in range(4))
            first = np.maximum.accumulate(np.where(np.concatenate(([True], tok[1:] != tok[:-1])), np.arange(len(tok)), 0))
            ok = np.flatnonzero((100 * size[first].astype(np.int64) >= percent * size.astype(np.int64)) & (first != np.arange(len(tok))))
            found.add(cid[first[ok]], cid[ok], size[first[ok]], size[ok], pos[first[ok]], pos[ok])
            if found.rows > 1 << 18:
                yield found.taken()
        yield found.taken()

    best = _possible(live.mapInArrow(partners, _MET), percent).groupBy("cid").agg(F.max_by("hub", F.struct("times", "hub")).alias("hub")).select("hub", "cid")
    one = scratch.keep(_verified(_paired(best, scratch, bundle), scratch, rows, level, n, percent, naming), "one")
    roots = components(one)
    apart = live.join(roots, F.col("cid") == F.col("node"), "left").select("tok", "n", "cid", "pos", F.coalesce("root", "cid").alias("root"))

    def crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of different components that share a token; under a crowded one (first class, class) with n1 = 0."""
        found = _Met()
        for group in sorted_groups(batches, 1):
            _, size, cid, pos, root = (group.column(k).to_numpy() for k in range(5))
            if (root == root[0]).all():
                continue
            if len(cid) > CROWD:
                none = np.zeros(len(cid), dtype=np.int32)
                found.add(np.full(len(cid), cid[0]), cid, none, none, none, none)
            for k in range(1, len(cid)) if len(cid) <= CROWD else ():  # each class with the shorter ones before it
                lo = int(np.searchsorted(size[:k], -(-percent * int(size[k]) // 100)))
                # Shared shingles come in one order in both sets: where this one is too late to be the first, so are all after it.
                most = np.minimum(size[lo:k] - pos[lo:k], size[k] - pos[k]).astype(np.int64)
                other = lo + np.flatnonzero((root[lo:k] != root[k]) & (most * (100 + percent) >= (size[lo:k].astype(np.int64) + size[k]) * percent))
                own = np.full(len(other), k)
                found.add(cid[other], cid[own], size[other], size[own], pos[other], pos[own])
            if found.rows > 1 << 18:
                yield found.taken()
        yield found.taken()

    met = scratch.keep(apart.repartition("tok").sortWithinPartitions("tok", "n", "cid").mapInArrow(crossing, _MET), "met")
    # A pair that also meets under a crowded token is compared there, so its other meetings may be too few to keep it here.
    pairs = _paired(_possible(met.filter("n1 > 0"), percent).select("hub", "cid"), scratch, bundle)
    seats = pairs.withColumn("part", -1 - F.col("part")).unionByName(_crowds(met.filter("n1 = 0").select("hub", "cid").distinct(), scratch))
    labelled = seats.join(roots, F.col("cid") == F.col("node"), "left").select("hub", "part", "cid", F.coalesce("root", "cid").alias("label"))
    return one.union(_verified(labelled, scratch, rows, level, n, percent, naming))


#: Pairs of classes that met under prefix tokens: how often, and the last positions where.
_MET = "hub long, cid long, n1 int, n2 int, pos1 int, pos2 int, times long"


class _Met:
    """Meetings of pairs, summed up before they leave the task."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.rows = 0

    def add(self, *columns: np.ndarray) -> None:
        if len(columns[0]):
            self.parts.append(columns)
            self.rows += len(columns[0])

    def taken(self) -> pa.RecordBatch:
        names = ["hub", "cid", "n1", "n2", "pos1", "pos2", "times"]
        kinds = [np.int64, np.int64, np.int32, np.int32, np.int32, np.int32, np.int64]
        columns = [np.concatenate([p[k] for p in self.parts]) if self.parts else np.zeros(0, kinds[k]) for k in range(6)]
        self.parts, self.rows = [], 0
        order = np.lexsort((columns[1], columns[0]))
        columns = [c[order] for c in columns]
        at = np.flatnonzero(np.concatenate(([True], (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])))) if len(order) else np.zeros(0, np.int64)
        times = np.diff(np.append(at, len(order)))
        last = [np.maximum.reduceat(c, at) if len(at) else c for c in columns[4:]]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(kind)) for c, kind in zip([*(c[at] for c in columns[:4]), *last, times], kinds, strict=True)], names)


def _possible(met: DataFrame, percent: int) -> DataFrame:
    """Pairs that can be similar: what they share is their meetings and at most what follows the last one in either set."""
    total = met.groupBy("hub", "cid", "n1", "n2").agg(F.max("pos1").alias("pos1"), F.max("pos2").alias("pos2"), F.sum("times").alias("times"))
    bound = F.col("times") + F.least(F.col("n1") - F.col("pos1"), F.col("n2") - F.col("pos2")) - 1
    return total.filter(bound * (100 + percent) >= (F.col("n1") + F.col("n2")) * percent)


def _packed(tokens: np.ndarray) -> bytes:
    """The low 48 bits of each; two sets of a million shingles still have one false match in 300 pairs at most."""
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(packed, dtype=np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8").astype(np.uint64)


def _shared(table: pa.Table) -> Iterator[pa.RecordBatch]:
    tok, cid = table.column(0).to_numpy(), table.column(1).to_numpy()
    if not len(tok):
        return
    new = np.concatenate(([True], tok[1:] != tok[:-1]))
    once = new | np.concatenate(([True], cid[1:] != cid[:-1]))
    table, new = table.filter(pa.array(once)), new[once]
    at = np.flatnonzero(new)
    several = np.repeat(np.diff(np.append(at, len(new))) > 1, np.diff(np.append(at, len(new))))
    yield from table.filter(pa.array(several)).combine_chunks().to_batches(max_chunksize=1 << 16)


def _paired(pairs: DataFrame, scratch: Scratch, bundle: int) -> DataFrame:
    """(hub, part, cid): each hub in bundles of at most about `bundle` of the classes paired with it."""
    pairs = scratch.settle(pairs)
    many = pairs.groupBy("hub").agg(F.count("*").alias("m")).select("hub", F.ceil(F.col("m") / bundle).alias("parts"))
    dealt = scratch.settle(pairs.join(many, "hub").select("hub", F.pmod(F.xxhash64("cid"), "parts").alias("part"), "cid"))
    return dealt.union(dealt.select("hub", "part", F.col("hub").alias("cid")).distinct())


def _crowds(members: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """(hub, part, cid): the classes of a hub's crowd by pairs of blocks, so that any two are together somewhere."""
    members = scratch.settle(members)
    sizes = members.groupBy("hub").agg(F.ceil(F.count("*") / F.lit(block)).alias("b"))
    placed = members.join(sizes, "hub").select("hub", "cid", "b", F.pmod(F.xxhash64("cid"), "b").alias("i"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("b") - 1)).alias("j"))
    return placed.select("hub", (F.least("i", "j") * F.col("b") + F.greatest("i", "j")).alias("part"), "cid")


def _verified(seats: DataFrame, scratch: Scratch, rows: DataFrame, level, n: int, percent: int, naming: tuple[frozenset[int], int]) -> DataFrame:
    """(a, b): links that span those among the classes of each bundle (hub, part); label, where there is one, is equal for linked classes."""
    known = "label" in seats.columns
    seats = scratch.settle(seats if known else seats.withColumn("label", F.col("cid")))
    classes = rows.sparkSession.sparkContext.broadcast(membership(seats.select("cid").distinct()))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            names, values = [], []
            for _, s in K.distinct_sets(batch.column(0), n):
                if _prefix(len(s), percent) and (cid := _class(s, *naming)) not in seen and classes.value[slot_of(np.array([cid]), len(classes.value))[0]]:
                    seen.add(cid)
                    names.append(cid)
                    values.append(_packed(s))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(values, pa.binary())], ["cid", "tokens"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for group in sorted_groups(batches, 2):
            hub = group.column(0)[0].as_py()
            members = dict(zip(group.column(2).to_pylist(), zip(group.column(4).to_pylist(), group.column(3).to_pylist(), strict=True), strict=True))
            if len(members) < 2:
                continue
            names = list(members)
            tokens = [_unpacked(members[c][0]) for c in names]
            every = np.unique(np.concatenate(tokens))
            every = _in_order(every, level.value)
            by_value = np.argsort(every)
            ranks = [np.sort(by_value[np.searchsorted(every, t, sorter=by_value)]) for t in tokens]
            out += [(names[a], names[b]) for a, b in linked(ranks, percent, names.index(hub) if hub in members else 0, [members[c][1] for c in names] if known else None)]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

    whole = rows.select("text").mapInArrow(sets, "cid long, tokens binary").dropDuplicates(["cid"])  # each task gives a class once
    seated = seats.join(whole, "cid").select("hub", "part", "cid", "label", "tokens")
    # Few bytes can be long walks: a fixed number of tasks, which adaptive execution does not join.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return seated.repartition(parts, "hub", "part").sortWithinPartitions("hub", "part").mapInArrow(walk, "a long, b long")
