"""Shared plumbing: scratch tables, fixed-size sketches, sorted streams, components."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Gives the executors' Python this package, once a context: they need not have it installed."""
    sc = spark.sparkContext
    package = Path(__file__).resolve().parents[1]
    if getattr(sc, "_rosterlake_shipped", False) or not package.is_dir():  # already in an archive
        return
    sc._rosterlake_shipped = True
    archive = Path(tempfile.mkdtemp(prefix="rosterlake-")) / "rosterlake.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(archive))  # the driver serves it; nothing else reads the local file


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset (tests, one machine), one of our own."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = getattr(sc, "_rosterlake_dir", None) or tempfile.mkdtemp(prefix="rosterlake-")
        sc._rosterlake_dir = where
    return where


def settle(df: DataFrame) -> DataFrame:
    """df computed once into a table in the shared folder; survives lost executors. The tables of a session are deleted at its end."""
    sc = df.sparkSession.sparkContext
    kept = getattr(sc, "_rosterlake_settled", None)
    if kept is None:
        kept = sc._rosterlake_settled = Scratch(df.sparkSession)
        atexit.register(_forget, kept)
    return kept.keep(df, uuid.uuid4().hex)


def _forget(scratch: Scratch) -> None:
    with contextlib.suppress(Exception):  # the session may have ended, and with it the way to the folder
        scratch.drop()


class Scratch:
    """Parquet tables in the shared folder that live until the end of a `with` block (or until `drop`)."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/rosterlake-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def settle(self, df: DataFrame) -> DataFrame:
        return self.keep(df, uuid.uuid4().hex)

    def drop(self, name: str = "") -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def __exit__(self, *_: object) -> None:
        self.drop()


#: Counters in one row of a partial sketch.
_PIECE = 1 << 15


def sketch_rows(counts: np.ndarray) -> tuple[list[int], list[bytes]]:
    """A partial sketch as (piece number, packed counters) without all-zero pieces."""
    pieces = counts.astype(np.uint32, copy=False).reshape(-1, _PIECE)
    used = np.flatnonzero(pieces.any(axis=1))
    return used.tolist(), [zlib.compress(pieces[k].tobytes(), 1) for k in used]


def merged_sketch(partials: DataFrame, slots: int, finish: Callable[[np.ndarray], np.ndarray], kind: type = np.uint8) -> np.ndarray:
    """`finish` (counters to numbers of a kind) of the sum of partial sketches (piece int, packed binary): `slots` numbers.

    The sum is distributed over the pieces and streams; only `slots` numbers, a
    fixed count, reach the driver.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(packed), dtype=np.uint32).astype(np.uint64)
                total[k] = total[k] + part if k in total else part
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([finish(v).tobytes() for v in total.values()], pa.binary())], ["piece", "bytes"])

    out = np.zeros((slots // _PIECE, _PIECE), dtype=kind)
    for row in partials.select("piece", "packed").repartition("piece").mapInArrow(add, "piece int, bytes binary").collect():
        out[row.piece] = np.frombuffer(row.bytes, dtype=kind)
    return out.reshape(-1)


def membership(keys: DataFrame, slots: int = 1 << 22) -> np.ndarray:
    """A fixed-size one-hash Bloom table (bool) of the long column of `keys`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit = np.zeros(slots, dtype=np.uint32)
        for batch in batches:
            hit[slot_of(batch.column(0).to_numpy(zero_copy_only=False), slots)] = 1
        k, packed = sketch_rows(hit)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(packed, pa.binary())], ["piece", "packed"])

    return merged_sketch(keys.mapInArrow(count, "piece int, packed binary"), slots, lambda c: (c > 0).astype(np.uint8)) > 0


def slot_of(keys: np.ndarray, slots: int) -> np.ndarray:
    return (keys.astype(np.int64).view(np.uint64) & np.uint64(slots - 1)).astype(np.int64)


def sorted_groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Groups of equal leading `n_keys` columns of a stream sorted by them."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(n_keys)]
        change = np.zeros(batch.num_rows, dtype=bool)
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        at = np.flatnonzero(change)
        first = tuple(k[0] for k in keys)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *at.tolist(), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            held.append(batch.slice(lo, hi - lo))
            if hi < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
        last = tuple(k[-1] for k in keys)
    if held:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the least node reachable over undirected edges, for every node of an edge.

    Alternating large-star and small-star steps; each round is a map-side
    combined minimum and a join, so that a hub's edges are never in one task's
    memory, and is cut by a written table, of which the last two are kept.
    Nulls and self-loops link nothing; repeated edges count once; without edges it is empty.
    """
    with Scratch(edges.sparkSession) as scratch:
        e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u is not null and v is not null and u > v").distinct()
        e = scratch.keep(e, "0")
        before, k = None, 0
        while True:
            now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
            if now == before or not now[0]:
                break
            before = now
            both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
            e = scratch.keep(small.filter("u > v").distinct(), str(k + 1))
            scratch.drop(str(k))
            k += 1
        return settle(e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v"), F.col("v")).distinct()))
