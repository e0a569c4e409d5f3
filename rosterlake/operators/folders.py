"""Folders, trash and counters of a keyed store with revisions: bulk changes that apply whole or not at all.

A selection is (key, revision). Whether all of it is current is one aggregated
row, met with the store by a join of one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import insert_ignore


def _marked(store: DataFrame, selection: DataFrame, key: Sequence[str], refuse: Column | None = None) -> DataFrame:
    """store with __hit: the row is selected, all of the selection is there at its revision, and none of it is refused."""
    asked = selection.select(*key, F.col("revision").alias("__asked")).distinct()
    met = asked.join(store, list(key), "left")
    bad = ~F.col("__asked").eqNullSafe(F.col("revision"))
    if refuse is not None:
        bad = bad | F.coalesce(refuse, F.lit(False))
    verdict = met.agg((F.count_if(bad) == 0).alias("__fine"))
    return store.join(asked, list(key), "left").crossJoin(F.broadcast(verdict)).withColumn("__hit", F.col("__asked").isNotNull() & F.col("__fine")).drop("__asked", "__fine")


def _changed(marked: DataFrame, values: dict[str, Column]) -> DataFrame:
    values = values | {"revision": F.col("revision") + 1}
    return marked.withColumns({c: F.when(F.col("__hit"), v).otherwise(F.col(c)) for c, v in values.items()}).drop("__hit")


def all_current(store: DataFrame, selection: DataFrame, key: Sequence[str]) -> DataFrame:
    """(current): whether every selected key is there at its revision; one row."""
    asked = selection.select(*key, F.col("revision").alias("__asked"))
    met = asked.join(store.select(*key, "revision"), list(key), "left")
    return met.agg((F.count_if(~F.col("__asked").eqNullSafe(F.col("revision"))) == 0).alias("current"))


def move(store: DataFrame, selection: DataFrame, key: Sequence[str], folder: str, folders: DataFrame | None = None) -> DataFrame:
    """Selected rows into a folder ('' is none) that is in folders (name), if given; refused as a whole for rows in the trash."""
    marked = _marked(store, selection, key, F.col("deleted"))
    if folders is not None and folder:
        there = folders.agg((F.count_if(F.col("name") == folder) > 0).alias("__there"))
        marked = marked.crossJoin(F.broadcast(there)).withColumn("__hit", F.col("__hit") & F.col("__there")).drop("__there")
    return _changed(marked, {"folder": F.lit(folder)})


def trash(store: DataFrame, selection: DataFrame, key: Sequence[str], stamp: Column, deleted: bool = True) -> DataFrame:
    """Selected rows into the trash with a stamp, or back to their folder without one."""
    return _changed(_marked(store, selection, key), {"deleted": F.lit(deleted), "deleted_at": stamp if deleted else F.lit("")})


def delete_folder(store: DataFrame, folders: DataFrame, selection: DataFrame, key: Sequence[str], folder: str) -> tuple[DataFrame, DataFrame]:
    """(store, folders) without a folder: what is in it is in none, if the selection is just that at its revisions; else both as they are."""
    inside = store.filter(F.col("folder") == folder).select(*key, "revision")
    same = inside.withColumn("__in", F.lit(1)).join(selection.select(*key, "revision").distinct().withColumn("__asked", F.lit(1)), [*key, "revision"], "full_outer")
    verdict = same.agg((F.count_if(F.col("__in").isNull() | F.col("__asked").isNull()) == 0).alias("__fine"))
    marked = store.crossJoin(F.broadcast(verdict)).withColumn("__hit", (F.col("folder") == folder) & F.col("__fine")).drop("__fine")
    left = folders.crossJoin(F.broadcast(verdict)).filter((F.col("name") != folder) | ~F.col("__fine")).drop("__fine")
    return _changed(marked, {"folder": F.lit("")}), left


def create_folder(folders: DataFrame, name: str) -> DataFrame:
    """folders with a name, once."""
    return insert_ignore(folders, folders.sparkSession.createDataFrame([(name,)], "name string"), ["name"], [F.col("name")])


def touch(entries: DataFrame, used: DataFrame, key: Sequence[str], counter: str = "hits") -> DataFrame:
    """entries with their counters raised by as often as their key was used."""
    times = used.groupBy(*key).agg(F.count("*").alias("__times"))
    return entries.join(times, list(key), "left").withColumn(counter, F.coalesce(F.col(counter), F.lit(0)) + F.coalesce("__times", F.lit(0))).drop("__times")


def upsert_settings(settings: DataFrame, changes: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """(name, value) with the changes of allowed names; the last value of a name (by `at`) counts, and a null one is a tombstone."""
    last = changes.filter(F.col("name").isin(*allowed)).groupBy("name").agg(F.max_by("value", "at").alias("value"))
    return settings.join(last, "name", "left_anti").unionByName(last)


def cancel_kind(jobs: DataFrame, kind: str, now: Column) -> DataFrame:
    """Jobs of a kind asked to stop: running ones are asked, waiting ones are cancelled at once and are not to be tried again."""
    mine = F.col("kind") == kind
    running, waiting = mine & (F.col("state") == "running"), mine & F.col("state").isin("queued", "interrupted")
    return jobs.withColumns({
        "finished_at": F.when(waiting, now).otherwise(F.col("finished_at")),
        "retryable": F.when(waiting, F.lit(False)).otherwise(F.col("retryable")),
        "updated_at": F.when(running | waiting, now).otherwise(F.col("updated_at")),
        "state": F.when(running, "cancel_requested").when(waiting, "cancelled").otherwise(F.col("state")),
    })


def size_check(store: DataFrame, payload: str) -> DataFrame:
    """(n, characters): rows and the length of all payloads; zero for an empty store."""
    return store.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(payload)), F.lit(0)).alias("characters"))
