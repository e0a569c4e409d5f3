"""Keyed stores: upserts, insert-ignore, tombstones, revisions, ledgers. A store is a DataFrame; each operator returns its next state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rank import first_per_key


def latest_wins(changes: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key with revision, the number of its changes.

    A map-side combined max of a struct: a key with very many changes sends one row a task.
    """
    rest = [c for c in changes.columns if c not in key and c not in order]
    last = changes.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("__x"), F.count("*").alias("revision"))
    return last.select(*key, *(F.col(f"__x.{c}").alias(c) for c in [*order, *rest]), "revision")


def upsert(store: DataFrame, changes: DataFrame, key: Sequence[str]) -> DataFrame:
    """Changes replace rows of their key; a replaced row keeps its ordinal (first seen), new ones follow."""
    kept = store.join(changes, list(key), "left_anti")
    place = store.select(*key, F.col("ordinal").alias("__was"))
    moved = changes.join(place, list(key), "left").withColumn("ordinal", F.coalesce("__was", "ordinal")).drop("__was")
    return kept.unionByName(moved)


def insert_ignore(store: DataFrame, changes: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Rows of new keys are added, the first of each; rows of known keys change nothing."""
    return store.unionByName(first_per_key(changes.join(store, list(key), "left_anti"), key, order))


def import_once(store: DataFrame, batch: DataFrame, ledger: DataFrame, fingerprint: str, key: Sequence[str], order: Sequence[Column | str]) -> tuple[DataFrame, DataFrame]:
    """(store, ledger) after an import that a ledger of fingerprints makes idempotent."""
    fresh = ledger.sparkSession.createDataFrame([(fingerprint,)], "fingerprint string").join(ledger, "fingerprint", "left_anti")
    gated = batch.crossJoin(F.broadcast(fresh)).drop("fingerprint")  # one row or none
    return insert_ignore(store, gated, key, order), ledger.unionByName(fresh)


def replace_all(store: DataFrame, listed: DataFrame, key: Sequence[str]) -> DataFrame:
    """What is listed is live, all else is marked deleted; listed rows come back to life."""
    gone = store.drop("deleted").join(listed, list(key), "left_anti").withColumn("deleted", F.lit(True))
    return gone.unionByName(listed.withColumn("deleted", F.lit(False)), allowMissingColumns=True)


def set_deleted(store: DataFrame, selection: DataFrame, key: Sequence[str], deleted: bool = True) -> DataFrame:
    """Soft delete of (key, revision) rows, all or nothing: any missing or stale one leaves all as they are."""
    asked = selection.select(*key, F.col("revision").alias("__asked"))
    met = store.join(asked, list(key), "left")
    # One bounded verdict row: how many of the selection are present at their revision.
    bad = asked.join(store.select(*key, F.col("revision").alias("__have")), list(key), "left").agg(F.count_if(~F.col("__asked").eqNullSafe(F.col("__have"))).alias("__bad"))
    joined = met.crossJoin(F.broadcast(bad))
    apply = F.col("__asked").isNotNull() & (F.col("__bad") == 0)
    return joined.withColumn("deleted", F.when(apply, F.lit(deleted)).otherwise(F.col("deleted"))).withColumn("revision", F.when(apply, F.col("revision") + 1).otherwise(F.col("revision"))).drop("__asked", "__bad")


def checked_update(store: DataFrame, changes: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Changes of the current revision are applied (revision + 1); stale ones are not. conflict tells which rows had one."""
    c = changes.select(*key, F.col("revision").alias("__r"), *(F.col(x).alias(f"__{x}") for x in columns))
    met = store.join(c, list(key), "left")
    fits = F.coalesce(F.col("__r") == F.col("revision"), F.lit(False))
    out = met.select(*(F.when(fits, F.col(f"__{x}")).otherwise(F.col(x)).alias(x) if x in columns else (F.when(fits, F.col("revision") + 1).otherwise(F.col("revision")).alias("revision") if x == "revision" else F.col(x)) for x in store.columns), (F.col("__r").isNotNull() & ~fits).alias("conflict"))
    return out


def purge(store: DataFrame, selection: DataFrame, key: Sequence[str]) -> DataFrame:
    """Selected rows go if they are in the trash."""
    return store.join(selection.join(store.filter("deleted").select(*key), list(key), "left_semi").select(*key), list(key), "left_anti")


def expire(rows: DataFrame, at: Column, now: Column) -> DataFrame:
    return rows.filter(at >= now)


def merged_cache(entries: DataFrame, family: str, evidence: str, titles: str, hits: str, created: str, cap: int) -> DataFrame:
    """Entries of one family and evidence set become one: hits summed, longest titles, earliest creation; the cap most hit stay."""
    keyed = entries.withColumn("__e", F.array_sort(F.array_distinct(evidence)))
    merged = keyed.groupBy(family, "__e").agg(F.sum(hits).alias(hits), F.max(F.struct(F.size(titles).alias("n"), F.col(titles).alias("t"))).alias("__t"), F.min(created).alias(created))
    out = merged.select(family, F.col("__e").alias(evidence), hits, F.col("__t.t").alias(titles), created)
    return out.orderBy(F.col(hits).desc(), family, evidence).limit(cap)


def cascade(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent is still there."""
    return children.join(parents.select(key), key, "left_semi")


def identity_key(candidate_id: Column, email: Column, name: Column, raw: Column) -> Column:
    """id:, email:, name: or raw:sha1, the first that is not blank."""
    known = lambda prefix, c: F.when(F.trim(F.coalesce(c.cast("string"), F.lit(""))) != "", F.concat(F.lit(prefix), F.lower(F.trim(c.cast("string")))))
    return F.coalesce(known("id:", candidate_id), known("email:", email), known("name:", name), F.concat(F.lit("raw:"), F.sha1(F.coalesce(raw, F.lit("")))))
