"""Folders, trash, counters and settings of keyed stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import folders
from .catalog import query, table


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("folder"), (k % 10 == 0).alias("deleted"), F.lit("").alias("deleted_at"), (k % 3).alias("revision"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name")).distinct()


_STORE = "SELECT c_custkey, c_mktsegment AS folder, c_custkey % 10 = 0 AS deleted, c_custkey % 3 AS revision FROM customer"


@query(f"""WITH s AS ({_STORE}) SELECT c_custkey, CASE WHEN c_custkey % 10 = 1 THEN 'BUILDING' ELSE folder END AS folder, revision + (c_custkey % 10 = 1)::INT AS revision, folder AS refused FROM s""")
def folder_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A move of live rows, and beside it one that is refused as rows of it are in the trash."""
    s = _store(spark, sf_dir)
    moved = folders.move(s, s.filter("c_custkey % 10 = 1"), ["c_custkey"], "BUILDING", _names(spark, sf_dir))
    refused = folders.move(s, s.filter("c_custkey % 10 < 2"), ["c_custkey"], "BUILDING").select("c_custkey", F.col("folder").alias("refused"))
    return moved.join(refused, "c_custkey").select("c_custkey", "folder", "revision", "refused")


@query(f"""WITH s AS ({_STORE}) SELECT c_custkey, deleted OR c_custkey % 4 = 0 AS deleted, CASE WHEN c_custkey % 4 = 0 THEN '2026-01-01' ELSE '' END AS deleted_at, revision + (c_custkey % 4 = 0)::INT AS revision FROM s""")
def folder_trash(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _store(spark, sf_dir)
    return folders.trash(s, s.filter("c_custkey % 4 = 0"), ["c_custkey"], F.lit("2026-01-01")).select("c_custkey", "deleted", "deleted_at", "revision")


@query(f"""WITH s AS ({_STORE}) SELECT folder, count(*) AS n, sum(revision)::BIGINT AS revisions, count(*) FILTER (folder = '') > 0 AS named FROM (SELECT CASE WHEN folder = 'MACHINERY' THEN '' ELSE folder END AS folder, revision + (folder = 'MACHINERY')::INT AS revision FROM s) GROUP BY folder""")
def folder_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One folder goes; another stays, as the selection is not just what is in it. named: the folder is no more in the list of names."""
    s = _store(spark, sf_dir)
    after, names = folders.delete_folder(s, _names(spark, sf_dir), s.filter("folder = 'MACHINERY'"), ["c_custkey"], "MACHINERY")
    after, names = folders.delete_folder(after, names, s.filter("folder = 'BUILDING' and c_custkey % 2 = 0"), ["c_custkey"], "BUILDING")
    counted = after.groupBy("folder").agg(F.count("*").alias("n"), F.sum("revision").alias("revisions"))
    return counted.join(names, F.col("folder") == F.col("name"), "left").select("folder", "n", "revisions", F.col("name").isNull().alias("named"))


@query("""SELECT true AS all_of_them, false AS one_stale, false AS one_missing""")
def selections_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _store(spark, sf_dir)
    asked = {"all_of_them": s, "one_stale": s.withColumn("revision", F.when(F.col("c_custkey") == 1, 9).otherwise(F.col("revision"))), "one_missing": s.select("c_custkey", "revision").union(spark.createDataFrame([(-5, 0)], "c_custkey long, revision long"))}
    out = None
    for name, a in asked.items():
        one = folders.all_current(s, a, ["c_custkey"]).select(F.col("current").alias(name))
        out = one if out is None else out.crossJoin(one)
    return out


@query("""SELECT user_id, count(*) FILTER (event_type = 'signup') + count(*) FILTER (event_type = 'click') AS hits FROM events GROUP BY user_id""")
def touched_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    have = e.groupBy("user_id").agg(F.count_if(F.col("event_type") == "signup").alias("hits"))
    return folders.touch(have, e.filter("event_type = 'click'").select("user_id"), ["user_id"])


@query("""WITH c AS (SELECT event_type AS name, arg_max(user_id, event_id) AS value FROM events WHERE event_type IN ('click', 'view') GROUP BY event_type)
SELECT name, value::BIGINT AS value FROM c UNION ALL SELECT * FROM (VALUES ('theme', 1), ('size', 2)) UNION ALL SELECT 'new', NULL""")
def settings_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = spark.createDataFrame([("theme", 1), ("click", 5), ("size", 2)], "name string, value long")
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.col("user_id").cast("long").alias("value"), F.col("event_id").alias("at"))
    gone = spark.createDataFrame([("new", None, 1)], "name string, value long, at long")
    return folders.upsert_settings(have, e.unionByName(gone), ["click", "view", "new"])


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority <> '1-URGENT' THEN state WHEN state = 'running' THEN 'cancel_requested' WHEN state = 'queued' THEN 'cancelled' ELSE state END AS state,
  CASE WHEN o_orderpriority = '1-URGENT' AND state = 'queued' THEN 'now' END AS finished_at, NOT (o_orderpriority = '1-URGENT' AND state = 'queued') AS retryable, CASE WHEN o_orderpriority = '1-URGENT' AND state <> 'failed' THEN 'now' ELSE 'then' END AS updated_at
FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'running' ELSE 'queued' END AS state FROM orders)""")
def jobs_of_a_kind_cancelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "running").otherwise("queued")
    j = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("kind"), state.alias("state"), F.lit(None).cast("string").alias("finished_at"), F.lit(True).alias("retryable"), F.lit("then").alias("updated_at"))
    return folders.cancel_kind(j, "1-URGENT", F.lit("now")).drop("kind")


@query("""SELECT count(*) AS n, coalesce(sum(length(text)), 0)::BIGINT AS characters, 6::BIGINT AS folders FROM documents""")
def store_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = folders.create_folder(folders.create_folder(_names(spark, sf_dir), "NEW"), "BUILDING")
    return folders.size_check(table(spark, sf_dir, "documents"), "text").crossJoin(names.agg(F.count("*").alias("folders")))
