"""Stores, ranks, intervals, joins and the job lifecycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import intervals, jobs, match, rank, store
from .catalog import query, table


@query("""SELECT user_id, event_type, ts, event_id, value, revision FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY user_id, event_type) AS revision FROM events) WHERE k = 1""")
def latest_wins_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return store.latest_wins(e, ["user_id", "event_type"], ["ts", "event_id"])


@query("""SELECT user_id, arg_min(event_type, (ts, event_id)) AS event_type, min(ts) AS ts FROM events GROUP BY user_id""")
def insert_ignore_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    first = F.to_timestamp_ntz(F.lit("2024-01-10 00:00:00"))
    base = rank.first_per_key(e.filter(F.col("ts") < first), ["user_id"], ["ts", "event_id"])
    return store.insert_ignore(base, e.filter(F.col("ts") >= first), ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "ts")


@query("""SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 25""")
def newest_n_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return rank.keep_newest(e, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 25).select("user_id", "event_id")


@query("""SELECT o_orderkey, o_orderstatus <> 'O' AS deleted FROM orders""")
def soft_delete_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.lit(False).alias("deleted"))
    return store.replace_all(o, o.filter("o_orderstatus = 'O'").drop("deleted"), ["o_orderkey"]).select("o_orderkey", "deleted")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) || '!' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END AS revision, c_custkey % 3 = 0 AND c_custkey % 2 <> 0 AS conflict FROM customer""")
def revision_checked_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.lit(1).alias("revision"))
    key = F.col("c_custkey")
    changes = c.filter((key % 2 == 0) | (key % 3 == 0)).select("c_custkey", F.concat(F.upper("c_mktsegment"), F.lit("!")).alias("c_mktsegment"), F.when(key % 2 == 0, 1).otherwise(0).alias("revision"))
    return store.checked_update(c, changes, ["c_custkey"], ["c_mktsegment"])


@query("""SELECT c_custkey, c_custkey <= 10 AS deleted, CASE WHEN c_custkey <= 10 THEN 2 ELSE 1 END AS revision FROM customer""")
def bulk_soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.lit(False).alias("deleted"), F.lit(1).alias("revision"))
    return store.set_deleted(c, c.filter("c_custkey <= 10"), ["c_custkey"])


@query("""SELECT c_custkey, false AS deleted, 1 AS revision FROM customer""")
def bulk_delete_with_stale_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.lit(False).alias("deleted"), F.lit(1).alias("revision"))
    stale = c.filter("c_custkey <= 10").withColumn("revision", F.when(F.col("c_custkey") == 3, 9).otherwise(F.col("revision")))
    return store.set_deleted(c, stale, ["c_custkey"])


@query("""SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderkey % 2 = 0)""")
def purge_trashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("deleted"))
    return store.purge(o, o.filter("o_orderkey % 2 = 0").select("o_orderkey"), ["o_orderkey"]).select("o_orderkey")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'moved' ELSE c_mktsegment END AS c_mktsegment, row_number() OVER (ORDER BY c_custkey) AS ordinal FROM customer""")
def upsert_keeps_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.col("c_custkey").alias("ordinal"))
    low = table(spark, sf_dir, "customer").agg(F.min("c_custkey").alias("low"))
    numbered = c.crossJoin(F.broadcast(low)).withColumn("ordinal", F.col("ordinal") - F.col("low") + 1).drop("low")  # keys are dense: one row of the least key
    changes = numbered.filter("c_custkey % 10 = 0").select("c_custkey", F.lit("moved").alias("c_mktsegment"), F.lit(0).cast("bigint").alias("ordinal"))
    return store.upsert(numbered, changes, ["c_custkey"])


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def anti_join_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@query("""WITH e AS (SELECT event_type AS family, list_sort(list_distinct([CASE WHEN user_id % 3 = 0 THEN 'a' ELSE 'b' END, CASE WHEN user_id % 2 = 0 THEN 'c' ELSE 'a' END])) AS evidence, event_id % 5 AS hits, ts FROM events)
SELECT family, evidence, sum(hits)::BIGINT AS hits, min(ts) AS created FROM e GROUP BY family, evidence ORDER BY hits DESC, family, evidence LIMIT 12""")
def title_cache_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("family"), F.array(F.when(F.col("user_id") % 3 == 0, "a").otherwise("b"), F.when(F.col("user_id") % 2 == 0, "c").otherwise("a")).alias("evidence"), F.array("event_type").alias("titles"), (F.col("event_id") % 5).alias("hits"), F.col("ts").alias("created"))
    return store.merged_cache(e, "family", "evidence", "titles", "hits", "created", 12).select("family", "evidence", "hits", "created")


@query("""SELECT source, turn, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INT AS turn, min(doc_id) OVER (PARTITION BY source) AS f FROM documents) ORDER BY turn, f LIMIT 50""")
def round_robin_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.round_robin(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", ["doc_id"], 50).select("source", "turn", "doc_id")


@query("""SELECT event_id, label FROM (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 4 = 1 THEN NULL ELSE event_type END AS label FROM events) ORDER BY (label IS NULL OR trim(label) = ''), label DESC NULLS LAST, event_id LIMIT 6000""")
def blanks_last_sort_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 4 == 0, "").when(F.col("event_id") % 4 != 1, F.col("event_type")).alias("label"))
    return rank.evict_beyond(e, rank.blanks_last("label", True, ["event_id"]), 6000)


@query("""SELECT event_id, label FROM (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type END AS label FROM events)""")
def blanks_first_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 4 == 0, "").otherwise(F.col("event_type")).alias("label"))
    return e.orderBy(*rank.blanks_first("label", ["event_id"]))


@query("""SELECT source, doc_id, running FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM documents) WHERE running <= 14000""")
def text_budget_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.within_budget(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), ["source"], ["doc_id"], F.col("n_chars"), 14_000).select("source", "doc_id", "running")


@query("""SELECT c_custkey, lower(c_mktsegment) || lpad(length(c_custkey::VARCHAR)::VARCHAR, 5, '0') || c_custkey AS key FROM customer""")
def natural_sort_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", rank.natural_key(F.concat("c_mktsegment", F.col("c_custkey").cast("string"))).alias("key"))


@query("""WITH d AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY slot) AS k, row_number() OVER (PARTITION BY u ORDER BY d DESC, slot) AS m FROM (SELECT user_id AS u, event_id AS slot, value AS d FROM events WHERE event_type <> 'error'))
SELECT a.u AS user_id, a.slot AS event_id, b.slot AS new_slot FROM d a JOIN d b ON a.u = b.u AND a.m = b.k UNION ALL SELECT user_id, event_id, event_id FROM events WHERE event_type = 'error'""")
def dated_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("d"))
    return rank.dated_in_dated_slots(e, ["user_id"], "event_id", "d").select("user_id", "event_id", "new_slot")


_MONTHS = "SELECT l_suppkey, year(l_shipdate) * 12 + month(l_shipdate) - 1 AS a FROM lineitem"


@query(f"""WITH m AS ({_MONTHS}), g AS (SELECT DISTINCT l_suppkey, a FROM m), h AS (SELECT l_suppkey, a, a - row_number() OVER (PARTITION BY l_suppkey ORDER BY a) AS k FROM g)
SELECT l_suppkey, min(a)::INT AS a, max(a)::INT AS b FROM h GROUP BY l_suppkey, k""")
def month_islands_shipdates(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1).alias("a")).distinct().withColumn("b", F.col("a"))
    return intervals.islands(m, ["l_suppkey"], "a", "b", gap=1).select("l_suppkey", "a", "b")


@query(f"""SELECT l_suppkey, count(DISTINCT x)::INT AS length FROM (SELECT l_suppkey, unnest([a, a + 1, a + 2]) AS x FROM ({_MONTHS})) GROUP BY l_suppkey""")
def interval_union_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1).alias("a")).distinct().withColumn("b", F.col("a") + 3)
    return intervals.union_length(m, ["l_suppkey"], "a", "b").select("l_suppkey", F.col("length").cast("int").alias("length"))


@query("""WITH e AS (SELECT user_id, event_id, event_type, (event_id // 100)::BIGINT AS a, (event_id // 100 + 2)::BIGINT AS b FROM events),
f AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type AND greatest(lag(a) OVER w, a) <= least(lag(b) OVER w, b) + 1 THEN 0 ELSE 1 END AS x FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
g AS (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM f)
SELECT user_id, run::BIGINT AS run, any_value(event_type) AS event_type, min(a) AS a, max(b) AS b, count(*) AS n FROM g GROUP BY user_id, run""")
def adjacent_stints(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.floor(F.col("event_id") / 100).alias("a"), (F.floor(F.col("event_id") / 100) + 2).alias("b"))
    return intervals.adjacent_runs(e, ["user_id"], "event_id", "event_type", "a", "b")


@query("""SELECT user_id, arg_max(ts, event_id) AS start, arg_min(ts, event_id) AS stop FROM events GROUP BY user_id""")
def newest_first_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").alias("start"), F.col("ts").alias("stop"))
    return intervals.newest_first_span(e, ["user_id"], "event_id", "start", "stop")


@query("""SELECT s_suppkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(s_name || ' Sdn. Bhd. (Holdings) Group'), '[^a-z0-9]+', ' ', 'g'), '\\b(sdn|bhd|pte|ltd|limited|inc|llc|plc|corp|corporation|company|co|group|holdings)\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS name FROM supplier""")
def company_norm_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.company_name(F.concat("s_name", F.lit(" Sdn. Bhd. (Holdings) Group"))).alias("name"))


_NORM = "trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""WITH a AS (SELECT c_custkey, {_NORM.format(c='c_name')} AS n FROM customer), b AS (SELECT DISTINCT {_NORM.format(c="replace(s_name, 'Supplier', 'Customer') || CASE WHEN s_suppkey % 2 = 0 THEN ' Ltd' ELSE '0' END")} AS m FROM supplier),
c AS (SELECT trim(replace(' ' || m || ' ', ' ltd ', ' ')) AS m FROM b)
SELECT c_custkey FROM a WHERE EXISTS (SELECT 1 FROM c WHERE n = m OR (length(n) >= 4 AND length(m) >= 4 AND (contains(n, m) OR contains(m, n))))""")
def fuzzy_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.concat(F.regexp_replace("s_name", "Supplier", "Customer"), F.when(F.col("s_suppkey") % 2 == 0, " Ltd").otherwise("0")).alias("s_name"))
    return match.fuzzy_semi_join(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), s, "c_name", "s_name").select("c_custkey")


@query("""WITH t AS (SELECT doc_id, lang, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> ''))) AS w FROM documents), n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
p AS (SELECT a.doc_id, b.doc_id AS o, count(*) AS c FROM t a JOIN t b ON a.lang = b.lang AND a.w = b.w AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
s AS (SELECT p.doc_id, o, c::DOUBLE / (x.n + y.n - c) AS similarity FROM p JOIN n x ON x.doc_id = p.doc_id JOIN n y ON y.doc_id = p.o)
SELECT doc_id, arg_min(o, (-similarity, o)) AS other_id_best, max(similarity) AS similarity FROM s WHERE similarity >= 0.6 GROUP BY doc_id""")
def jaccard_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", text.tokens(F.col("text")).alias("s"))
    right = d.select(F.col("doc_id").alias("other_id"), "lang", F.col("s").alias("s2"))
    return match.best_jaccard(d, right, family="lang", left_id="doc_id", right_id="other_id", left_tokens="s", right_tokens="s2", least=0.6, same_rows=True)


@query("""SELECT c.c_custkey AS k, CASE WHEN c_custkey % 3 = 0 OR c_custkey IS NULL THEN c_mktsegment || '2' ELSE c_mktsegment END AS v FROM customer c""")
def merge_missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    return match.merge_missing(c.withColumn("v", F.when(F.col("k") % 3 == 0, " ").otherwise(F.col("v"))), c.withColumn("v", F.concat("v", F.lit("2"))), "k", ["v"])


@query(r"""WITH q AS (SELECT item_id, trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS q FROM benchmark), d AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS t FROM documents)
SELECT item_id, doc_id, d.t IS NOT NULL AS grounded FROM q LEFT JOIN d ON q.q <> '' AND contains(d.t, q.q)""")
def grounded_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return match.evidence_anywhere(q, d, "quote", "doc_id", "text").select("item_id", "doc_id", "grounded")


@query("""SELECT e.event_id, arg_max(p.value, (p.ts, p.event_id)) AS value_as_of FROM events e LEFT JOIN events p ON p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts <= e.ts WHERE e.event_type = 'click' GROUP BY e.event_id""")
def latest_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return match.nearest_earlier(e.filter("event_type = 'click'").select("user_id", "ts", "event_id"), e.filter("event_type = 'purchase'").select("user_id", "ts", "value"), "user_id", "ts", "value").select("event_id", "value_as_of")


@query("""SELECT 'id:' || doc_id AS key, count(*) AS n FROM documents WHERE doc_id % 2 = 0 GROUP BY doc_id UNION ALL SELECT 'raw:' || sha1(text), count(*) FROM documents WHERE doc_id % 2 = 1 GROUP BY sha1(text)""".replace("sha1(text)", "sha1(text)"))
def dedup_identity_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).alias("i"), "text")
    return d.groupBy(store.identity_key(F.col("i"), F.lit(None).cast("string"), F.lit(" "), F.col("text")).alias("key")).agg(F.count("*").alias("n"))


@query("""SELECT state, (SELECT count(*) FROM orders o WHERE o.s = t.state) AS n FROM (VALUES ('queued'), ('running'), ('succeeded'), ('failed'), ('cancel_requested'), ('cancelled'), ('interrupted'), ('needs_attention')) t(state)""".replace("FROM orders o", "FROM (SELECT CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'running' ELSE 'queued' END AS s FROM orders) o"))
def job_state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "running").otherwise("queued").alias("state"))
    return jobs.summary(o)


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN 'succeeded' WHEN o_orderkey % 3 = 0 THEN 'needs_attention' WHEN o_orderkey % 5 < 3 THEN 'interrupted' ELSE 'failed' END AS state FROM orders""")
def job_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "running").otherwise("succeeded").alias("state"), F.when(F.col("o_orderkey") % 3 == 0, "paid").otherwise("local_idempotent").alias("safety"), (F.col("o_orderkey") % 5).alias("recoveries"))
    return jobs.recover(o).select("o_orderkey", "state")


def _transitions(e: DataFrame) -> DataFrame:
    kind = F.create_map(*(F.lit(x) for kv in {"signup": "begin", "click": "progress", "view": "progress", "purchase": "complete", "error": "fail"}.items() for x in kv))
    return e.select("user_id", "event_id", kind[F.col("event_type")].alias("event"))


@query("""WITH RECURSIVE e AS (SELECT user_id, CASE event_type WHEN 'signup' THEN 'begin' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail' ELSE 'progress' END AS event, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events),
f AS (SELECT user_id, 0::BIGINT AS k, '' AS state, 0 AS attempts, 0 AS refused, max(n) AS n FROM e GROUP BY user_id
  UNION ALL SELECT f.user_id, e.k, CASE WHEN e.event = 'begin' AND f.state <> 'running' THEN 'running' WHEN f.state = 'running' AND e.event = 'complete' THEN 'succeeded' WHEN f.state = 'running' AND e.event = 'fail' THEN 'failed' ELSE f.state END,
    f.attempts + (e.event = 'begin' AND f.state <> 'running')::INT,
    f.refused + CASE WHEN e.event = 'begin' THEN (f.state = 'running')::INT WHEN e.event = 'progress' THEN (f.state <> 'running')::INT WHEN e.event = 'complete' THEN (f.state NOT IN ('running', 'succeeded'))::INT ELSE (f.state NOT IN ('running', 'failed'))::INT END, f.n
  FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
SELECT user_id, state, attempts, refused, n AS n_events FROM f WHERE k = n""")
def job_state_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.fold(_transitions(table(spark, sf_dir, "events")), "user_id", "event_id", "event")


@query("""SELECT p_partkey, CASE WHEN contains(lower(p_type), 'tin') THEN 'Tin' WHEN contains(lower(p_type), 'steel') THEN 'STEEL' END AS section FROM part""")
def manual_section_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", match.first_match(F.col("p_type"), ["Tin", "STEEL"]).alias("section"))
