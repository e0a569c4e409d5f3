"""Job leads: urls, sources, keys and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import leads
from .catalog import query, table

_URLS = ("https://www.linkedin.com/jobs/view/{k}", "https://www.linkedin.com/jobs/search?q={k}", "https://my.jobstreet.com/job/{k}00000", "https://my.jobstreet.com/data-jobs/in-x{k}", "https://acme.com/careers/", "https://acme.com/jobs/engineer-{k}", "https://www.google.com/search?q={k}", "https://acme.com/blog/jobs-{k}")
_WANT = (True, False, True, False, False, True, False, False)


@query("SELECT o_orderkey, CASE o_orderkey % 8 " + " ".join(f"WHEN {i} THEN {str(w).lower()}" for i, w in enumerate(_WANT)) + " END AS job_page, o_orderkey % 8 = 7 AS editorial FROM orders")
def lead_urls_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    url = F.element_at(F.array(*(F.concat(F.lit(u.split("{k}")[0]), *( [key.cast("string"), F.lit(u.split("{k}")[1])] if "{k}" in u else [])) for u in _URLS)), (key % 8 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", leads.is_job_page(url).alias("job_page"), leads.is_editorial(url).alias("editorial"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE false END AS chosen FROM part")
def lead_sources_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    url = F.when(k == 0, "https://my.jobstreet.com/1").when(k == 1, "https://indeed.com/2").otherwise("https://other.org/3")
    return table(spark, sf_dir, "part").select("p_partkey", leads.source_chosen(url, F.lit(""), ["JobStreet"], ["linkedin", "jobstreet", "indeed"]).alias("chosen"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'li:https://linkedin.com/in/u' || c_custkey WHEN 1 THEN 'nc:' || lower(c_name) || '|acme' ELSE '' END AS key FROM customer")
def contact_keys_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    profile = F.when(k % 3 == 0, F.concat(F.lit("http://WWW.linkedin.com/in/U"), k.cast("string"), F.lit("/?trk=x")))
    return table(spark, sf_dir, "customer").select("c_custkey", leads.contact_key(profile, F.concat(F.lit(" "), "c_name"), F.when(k % 3 == 1, "Acme")).alias("key"))


@query("SELECT s_suppkey, [s_name || ' (Brand), Inc', s_name, s_name || ' (Brand)'] AS own, ['Brand'] AS bracketed, regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') AS base FROM supplier")
def name_readings_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, bracketed = leads.name_readings(F.concat("s_name", F.lit("  (Brand), Inc")))
    base = leads.company_base(F.concat("s_name", F.lit(" - Hong Kong")), ["Hong Kong", "Asia"])
    return table(spark, sf_dir, "supplier").select("s_suppkey", own.alias("own"), bracketed.alias("bracketed"), base.alias("base"))


@query("""WITH t AS (SELECT p_partkey, list_distinct(string_split_regex(lower(p_name), '[^a-z0-9]+')) AS s, list_distinct(string_split_regex(lower(p_type), '[^a-z0-9]+')) AS u, p_name, p_type FROM part)
SELECT p_partkey, CASE WHEN lower(p_name) = lower(p_type) THEN 1.0 ELSE len(list_intersect(s, u))::DOUBLE / greatest(len(s), len(u)) END AS similarity FROM t""")
def text_similarity_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", leads.text_similarity(F.col("p_name"), F.col("p_type")).alias("similarity"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN (event_id % 20)::DOUBLE END AS low, CASE WHEN event_id % 2 = 0 THEN (event_id % 20 + 5)::DOUBLE END AS high,
  'MYR ' || format('{:,}', 1000 + event_id % 20) || CASE WHEN event_id % 3 = 0 THEN ' to MYR ' || format('{:,}', 2000 + event_id % 20) ELSE '' END || '/month' AS display FROM events""")
def pay_notes_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    said = F.when(k % 2 == 0, F.concat((k % 20).cast("string"), F.lit("-"), (k % 20 + 5).cast("string"), F.lit("% increment")))
    low, high = leads.percent_increase(said)
    base = 1000 + k % 20
    return table(spark, sf_dir, "events").select("event_id", low.alias("low"), high.alias("high"), leads.pay_display(F.lit("MYR"), base, F.when(k % 3 == 0, base + 1000)).alias("display"))
