"""Records with one fault each, or two, by the key of a row; the SQL knows which faults were put in."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import quarantine
from .catalog import query, table

_FAULTS = ("field", "url", "name", "company_url", "status", "folder", "day")


@query(f"""SELECT o_orderkey, list_extract([{", ".join(f"'{f}'" for f in _FAULTS)}], 1 + least(o_orderkey % 9, (o_orderkey // 9) % 9)::INT) AS reason, CASE WHEN o_orderkey % 9 = 1 OR (o_orderkey // 9) % 9 = 1 THEN '' ELSE 'https://www.linkedin.com/jobs/view/' || o_orderkey END AS url,
  CASE WHEN o_orderkey % 9 = 4 OR (o_orderkey // 9) % 9 = 4 THEN 'lost' ELSE 'new' END AS status FROM orders""")
def leads_checked_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, key = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    has = lambda i: (k % 9 == i) | (F.floor(k / 9) % 9 == i)
    blank = {c: F.lit(None).cast("string") for c in quarantine.LEAD_FIELDS}
    said = {
        "notes": F.when(has(0), F.repeat(F.lit("x"), 10001)).otherwise("fine"),
        "url": F.when(has(1), "https://www.linkedin.com/jobs/search/").otherwise(F.concat(F.lit(" https://my.linkedin.com/jobs/view/x-"), key, F.lit("/?trk=1"))),
        "company": F.when(has(2), "  ").otherwise("Acme"),
        "role": F.lit("Engineer"),
        "company_url": F.when(has(3), "https://acme.example").when(k % 2 == 0, "https://linkedin.com/company/acme/about"),
        "status": F.when(has(4), "lost"),
        "folder": F.when(has(5), " !trash ").otherwise(""),
        "follow_up": F.when(has(6), "2026-02-30").otherwise("2026-02-28"),
    }
    rows = table(spark, sf_dir, "orders").select("o_orderkey", *(c.alias(n) for n, c in {**blank, **said}.items()))
    return quarantine.clean_leads(rows).select("o_orderkey", "reason", "url", "status")


@query("""WITH p AS (SELECT o_custkey, count(*) AS n, count(CASE WHEN o_orderkey % 50 = 3 THEN 1 END) AS bad FROM orders GROUP BY o_custkey)
SELECT o_custkey, o_orderkey, 'https://www.linkedin.com/in/u' || o_orderkey AS url, CASE WHEN o_orderkey % 2 = 0 THEN upper(o_orderpriority) END AS title FROM orders JOIN p USING (o_custkey) WHERE bad = 0 AND n <= 12""")
def profile_pages_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(k))
    rows = table(spark, sf_dir, "orders").select(
        "o_custkey",
        "o_orderkey",
        F.concat(F.lit("p"), place.cast("string")).alias("id"),
        F.concat(F.when(k % 50 == 3, "https://evil.example/in/u").otherwise("https://www.linkedin.com/in/u"), k.cast("string"), F.lit("/?x=1")).alias("url"),
        F.lit("").alias("name"),
        F.concat(F.lit("works on "), F.when(k % 2 == 0, F.col("o_orderpriority")).otherwise("nothing"), F.lit("  now")).alias("text"),
        F.upper("o_orderpriority").alias("title"),
        F.lit(None).cast("string").alias("location"),
    )
    return quarantine.clean_profile_pages(rows, "o_custkey", most=12).select("o_custkey", "o_orderkey", "url", "title")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'query' WHEN p_partkey % 7 = 0 THEN 'requirements' WHEN p_partkey % 11 = 0 THEN 'country' WHEN p_partkey % 3 = 0 THEN 'country_in_query' END AS reason,
  CASE p_partkey % 6 WHEN 0 THEN 'missing' WHEN 1 THEN 'long' WHEN 2 THEN 'signs' WHEN 3 THEN 'reserved' WHEN 4 THEN 'blank' END AS folder FROM part""")
def plans_checked_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    asked = F.when(k % 5 == 0, "  ").when(k % 3 == 0, F.concat("p_name", F.lit(" (New Zealand)"))).otherwise(F.concat("p_name", F.lit(" New Zealander")))
    needs = F.when(k % 7 == 0, F.array(F.lit("a"), F.lit(" "))).otherwise(F.array("p_type"))
    country = F.when(k % 11 == 0, "New\tZealand").otherwise(" New Zealand ")
    name = F.when(k % 6 == 1, F.repeat(F.lit("f"), 81)).when(k % 6 == 2, "a\nb").when(k % 6 == 3, " * ").when(k % 6 == 4, "  ").when(k % 6 == 5, "p_name")
    return table(spark, sf_dir, "part").select(k, quarantine.plan_reason(asked, country, needs).alias("reason"), quarantine.folder_reason(name).alias("folder"))


_BILL_FAULTS = ("open", "authority", "source", "currency", "amount", "scope", "provider", "other_provider")


@query(f"""SELECT event_id, list_extract([{", ".join(f"'{f}'" for f in _BILL_FAULTS)}], 1 + least(event_id % 10, (event_id // 10) % 10)::INT) AS reason,
  CASE WHEN least(event_id % 10, (event_id // 10) % 10) >= 8 THEN (event_id % 1000 + 0.25)::DOUBLE END AS amount, CASE WHEN least(event_id % 10, (event_id // 10) % 10) >= 8 THEN 'beta' END AS provider FROM events""")
def bills_checked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    has = lambda i: (k % 10 == i) | (F.floor(k / 10) % 10 == i)
    rows = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(has(0), " Pending").otherwise("final").alias("status"),
        F.when(~has(1), F.lit(True)).alias("authoritative"),
        F.when(has(2), "rumour").otherwise(" Provider_Invoice ").alias("source"),
        F.when(has(3), "US$").otherwise("usd").alias("currency"),
        F.when(has(4), F.when(k % 2 == 0, "-1").when(k % 3 == 0, "NaN").otherwise("1000000000001")).otherwise(F.concat((k % 1000).cast("string"), F.lit(".250"))).alias("amount"),
        F.when(has(5), "month").otherwise("Request").alias("scope"),
        F.when(has(6), "gamma").when(has(7), "alpha").when(k % 2 == 0, "b").alias("provider"),
        F.lit("Beta").alias("expected_provider"),
    )
    return quarantine.clean_bills(rows, {"alpha": "alpha", "beta": "beta", "b": "beta"}).select("event_id", "reason", F.col("amount").cast("double").alias("amount"), "provider")


@query("""WITH t AS (SELECT event_id, event_id % 7 = 0 AS off, event_id % 5 = 0 AS blocked, event_id % 3 = 0 AS wrong, event_id % 2 = 0 AS used, event_id % 11 < 5 AS coded, list_extract(['pending', 'delayed', 'partial', 'unavailable', 'invalid'], (event_id % 13 + 1)::INT) AS bill FROM events),
u AS (SELECT *, off OR (blocked AND bill IS NULL) AS never, coalesce(bill = 'invalid', false) OR (wrong AND NOT blocked) AS invalid FROM t)
SELECT event_id, CASE WHEN off THEN 'not_called' WHEN blocked THEN 'blocked_before_provider_transport' WHEN wrong OR used OR bill IS NOT NULL THEN 'provider_response_received' WHEN coded THEN 'provider_error_response_received' ELSE 'ambiguous_no_provider_usage_returned' END AS call,
  CASE WHEN never THEN 'not_called' WHEN bill = 'invalid' THEN 'reconciliation_failed' WHEN bill IS NOT NULL THEN 'provider_billing_' || bill WHEN wrong THEN 'reconciliation_failed' WHEN used OR coded THEN 'provider_billing_unavailable' ELSE 'ambiguous_provider_charge' END AS reconciliation,
  CASE WHEN never THEN 'not_applicable' WHEN bill IS NOT NULL THEN bill WHEN invalid THEN 'invalid' ELSE 'unavailable' END AS billing, NOT never AND NOT invalid AS missing, invalid,
  CASE WHEN event_id % 100 <= 60 THEN 'allowed' ELSE 'blocked' END AS guarded FROM u""")
def failed_requests_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    bills = F.array(*map(F.lit, ("pending", "delayed", "partial", "unavailable", "invalid")))
    kind = F.when(k % 5 == 0, "guardrail").when(k % 3 == 0, "reconciliation")
    told: Column = quarantine.failure_status(F.when(k % 7 == 0, F.lit(False)), kind, k % 2 == 0, F.when(k % 11 < 5, "429"), F.try_element_at(bills, (k % 13 + 1).cast("int")))
    limit = quarantine.limit_of("")
    assert limit == Decimal(60)
    return table(spark, sf_dir, "events").select("event_id", told.alias("x"), quarantine.guarded((k % 100).cast("decimal(12,6)"), limit).alias("guarded")).select("event_id", "x.*", "guarded")
