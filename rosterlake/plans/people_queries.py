"""People, jobs and vectorised operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, pay, people, vectorised, web
from ..operators import match, nested
from ..sources import readers
from .catalog import query, table


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN ['citizen'] WHEN 1 THEN ['permanent_resident'] WHEN 2 THEN ['work_visa'] WHEN 3 THEN ['permanent_resident'] ELSE []::VARCHAR[] END AS classes,
  CASE c_custkey % 5 WHEN 0 THEN 'citizen' WHEN 1 THEN 'permanent_resident' WHEN 2 THEN 'work_visa' WHEN 3 THEN 'pr / 5 years' ELSE '' END AS target FROM customer""")
def residency_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, ("Malaysian  Citizen", "Permanent resident", "Employment Pass holder", "PR / 5 years", "any"))), (F.col("c_custkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", people.residency_classes(said).alias("classes"), people.residency_target(said).alias("target"))


@query("""SELECT p_partkey, CASE WHEN contains(p_type, 'TIN') OR contains(p_type, 'BRASS') THEN 'match' ELSE 'mismatch' END AS any_of, CASE WHEN contains(p_type, 'TIN') AND contains(p_type, 'SMALL') THEN 'match' ELSE 'mismatch' END AS all_of FROM part""")
def option_match_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.split("p_type", " ")
    return table(spark, sf_dir, "part").select("p_partkey", people.option_match(own, ["tin", "Brass"]).alias("any_of"), people.option_match(own, ["tin", "small"], True).alias("all_of"))


@query("""SELECT s_suppkey, CASE WHEN s_nationkey % 3 = 0 THEN CASE WHEN s_nationkey = 12 THEN 'match' ELSE 'mismatch' END WHEN s_nationkey % 3 = 1 THEN CASE WHEN n_name = 'CHINA' THEN 'match' ELSE 'mismatch' END ELSE CASE WHEN contains(n_name, 'JAPAN') THEN 'match' ELSE 'unknown' END END AS state
  FROM supplier JOIN nation ON s_nationkey = n_nationkey""".replace("n_name = 'CHINA'", "n_name IN ('JAPAN')"))
def country_match_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    kind = F.col("s_nationkey") % 3
    code = F.when(kind == 0, F.when(F.col("s_nationkey") == 12, "JP").otherwise("XX"))
    return s.select("s_suppkey", people.country_match(code, F.when(kind == 1, F.col("n_name")), F.concat(F.col("n_name"), F.lit(" office")), "jp", ["Japan"], ["Tokyo"]).alias("state"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Immediate' WHEN 1 THEN (o_orderkey % 9)::VARCHAR || ' weeks' ELSE 'ask me' END AS display, CASE o_orderkey % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 7.0 * (o_orderkey % 9) END::DOUBLE AS days FROM orders""")
def notice_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    said = F.when(k % 3 == 0, "available NOW asap").when(k % 3 == 1, F.concat((k % 9).cast("string"), F.lit("  weeks"))).otherwise("ask me")
    display, days = people.notice(said)
    return table(spark, sf_dir, "orders").select("o_orderkey", display.alias("display"), days.alias("days"))


_FAM = {"a": ["tion"], "b": ["ing"], "c": ["ment"]}


@query("""WITH s AS (SELECT doc_id, 3 * len(regexp_extract_all(t, 'tion')) + regexp_matches(t, '(^|[^a-z0-9])the([^a-z0-9]|$)')::INT AS a, 3 * len(regexp_extract_all(t, 'ing')) AS b, 3 * len(regexp_extract_all(t, 'ment')) AS c FROM (SELECT doc_id, lower(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)),
l AS (SELECT doc_id, unnest([{'f': 'a', 's': a}, {'f': 'b', 's': b}, {'f': 'c', 's': c}]) AS x, greatest(a, b, c) AS m FROM s)
SELECT s.doc_id, coalesce(f, []::VARCHAR[]) AS families FROM s LEFT JOIN (SELECT doc_id, list(x.f ORDER BY x.s DESC, x.f)[1:2] AS f FROM l WHERE x.s >= 3 AND x.s >= m * 0.65 GROUP BY doc_id) USING (doc_id)""")
def family_scores_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = people.family_scores(F.col("text"), _FAM, {"a": [("the", 1)]})
    return table(spark, sf_dir, "documents").select("doc_id", people.families(scores, 2).alias("families"))


@query("""SELECT event_id AS id, score FROM (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 100 END::INT AS score FROM events WHERE event_id % 7 <> 0 AND contains(lower(event_type), 'cl')) WHERE coalesce(score, 0) >= 40""")
def filter_cards_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "event_type", F.col("ts").alias("saved_at"), (F.col("event_id") % 7 == 0).alias("deleted"), F.lit("").alias("folder"), F.lit(False).alias("shortlisted"), F.when(F.col("event_id") % 11 != 0, (F.col("event_id") % 100).cast("int")).alias("score"))
    return people.filter_cards(e, search="CL", search_cols=["event_type"], min_score=40).select("id", "score")


@query("""SELECT sha256(user_id || '|' || lower(event_type)) AS key, max(ts) AS scanned_at, count(*) AS ads FROM events GROUP BY user_id, event_type""")
def current_people_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("company_id"), F.concat(F.upper("event_type"), F.lit("/")).alias("url"), F.col("ts").alias("scanned_at"))
    return people.current_people(e).select("key", "scanned_at", "ads")


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 100 WHEN 1 THEN 85 WHEN 2 THEN 80 END::INT AS score FROM customer""")
def name_match_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("c_custkey") % 4 + 1).cast("int")
    a = F.element_at(F.array(*map(F.lit, ("Dr. José Alvarez", "J. Alvarez", "Katherine Jones", "Ann Bo"))), k)
    b = F.element_at(F.array(*map(F.lit, ("ALVAREZ, Jose", "Jose Alvarez", "Catherine Jones", "Cy Do"))), k)
    return table(spark, sf_dir, "customer").select("c_custkey", vectorised.name_match(a, b, F.lit(False)).alias("score"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN [10000, 500] WHEN 1 THEN [p_size * 1000] ELSE []::BIGINT[] END::BIGINT[] AS amounts FROM part""")
def salary_amounts_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    said = F.when(k == 0, "RM120k annual + RM500 monthly allowance").when(k == 1, F.concat(F.lit("SGD "), F.col("p_size").cast("string"), F.lit("k basic x 13"))).otherwise("15-30% increment, 2 months")
    return table(spark, sf_dir, "part").select("p_partkey", pay.amounts(said).alias("amounts"))


@query("""SELECT event_id, ['k', (props->>'k')] AS leaves, '{"k":' || (props->>'k') || '}' AS canonical FROM events""")
def json_leaves_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    secret = F.concat(F.regexp_replace("props", r"\}\s*$", ""), F.lit(', "api_key": "x"}'))
    return table(spark, sf_dir, "events").select("event_id", vectorised.json_flatten("props").alias("leaves"), vectorised.json_sanitised(secret).alias("canonical"))


@query()
def passage_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorised.passage_rows(table(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def html_parsed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", vectorised.html_parsed("html").alias("text"))


@query("""SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title FROM pages""")
def job_posting_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", readers.job_posting(F.col("html"))["title"].alias("title"))


@query("""SELECT user_id, min(event_id) AS event_id, max(event_id) AS other, 5.0::DOUBLE AS v FROM events GROUP BY user_id""")
def greedy_pairs_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("event_id").alias("event_id"), F.max("event_id").alias("other"))
    rows = ends.withColumn("v", F.lit(5.0)).union(ends.withColumn("v", F.lit(4.5))).union(ends.select("user_id", "other", "event_id", F.lit(3.0)))
    return match.greedy_assignment(rows, "user_id", "event_id", "other", "v", 4.0)


@query("""SELECT o_orderkey, strftime(o_orderdate, '%b %Y') || ' to Present' AS range, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m FROM orders""")
def date_ranges_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" - now"))
    point = dates.sort_point(F.date_format("o_orderdate", "MMM yyyy"))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.date_range(said).alias("range"), point["year"].alias("y"), point["month"].alias("m"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'zip' WHEN 2 THEN 'ole' ELSE 'unknown' END AS kind FROM part""")
def content_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = F.array(F.unhex(F.lit("255044462D312E37")), F.unhex(F.lit("504B030414000000")), F.unhex(F.lit("D0CF11E0A1B11AE1")), F.unhex(F.lit("0102")))
    return table(spark, sf_dir, "part").select("p_partkey", web.content_kind(F.element_at(heads, (F.col("p_partkey") % 4 + 1).cast("int"))).alias("kind"))


@query("""SELECT user_id, sha256(string_agg(DISTINCT h, '' ORDER BY h)) AS fingerprint, count(*) AS n FROM (SELECT user_id, sha256('{"event_type":"' || event_type || '","k":' || (event_id % 5) || '}') AS h FROM events) GROUP BY user_id""")
def record_set_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", (F.col("event_id") % 5).alias("k"))
    return nested.set_fingerprint(e, ["user_id"], "event_type", "k")


@query("""SELECT o_custkey, b - a AS total_difference, CASE WHEN a <> 0 THEN round((b - a) / a, 6) END AS total_uplift FROM (SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS a, max(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS b FROM orders GROUP BY o_custkey)""")
def compared_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", F.col("o_totalprice").alias("total"))
    return nested.compared(o, "o_custkey", "o_orderstatus", ["total"], "F", "O")
