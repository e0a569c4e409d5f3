"""Identities of links, lenient readers, record keys and lead filters.

Links and notes are put together from parts by the key of a row, in all
combinations of the parts; the SQL works out the answer from the parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cv, lead_filters, lenient, links, records
from .catalog import query, table, values

_HOSTS = ("https://www.linkedin.com", "https://my.linkedin.com", "http://www.linkedin.com", "https://u@www.linkedin.com", "https://evil.org", "https://my.jobstreet.com", "https://www.jobstreet.com.sg")
_PATHS = ("/jobs/view/{k}", "/jobs/view/data-engineer-at-x-{k}/", "/jobs/search/", "/jobs/collections/recommended", "/company/acme-{k}/about/", "/in/someone-{k}/", "/in/a%20b", "/job/{k}", "/jobs", "/")
_QUERIES = ("", "?currentJobId={k}", "?currentJobId={k}&currentJobId=1", "?jobId={k}", "?job_id={k}&jobid={k}", "?jobId=9&trk=x")


def _pick(parts: tuple[str, ...], n: Column, k: Column) -> Column:
    return F.replace(F.element_at(F.array(*map(F.lit, parts)), (n % len(parts) + 1).cast("int")), F.lit("{k}"), k.cast("string"))


def _link_sql() -> str:
    n = len(_HOSTS), len(_PATHS), len(_QUERIES)
    hosts, paths, asked = (values("i, t", list(enumerate(p))) for p in (_HOSTS, _PATHS, _QUERIES))
    return f"""WITH h AS ({hosts}), p AS ({paths}), q AS ({asked}),
u AS (SELECT o_orderkey AS k, h.i AS h, p.i AS p, q.i AS q, h.t AS host, replace(p.t, '{{k}}', o_orderkey::VARCHAR) AS path, h.t || replace(p.t || q.t, '{{k}}', o_orderkey::VARCHAR) AS url FROM orders
  JOIN h ON h.i = o_orderkey % {n[0]} JOIN p ON p.i = (o_orderkey // {n[0]}) % {n[1]} JOIN q ON q.i = (o_orderkey // {n[0] * n[1]}) % {n[2]})
SELECT k AS o_orderkey,
  CASE WHEN h < 2 AND (p < 2 OR p IN (2, 3, 8) AND q = 1) THEN 'https://www.linkedin.com/jobs/view/' || k ELSE '' END AS job,
  CASE WHEN h < 2 AND p = 4 THEN 'https://www.linkedin.com/company/acme-' || k || '/' ELSE '' END AS company,
  CASE WHEN h = 0 AND p = 5 THEN 'https://www.linkedin.com/in/someone-' || k ELSE '' END AS profile,
  CASE WHEN h < 5 THEN '' WHEN p = 7 AND (q < 5 OR k = 9) THEN k::VARCHAR WHEN p = 8 AND q IN (3, 4) THEN k::VARCHAR WHEN p = 8 AND q = 5 THEN '9' ELSE '' END AS board,
  CASE WHEN h < 5 THEN '' WHEN p = 7 AND (q < 5 OR k = 9) OR p = 8 AND q IN (3, 4) THEN host || '/job/' || k WHEN p = 8 AND q = 5 THEN host || '/job/9' ELSE '' END AS detail,
  CASE WHEN h < 4 AND p = 3 AND q IN (1, 2) AND k >= 10000 THEN 'https://www.linkedin.com/jobs/view/' || k || '/' ELSE url END AS direct
FROM u"""


@query(_link_sql())
def link_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    over = lambda n: F.floor(k / n)
    url = F.concat(_pick(_HOSTS, k, k), _pick(_PATHS, over(len(_HOSTS)), k), _pick(_QUERIES, over(len(_HOSTS) * len(_PATHS)), k))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", url.alias("url"))
    u = F.col("url")
    return rows.select("o_orderkey", links.job_link(u).alias("job"), links.company_link(u).alias("company"), links.profile_link(u).alias("profile"), links.board_job(u).alias("board"), links.board_detail(u).alias("detail"), links.without_collection(u).alias("direct"))


@query("""SELECT page_id, regexp_matches(url, '^[a-z]+://[^/?#]*google\\.[^/?#]*/search') AS own_search FROM pages""")
def own_search_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", links.is_own_search(F.col("url")).alias("own_search"))


@query("""WITH t AS (SELECT o_orderkey AS k, o_orderdate, o_totalprice::DECIMAL(38,2)::DECIMAL(38,12) AS v FROM orders)
SELECT k AS o_orderkey, v::DOUBLE AS number, CASE WHEN k % 4 = 1 THEN NULL WHEN k % 4 = 2 THEN 7.5 ELSE v END::DECIMAL(38,12) AS exact,
  CASE WHEN k % 150 <= 100 THEN (k % 150) / 100.0 END::DECIMAL(38,12) AS rate, CASE WHEN v <= 100000 THEN v END AS bounded,
  CASE k % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN NULL ELSE true END AS flag, CASE WHEN 1800 + k % 500 BETWEEN 1900 AND 2200 THEN 1800 + k % 500 END::INT AS year,
  o_orderdate >= DATE '1996-01-01' - INTERVAL 400 DAY AND o_orderdate <= DATE '1996-01-01' AS fresh FROM t""")
def lenient_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, price = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(38,2)").cast("string")
    said = F.when(k % 4 == 1, "no number").when(k % 4 == 2, "").otherwise(price)
    word = F.when(k % 5 == 0, " YES").when(k % 5 == 1, "on").when(k % 5 == 2, "No ").when(k % 5 == 3, "maybe")
    stamp = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(k % 2 == 0, "T00:00:00Z").otherwise("T08:00:00+08:00"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", lenient.number(F.when(k % 3 == 0, F.concat(F.lit("RM "), price)).otherwise(price)).alias("number"), lenient.exact(said, "7.5").alias("exact"), lenient.rate((k % 150) / 100).alias("rate"),
        lenient.bounded(price, 0, 100_000).alias("bounded"), lenient.flag(word, True).alias("flag"), lenient.tax_year(F.when(k % 2 == 0, 1800 + k % 500), 1800 + k % 500).alias("year"),
        lenient.fresh(stamp, F.lit("1996-01-01T00:00:00Z").cast("timestamp"), 400 * 24).alias("fresh"),
    )


#: Notes on expected pay, and what they say: same as the current, open, with an amount.
_NOTES: tuple[tuple[str, bool, bool, bool], ...] = (
    ("Same as current", True, False, False), ("match the current package", True, False, False), ("no increment needed", True, False, False), ("lateral move", True, False, False),
    ("current salary is fine", True, False, False), ("negotiable", False, True, False), ("N/A", False, True, False), ("TBD, around 8k", False, True, True), ("6,500 per month", False, False, True),
    ("10 to 15%", False, False, False), ("open to current", True, True, False), ("", False, False, False), ("RM 12000 nego", False, True, True), ("currently reopened", False, False, False),
)


@query(f"SELECT event_id, v.same, v.open, v.amount FROM events JOIN ({values('k, same, open, amount', [(k, *n[1:]) for k, n in enumerate(_NOTES)])}) v ON event_id % {len(_NOTES)} = v.k")
def pay_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _pick(tuple(n[0] for n in _NOTES), F.col("event_id"), F.lit(""))
    return table(spark, sf_dir, "events").select("event_id", lenient.same_as_current(said).alias("same"), lenient.is_open(said).alias("open"), lenient.amount_given(said).alias("amount"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'id:f' || c_custkey WHEN c_custkey % 3 = 1 THEN 'label:' || lower(regexp_replace(c_mktsegment, '[^A-Za-z0-9]', '', 'g')) ELSE '' END AS field_key,
  CASE WHEN c_custkey % 3 = 0 THEN 'id:f' || c_custkey WHEN c_custkey % 2 = 0 THEN 'work:fulltime' WHEN c_custkey % 3 = 1 THEN 'work:' || lower(c_mktsegment) ELSE '' END AS work_key,
  CASE WHEN c_custkey % 3 = 1 THEN c_mktsegment WHEN c_custkey % 5 = 0 THEN 'Ann ' || c_name ELSE 'Candidate ' || c_custkey END AS name FROM customer""")
def record_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    given = {"fieldId": F.when(k % 3 == 0, F.concat(F.lit(" F"), k.cast("string"))), "id": F.when(k % 3 == 0, F.concat(F.lit("F"), k.cast("string"))), "workType": F.when(k % 2 == 0, "Full-Time"), "name": F.when(k % 3 == 1, F.col("c_mktsegment")), "firstName": F.when(k % 5 == 0, " Ann"), "lastName": F.when(k % 5 == 0, F.col("c_name"))}
    r = F.map_filter(F.create_map(*(x for n, c in given.items() for x in (F.lit(n), c))), lambda _, v: v.isNotNull())
    rows = table(spark, sf_dir, "customer").select("c_custkey", r.alias("r"))
    return rows.select("c_custkey", records.field_key(F.col("r")).alias("field_key"), records.work_key(F.col("r")).alias("work_key"), records.preview_name(F.col("r"), k).alias("name"))


#: Names of models and reasons as they come, and as they may be shown.
_MODELS = (("gpt-x/mini:2", "gpt-x/mini:2"), (" a.b_c ", "a.b_c"), ("", ""), ("sk-abc123", "[redacted-or-invalid-model]"), ("two words", "[redacted-or-invalid-model]"), ("my-api_key", "[redacted-or-invalid-model]"), ("-x", "[redacted-or-invalid-model]"))
_REASONS = (("", records.NO_BILLING), ("timeout", "timeout"), ("api_key=abc; x", "api_key=[redacted]; x"), ("Authorization: Bearer t.k, y", "Authorization: Bearer [redacted], y"), ("used sk-Ab.1_z", "used [redacted]"))


@query(f"""WITH m AS ({values('k, want', [(k, m[1]) for k, m in enumerate(_MODELS)])}), r AS ({values('k, want', [(k, m[1]) for k, m in enumerate(_REASONS)])})
SELECT event_id, m.want AS model, r.want AS reason, CASE WHEN event_id % 3 = 0 THEN '[redacted]' ELSE 'v' || event_id END AS header, greatest(event_id % 7 - 3, 0)::BIGINT AS observed, NULL::DECIMAL(18,6) AS amount
FROM events JOIN m ON m.k = event_id % {len(_MODELS)} JOIN r ON r.k = event_id % {len(_REASONS)}""")
def safe_billing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    headers = F.create_map(F.when(k % 3 == 0, "Set-Cookie").otherwise("Retry-After"), F.concat(F.lit("v"), k.cast("string")))
    bill = records.billing_unavailable(F.lit(" Acme "), k % 7 - 3, _pick(tuple(r[0] for r in _REASONS), k, F.lit("")))
    rows = table(spark, sf_dir, "events").select("event_id", records.safe_model(_pick(tuple(m[0] for m in _MODELS), k, F.lit(""))).alias("model"), bill.alias("b"), F.map_values(records.safe_headers(headers)).alias("h"))
    return rows.select("event_id", "model", F.col("b.reason").alias("reason"), F.element_at("h", 1).alias("header"), F.col("b.observed_operations").alias("observed"), F.col("b.amount").alias("amount"))


_FILTERS = {"exclude_keywords": "tin, small", "company_exclude": "wheat;  plum ", "max_days_open": 30, "must_have": "spark, sql,spark", "seniority": "senior"}


@query("""WITH p AS (SELECT *, lower(p_type || ' ' || p_name) AS t FROM part)
SELECT p_partkey, regexp_matches(t, '\\brod\\b') OR contains(t, 'gear') OR contains(t, 'promo') OR contains(t, 'economy') AND contains(t, 'small') AS placed,
  regexp_matches(t, '\\b(steel|widget|anvil)\\b') AS family, NOT regexp_matches(t, 'tin|small|wheat|plum') AND (p_partkey % 3 = 0 OR p_size <= 30) AS wanted FROM p""")
def lead_filters_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the names stand for regions and titles, two of them for remote work and its scope."""
    text = lead_filters.blob("p_type", "p_name")
    place = F.regexp_replace(F.regexp_replace(text, "economy", "remote"), "small", "asean")
    days = F.when(F.col("p_partkey") % 3 != 0, F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", lead_filters.location_allowed(place, ["Gear"], {"Gear": ["rod", "promo"]}, ["gear"]).alias("placed"),
        lead_filters.in_role_family(text, ["Manager", "Senior Steel-Widget Engineer", "anvil lead"]).alias("family"), lead_filters.wanted_lead(text, days, _FILTERS).alias("wanted"),
    )


@query("""WITH q AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(?i)\\bsite:[^ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), '(?i)\\bOR\\b', ' ', 'g'), '[-–][ \\t\\n\\x0B\\f\\r]*[\\pL\\pM\\p{Nd}\\p{Pc}]+', ' ', 'g'), '"', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') AS q FROM documents)
SELECT doc_id, substr(CASE WHEN contains(lower(q), ' job') THEN q ELSE q || ' jobs' END, 1, 220) AS query FROM q""")
def plain_job_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", lead_filters.plain_job_query(F.col("text")).alias("query"))


@query("""WITH p AS (SELECT c_custkey, c_custkey % 4 AS k, CASE c_custkey % 4 WHEN 0 THEN 'ann@acme.com' WHEN 1 THEN 'ann@gmail.com' WHEN 2 THEN '' ELSE 'not an address' END AS e FROM customer)
SELECT c_custkey, CASE WHEN k IN (1, 3) THEN '' ELSE e END AS email, CASE WHEN k IN (1, 2, 3) THEN 'Not found' ELSE '' END AS status,
  CASE WHEN k = 1 AND c_custkey % 3 = 0 THEN 'seen Removed personal/free-mail or invalid email; public business-domain email required.' WHEN k IN (1, 3) THEN CASE WHEN c_custkey % 3 = 0 THEN 'seen ' ELSE '' END || 'Removed personal/free-mail or invalid email; public business-domain email required.' WHEN c_custkey % 3 = 0 THEN 'seen' ELSE '' END AS notes FROM p""")
def business_emails_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select("c_custkey", _pick(("ann@acme.com", "ann@gmail.com", "", "not an address"), k, F.lit("")).alias("email"), F.lit("high").alias("email_confidence"), F.lit("web").alias("email_source"), F.lit("").alias("verification_status"), F.when(k % 3 == 0, "seen").otherwise("").alias("notes"))
    return lead_filters.business_emails_only(p, ["gmail.com"]).select("c_custkey", "email", F.col("verification_status").alias("status"), "notes")


@query("""SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE lower(n_name) IN (SELECT lower(n_name) FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 5000) AND (contains(lower(c_mktsegment), 'machin') OR c_custkey % 2 = 0)""")
def people_of_kept_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    people = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat(F.lit(" "), F.lower("n_name")).alias("company"), "c_mktsegment")
    kept = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("company"))
    allowed = lead_filters.location_allowed(lead_filters.blob("c_mktsegment"), ["machin"], {})
    return lead_filters.people_of_kept_companies(people, kept, allowed, F.col("c_custkey") % 2 != 0).select("c_custkey")


@query("""WITH t AS (SELECT p_partkey, list_distinct(list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda x: x <> '')) AS a, list_distinct(list_filter(string_split_regex(lower(p_type), '[^a-z0-9]+'), lambda x: x <> '')) AS b FROM part),
s AS (SELECT p_partkey, len(list_intersect(a, b)) / greatest(len(a), len(b))::DOUBLE AS o FROM t)
SELECT p_partkey, (5.0 + CASE WHEN o >= 0.67 THEN 2.0 WHEN o >= 0.34 THEN 1.0 ELSE 0.0 END + CASE p_partkey % 3 WHEN 0 THEN 2.5 WHEN 1 THEN 1.0 ELSE 0.0 END)::DOUBLE AS score, o >= 0.67 AS same,
  CASE p_partkey % 3 WHEN 0 THEN 'Jan 2020 to Present' WHEN 1 THEN '2019 to Mar 2021' ELSE 'Not confirmed' END AS label FROM s""")
def row_scores_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    row = {"company": F.col("p_brand"), "title": F.col("p_name"), "dates": F.lit("2020-01 - 2021-03")}
    role = {"company": F.lower("p_brand"), "title": F.col("p_type"), "dates": F.when(k == 0, "January 2020 to March 2021").when(k == 1, "Jan 2020 - now").otherwise("2018 - 2019")}
    label = cv.employment_label(F.when(k == 0, "2020-01").when(k == 1, "2019"), F.lit("2021-03"), k == 0, F.lit("not_shown"))
    return table(spark, sf_dir, "part").select("p_partkey", cv.row_match_score(row, role).cast("double").alias("score"), cv.employers_match(F.col("p_name"), F.col("p_type")).alias("same"), label.alias("label"))


@query("""WITH s AS (SELECT source, doc_id, lang, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents), f AS (SELECT source, lang, min(n) AS n FROM s WHERE lang IS NOT NULL GROUP BY source, lang)
SELECT source, list(lang ORDER BY n) AS employers FROM f GROUP BY source""")
def distinct_employers_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages stand for employers: all of a source's in order of id, spelt in two ways; the first spellings are kept."""
    d = table(spark, sf_dir, "documents").filter("lang is not null")
    spelt = d.select("source", F.inline(F.array(*(F.struct(F.struct(F.col("doc_id"), F.lit(k)).alias("at"), n.alias("name")) for k, n in enumerate((F.col("lang"), F.concat(F.upper("lang"), F.lit("."))))))))
    few = cv.first_spellings(spelt, "source", "at", "name")
    return few.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("employers"))
