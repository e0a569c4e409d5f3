"""Links of leads: every combination of links and qualities by the key of a row; the SQL knows what each link is, not how it looks."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lead_urls
from .catalog import query, table, values

#: (link, kind, host, as a job's link): d is a job's own page, m a page of many or no jobs, o another page, n none.
_LINKS = [
    ("https://www.linkedin.com/jobs/view/4{k}", "d", "www.linkedin.com", "https://www.linkedin.com/jobs/view/4{k}"),
    ("https://www.linkedin.com/jobs/collections/recommended?currentJobId=40000{k}", "d", "www.linkedin.com", "https://www.linkedin.com/jobs/view/40000{k}/"),
    ("https://my.jobstreet.com/senior-data-engineer-jobs", "m", "my.jobstreet.com", ""),
    ("https://www.glassdoor.com/Overview/acme-{k}", "o", "www.glassdoor.com", ""),
    ("https://my.jobstreet.com/companies/acme-{k}", "m", "my.jobstreet.com", ""),
    ("https://acme-{k}.example.com/about", "o", "acme-{k}.example.com", ""),
    ("https://acme.example.com/blog/how-to-{k}", "m", "acme.example.com", ""),
    ("https://my.indeed.com/?q=engineer", "m", "my.indeed.com", ""),
    (None, "n", "", ""),
]
_COMPANIES = [("Acme & Co", "%22Acme%20%26%20Co%22%20"), ("Unknown (Data / AWS)", ""), ("Café  Zürich*", "%22Caf%C3%A9%20Z%C3%BCrich%2A%22%20"), (" n/a ", ""), (None, ""), ("Unknowns Ltd", "%22Unknowns%20Ltd%22%20"), ("Not  specified", "")]
_QUALITIES = ["needs_verification", "structured_google_job", "", "direct_job_ad", None]
_ROLE = "Data Engineer"


def _nth(rows: list, k: Column, every: int = 1) -> Column:
    n = (F.floor(k / every) % len(rows) + 1).cast("int")
    return F.element_at(F.array(*(F.lit(r).cast("string") for r in rows)), n)


def _leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    link = lambda every: F.replace(_nth([r[0] for r in _LINKS], k, every), F.lit("{k}"), (k % 1000).cast("string"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        _nth([c[0] for c in _COMPANIES], k).alias("company"),
        F.when(k % 2 == 0, _ROLE).alias("matched_role"),
        F.lit(_ROLE).alias("title"),
        link(1).alias("job_url"),
        link(9).alias("source_url"),
        link(5).alias("company_url"),
        _nth(_QUALITIES, k, 2).alias("job_url_quality"),
        F.when(k % 3 == 0, "Seen.").alias("source_note"),
    )


def _parts_sql() -> str:
    fill = lambda c: f"replace({c}, '{{k}}', (o_orderkey % 1000)::VARCHAR)"
    one = lambda a, every: f"JOIN links {a} ON {a}.i = (o_orderkey // {every}) % {len(_LINKS)}"
    return f"""links AS ({values("i, link, kind, host, own", [(i, *r) for i, r in enumerate(_LINKS)])}),
companies AS ({values("i, name, quoted", [(i, *r) for i, r in enumerate(_COMPANIES)])}), qualities AS ({values("i, q", list(enumerate(_QUALITIES)))}),
p AS (SELECT o_orderkey, coalesce({fill("j.link")}, '') AS j, j.kind AS jk, {fill("j.host")} AS jh, coalesce({fill("s.link")}, '') AS s, s.kind AS sk, {fill("s.host")} AS sh,
  CASE 'd' WHEN j.kind THEN {fill("j.own")} WHEN s.kind THEN {fill("s.own")} WHEN c.kind THEN {fill("c.own")} ELSE '' END AS direct,
  'https://www.google.com/search?q=' || quoted || '%22Data%20Engineer%22%20site%3A' AS search, coalesce(q, '') AS q, CASE WHEN o_orderkey % 3 = 0 THEN 'Seen.' ELSE '' END AS note
  FROM orders {one("j", 1)} {one("s", 9)} {one("c", 5)} JOIN companies ON companies.i = o_orderkey % {len(_COMPANIES)} JOIN qualities ON qualities.i = (o_orderkey // 2) % {len(_QUALITIES)}),
v AS (SELECT *, CASE WHEN q = 'needs_verification' THEN 'v' WHEN q = 'structured_google_job' AND jk IN ('d', 'o') THEN 'k' WHEN q = 'structured_google_job' AND jk = 'm' THEN 'x' WHEN direct <> '' THEN 'd' ELSE 'n' END AS plan FROM p),
w AS (SELECT *, CASE WHEN plan = 'v' THEN (CASE WHEN jk <> 'n' THEN 'j' WHEN sk <> 'n' THEN 's' END) WHEN plan = 'x' THEN 'j' WHEN plan = 'n' THEN (CASE WHEN sk = 'm' THEN 's' WHEN jk = 'm' OR (jk <> 'n' AND sk = 'n') THEN 'j' END) END AS which FROM v),
linked AS (SELECT o_orderkey, CASE plan WHEN 'k' THEN j WHEN 'd' THEN direct ELSE '' END AS job_url,
  CASE which WHEN 'j' THEN CASE WHEN jk = 'm' THEN search || jh ELSE j END WHEN 's' THEN CASE WHEN sk = 'm' THEN search || sh ELSE s END ELSE s END AS source_url,
  CASE plan WHEN 'v' THEN 'needs_verification' WHEN 'x' THEN 'needs_verification' WHEN 'k' THEN q WHEN 'd' THEN 'direct_job_ad' ELSE 'source_or_search_result_only' END AS job_url_quality,
  concat_ws(' ', CASE WHEN note <> '' THEN note END, CASE WHEN plan = 'x' THEN '{lead_urls.NOTE_STRUCTURED}' END,
    CASE WHEN (which = 'j' AND jk = 'm') OR (which = 's' AND sk = 'm') THEN '{lead_urls.NOTE_REPLACED}' END, CASE WHEN plan = 'n' AND jk <> 'n' THEN '{lead_urls.NOTE_NO_DIRECT}' END) AS source_note FROM w)"""


@query(f"WITH {_parts_sql()} SELECT * FROM linked")
def leads_with_one_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lead_urls.with_one_link(_leads(spark, sf_dir)).select("o_orderkey", "job_url", "source_url", "job_url_quality", "source_note")


@query(f"WITH {_parts_sql()} SELECT min(o_orderkey) AS o_orderkey, job_url FROM (SELECT linked.o_orderkey, job_url FROM linked JOIN v USING (o_orderkey) WHERE (plan = 'd') OR (plan = 'k' AND jk = 'd')) GROUP BY job_url")
def direct_leads_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lead_urls.direct_job_leads(_leads(spark, sf_dir), "o_orderkey").select("o_orderkey", "job_url")


_AS_OF = date(2026, 7, 1)
_FIT_SQL = f"""WITH {_parts_sql()}, f AS (SELECT o_orderkey, job_url_quality, CASE o_orderkey % 4 WHEN 0 THEN (o_orderkey % 130)::VARCHAR WHEN 1 THEN (o_orderkey % 50)::VARCHAR END AS given, o_orderkey % 40 AS d, o_orderkey % 6 AS form FROM linked)
SELECT o_orderkey, CASE WHEN given IS NOT NULL THEN least(given::INT, 100) WHEN job_url_quality IN ('direct_job_ad', 'structured_google_job') THEN 78 ELSE 68 END AS job_fit_percent,
  CASE WHEN form IN (0, 1, 2) THEN (DATE '2026-07-01' - d::INT)::VARCHAR WHEN form = 3 THEN 'some day' ELSE '' END AS date_posted, CASE WHEN form IN (0, 1, 2) THEN d::INT END AS days_open FROM f"""


@query(_FIT_SQL)
def leads_fit_and_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, form, d = F.col("o_orderkey"), F.col("o_orderkey") % 6, (F.col("o_orderkey") % 40).cast("int")
    rows = _leads(spark, sf_dir).withColumns(
        {
            "job_fit_percent": F.when(k % 4 == 0, (k % 130).cast("string")).when(k % 4 == 2, ""),
            "match_score": F.when(k % 4 == 1, (k % 50).cast("string")),
            "date_posted": F.when(form == 0, F.date_sub(F.lit(_AS_OF), d).cast("string")).when(form == 3, "some day").when(form.isin(2, 4), "Not shown"),
            "posted": F.when(form == 1, F.concat(d.cast("string"), F.lit(" days ago"))),
            "days_open": F.when(form == 2, d.cast("string")).when(form == 4, "many"),
        }
    )
    return lead_urls.with_fit_and_freshness(rows, _AS_OF).select("o_orderkey", "job_fit_percent", "date_posted", "days_open")


_CHOSEN_SQL = f"""WITH {_parts_sql()}, b AS (SELECT o_orderkey, j, s, quoted, jk <> 'n' AND j NOT LIKE '%linkedin.com%' AS bj, sk <> 'n' AND s NOT LIKE '%linkedin.com%' AS bs FROM p JOIN companies ON companies.i = o_orderkey % {len(_COMPANIES)})
SELECT o_orderkey, CASE WHEN bj THEN '' ELSE j END AS job_url, CASE WHEN (bj OR bs) AND (bs OR s = '') THEN 'https://www.google.com/search?q=' || quoted || '%22Data%20Engineer%22%20site%3Alinkedin.com/jobs' ELSE s END AS source_url FROM b"""


@query(_CHOSEN_SQL)
def leads_of_chosen_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _leads(spark, sf_dir).withColumn("job_portal", F.lit("")).withColumn("lead_kind", F.lit(""))
    kept = lead_urls.without_unchosen_sources(rows, ["LinkedIn"], ["linkedin", "jobstreet", "indeed", "glassdoor"], "linkedin.com/jobs", "LinkedIn")
    return kept.select("o_orderkey", *(F.coalesce(c, F.lit("")).alias(c) for c in ("job_url", "source_url")))


_PAGES = [
    ("LinkedIn", "https://www.linkedin.com/jobs/search/?keywords={}&location=Singapore%2C+Hong+Kong", False),
    ("JobStreet SG", "https://www.jobstreet.com.sg/jobs?keywords={}", False),
    ("jobsdb", "https://hk.jobsdb.com/jobs?keywords={}", True),
    ("Glassdoor", "https://www.glassdoor.com/Job/jobs.htm?sc.keyword={}&locT=&locId=&locKeyword=Singapore%2C+Hong+Kong", False),
    ("Foundit", "https://www.foundit.my/srp/results?query={}", True),
    ("Own page", "https://www.google.com/search?q=Own+page+{}+jobs", True),
]


@query(f"""WITH t AS ({values("i, a, b, z", [(i, *p.split("{}"), z) for i, (_, p, z) in enumerate(_PAGES)])})
SELECT p_partkey, a || replace(p_name, ' ', '+') || '+SQL+-intern' || CASE WHEN z THEN '+Singapore%2C+Hong+Kong' ELSE '' END || b AS page FROM part JOIN t ON i = p_partkey % {len(_PAGES)}""")
def portal_searches_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _nth([p[0] for p in _PAGES], F.col("p_partkey"))
    filters = lead_urls.clean_filters({"must_have": " SQL;sql", "exclude_keywords": "intern", "seniority": " "})
    return table(spark, sf_dir, "part").select("p_partkey", lead_urls.portal_search(source, F.col("p_name"), ["Singapore", " Hong Kong "], filters).alias("page"))


_FAMILIES = {"data": [r"\bdata\b"], "hr": [r"\bhr\b", r"\brecruit"], "sales": [r"\bsales\b"]}
_TITLES = {"data": "Data Engineer", "hr": "HR Executive"}
_WORDS = [("", []), ("data", ["data"]), ("hr", ["hr"]), ("sales", ["sales"]), ("gardener", [])]


@query(f"""WITH w AS ({values("i, t, f", [(i, *r) for i, r in enumerate(_WORDS)])}),
x AS (SELECT p_partkey, a.t AS target, a.f AS tf, b.f AS rf, CASE WHEN len(b.f) = 0 THEN '' WHEN b.t = 'data' THEN 'Data Engineer' WHEN b.t = 'hr' THEN 'HR Executive' ELSE 'Relevant open role' END AS own FROM part JOIN w a ON a.i = p_partkey % 5 JOIN w b ON b.i = (p_partkey // 5) % 5)
SELECT p_partkey, CASE WHEN len(tf) > 0 THEN tf ELSE rf END AS families, CASE WHEN target = '' OR (len(tf) > 0 AND len(rf) > 0 AND tf <> rf) THEN own ELSE target END AS role,
  target <> '' AND len(tf) > 0 AND len(rf) > 0 AND tf <> rf AS noted FROM x""")
def search_targets_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, words = F.col("p_partkey"), [w[0] for w in _WORDS]
    target, resume, none = F.col("target"), F.col("resume"), F.lit("")
    rows = table(spark, sf_dir, "part").select(k, _nth(words, k).alias("target"), _nth(words, k, 5).alias("resume"))
    found = lead_urls.primary_families(target, resume, none, none, _FAMILIES, {})
    of = lambda t, r: lead_urls.primary_families(t, r, none, none, _FAMILIES, {})
    told = lead_urls.search_target(target, of(none, resume), of(target, none), _TITLES)
    return rows.select(k, found.alias("families"), told["role"].alias("role"), (told["note"] != "").alias("noted"))
