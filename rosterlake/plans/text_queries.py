"""Pages, redaction and term lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import redact, text, web
from .catalog import query, table

_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?([^/?#:]*)', 2))"
_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


@query(f"SELECT page_id, lower('https://' || regexp_replace({_HOST}, '^www\\.', '') || regexp_replace({_PATH}, '/+$', '')) AS url FROM pages")
def url_canonical_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", web.canonical_url(F.col("url")).alias("url"))


@query(f"SELECT page_id, {_HOST} AS host, CASE WHEN contains({_HOST}, 'blog.') THEN 'Blog' WHEN contains({_HOST}, 'www.') THEN 'Web' ELSE 'Other' END AS label, starts_with(url, 'https://') AND ends_with({_HOST}, '.example.com') AS allowed, regexp_extract({_PATH}, '(\\d{{3,}})', 1) AS number FROM pages")
def url_facts_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", web.url_host(u).alias("host"), web.host_label(u, [("blog.", "Blog"), ("www.", "Web")], "Other").alias("label"), web.host_allowed(u, ["example.com"]).alias("allowed"), web.numeric_id(u, 3).alias("number"))


def _html_sql() -> str:
    t = "html"
    for pattern, to in (("(?is)<!--.*?-->", ""), ("(?is)<(script|style|noscript)\\b[^>]*>.*?</(script|style|noscript)\\s*>", ""), ("(?i)</?(?:" + "|".join(web.BLOCKS) + ")\\b[^>]*>", "\n"), ("(?s)<[^>]+>", "")):
        t = f"regexp_replace({t}, '{pattern}', '{to}', 'g')"
    for name, sign in web._ENTITIES:
        t = f"replace({t}, '{name}', '{sign.replace(chr(39), chr(39) * 2)}')"
    for pattern, to in (("[ \\t]+", " "), ("\\n[ \\t]+", "\n"), ("\\n{3,}", "\n\n"), ("^\\s+|\\s+$", "")):
        t = f"regexp_replace({t}, '{pattern}', '{to}', 'g')"
    return t


@query(f"SELECT page_id, {_html_sql()} AS text FROM pages")
def html_to_text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", web.html_text(F.col("html")).alias("text"))


@query("""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, len(list_distinct(regexp_extract_all(html, '(?i)\\bhref="([^"]*)"', 1)))::INT AS n_links FROM pages""")
def page_titles_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", web.page_title(F.col("html")).alias("title"), F.size(web.links(F.col("html"))).alias("n_links"))


@query("""SELECT doc_id, regexp_replace(text, '(?i)\\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}\\b', '[redacted-email]', 'g') AS text FROM documents""")
def email_redact_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", redact.without_emails(F.col("text")).alias("text"))


@query("""SELECT doc_id, lower(regexp_extract(text, '(?i)(\\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}\\b)', 1)) AS email FROM documents""")
def first_email_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", redact.email_in(F.col("text")).alias("email"))


@query()
def phone_redact_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", redact.without_phones(t).alias("text"), redact.phone_in(t).alias("phone"))


@query("""SELECT c_custkey, sha256(concat_ws(chr(31), c_name, c_mktsegment, c_nationkey::VARCHAR)) AS fingerprint, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS key FROM customer""")
def row_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", web.fingerprint(F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey")).alias("fingerprint"), text.match_key(F.col("c_name")).alias("key"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN [lower(p_brand), 'Second term'] ELSE [p_brand] END AS terms FROM part""")
def term_lists_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" - "), F.lower("p_brand"), F.lit(";x, Second   term\n"), F.col("p_brand"))).otherwise(F.concat(F.col("p_brand"), F.lit(",\"\",a")))
    return table(spark, sf_dir, "part").select("p_partkey", text.term_list(raw, 18).alias("terms"))


@query("""SELECT conv_id, count(*) AS n_turns, sum(length(text))::BIGINT AS n_chars, count(*) FILTER (WHERE role = 'user') AS n_user FROM conversations GROUP BY conv_id""")
def conversation_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sum(F.char_length("text")).alias("n_chars"), F.count_if(F.col("role") == "user").alias("n_user"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'gmail.com' ELSE 'acme.example' END AS domain, c_custkey % 2 = 1 AS business, CASE WHEN c_custkey % 5 = 0 THEN 'invalid' ELSE 'ok' END AS state FROM customer""")
def email_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    host = F.when(k % 2 == 0, "@Gmail.com").otherwise("@acme.example")
    email = F.concat(F.lit("User."), k.cast("string"), host)
    odd = F.when(k % 5 == 0, F.concat(F.lit("a..b"), host)).otherwise(email)
    return table(spark, sf_dir, "customer").select("c_custkey", redact.email_domain(email).alias("domain"), redact.business_email(email, ("gmail.com",)).alias("business"), redact.email_state(odd).alias("state"))
