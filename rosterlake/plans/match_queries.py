"""Names, spans, stamps and joins of scenarios, contacts and observed people."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, leads, people, vectorised
from ..operators import match
from .catalog import query, table, values

#: Lines of CVs: is it a place, a person's name, a term that no fit counts.
_LINES: tuple[tuple[str, bool, bool, bool], ...] = (
    ("Ann Marie Tan", False, True, False), ("12, Jalan Ampang", True, False, False), ("ann@x.org", True, False, False), ("Kuala  Lumpur", True, False, False), ("O'Neil-Smith, ", False, False, False), ("J. R. Tolkien", False, True, False),
    ("fluent English", False, True, True), ("Master of Arts", False, True, True), ("Python", False, False, False), ("", False, False, True), ("Streetcar Driver", False, True, False), ("Main Street Shop", True, False, False), ("a b c d e f g", False, False, False),
)


def _said(parts: tuple[str, ...], key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, parts)), (key % len(parts) + 1).cast("int"))


@query(f"SELECT event_id, v.place, v.person, v.uncounted FROM events JOIN ({values('k, place, person, uncounted', [(k, *x[1:]) for k, x in enumerate(_LINES)])}) v ON v.k = event_id % {len(_LINES)}")
def line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _said(tuple(x[0] for x in _LINES), F.col("event_id"))
    return table(spark, sf_dir, "events").select("event_id", people.is_place_line(t).alias("place"), people.is_person_name(t).alias("person"), people.uncounted_term(t).alias("uncounted"))


@query("""WITH t AS (SELECT doc_id, trim(regexp_replace(regexp_replace(coalesce(text, ''), '[\\pZ\\s\\x0B\\x85\\x{200B}\\x{FEFF}]+', ' ', 'g'), ' +', ' ', 'g'), ' ') AS t, source AS s FROM documents)
SELECT doc_id, md5(CASE WHEN t = '' THEN s ELSE trim(substr(t, 1, 14000) || ' ' || substr(s || ' ' || s, 1, 19999 - length(substr(t, 1, 14000))), ' ') END) AS digest FROM (SELECT doc_id, trim(regexp_replace(coalesce(t, ''), ' +', ' ', 'g')) AS t, s FROM t)""")
def evidence_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(people.evidence_text(F.col("text"), F.concat_ws("\n ", "source", "source")).cast("binary")).alias("digest"))


@query("""WITH o AS (SELECT o_orderkey AS k, year(o_orderdate) AS y, month(o_orderdate) AS m, o_orderkey % 5 AS f, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders)
SELECT k AS o_orderkey, CASE f WHEN 0 THEN y * 12 + m WHEN 1 THEN (y - 1) * 12 + 12 WHEN 2 THEN y * 12 + m WHEN 3 THEN y * 12 + 1 END::INT AS start, CASE f WHEN 0 THEN (y + 1) * 12 + m WHEN 1 THEN y * 12 + m WHEN 2 THEN 9999 * 12 + 12 WHEN 3 THEN y * 12 + 12 END::INT AS stop, f IN (0, 2) AS months,
  CASE f WHEN 0 THEN d || 'T10:00:00Z' WHEN 1 THEN d || 'T13:05:09Z' WHEN 2 THEN d || 'T03:05:09Z' ELSE 'some day' END AS stamp, CASE WHEN f < 3 THEN d || 'T23:59:59Z' ELSE '' END AS bound, CASE WHEN f IN (0, 4) THEN d ELSE '' END AS day FROM o""")
def spans_and_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, f = F.col("o_orderdate"), F.col("o_orderkey") % 5
    iso = F.date_format(at, "yyyy-MM-dd")
    said = F.when(f == 0, F.concat(F.date_format(at, "MMM yyyy"), F.lit(" - "), F.date_format(F.add_months(at, 12), "MM/yyyy"))).when(f == 1, F.concat(F.date_format(at, "MMMM yyyy"), F.lit(" to "), (F.year(at) - 1).cast("string"))).when(f == 2, F.concat(F.date_format(at, "yyyy-MM"), F.lit(" - now"))).when(f == 3, F.year(at).cast("string")).otherwise("none")
    stamp = F.when(f == 0, F.concat(iso, F.lit("T10:00:00Z"))).when(f == 1, F.date_format(at, "MM/dd/yyyy' 1:05:09 PM'")).when(f == 2, F.date_format(at, "yyyy-MM-dd' 03:05:09'")).otherwise(" some day")
    day = F.when(f == 0, F.concat(iso, F.lit("T10:00+08:00"))).when(f == 4, iso).when(f == 1, "2 days ago").when(f == 2, "2024-02-31").otherwise(F.concat(iso, F.lit(" x")))
    span = dates.experience_span(said)
    return table(spark, sf_dir, "orders").select("o_orderkey", span["start"].alias("start"), span["end"].alias("stop"), dates.has_months(said).alias("months"), dates.any_stamp(stamp).alias("stamp"), dates.date_bound(F.when(f < 3, iso).otherwise("soon"), True).alias("bound"), dates.calendar_day(day).alias("day"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'Immediate' WHEN o_orderkey % 4 = 1 THEN NULL ELSE 'In' || n || u || CASE WHEN n = 1 THEN '' ELSE 's' END END AS type,
  CASE WHEN o_orderkey % 4 > 1 THEN CASE WHEN u = 'Week' THEN strftime(DATE '2026-01-31' + (7 * n)::INT, '%Y-%m-%d') ELSE strftime(DATE '2026-01-31' + to_months(n::INT), '%Y-%m-%d') END END AS day
FROM (SELECT o_orderkey, o_orderkey % 3 + 1 AS n, CASE WHEN o_orderkey % 2 = 0 THEN 'Week' ELSE 'Month' END AS u FROM orders)""")
def notice_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    c = dates.notice_choice(k % 4 == 0, F.when(k % 4 == 1, "2026-05-01"), k % 3 + 1, F.when(k % 2 == 0, "Week").otherwise("Month"), date(2026, 1, 31))
    return table(spark, sf_dir, "orders").select("o_orderkey", c["type"].alias("type"), c["date"].alias("day"))


#: Urls and titles, and the companies that are read from them.
_HOSTS = (("https://www.acme-labs.com/jobs/1", "Acme Labs"), ("https://careers.acme.com.my/x", "Acme"), ("https://jobs.lever.co/acme", ""), ("https://my.jobstreet.com/1", ""), ("https://boards.greenhouse.io/a", ""), ("no url", ""), ("http://localhost/x", "Localhost"))
_TITLES = (("Acme Acme is hiring a cook", "Acme"), ("Beta Labs - Jobs in KL", "Beta Labs"), (" | Gamma Group Gamma Group, ", "Gamma Group"), ("Careers", ""), ("Delta | LinkedIn", "Delta"), ("Remote", ""), ("Epsilon is", "Epsilon"), ("x", ""))


@query(f"""SELECT event_id, h.want AS host_company, t.want AS title_company FROM events JOIN ({values('k, want', [(k, w) for k, (_, w) in enumerate(_HOSTS)])}) h ON h.k = event_id % {len(_HOSTS)} JOIN ({values('k, want', [(k, w) for k, (_, w) in enumerate(_TITLES)])}) t ON t.k = event_id % {len(_TITLES)}""")
def guessed_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", leads.company_of_host(_said(tuple(u for u, _ in _HOSTS), k)).alias("host_company"), leads.guessed_company(_said(tuple(t for t, _ in _TITLES), k)).alias("title_company"))


@query("""WITH s AS (SELECT c_custkey, n_name, c_custkey % 3 AS y, c_custkey % 4 AS q, CASE WHEN c_custkey % 7 = 0 THEN 2.5 END AS o FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, CASE WHEN y < 2 THEN substr(n_name, 1, 3) END AS currency, CASE WHEN o IS NOT NULL THEN o WHEN y = 2 THEN NULL WHEN q = 0 THEN 1.0 WHEN q = 1 THEN 1.0 + y WHEN q = 2 THEN 9.0 END::DOUBLE AS fx_rate,
  CASE WHEN o IS NOT NULL THEN 'manual override' WHEN y = 2 THEN NULL WHEN q = 0 THEN 'same' WHEN q = 1 THEN 'fresh' WHEN q = 2 THEN 'stale' END AS fx_source FROM s""")
def scenarios_with_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of two years for each nation; fresh rates into USD (two a pair and year, the higher counts), stale ones into EUR, none into GBP."""
    k = F.col("c_custkey")
    n = table(spark, sf_dir, "nation")
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    s = c.select("c_custkey", F.concat(F.lit(" "), F.lower("n_name")).alias("country"), (2024 + k % 3).alias("tax_year"), F.when(k % 2 == 0, "RESIDENT").alias("residency"), F.when(k % 4 == 1, F.concat(F.lit("us"), (k % 3).cast("string"))).when(k % 4 == 2, "EUR").when(k % 4 == 3, "GBP").alias("reporting_currency"), F.when(k % 7 == 0, 2.5).alias("fx_override"))
    code = F.substring("n_name", 1, 3)
    rules = n.select(F.col("n_name").alias("country"), F.explode(F.array(F.lit(2024), F.lit(2025))).alias("tax_year"), F.lit("resident").alias("residency"), F.lower(code).alias("currency"))
    rates = n.select(code.alias("base"), F.explode(F.array(*(F.struct(F.lit(q).alias("quote"), F.lit(r).alias("rate"), F.lit(f).alias("fresh")) for q, r, f in (("US0", 1.0, True), ("US1", 2.0, True), ("US0", 0.5, True), ("US1", 7.0, False), ("EUR", 9.0, False))))).alias("x")).select("base", "x.*")
    return match.with_rules(s, rules, rates).select("c_custkey", "currency", "fx_rate", "fx_source")


@query("""WITH p AS (SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey), c AS (SELECT c_custkey, n_name, CASE WHEN c_custkey % 2 = 0 THEN n_name ELSE 'else where' END AS company FROM customer JOIN nation ON c_nationkey = n_nationkey),
m AS (SELECT s_suppkey, c_custkey, c.company = p.n_name AND length(p.n_name) > 0 AS same FROM p JOIN c ON c.n_name = p.n_name),
r AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY same DESC, c_custkey) AS n FROM m)
SELECT s_suppkey, c_custkey, 100 AS score, same AS company_matches FROM r WHERE n <= 10""")
def contact_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers stand for people and customers for contacts, named by their nations; the best ten of each."""
    n = table(spark, sf_dir, "nation")
    letters = F.translate(F.md5(F.col("n_name").cast("binary")), "0123456789", "ghijklmnop")
    p = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.concat(F.lit("Dr "), F.substring(letters, 1, 8), F.lit(" "), letters).alias("name"), letters.alias("company"))
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat(letters, F.lit(", "), F.substring(letters, 1, 8)).alias("name"), F.when(F.col("c_custkey") % 2 == 0, letters).otherwise("else where").alias("company"))
    return match.contact_matches(p, c, "s_suppkey", "c_custkey", vectorised.name_match)


@query("""WITH c AS (SELECT p_partkey, p_brand, p_size, p_type FROM part), k AS (SELECT *, p_partkey % 24 AS pick FROM c WHERE p_partkey <= 24),
s AS (SELECT *, row_number() OVER (PARTITION BY p_size % 5 ORDER BY pick) AS n FROM k WHERE p_partkey % 4 <> 3)
SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE 'said' END AS title FROM s WHERE n = 1""")
def observed_people_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts stand for cards; every fourth text lacks the company."""
    k = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").filter(k <= 24)
    cards = parts.select(k.alias("id"), (F.col("p_size") % 5).cast("string").alias("url"), F.col("p_name").alias("name"), F.when(k % 2 == 0, F.col("p_type")).otherwise("").alias("title"), F.lit("Group Acme Ltd").alias("company"), F.concat(F.lit("SAID of "), F.upper("p_type"), F.when(k % 4 == 3, " acmex").otherwise(", acme")).alias("text"))
    return match.observed_people(parts.select((k % 24).alias("pick"), k.alias("id"), F.lit("said ").alias("title")), cards, ["group", "ltd"]).select("id", "title")
