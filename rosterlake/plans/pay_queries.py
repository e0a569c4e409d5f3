"""Pay notes and notice periods as grids of their parts, made of orders; the SQL works on the parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cv, pay, sentences
from ..functions.text import bound
from ..operators import typos
from .catalog import query, table


def _pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


#: Parts of a note by its order: number, scale, period, months, allowance, and what is no pay.
_SCALE, _FACTOR = ["", "k", " lakh"], [1, 1000, 100000]
_PERIOD, _DIVISOR = ["", " per annum", "/year", " monthly"], [1, 12, 12, 1]
_MONTHS, _TIMES = ["", " + 13th month", " + AWS", " x 14", " + 2 months guaranteed bonus"], [12, 13, 13, 14, 14]
_MORE, _ADDED = ["", " + RM350 transport allowance", " + 500", ", EPF 1200"], [0, 350, 500, 0]
_PARTS = f"""WITH p AS (SELECT o_orderkey AS k, o_orderkey % 89 + 11 AS n, {_FACTOR}[o_orderkey % 3 + 1] AS f, {_DIVISOR}[o_orderkey // 3 % 4 + 1] AS d, {_TIMES}[o_orderkey // 12 % 5 + 1] AS m, {_ADDED}[o_orderkey // 60 % 4 + 1] AS a FROM orders),
v AS (SELECT *, floor(n * f * 1.0 / d + 0.5)::BIGINT AS base FROM p)"""


def _note() -> Column:
    k = F.col("o_orderkey")
    q = lambda d: F.floor(k / d)
    return F.concat(F.lit("Basic RM"), (k % 89 + 11).cast("string"), _pick(_SCALE, k), _pick(_PERIOD, q(3)), _pick(_MONTHS, q(12)), _pick(_MORE, q(60)))


@query(f"{_PARTS} SELECT k AS o_orderkey, base, m::DOUBLE AS months, a AS allowances, floor(base * m / 12.0 + a + 0.5)::BIGINT AS value FROM v WHERE base > 0")
def pay_fixed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bound(bound(table(spark, sf_dir, "orders").select("o_orderkey"), note=_note()), p=pay.fixed_pay(F.col("note"))).filter("p is not null")
    return rows.select("o_orderkey", F.col("p.base").alias("base"), F.col("p.months").alias("months"), F.col("p.allowances").alias("allowances"), F.col("p.value").alias("value"))


@query(f"""{_PARTS} SELECT k AS o_orderkey, CASE k % 6 WHEN 0 THEN 'fixed' WHEN 1 THEN 'range' WHEN 2 THEN 'same_as_current' WHEN 3 THEN 'percent' WHEN 4 THEN 'open' ELSE 'percent_range' END AS kind,
  CASE k % 6 WHEN 0 THEN n * 1000 WHEN 1 THEN n * 1000 WHEN 2 THEN 5000 WHEN 3 THEN floor(5000 * (100 + n) / 100.0 + 0.5) WHEN 5 THEN floor(5000 * (100 + n) / 100.0 + 0.5) END::BIGINT AS low,
  CASE k % 6 WHEN 0 THEN n * 1000 WHEN 1 THEN (n + 3) * 1000 WHEN 2 THEN 5000 WHEN 3 THEN floor(5000 * (100 + n) / 100.0 + 0.5) WHEN 5 THEN floor(5000 * (105 + n) / 100.0 + 0.5) END::BIGINT AS high,
  CASE k % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'MYR' ELSE 'SGD' END AS currency FROM p""")
def pay_expected_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    n = lambda more: (k % 89 + 11 + more).cast("string")
    said = (
        F.when(k % 6 == 0, F.concat(F.lit("looking for "), n(0), F.lit(",000 or 20%")))
        .when(k % 6 == 1, F.concat(n(0), F.lit("-"), n(3), F.lit("k")))
        .when(k % 6 == 2, "OK with  same as current")
        .when(k % 6 == 3, F.concat(n(0), F.lit(" percent more")))
        .when(k % 6 == 4, "Negotiable")
        .otherwise(F.concat(n(0), F.lit("% to "), n(5), F.lit("%")))
    )
    codes = [("MYR", r"(?<![a-z])rm(?![a-z])"), ("USD", r"(?<![a-z])usd(?![a-z])")]
    found = cv.currencies(F.when(k % 3 == 0, "usd then rm"), codes), cv.currencies(F.lit("rm 5k"), codes)
    code = F.when(k % 3 < 2, pay.chosen_currency(*found, F.lit("sgd"))).otherwise(pay.chosen_currency(found[0], found[0], F.lit(" sgd")))
    e = table(spark, sf_dir, "orders").select("o_orderkey", pay.expected_pay(said, F.lit(5000)).alias("e"), code.alias("currency"))
    return e.select("o_orderkey", F.col("e.type").alias("kind"), F.col("e.low").alias("low"), F.col("e.high").alias("high"), "currency")


@query(f"""{_PARTS} SELECT k AS o_orderkey, CASE WHEN k % 7 = 0 THEN 'base' WHEN k % 5 = 0 AND m <> 15 THEN 'months' WHEN k % 11 = 0 THEN 'additions' END AS against FROM v WHERE base > 0""")
def pay_components_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given components against the note: of every seventh the base is wrong, of every fifth the months, of every eleventh the sum added."""
    k = F.col("o_orderkey")
    rows = bound(bound(table(spark, sf_dir, "orders").select("o_orderkey"), note=_note()), parts=pay.components(F.col("note")))
    rows = bound(rows, p=pay.fixed_pay(parts=F.col("parts"))).filter("p is not null")
    base = F.when(k % 7 == 0, F.col("p.base") + 7).otherwise(F.col("p.base")).cast("double")
    months = F.when(k % 5 == 0, F.lit(15.0)).otherwise(F.col("p.months"))
    added = F.when(k % 11 == 0, F.lit(10_000_001.0)).otherwise(F.col("p.allowances").cast("double"))
    return rows.select("o_orderkey", pay.base_confirmed(base, months, added, None, F.lit(True), F.col("parts")).alias("against"))


_FACTS = ["Worked at Acme Co. Ltd in Ipoh.", "Based in the U.S.", "Skilled in C.", "Reports to Dr. Lim, e.g. weekly.", "Managed payroll of RM 9,000 for 40 staff.", "Improved margin by 5.5%."]
_STATED = ["Expected salary RM 9k.", "Current package: SGD 8,000 per month!", "Last drawn salary MYR 8,500", "Earning $85,000 a year.", "Salary of RM 12,000 monthly."]


@query(f"""SELECT o_orderkey, {_FACTS!r}[o_orderkey % 6 + 1] || CASE WHEN o_orderkey % 3 = 0 THEN '  ' || 'Ends here.' WHEN o_orderkey % 3 = 1 THEN '' ELSE chr(10) || 'Ends here.' END AS kept, CASE o_orderkey % 3 WHEN 1 THEN 1 ELSE 2 END AS removed FROM orders""")
def pay_sentences_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact, one or two statements of pay and mostly an end: what remains is as it was."""
    k = F.col("o_orderkey")
    fact, stated, other = _pick(_FACTS, k), _pick(_STATED, F.floor(k / 6)), _pick(_STATED[:2], F.floor(k / 30))
    gap = F.when(k % 3 == 2, "\n").otherwise("  ")
    text = F.when(k % 3 == 1, F.concat(fact, F.lit(" \n"), stated)).otherwise(F.concat(fact, gap, stated, F.lit("\n"), other, F.lit(" "), F.lit("Ends here.")))
    rows = bound(bound(table(spark, sf_dir, "orders").select("o_orderkey"), said=text), x=sentences.pay_removed(F.col("said")))
    return rows.select("o_orderkey", F.col("x.text").alias("kept"), F.col("x.removed").alias("removed"))


_UNIT = ["month", "monhts", "Wek", "weeks", "daay", "dayz"]


@query(f"""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Immediate' WHEN 1 THEN n || ' ' || u || CASE WHEN n = 1 THEN '' ELSE 's' END WHEN 2 THEN n || ' month' || CASE WHEN n = 1 THEN '' ELSE 's' END WHEN 3 THEN '2024-01-0' || (event_id % 9 + 1) ELSE '2 ' || u || 's' END AS notice
FROM (SELECT event_id, event_id // 5 % 12 + 1 AS n, ['month', 'month', 'week', 'week', 'day', 'day'][event_id // 60 % 6 + 1] AS u FROM events)""")
def notice_corrected_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    n, unit = (F.floor(k / 5) % 12 + 1).cast("string"), _pick(_UNIT, F.floor(k / 60))
    now = _pick(["imediate", "Immidiatley", "IMM", "can start inmediately", "0", "available now", "none"], F.floor(k / 5))
    said = F.when(k % 5 == 0, now).when(k % 5 == 1, F.concat(n, F.lit("  "), unit)).when(k % 5 == 2, n).when(k % 5 == 3, F.concat(F.lit("2024-01-0"), (k % 9 + 1).cast("string"))).otherwise(F.concat(F.lit("Two "), unit))
    return table(spark, sf_dir, "events").select("event_id", typos.notice_corrected(said).alias("notice"))


_TERMS = ("allowance", "permanent", "relocation", "employment", "guaranteed", "citizenship", "nationality", "availability", "communication", "presentability")


@query(f"""SELECT o_orderkey, 'Needs ' || upper(t[1]) || t[2:] || ', ' || CASE WHEN o_orderkey % 4 = 3 THEN 'SALLOWANCE' ELSE t END || ' & salary' AS corrected, CASE WHEN o_orderkey % 4 = 3 THEN 1 ELSE 2 END AS changes
FROM (SELECT o_orderkey, {list(_TERMS)!r}[o_orderkey % 10 + 1] AS t FROM orders)""")
def typo_texts_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms with a letter left out, then with two neighbours swapped; a kept word, though an alias, stays."""
    k, t = F.col("o_orderkey"), _pick(list(_TERMS), F.col("o_orderkey"))
    at = (F.floor(k / 10) % 5 + 2).cast("int")
    without = F.concat(F.upper(F.left(t, F.lit(1))), F.substr(t, F.lit(2), at - 2), F.substr(t, at + 1))
    place = (F.floor(k / 50) % 4 + 2).cast("int")
    swapped = F.concat(F.substr(t, F.lit(1), place - 1), F.substr(t, place + 1, F.lit(1)), F.substr(t, place, F.lit(1)), F.substr(t, place + 2))
    second = F.when(k % 4 == 3, "SALLOWANCE").otherwise(F.when(F.substr(t, place, F.lit(1)) == F.substr(t, place + 1, F.lit(1)), F.concat(F.left(t, F.lit(3)), F.lit("e"), F.substr(t, F.lit(4)))).otherwise(swapped))
    texts = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("Needs "), without, F.lit(", "), second, F.lit(" & salry")).alias("said"))
    terms = spark.createDataFrame([(x, i) for i, x in enumerate(_TERMS)], "term string, rank int")
    out = typos.corrected_texts(texts, "o_orderkey", "said", terms, {"salry": "salary", "sallowance": "allowance"}, ("sallowance",))
    return out.select("o_orderkey", "corrected", (F.size("changes") - 1).alias("changes"))


@query("""WITH w AS (SELECT DISTINCT unnest(string_split(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), ' ')) AS w FROM documents), t AS (SELECT DISTINCT unnest(string_split(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), ' ')) AS t FROM benchmark),
a AS (SELECT w FROM w WHERE len(w) >= 8 AND w NOT IN (SELECT t FROM t)), b AS (SELECT t FROM t WHERE len(t) >= 8)
SELECT w AS word, min(t) AS term FROM a JOIN b ON w[1] = t[1] AND w[-1] = t[-1] AND abs(len(w) - len(t)) <= 1 AND damerau_levenshtein(w, t) = 1 GROUP BY w""")
def typo_words_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of eight letters of the documents within one edit of a word of the benchmark."""
    words = lambda name, c: table(spark, sf_dir, name).select(F.explode(F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z]+", " ")), " ")).alias(c)).distinct()
    long = lambda df, c: df.filter(F.char_length(c) >= 8)
    found = typos.corrections(long(words("documents", "word"), "word"), long(words("benchmark", "term"), "term"), most=1)
    return found.select("word", "term")
