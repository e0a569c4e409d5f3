"""Brackets, scenarios, exchange rates and costs over orders, customers and events."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, money
from ..functions.text import bound
from ..operators import costs
from .catalog import query, table

BRACKETS = money.brackets([(0, 5000, "0"), (5000, 20000, "0.01"), (20000, 50000, "0.06"), (50000, 100000, "0.11"), (100000, None, "0.21")])
_TAX = "CAST(0 AS DECIMAL(38,10)) + " + " + ".join(f"greatest(least({{x}}, {u if u is not None else '1000000000000'}) - {l}, 0)::DECIMAL(24,6) * {r}::DECIMAL(8,6)" for l, u, r in BRACKETS)
_RATE = "CASE WHEN {x} <= 0 THEN 0.0 " + " ".join(f"WHEN {{x}} > {l} AND {{x}} <= {u if u is not None else '1000000000000'} THEN {r}" for l, u, r in BRACKETS if r) + " ELSE 0.0 END::DOUBLE"


def cents(x: str) -> str:
    return f"round(({x})::DECIMAL(38,12), 2)::DOUBLE"


@query(f"SELECT o_orderkey, {cents(_TAX.format(x='o_totalprice::DECIMAL(28,6)'))} AS tax FROM orders")
def progressive_tax_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", money.money(money.progressive_tax(F.col("o_totalprice").cast("decimal(28,6)"), BRACKETS)).cast("double").alias("tax"))


@query(f"SELECT o_orderkey, {_RATE.format(x='o_totalprice::DECIMAL(28,6)')} AS rate FROM orders")
def marginal_rate_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", money.marginal_rate(F.col("o_totalprice"), BRACKETS).cast("double").alias("rate"))


@query(f"""WITH b AS (SELECT c_custkey, greatest(round(c_acctbal::DECIMAL(18,2), 2), 0)::DECIMAL(18,2) AS m FROM customer),
g AS (SELECT c_custkey, m, m * 12 AS base, m * 1 AS guaranteed, m * 12 * 0.1 AS variable FROM b),
t AS (SELECT *, (base + guaranteed + variable)::DECIMAL(28,6) AS gross, (base + guaranteed)::DECIMAL(28,6) AS lean FROM g),
x AS (SELECT *, greatest(gross - 9000 - gross * 0.11, 0)::DECIMAL(28,6) AS taxable, greatest(lean - 9000 - lean * 0.11, 0)::DECIMAL(28,6) AS taxable2 FROM t)
SELECT c_custkey, {cents('gross')} AS gross_annual_cash, ((2 * (m * 100)::BIGINT * 13 + 12) // 24) / 100.0::DOUBLE AS gross_monthly_cash, {cents('gross * 0.11')} AS employee_contribution,
  {cents(_TAX.format(x='taxable'))} AS estimated_income_tax, {cents('gross - gross * 0.11 - (' + _TAX.format(x='taxable') + ')')} AS net_annual_cash,
  {cents('lean - lean * 0.11 - (' + _TAX.format(x='taxable2') + ')')} AS net_annual_cash_ex_variable, {cents('gross * 1.12')} AS total_employer_cost FROM x""")
def scenario_net_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.greatest(F.round(F.col("c_acctbal").cast("decimal(18,2)"), 2), F.lit(0).cast("decimal(18,2)"))
    s = money.scenario(base, table=BRACKETS, guaranteed_months=1, variable_share="0.1", relief=9000, employee_rate="0.11", employer_rate="0.12", deductible=True)
    names = ("gross_annual_cash", "gross_monthly_cash", "employee_contribution", "estimated_income_tax", "net_annual_cash", "net_annual_cash_ex_variable", "total_employer_cost")
    return table(spark, sf_dir, "customer").select("c_custkey", *(s[n].cast("double").alias(n) for n in names))


@query("""SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 4.5 WHEN 2 THEN 1.0 / 1.25 END::DOUBLE AS rate FROM nation""")
def fx_reciprocal(spark: SparkSession, sf_dir: str) -> DataFrame:
    quote = F.element_at(F.array(F.lit("USD"), F.lit("MYR"), F.lit("GBP"), F.lit("XXX")), (F.col("n_nationkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "nation").select("n_nationkey", money.fx_rate(F.lit("USD"), quote, {("USD", "MYR"): 4.5, ("GBP", "USD"): 1.25}).alias("rate"))


@query("""SELECT p_partkey, CASE WHEN p_size = 13 THEN 'unknown' WHEN p_retailprice * 1.2 < 1100 THEN 'mismatch' WHEN p_retailprice > 1500 THEN 'mismatch' ELSE 'match' END AS state FROM part""")
def salary_overlap_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.when(F.col("p_size") != 13, F.col("p_retailprice"))
    return table(spark, sf_dir, "part").select("p_partkey", money.salary_match(low, low * 1.2, 1100, 1500).alias("state"))


@query("""SELECT p_partkey, least(a, b) * f AS low, greatest(a, b) * f AS high FROM (SELECT p_partkey, p_retailprice AS a, p_retailprice + p_size AS b,
  CASE p_size % 5 WHEN 0 THEN 173.333 WHEN 1 THEN 21.666 WHEN 2 THEN 4.333 WHEN 3 THEN 1.0 ELSE 1.0::DOUBLE / 12 END::DOUBLE AS f FROM part)""")
def monthly_pay_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.element_at(F.array(*map(F.lit, ("hour", "day", "week", "month", "year"))), (F.col("p_size") % 5 + 1).cast("int"))
    low, high = money.monthly_range(F.col("p_retailprice"), F.col("p_retailprice") + F.col("p_size"), unit)
    return table(spark, sf_dir, "part").select("p_partkey", low.alias("low"), high.alias("high"))


@query("""SELECT c_custkey, CASE WHEN regexp_full_match(t, '\\d{1,3}(,\\d{3})+(\\.\\d*)?|\\d+(\\.\\d*)?|\\.\\d+') THEN replace(t, ',', '')::DOUBLE END AS bound
  FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_acctbal::DECIMAL(12,2)::VARCHAR WHEN 1 THEN '1,' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') || '.5' WHEN 2 THEN c_name ELSE '.75' END AS t FROM customer)""")
def salary_bound_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    t = F.when(key % 4 == 0, F.col("c_acctbal").cast("decimal(12,2)").cast("string")).when(key % 4 == 1, F.concat(F.lit("1,"), F.lpad((key % 1000).cast("string"), 3, "0"), F.lit(".5"))).when(key % 4 == 2, F.col("c_name")).otherwise(".75")
    return table(spark, sf_dir, "customer").select("c_custkey", money.salary_bound(t).alias("bound"))


_EVENT_USAGE = """SELECT event_id, user_id, CASE user_id % 3 WHEN 0 THEN 'm1' WHEN 1 THEN 'm2' ELSE 'mx' END AS model, CASE WHEN user_id % 7 = 0 THEN 'q' ELSE 'p' END AS provider,
  (event_id % 5000)::BIGINT AS input_tokens, (event_id % 700)::BIGINT AS cached_tokens, (event_id % 900)::BIGINT AS output_tokens FROM events"""
_COST = """WITH u AS (""" + _EVENT_USAGE + """), c AS (SELECT *, CASE WHEN provider = 'q' THEN 'none' WHEN model = 'mx' THEN 'group' ELSE 'exact' END AS price_source,
  CASE WHEN provider = 'q' THEN NULL WHEN model = 'm1' THEN 3.0 WHEN model = 'm2' THEN 1.0 ELSE 2.5 END AS i, CASE WHEN provider = 'q' THEN NULL WHEN model = 'm1' THEN 0.3 WHEN model = 'm2' THEN 0.1 ELSE 0.25 END AS h,
  CASE WHEN provider = 'q' THEN NULL WHEN model = 'm1' THEN 15.0 WHEN model = 'm2' THEN 5.0 ELSE 10.0 END AS o FROM u),
x AS (SELECT *, (((greatest(input_tokens - cached_tokens, 0) * (i * 100)::BIGINT + cached_tokens * (h * 100)::BIGINT + output_tokens * (o * 100)::BIGINT) * 2 + 100) // 200)::DECIMAL(24,6) * 0.000001 AS cost FROM c)"""


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    usage = e.select("event_id", "user_id", F.when(F.col("user_id") % 3 == 0, "m1").when(F.col("user_id") % 3 == 1, "m2").otherwise("mx").alias("model"), F.when(F.col("user_id") % 7 == 0, "q").otherwise("p").alias("provider"), (F.col("event_id") % 5000).alias("input_tokens"), (F.col("event_id") % 700).alias("cached_tokens"), (F.col("event_id") % 900).alias("output_tokens"))
    prices = spark.createDataFrame([("m1", "p", 3.0, 0.3, 15.0), ("m2", "p", 1.0, 0.1, 5.0), (None, "p", 2.5, 0.25, 10.0)], "model string, provider string, in_rate double, cached_rate double, out_rate double")
    return costs.estimate(usage, prices)


@query(_COST + """ SELECT model, provider, count(*) AS n, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, CASE WHEN count(*) = count(cost) THEN sum(cost) END::DOUBLE AS cost,
  CASE max(CASE price_source WHEN 'exact' THEN 0 WHEN 'group' THEN 1 ELSE 3 END) WHEN 0 THEN 'exact' WHEN 1 THEN 'estimated' ELSE 'unavailable' END AS status FROM x GROUP BY model, provider""")
def usage_cost_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return costs.rollup(_usage(spark, sf_dir), ["model", "provider"]).withColumn("cost", F.col("cost").cast("double"))


@query(_COST + " SELECT event_id, price_source, cost::DOUBLE AS cost FROM x")
def usage_cost_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _usage(spark, sf_dir).select("event_id", "price_source", F.col("cost").cast("double").alias("cost"))


@query("""SELECT event_type, CASE WHEN count(DISTINCT c) = 1 THEN sum(value) END AS billed, CASE WHEN count(DISTINCT c) = 1 THEN min(c) END AS currency, CASE WHEN count(DISTINCT c) = 1 THEN 'reconciled' ELSE 'mixed_currency' END AS status FROM (
  SELECT event_type, value::DECIMAL(18,4)::DOUBLE AS value, CASE WHEN event_type = 'click' AND user_id % 2 = 0 THEN 'EUR' ELSE 'USD' END AS c FROM events) GROUP BY event_type""".replace("sum(value)", "round(sum(value::DECIMAL(18,4))::DOUBLE, 4)"))
def billing_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", F.col("value").cast("decimal(18,4)").alias("billed"), F.col("value").alias("estimated"), F.when((F.col("event_type") == "click") & (F.col("user_id") % 2 == 0), "EUR").otherwise("USD").alias("currency"))
    return costs.reconcile(e, ["event_type"]).select("event_type", F.round("billed", 4).alias("billed"), "currency", "status")


@query("""SELECT o_orderkey, d AS days_open, CASE WHEN d <= 0 THEN 'Today' WHEN d <= 7 THEN d || ' day(s) open' WHEN d <= 14 THEN '8-14 days open' WHEN d <= 30 THEN '15-30 days open' ELSE '30+ days open' END AS freshness
  FROM (SELECT o_orderkey, greatest(0, date_diff('day', o_orderdate::DATE, DATE '1998-08-02'))::INT AS d FROM orders)""")
def posted_days_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = date(1998, 8, 2)
    days = F.greatest(F.lit(0), F.datediff(F.lit(as_of), F.col("o_orderdate").cast("date")))
    return table(spark, sf_dir, "orders").select("o_orderkey", days.alias("days_open"), dates.freshness(days).alias("freshness"))


@query("""SELECT event_id, strftime(ts::DATE, '%Y-%m-%d') AS posted, date_diff('day', ts::DATE, DATE '2024-02-01')::INT AS days_open FROM events""")
def posted_date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = date(2024, 2, 1)
    day = F.col("ts").cast("date")
    text = F.when(F.col("event_id") % 3 == 0, F.date_format(day, "yyyy-MM-dd")).when(F.col("event_id") % 3 == 1, F.date_format(day, "dd/MM/yyyy")).otherwise(F.concat(F.datediff(F.lit(as_of), day).cast("string"), F.lit(" days ago")))
    rows = bound(table(spark, sf_dir, "events").select("event_id", "ts"), said=text)
    rows = bound(rows, x=dates.posted(F.col("said"), as_of))
    return rows.select("event_id", F.col("x.posted").alias("posted"), F.col("x.days").alias("days_open"))


@query("""SELECT o_orderkey, (year(o_orderdate) * 12 + month(o_orderdate) - 1)::INT AS a, (year(o_orderdate) * 12 + month(o_orderdate) - 1)::INT AS b FROM orders""")
def employment_month_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = date(2024, 2, 1)
    forms = (F.date_format("o_orderdate", "yyyy-MM"), F.date_format("o_orderdate", "yyyy/MM"))
    return table(spark, sf_dir, "orders").select("o_orderkey", *(dates.month_index(t, as_of).alias(n) for n, t in zip(("a", "b"), forms, strict=True)))
