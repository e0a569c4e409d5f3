"""Nested records, made of the columns of a row in several shapes; the SQL answers from the columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import json_records
from ..functions.people import residency_classes
from ..functions.text import bound
from .catalog import query, table

_CODES = ("SG", "SGP", "MY", "MYS")


def _json(*fields: tuple[str, Column]) -> Column:
    return F.to_json(F.struct(*(c.alias(n) for n, c in fields)))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN ['MY', 'SG'] WHEN 1 THEN ['SGP'] ELSE []::VARCHAR[] END AS codes, CASE c_custkey % 3 WHEN 0 THEN 'my | Asia' WHEN 1 THEN 'Sgp' ELSE '' END AS country,
  CASE c_custkey % 3 WHEN 2 THEN '' WHEN 0 THEN 'line ' || c_name ELSE c_name END AS location FROM customer""")
def record_places_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 3
    deep = _json(("person", F.struct(F.lit("sg/xx").alias("Country-Code"), F.array(F.lit("my"), F.lit(" Asia ")).alias("country"), F.struct(F.col("c_name").alias("line")).alias("Address"))))
    flat = _json(("countryName", F.lit("Sgp")), ("city", F.col("c_name")))
    found = json_records.location_identity(F.when(k == 0, deep).when(k == 1, flat).otherwise("no JSON"), _CODES)
    return table(spark, sf_dir, "customer").select("c_custkey", found.alias("x")).select("c_custkey", "x.*")


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority WHEN 1 THEN o_orderpriority || ' | ' || o_orderstatus WHEN 2 THEN 'pr' ELSE '' END AS said,
  CASE WHEN o_orderkey % 4 = 3 THEN 'unknown' WHEN o_orderkey % 4 = 2 OR o_orderpriority = '1-URGENT' THEN 'match' ELSE 'mismatch' END AS urgent_or_pr,
  CASE o_orderkey % 4 WHEN 2 THEN 'match' WHEN 3 THEN 'unknown' ELSE 'mismatch' END AS permanent FROM orders""")
def record_residency_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, p = F.col("o_orderkey") % 4, F.col("o_orderpriority")
    direct = _json(("a", F.struct(p.alias("Visa status"), F.lit("x").alias("name"))))
    labelled = _json(("custom", F.array(F.struct(F.lit("Work rights").alias("fieldName"), F.array(p, F.upper(p), F.col("o_orderstatus")).alias("values")), F.struct(F.lit("Other").alias("fieldName"), F.array(p).alias("values")))))
    said = json_records.residency_text(F.when(k == 0, direct).when(k == 1, labelled).when(k == 2, _json(("residency", F.lit(" pr ")))).otherwise(_json(("name", F.lit("residency")))))
    rows = bound(table(spark, sf_dir, "orders"), said=said)
    rows = bound(rows, own=F.filter(F.split("said", r" \| "), lambda v: v != ""), classes=residency_classes(F.col("said")))
    result = lambda w: json_records.residential_match(F.col("own"), w, F.col("classes"))["result"]
    return rows.select("o_orderkey", "said", F.when(result("permanent resident") == "match", "match").otherwise(result("1-urgent")).alias("urgent_or_pr"), result("Permanent  Resident").alias("permanent"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN [p_name, p_type] ELSE [p_brand, p_name] END AS options, CASE WHEN p_partkey % 2 = 0 THEN [['a' || p_partkey]] ELSE [['7']] END AS ids FROM part""")
def record_options_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, even = F.col("p_name"), F.col("p_partkey") % 2 == 0
    options = F.when(even, _json(("items", F.array(F.struct(name.alias("label")), F.struct(F.upper(name).alias("label")), F.struct(F.col("p_type").alias("label")))))).otherwise(_json(("data", F.array(F.struct(F.struct(F.col("p_brand").alias("text")).alias("value"), F.lit("").alias("name")), F.struct(F.struct(name.alias("text")).alias("value"), F.lit(None).cast("string").alias("name"))))))
    file = F.when(even, F.to_json(F.array(F.struct(F.concat(F.lit("a"), F.col("p_partkey").cast("string")).alias("attachmentId"), F.lit("Formatted Resume.pdf").alias("fileName")), F.struct(F.lit("b").alias("attachmentId"), F.lit("photo.png").alias("fileName"))))).otherwise(F.to_json(F.array(F.struct(F.lit(7).alias("id"), F.lit("My CV").alias("title")))))
    rows = bound(table(spark, sf_dir, "part"), options=options, file=file)
    return rows.select("p_partkey", json_records.option_values(F.col("options")).alias("options"), json_records.resume_files(F.col("file"))["ids"].alias("ids"))


@query("""SELECT event_id, '{"a":{"t":"' || CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'own' END || '","u":' || user_id || '},"l":[1' || CASE WHEN event_id % 3 <> 1 THEN ',' || event_id % 3 ELSE '' END || ']}' AS filled,
  '[{"id":' || user_id || ',"n":"x","v":"' || event_type || '"},{"id":-1}' || CASE WHEN event_id % 2 = 0 THEN ',{"name":"New"}' ELSE '' END || ']' AS united FROM events""")
def records_filled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, user, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    own = F.concat(F.lit('{"l": [1], "a": {"t": "'), F.when(k % 2 == 0, "").otherwise("own"), F.lit('"}}'))
    other = _json(("a", F.struct(kind.alias("t"), user.alias("u"))), ("l", F.array(F.lit(1), (k % 3).cast("int"))))
    left = F.to_json(F.array(F.struct(user.alias("id"), F.lit("x").alias("n")), F.struct(F.lit(-1).cast("long").alias("id"), F.lit(None).cast("string").alias("n"))))
    right = F.concat(F.lit("["), _json(("id", user), ("n", F.lit("y")), ("v", kind)), F.when(k % 2 == 0, ',{"name":"New"},{"name":"new"}').otherwise(""), F.lit("]"))
    merged = json_records.united_json(left, right, ("id",), ("name",))
    return table(spark, sf_dir, "events").select("event_id", json_records.filled_json(own, other).alias("filled"), merged.alias("united"))


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN (o_orderkey % 61)::DOUBLE WHEN 1 THEN round_even((o_orderkey % 700) / 12.0, 2)::DOUBLE WHEN 2 THEN (o_orderkey % 61)::DOUBLE WHEN 3 THEN (o_orderkey % 30 + 0.5)::DOUBLE WHEN 5 THEN 7.0 END AS years FROM orders""")
def record_years_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    n = lambda m: (k % m).cast("string")
    said = (
        F.when(k % 6 == 0, F.concat(n(61), F.lit("+ yrs of overall professional  experience")))
        .when(k % 6 == 1, F.concat(n(700), F.lit(" months AWS exp")))
        .when(k % 6 == 2, F.concat(F.lit("Total experience: "), n(61), F.lit(" years, 90 years experience")))
        .when(k % 6 == 3, F.concat(n(30), F.lit(".5 years hands-on experience and 6 months experience")))
        .otherwise(F.concat(F.lit("lived "), n(61), F.lit(" years in Malaysia")))
    )
    record = _json(("candidate", F.struct(said.alias("profileText"), F.lit("50 years experience").alias("note"))))
    return table(spark, sf_dir, "orders").select("o_orderkey", json_records.visible_years(F.when(k % 6 == 5, 7.0), record).alias("years"))


@query("""WITH t AS (SELECT p_partkey, p_size * 1000 AS a, CASE p_partkey % 3 WHEN 0 THEN 12 WHEN 1 THEN 1 ELSE 0 END AS f FROM part)
SELECT p_partkey, CASE WHEN f = 1 THEN 'SGD ' || format('{:,}', a) || '.5 / Month' WHEN f = 12 THEN format('{:,}', a) || ' / year' END AS current, CASE WHEN f = 1 THEN (a + 0.5)::DOUBLE WHEN f = 12 THEN (a / 12.0)::DOUBLE END AS current_sort,
  CASE WHEN f = 1 THEN 'MYR ' || format('{:,}', a) || ' to ' || format('{:,}', a + 500) ELSE 'MYR ' || format('{:,}', a + 500) END AS expected FROM t""")
def record_pay_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, a = F.col("p_partkey") % 3, F.col("p_size") * 1000
    now = F.when(k == 0, F.struct(F.lit("").alias("currency"), a.cast("double").alias("rate"), F.lit("year").alias("ratePer"))).when(k == 1, F.struct(F.lit("sgd").alias("currency"), (a + 0.5).alias("rate"), F.lit("Month").alias("ratePer")))
    span = F.struct(F.lit("myr").alias("currency"), (a + 500).cast("double").alias("rateLow"), F.when(k == 1, a.cast("double")).alias("rateHigh"))
    none = F.struct(F.lit("usd").alias("currency"), F.lit(None).cast("double").alias("rateLow"), F.lit(None).cast("double").alias("rateHigh"))
    ideal = F.struct(F.when(k == 1, span).otherwise(none).alias("salary"), F.array(F.struct(none.alias("salary")), F.struct(span.alias("salary"))).alias("other"))
    record = _json(("employment", F.struct(F.struct(now.alias("salary")).alias("current"), ideal.alias("ideal"))))
    card = json_records.card_pay(record)
    return table(spark, sf_dir, "part").select("p_partkey", card.alias("x")).select("p_partkey", F.col("x.current.display").alias("current"), F.col("x.current.sort").alias("current_sort"), F.col("x.expected.display").alias("expected"))
