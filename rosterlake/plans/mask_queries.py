"""Masking and claims, over texts and records made of rows; the SQL makes what must come out of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import masking, sentences
from ..operators import claims
from .catalog import query, table


@query("""SELECT doc_id, text || ' Built for [Company]; [Company]-led, Xcustomer#1.' AS summary, ['by [name]', 'then [name] of [Company]', NULL] AS points, '[name]' AS head, NULL AS note
FROM documents JOIN customer ON doc_id = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def masked_records_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its own terms (its customer's name and a person's) in a nested record."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "customer"), F.col("doc_id") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    company, person = F.col("c_name"), F.concat_ws(" ", F.lit("Jo"), F.concat(F.lit("Q"), F.col("doc_id").cast("string")), F.initcap("n_name"))
    own = F.concat(masking.terms(F.array(company), "[Company]"), masking.terms(F.array(person), "[name]", cased=True))
    point = lambda *parts: F.struct(F.concat(*parts).alias("said"), F.lit(1).alias("n"))
    record = F.struct(
        F.concat(F.col("text"), F.lit(" Built for "), F.upper(company), F.lit("; **"), company, F.lit("**-led, Xcustomer#1.")).alias("summary"),
        F.array(point(F.lit("by "), person), point(F.lit("then _"), person, F.lit("_ of "), F.lower(company)), F.struct(F.lit(None).cast("string").alias("said"), F.lit(2).alias("n"))).alias("points"),
        F.create_map(F.lit("head"), person).alias("more"), F.lit(None).cast("string").alias("note"),
    )
    out = masking.mask_columns(rows.select("doc_id", record.alias("r"), own.alias("terms")), "terms", ["r"])
    # a mark of emphasis goes with the term that it stands around
    return out.select("doc_id", "r.summary", F.transform("r.points", lambda p: p["said"]).alias("points"), F.col("r.more")["head"].alias("head"), F.col("r.note").alias("note"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'ring [p], or [p]; made ' || (10000000 + c_custkey) ELSE 'ref ' || (90000000 + c_custkey) END AS phones, CASE c_custkey % 2 WHEN 0 THEN 'run [n] and max_size' ELSE 'run max_size_of' END AS jobs,
  CASE WHEN c_custkey % 4 = 0 THEN []::VARCHAR[] ELSE ['Malay'] END AS languages FROM customer""")
def own_details_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's own number in two spellings, identifiers that hold the name, and languages under a redaction."""
    k, id8 = F.col("c_custkey"), F.lpad((F.col("c_custkey") + 20000000).cast("string"), 8, "0")
    cut = lambda a, n: F.substring(id8, a, n)
    said = F.when(k % 3 == 0, F.concat(F.lit("ring +60 "), cut(1, 2), F.lit("-"), cut(3, 3), F.lit(" "), cut(6, 3), F.lit(", or 0"), id8, F.lit("; made "), (k + 10000000).cast("string"))).otherwise(F.concat(F.lit("ref "), (k + 90000000).cast("string")))
    name = F.transform(F.split("c_name", "#"), lambda p: F.regexp_replace(p, "^0+", "x"))
    jobs = F.when(k % 2 == 0, F.concat(F.lit("run CUSTOMER_"), F.element_at(name, 2), F.lit("_etl and max_size"))).otherwise("run max_size_of")
    note = F.when(k % 4 == 0, "Languages: [REDACTED]").otherwise("Redacted elsewhere" + " ." * 400 + " Language: Malay")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", masking.own_number_masked(said, F.concat(F.lit("+60"), id8), "[p]").alias("phones"), masking.name_identifiers_masked(jobs, name, "[n]").alias("jobs"), sentences.unless_redacted(F.array(F.lit("Malay")), note).alias("languages")
    )


@query("""WITH o AS (SELECT o_custkey AS doc_id, o_orderkey AS k, translate(o_orderkey::VARCHAR, '0123456789', 'abcdefghij') AS n FROM orders)
SELECT doc_id, CASE k % 4 WHEN 0 THEN 'Firm ' || n || ' Sdn Bhd' WHEN 3 THEN 'Gone ' || n ELSE 'Agency ' || n || ' (Client ' || n || ')' END AS name, CASE k % 4 WHEN 0 THEN 'own' WHEN 1 THEN 'bracket' ELSE 'missing' END AS kept FROM o
UNION ALL SELECT doc_id, 'Client ' || n, 'own' FROM o WHERE k % 4 = 2""")
def claimed_employers_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as employers of customers: kept by name, by a bracket, by a bracket that another employer claims, or not."""
    return claims.claimed_employers(*_employers(spark, sf_dir))


def _employers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k, n = F.col("o_orderkey"), F.translate(F.col("o_orderkey").cast("string"), "0123456789", "abcdefghij")  # brackets with digits are no names
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), "o_orderkey")
    firm, client = F.concat(F.lit("Firm "), n, F.lit(" Sdn Bhd")), F.concat(F.lit("Client "), n)
    agency = F.concat(F.lit("Agency "), n, F.lit(" (Client "), n, F.lit(")"))
    source = orders.select("doc_id", F.explode(F.when(k % 4 == 0, F.array(firm, F.concat(firm, F.lit(' .')))).when(k % 4 == 1, F.array(agency)).when(k % 4 == 2, F.array(agency, client)).otherwise(F.array(F.concat(F.lit("Gone "), n)))).alias("employer"))
    parsed = orders.select("doc_id", F.when(k % 4 == 0, F.concat(F.lit("FIRM "), n)).when(k % 4 < 3, F.upper(client)).otherwise(F.lit(" | ")).alias("employer"))
    return source, parsed


@query("""WITH o AS (SELECT o_custkey AS doc_id, o_orderkey AS k, translate(o_orderkey::VARCHAR, '0123456789', 'abcdefghij') AS n FROM orders), e AS (SELECT doc_id, count(*) + count(*) FILTER (k % 4 = 2) AS source_employers, count(*) FILTER (k % 4 < 3) AS parsed_employers, count(*) FILTER (k % 4 = 3) AS unnamed,
  list_sort(list(CASE WHEN k % 4 = 3 THEN 'Gone ' || n ELSE 'Agency ' || n || ' (Client ' || n || ')' END) FILTER (k % 4 >= 2)) AS missing, count(*) AS source_bullets, count(*) FILTER (k % 2 = 0) AS parsed_bullets FROM o GROUP BY doc_id)
SELECT doc_id, source_employers, parsed_employers, coalesce(missing, []::VARCHAR[]) AS missing, unnamed, source_bullets, parsed_bullets, source_bullets >= 8 AND parsed_bullets < source_bullets * 0.6 AS shortfall,
  coalesce(len(missing), 0) = 0 AND unnamed = 0 AND NOT (source_bullets >= 8 AND parsed_bullets < source_bullets * 0.6) AS ok FROM e""")
def fidelity_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, parsed = _employers(spark, sf_dir)
    roles = F.collect_list(F.struct(F.array(F.struct(F.array(F.lit("did"), F.lit(" ")).alias("bullets"))).alias("roles")))
    even = F.collect_list(F.when(F.col("o_orderkey") % 2 == 0, F.struct(F.array(F.struct(F.array(F.lit("did"), F.lit(" "), F.lit(None)).alias("bullets"))).alias("roles"))))
    bullets = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(claims.nested_bullets(roles).alias("source_bullets"), claims.nested_bullets(even).alias("parsed_bullets"))
    return claims.fidelity(source, parsed, bullets)
