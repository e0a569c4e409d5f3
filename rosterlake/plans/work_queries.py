"""Work histories: texts in several layouts, made of orders and set behind documents; the SQL answers from the orders."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import narrow
from ..functions.dates import MONTHS
from ..operators import anchors, rank, work_history
from .catalog import query, table

_NAMES = ", ".join(f"'{m.title()}'" for m in MONTHS)
#: The parts of a job, from an order.
_JOBS = f"""WITH j AS (SELECT o_custkey AS doc_id, o_orderkey, ['Senior Analyst', 'Site Engineer', 'Area Manager'][o_orderkey % 3 + 1] AS title, 'Firm ' || o_orderkey || ' Sdn Bhd' AS employer,
  [{_NAMES}][o_orderkey % 12 + 1] || ' ' || (1980 + o_orderkey % 30) AS start, CASE WHEN o_orderkey % 7 = 0 THEN 'Present' ELSE [{_NAMES}][o_orderkey % 11 + 1] || ' ' || (1981 + o_orderkey % 30) END AS stop FROM orders)"""


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    months = [m.title() for m in MONTHS]
    year = lambda first: (k % 30 + first).cast("string")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc_id"), k,
        pick(["Senior Analyst", "Site Engineer", "Area Manager"], k % 3).alias("title"), F.concat(F.lit("Firm "), k.cast("string")).alias("name"),
        F.concat_ws(" ", pick(months, k % 12), year(1980)).alias("start"), F.when(k % 7 == 0, "Present").otherwise(F.concat_ws(" ", pick(months, k % 11), year(1981))).alias("stop"),
    )


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): a document, if there is one, then the jobs of a customer in one of six layouts, then schools."""
    employer = F.concat("name", F.lit(" Sdn Bhd"))
    span = F.concat("start", F.lit(" - "), "stop")
    joined = lambda sign, *cells: F.concat_ws(sign, *cells)
    layouts: list[Column] = [
        F.concat(F.lit("Company | Position | Period\n"), joined(" | ", employer, F.col("title"), span)),
        joined(" | ", span, employer, F.col("title")),
        joined("\t", F.col("title"), employer, span),
        F.concat("title", F.lit("\n"), employer, F.lit(" | "), span),
        F.concat(F.rpad(span, 24, " "), F.rpad("name", 20, " "), "title", F.lit("\n"), F.lpad(F.lit("Sdn Bhd"), 31, " ")),
        joined(" ", span, employer, F.col("title")),
    ]
    line = layouts[0]
    for k, layout in enumerate(layouts[1:], 1):
        line = F.when(F.col("doc_id") % len(layouts) == k, layout).otherwise(line)
    by = _jobs(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", line.alias("line")))), lambda x: x["line"]), "\n").alias("jobs"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    whole = F.concat_ws("\n", "text", F.lit("WORK EXPERIENCE"), "jobs", F.lit("E D U C A T I O N ___"), F.lit("Jan 2001 - May 2004 | Some University | Analyst"))
    return by.join(docs, "doc_id", "left").select("doc_id", whole.alias("text"))


@query(f"{_JOBS} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o_orderkey) AS ordinal, title, employer, start, stop, 1 AS times FROM j")
def work_rows_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return work_history.work_rows(_texts(spark, sf_dir)).drop("line")


@query(
    f"""{_JOBS}, d AS (SELECT *, count(*) OVER (PARTITION BY doc_id, title, CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE employer END) AS same FROM j)
SELECT doc_id, o_orderkey, CASE WHEN o_orderkey % 5 <> 0 AND strptime(start, '%b %Y') <= coalesce(try_strptime(stop, '%b %Y'), DATE '2024-01-01') THEN start || ' to ' || stop ELSE '1990 to 1991' END AS restored FROM d"""
)
def work_dates_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as parsed, with other dates; those of every fifth name no employer of the source."""
    items = _jobs(spark, sf_dir).select("doc_id", "o_orderkey", F.upper("title").alias("title"), F.when(F.col("o_orderkey") % 5 == 0, "Elsewhere").otherwise(F.concat("name", F.lit(", Sdn. Bhd."))).alias("employer"), F.lit("1990 to 1991").alias("dates"))
    rows = work_history.work_rows(_texts(spark, sf_dir))
    return work_history.dates_restored(items, rows, date(2024, 1, 1)).select("doc_id", "o_orderkey", "restored")


@query("""SELECT p_partkey // 5 AS doc_id, p_partkey % 5 + 1 AS ordinal, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS client, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS role,
  CASE WHEN p_partkey % 2 = 0 THEN ['Built ' || p_size, 'Sold it'] ELSE ['Built ' || p_size] END AS bullets FROM part""")
def project_blocks_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    block = F.concat_ws(
        "\n",
        F.concat(F.when(k % 2 == 0, "Project Name: ").otherwise("Project 2 - "), F.col("p_name")), F.when(k % 2 == 0, F.concat(F.lit("Client: "), F.col("p_brand"))), F.when(k % 3 == 0, F.concat(F.lit("ROLE – "), F.col("p_type"))),
        F.concat(F.lit("• Built "), F.col("p_size").cast("string")), F.when(k % 2 == 0, "1. Sold it"),
    )
    by = table(spark, sf_dir, "part").groupBy(F.floor(k / 5).alias("doc_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", block.alias("said")))), lambda x: x["said"]), "\n\n").alias("blocks"))
    texts = by.select("doc_id", F.concat(F.lit("Project: none\nKEY PROJECTS\nlead text\n"), "blocks", F.lit("\nSKILLS\nProject: none")).alias("text"))
    return work_history.project_blocks(texts).select("doc_id", "ordinal", "name", F.col("fields")["client"].alias("client"), F.col("fields")["role"].alias("role"), "bullets")


@query("""SELECT o_custkey AS doc_id, o_orderkey, CASE WHEN o_orderkey % 3 = 1 THEN 'given' WHEN o_orderkey % 5 = 0 THEN '' ELSE 'Award ' || o_orderkey END AS award FROM orders""")
def awards_restored_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a block for each order: blank awards come from the region of their own heading; of every fifth the heading stands twice."""
    k, n = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    name = F.concat(F.lit("Firm "), F.translate(n, "0123456789", "abcdefghij"))
    block = F.concat(F.upper(name), F.lit(" — Jan 2001 to Present\n- duty\n• AWARD: Award "), n, F.when(k % 5 == 0, F.concat(F.lit("\n"), name, F.lit(", Sdn. Bhd."))).otherwise(""))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), k, name.alias("name"), block.alias("block"))
    by = orders.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "block"))), lambda x: x["block"]), "\n").alias("blocks"))
    docs = by.join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "left").select("doc_id", F.concat_ws("\n", "text", F.lit("Award: of nobody"), "blocks").alias("text"))
    items = orders.select("doc_id", "o_orderkey", "name", F.when(k % 3 == 1, "given").otherwise(" ").alias("award"))
    out = anchors.restored_from_regions(docs, items, "award", "award")
    return out.select("doc_id", "o_orderkey", F.trim("award").alias("award"))


_PLACE = ("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_extendedprice")  # line numbers repeat in these tables


@query(f"""WITH t AS (SELECT *, l_suppkey % 3 AS line, l_quantity::BIGINT AS priority, row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 3 ORDER BY l_quantity::BIGINT DESC, {", ".join(_PLACE)}) > 1 AS later FROM lineitem),
g AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY later, priority DESC, {", ".join(_PLACE)}) AS k FROM t),
m AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY later, priority DESC, {", ".join(_PLACE)}) AS nth FROM g WHERE k <= CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 100 END)
SELECT l_orderkey, l_linenumber, nth FROM m WHERE nth <= 3""")
def quota_terms_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as terms of a text: the best of each supplier class first, one of flag A and two of N at most."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 3).alias("line"), F.col("l_quantity").cast("long").alias("priority"), "l_returnflag", F.struct(*_PLACE).alias("place"))
    return rank.filled_under_quotas(rows, ["l_orderkey"], "line", "priority", "place", "l_returnflag", {"A": 1, "N": 2}, 3).select("l_orderkey", "l_linenumber", "nth")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '(' || b || ' OR sql) AND (' || t || ' OR tableau)' WHEN 1 THEN b || ' OR sql OR ' || t || ' OR x' WHEN 2 THEN '("' || b || ' OR c" OR d) AND e AND ' || t END AS narrowed FROM (SELECT p_partkey, replace(p_brand, '#', '') AS b, p_type AS t FROM part)""")
def searches_narrowed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, b, t = F.col("p_partkey") % 4, F.regexp_replace("p_brand", "#", ""), F.col("p_type")
    said = (
        F.when(k == 0, F.concat(F.lit("(("), b, F.lit(" OR sql OR SQL OR dba) AND ("), t, F.lit(" OR tableau OR bi))")))
        .when(k == 1, F.concat(b, F.lit(" OR sql OR "), t, F.lit(" OR x OR y")))
        .when(k == 2, F.concat(F.lit('("'), b, F.lit(' OR c" OR d OR f) AND e AND '), t))
        .otherwise(F.concat(b, F.lit(" AND (a OR (b AND c)) AND NOT "), t))
    )
    return table(spark, sf_dir, "part").select("p_partkey", narrow.narrowed(said).alias("narrowed"))
