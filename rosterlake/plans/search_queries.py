"""Boolean search, coverage and fit over documents and other text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boolquery, text
from ..operators import score
from .catalog import query, table


def has(term: str, column: str = "text") -> str:
    """SQL for a term at word boundaries."""
    return f"regexp_matches(regexp_replace({column}, '\\s+', ' ', 'g'), '(^|[^\\p{{L}}\\p{{N}}_]){term}($|[^\\p{{L}}\\p{{N}}_])', 'i')"


@query(f"SELECT doc_id, {has('the')} AND {has('of')} AND NOT {has('die')} AS matched, ({has('the')})::INT + ({has('of')})::INT + ({has('die')})::INT AS n_hits FROM documents")
def bool_search_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = boolquery.compile_rule(F.col("text"), 'the AND "of" AND NOT die')
    return table(spark, sf_dir, "documents").select("doc_id", c.matched.alias("matched"), F.size(c.hits).alias("n_hits"))


@query(f"SELECT doc_id FROM documents WHERE NOT {has('der')} AND ({has('that')} OR {has('les')})")
def bool_not_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = boolquery.search(F.col("text"), "(that OR les) AND NOT der")
    return table(spark, sf_dir, "documents").filter(c.matched).select("doc_id")


@query(f"SELECT doc_id, {has('with')} OR {has('les')} OR {has('para')} AS matched, list_filter([CASE WHEN {has('with')} THEN 'with' END, CASE WHEN {has('les')} THEN 'les' END, CASE WHEN {has('para')} THEN 'para' END], lambda x: x IS NOT NULL) AS hits FROM documents")
def implied_or_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = boolquery.compile_rule(F.col("text"), "with les; para")
    return table(spark, sf_dir, "documents").select("doc_id", c.matched.alias("matched"), c.hits.alias("hits"))


@query(f"SELECT doc_id, {has('the')} AND {has('with')} AND {has('by')} AS all_terms, list_filter([CASE WHEN NOT {has('the')} THEN 'the' END, CASE WHEN NOT {has('with')} THEN 'with' END, CASE WHEN NOT {has('by')} THEN 'by' END], lambda x: x IS NOT NULL) AS missing FROM documents")
def strict_keyword_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = boolquery.search(F.col("text"), "the, with, by", strict=True)
    return table(spark, sf_dir, "documents").select("doc_id", c.matched.alias("all_terms"), c.missing.alias("missing"))


@query(f"SELECT doc_id, true AS matched FROM documents WHERE {has('the')} OR true")
def proven_term_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = boolquery.compile_rule(F.col("text"), "the OR sap", proven=["SAP"])
    return table(spark, sf_dir, "documents").select("doc_id", c.matched.alias("matched")).filter("matched")


@query(f"""SELECT doc_id, CASE WHEN {has('of the')} THEN 1.0 WHEN {has('of')} AND {has('the')} THEN 0.75 ELSE 0.0 END::DOUBLE AS two_words,
  CASE WHEN {has('that with from by')} THEN 1.0 WHEN c >= 2 AND c >= 2 THEN c / 4.0 ELSE 0.0 END::DOUBLE AS four_words
  FROM (SELECT *, ({has('that')})::INT + ({has('with')})::INT + ({has('from')})::INT + ({has('by')})::INT AS c FROM documents)""")
def term_coverage_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", score.term_coverage(t, "of the").alias("two_words"), score.term_coverage(t, "that with from by").alias("four_words"))


@query(f"""SELECT doc_id, round_even(100 * (55 * jd + 25 * must + 10 * role + 10 * nice) / 100.0, 0)::INT AS fit FROM (
  SELECT doc_id, (2.0 * CASE WHEN {has('of the')} THEN 1.0 WHEN {has('of')} AND {has('the')} THEN 0.75 ELSE 0 END + ({has('that')})::INT) / 3.0 AS jd,
    greatest(({has('with')})::INT / 1.0, CASE WHEN source = 'src1' THEN 0.6 ELSE 0 END) AS must, ({has('by')})::INT AS role, (1.6 * ({has('IT')})::INT + ({has('les')})::INT) / 2.6 AS nice FROM documents)""")
def weighted_fit_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = score.fit_percent(F.col("text"), jd=["of the", "that"], must=["with"], role=["by"], nice=["IT", "les"], confirmed=F.col("source") == "src1")
    return table(spark, sf_dir, "documents").select("doc_id", fit.alias("fit"))


@query(f"""SELECT doc_id, reason, CASE WHEN reason IS NULL THEN s END AS score FROM (SELECT doc_id, s, CASE WHEN lang <> 'en' THEN 'language' WHEN n_chars < 500 THEN 'too short' WHEN s < 10 THEN 'score below minimum' END AS reason
  FROM (SELECT *, round_even(100 * (50 * ({has('with')})::INT + 30 * ({has('that')})::INT) / 80.0, 0)::INT AS s FROM documents))""")
def gated_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    fit = score.fit_percent(F.col("text"), must=["with"], role=["that"])
    return score.scored(rows, "text", [("language", F.col("lang") == "en"), ("too short", F.col("n_chars") >= 500)], fit).select("doc_id", "reason", "score")


@query(f"""SELECT doc_id, list_filter([CASE WHEN {has('the')} THEN 'the' END, CASE WHEN {has('una')} THEN 'una' END, CASE WHEN {has('und')} THEN 'und' END], lambda x: x IS NOT NULL) AS hits,
  {has('the')} OR {has('una')} OR {has('und')} AS any_hit FROM documents""")
def hit_terms_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = ["the", "una", "und"]
    return table(spark, sf_dir, "documents").select("doc_id", text.hit_terms(F.col("text"), terms).alias("hits"), text.has_any(F.col("text"), terms).alias("any_hit"))


@query("""SELECT p_partkey, regexp_matches(lower(p_type), '(^|[^a-z0-9])tin([^a-z0-9]|$)') AS short_alias, contains(lower(p_type), 'plat') AS long_alias FROM part""")
def alias_tokens_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.token_or_substring(F.col("p_type"), "tin").alias("short_alias"), text.token_or_substring(F.col("p_type"), "plat").alias("long_alias"))


@query("""SELECT doc_id, n::INT AS line, t AS text, s AS section FROM (
  SELECT doc_id, n, t, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n), 'core') AS s FROM (
    SELECT doc_id, n, trim(regexp_replace(l, '\\s+', ' ', 'g')) AS t,
      CASE lower(regexp_replace(trim(regexp_replace(l, '\\s+', ' ', 'g')), ':$', '')) WHEN 'is.' THEN 'nice' WHEN 'the.' THEN 'nice' WHEN 'of.' THEN 'noise' WHEN 'be.' THEN 'core' END AS h
    FROM (SELECT doc_id, generate_subscripts(a, 1) AS n, unnest(a) AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)))) WHERE t <> ''""")
def section_lines_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.sections(table(spark, sf_dir, "documents"), "doc_id", "text", {"is.": "nice", "the.": "nice", "of.": "noise", "be.": "core"})


@query("""SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '' AND x NOT IN ('the', 'of', 'and'))) AS x FROM documents""".replace("list_distinct(", "list_sort(list_distinct(").replace(") AS x", ")) AS x"))
def token_sets_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_sort(text.tokens(F.col("text"), ["the", "of", "and"])).alias("x"))


@query("""SELECT c_custkey, CASE WHEN levenshtein(c_mktsegment, 'MACHINERY') <= 3 THEN levenshtein(c_mktsegment, 'MACHINERY') ELSE 4 END::INT AS d FROM customer""")
def bounded_edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", text.edit_distance_within(F.col("c_mktsegment"), F.lit("MACHINERY"), 3).alias("d"))
