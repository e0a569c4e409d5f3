"""Claims between two lists: which employers of a source a parsed record kept, and under what name.

A bracketed reading (a brand, or the client of an agency) is weaker than a name
of one's own: it may only stand for a parsed employer that no source employer
claims by its own name. Names meet by their keys and tokens inside a document;
the order of rows decides nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.cv import SAME_EMPLOYER
from ..functions.text import LEGAL_FORMS, bound, company_name, match_key, token_overlap, tokens

_BRACKET = r"^([^()]+?)\s*\(([^()0-9]*\p{L}[^()0-9]*)\)\s*$"
#: A parsed name that is only a sign between cells.
SEPARATOR_ONLY = r"^[\s|｜│¦:：]+$"
#: Least bullets of a source, and the share of them that must be kept, for a shortfall to be told.
LEAST_BULLETS, KEPT_BULLETS = 8, 0.6


def _readings(name: Column) -> Column:
    """array<struct<said, own>>: the whole name and the part before a bracket, and what stands in the bracket."""
    split = F.array(
        F.struct(name.alias("said"), F.lit(True).alias("own")),
        F.struct(F.regexp_extract(name, _BRACKET, 1).alias("said"), F.lit(True).alias("own")),
        F.struct(F.regexp_extract(name, _BRACKET, 2).alias("said"), F.lit(False).alias("own")),
    )
    return F.when(name.rlike(_BRACKET), split).otherwise(F.slice(split, 1, 1))


def _key(name: Column) -> Column:
    """The key without legal forms."""
    return match_key(company_name(name))


def _match(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """names_match of (key, key without legal forms, tokens) on both sides."""
    equal = lambda i: (a[i] != "") & (a[i] == b[i])
    return equal(0) | equal(1) | (token_overlap(a[2], b[2]) >= SAME_EMPLOYER)


def names_match(a: Column, b: Column) -> Column:
    """Equal keys, with or without legal forms, or at least SAME_EMPLOYER of the tokens shared (legal forms aside)."""
    parts = lambda c: (match_key(c), _key(c), tokens(c, LEGAL_FORMS))
    return _match(parts(a), parts(b))


def _blocked(rows: DataFrame, name_col: str, prefix: str) -> DataFrame:
    """rows with what names are compared by, worked out once, and a row for each block: two names that match have a key or a token in common."""
    full, bare, words = (f"{prefix}{c}" for c in ("full", "bare", "words"))
    own = bound(rows, **{full: match_key(F.col(name_col)), bare: _key(F.col(name_col)), words: tokens(F.col(name_col), LEGAL_FORMS)})
    keys = F.transform(F.filter(F.array_distinct(F.array(full, bare)), lambda k: k != ""), lambda k: F.concat(F.lit("="), k))
    return own.drop(name_col).withColumn(f"{prefix}block", F.explode(F.concat(keys, F.col(words))))


def _distinct(rows: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """One row for each document and key; names without letters or digits name nothing."""
    named = rows.select(F.col(id_col).alias("id"), F.trim(F.coalesce(F.col(name_col), F.lit(""))).alias("name")).withColumn("key", match_key(F.col("name"))).filter("key <> ''")
    return named.groupBy("id", "key").agg(F.min("name").alias("name"))


def claimed_employers(source: DataFrame, parsed: DataFrame, id_col: str = "doc_id", name_col: str = "employer") -> DataFrame:
    """(id, name, kept): the distinct employers of the source, and whether the parsed ones hold each (`own`, `bracket` or `missing`).

    Both are rows (id, employer); rows of null id are of one document that has
    none. Of several spellings of one key the least stands for all.
    """
    ours, theirs = _distinct(source, id_col, name_col), _distinct(parsed, id_col, name_col)
    read = _blocked(ours.select("id", "key", F.inline(_readings(F.col("name")))), "said", "a_")
    found = _blocked(theirs.select(F.col("id").alias("pid"), F.col("key").alias("pkey"), "name"), "name", "b_")
    parts = lambda p: [F.col(p + c) for c in ("full", "bare", "words")]
    # both sides grow from what Spark knows the size of: a broadcast of either could be of any size
    pairs = read.join(found.hint("merge"), F.col("id").eqNullSafe(F.col("pid")) & (F.col("a_block") == F.col("b_block"))).filter(_match(parts("a_"), parts("b_")))
    pairs = pairs.groupBy("id", "key", "pkey").agg(F.max("own").alias("own"))
    claimed = pairs.withColumn("claimed", F.max("own").over(Window.partitionBy("id", "pkey"))).filter("own or not claimed")
    hits = claimed.select("id", "key", F.lit(None).cast("string").alias("name"), F.when(F.col("own"), 1).otherwise(2).alias("how"))
    out = ours.select("id", "key", "name", F.lit(None).cast("int").alias("how")).union(hits).groupBy("id", "key").agg(F.max("name").alias("name"), F.min("how").alias("how"))
    return out.select(F.col("id").alias(id_col), "name", F.when(F.col("how") == 1, "own").when(F.col("how") == 2, "bracket").otherwise("missing").alias("kept"))


def fidelity(source: DataFrame, parsed: DataFrame, bullets: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row a document: employers in the source and parsed, those missing (sorted), unnamed parsed ones, bullets and whether too few were kept.

    source and parsed are rows (id, employer); bullets has (id, source_bullets,
    parsed_bullets), source_bullets null where no work section was found.
    """
    kept = claimed_employers(source, parsed, id_col).groupBy(id_col).agg(F.count("*").alias("source_employers"), F.sort_array(F.collect_list(F.when(F.col("kept") == "missing", F.col("name")))).alias("missing"))
    named = _distinct(parsed, id_col, "employer").groupBy(F.col("id").alias(id_col)).agg(F.count("*").alias("parsed_employers"))
    unnamed = parsed.filter(F.col("employer").rlike(SEPARATOR_ONLY)).groupBy(id_col).agg(F.count("*").alias("unnamed"))
    out = bullets.select(id_col, "source_bullets", "parsed_bullets")
    for part in (kept, named, unnamed):
        part = part.withColumnRenamed(id_col, "__id")
        out = out.join(part.hint("merge"), F.col(id_col).eqNullSafe(F.col("__id")), "left").drop("__id")
    short = F.coalesce((F.col("source_bullets") >= LEAST_BULLETS) & (F.col("parsed_bullets") < F.col("source_bullets") * KEPT_BULLETS), F.lit(False))
    zero = lambda *cs: [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in cs]
    missing = F.coalesce(F.col("missing"), F.array().cast("array<string>"))
    out = out.select(id_col, *zero("source_employers", "parsed_employers"), missing.alias("missing"), *zero("unnamed"), F.col("source_bullets").cast("long"), F.col("parsed_bullets").cast("long"), short.alias("shortfall"))
    return out.withColumn("ok", (F.size("missing") == 0) & (F.col("unnamed") == 0) & ~F.col("shortfall"))


def nested_bullets(experiences: Column, path: Sequence[str] = ("roles", "bullets")) -> Column:
    """Bullets that are not blank in array<struct<roles: array<struct<bullets: array<string>>>>>."""
    roles = F.flatten(F.transform(F.coalesce(experiences, F.array()), lambda e: F.coalesce(e[path[0]], F.array())))
    lines = F.flatten(F.transform(roles, lambda r: F.coalesce(r[path[1]], F.array().cast("array<string>"))))
    return F.size(F.filter(lines, lambda b: F.trim(F.coalesce(b, F.lit(""))) != ""))
