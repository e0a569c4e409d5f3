"""The corpus pipeline: language ID, near-duplicates, substring dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir), docs having the columns of documents,
and returns a DataFrame; each is written as Parquet and read again as the next
one's docs.
"""

from __future__ import annotations

import atexit
import contextlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.llm import mixing
from rosterlake.llm.common import Scratch, settle
from rosterlake.llm.decontaminate import without_leaks
from rosterlake.llm.language import fit, held_out, identify
from rosterlake.llm.ngram_join import ngram_components
from rosterlake.llm.substring_dedup import substring_dedup

#: The least share of its language's probability with which a document stays.
MIN_LANGUAGE_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of no known language: no text or letter, or no language of at least MIN_LANGUAGE_SCORE."""
    model = fit(docs.select("doc_id", "text", "lang").filter(~held_out()))
    return identify(docs, model).filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(docs.columns)


def ngram_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the document of least id stays, once.

    Documents without words are in no group and stay.
    """
    found = ngram_components(docs, n=5, percent=80)
    keep = settle(found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id").agg(F.count("*").alias("rows"), F.max("n_shingles").alias("n")).select(F.col("doc_id").alias("keep_id"), "rows", "n"))
    kept = docs.join(keep.select("keep_id"), F.col("doc_id").eqNullSafe(F.col("keep_id")), "left_semi")
    if keep.filter("rows > 1 and n > 0").isEmpty():
        return kept
    return kept.dropDuplicates(["doc_id", "text"])  # rows read twice


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages; n_chars follows the text. Every row stays."""
    cut = substring_dedup(docs)
    return cut.withColumn("n_chars", F.when(F.col("cut_bytes") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies documents to their sources' target weights, in a global random order."""
    return mixing.poisson_mix(docs, alpha=0.5, scale=1.0, seed=7)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("ngram_jaccard_join", ngram_stage),
    ("substring_dedup", substring_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("source_mixing", mixing_stage),
]
#: The walks, hashes and random numbers of the stages are not SQL; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Tables between stages are deleted once read; the last one at exit."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    atexit.register(_forget, scratch)
    return docs


def _forget(scratch: Scratch) -> None:
    with contextlib.suppress(Exception):  # the session may have ended, and with it the way to the folder
        scratch.drop()
