"""Interval operators over (key, start, end) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, key: list[str], start: str, end: str, gap: int = 0) -> DataFrame:
    """(key, island, start, end, n): intervals that overlap, or follow each other with at most `gap` between, become one."""
    before = Window.partitionBy(*key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(end).over(before)
    broken = rows.withColumn("__new", F.when(reach.isNull() | (F.col(start) > reach + gap), 1).otherwise(0))
    numbered = broken.withColumn("island", F.sum("__new").over(Window.partitionBy(*key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*key, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n"))


def union_length(rows: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """(key, length): what half-open intervals cover together; intervals that touch join."""
    return islands(rows, key, start, end).groupBy(*key).agg(F.sum(F.greatest(F.col(end) - F.col(start), F.lit(0))).alias("length"))


def adjacent_runs(rows: DataFrame, key: list[str], order: str, label: str, start: str, end: str) -> DataFrame:
    """Neighbours in source order with one label whose intervals touch (at most one apart) become one row; a later return stays apart."""
    w = Window.partitionBy(*key).orderBy(order)
    same = F.lag(label).over(w) == F.col(label)
    touch = F.greatest(F.lag(start).over(w), F.col(start)) <= F.least(F.lag(end).over(w), F.col(end)) + 1
    marked = rows.withColumn("__new", F.when(same & touch, 0).otherwise(1))
    run = F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("run", run).groupBy(*key, "run").agg(F.first(label).alias(label), F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n"))


def newest_first_span(rows: DataFrame, key: list[str], order: str, start: str, end: str) -> DataFrame:
    """(key, start, end) of a list that runs from new to old: the last row's start and the first row's end."""
    return rows.groupBy(*key).agg(F.max_by(start, order).alias(start), F.min_by(end, order).alias(end))
