"""Usage and cost: counters, estimates, reconciliation. A missing amount is null with a status, never 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .match import lookup_with_fallback

_STATUS = {"unavailable": 3, "partial": 2, "estimated": 1, "exact": 0}


def estimate(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage (model, provider, input_tokens, cached_tokens, output_tokens) with cost and price_source.

    prices: (model or null, provider, in_rate, cached_rate, out_rate) for a million tokens.
    """
    priced = lookup_with_fallback(usage, prices, "model", "provider", ["in_rate", "cached_rate", "out_rate"])
    part = lambda n, r: F.col(n).cast("decimal(20,0)") * F.col(r).cast("decimal(12,6)") / F.lit(1_000_000)
    fresh = (F.greatest(F.col("input_tokens") - F.col("cached_tokens"), F.lit(0))).cast("decimal(20,0)") * F.col("in_rate").cast("decimal(12,6)") / F.lit(1_000_000)
    total = fresh + part("cached_tokens", "cached_rate") + part("output_tokens", "out_rate")
    return priced.withColumn("cost", F.round(total.cast("decimal(28,10)"), 6))


def provider_ceiling(prices: DataFrame) -> DataFrame:
    """(provider, in_rate, out_rate): the highest rates, to bound what a request may cost."""
    return prices.groupBy("provider").agg(F.max("in_rate").alias("in_rate"), F.max("out_rate").alias("out_rate"))


def worst_status(status: Column) -> Column:
    """An aggregate: the least certain of the statuses."""
    rank = F.create_map(*(F.lit(x) for kv in _STATUS.items() for x in kv))
    return F.max_by(status, rank[status])


def rollup(costs: DataFrame, keys: list[str]) -> DataFrame:
    """Sums by key with the worst status; the amount is null if any part is missing."""
    return costs.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.when(F.count_if(F.col("cost").isNull()) == 0, F.sum("cost")).alias("cost"),
        worst_status(F.when(F.col("price_source") == "exact", "exact").when(F.col("price_source") == "group", "estimated").otherwise("unavailable")).alias("status"),
    )


def reconcile(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, billed, currency, status, difference, difference_percent) of billed against estimated amounts.

    Amounts of more than one currency do not add up: status mixed_currency and no amount.
    """
    summed = rows.groupBy(*keys).agg(F.sum(F.col("billed").cast("decimal(38,18)")).alias("b"), F.sum(F.col("estimated").cast("decimal(38,18)")).alias("e"), F.count_distinct("currency").alias("c"), F.min("currency").alias("currency"))
    one = F.col("c") == 1
    billed = F.when(one, F.col("b"))
    return summed.select(
        *keys,
        billed.cast("double").alias("billed"),
        F.when(one, F.col("currency")).alias("currency"),
        F.when(F.col("c") == 0, "unavailable").when(~one, "mixed_currency").otherwise("reconciled").alias("status"),
        (billed.cast("double") - F.col("e").cast("double")).alias("difference"),
        F.when(F.col("e") != 0, F.round((billed.cast("double") - F.col("e").cast("double")) / F.col("e").cast("double") * 100, 4)).alias("difference_percent"),
    )
