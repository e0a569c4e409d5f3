"""Operators on arrays of structs within a row: no explode, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def update_element(items: Column, key: str, wanted: Column, **changes: Column) -> Column:
    """items with the fields of the elements of one key changed; fields not named are kept."""
    return F.transform(items, lambda x: F.when(x[key] == wanted, x.withField(*next(iter(changes.items()))) if len(changes) == 1 else _with(x, changes)).otherwise(x))


def _with(x: Column, changes: dict[str, Column]) -> Column:
    for name, value in changes.items():
        x = x.withField(name, value)
    return x


def newest_first(items: Column, year_month: str) -> Column:
    """Dated elements by their struct(year, month) from new to old, ties in their order, undated ones after them; as it is with fewer than two dated."""
    numbered = F.transform(items, lambda x, i: F.struct(x[year_month].isNull().alias("blank"), (-x[year_month]["year"]).alias("y"), (-x[year_month]["month"]).alias("m"), i.alias("i"), x.alias("x")))
    ordered = F.transform(F.array_sort(numbered), lambda n: n["x"])
    return F.when(F.size(F.filter(items, lambda x: x[year_month].isNotNull())) >= 2, ordered).otherwise(items)


def span(items: Column, start: str, end: str) -> Column:
    """struct(start, end): the least start and the greatest end; null ends are left out."""
    pick = lambda name, f: f(F.array_compact(F.transform(items, lambda x: x[name])))
    return F.struct(pick(start, F.array_min).alias("start"), pick(end, F.array_max).alias("end"))


def absorb_labels(items: Column) -> Column:
    """array<struct<heading, text>>: a heading without a text is given to the plain texts after it, and goes if none follow."""
    start = F.struct(F.lit(None).cast("string").alias("label"), F.array().cast("array<struct<heading:string,text:string>>").alias("out"))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""

    def step(acc: Column, x: Column) -> Column:
        only_label = ~blank(x["heading"]) & blank(x["text"])
        plain = blank(x["heading"]) & ~blank(x["text"])
        row = F.struct(F.when(plain, F.coalesce(acc["label"], F.lit(""))).otherwise(x["heading"]).alias("heading"), x["text"].alias("text"))
        label = F.when(only_label, x["heading"]).when(plain, acc["label"])
        return F.struct(label.cast("string").alias("label"), F.when(only_label, acc["out"]).otherwise(F.concat(acc["out"], F.array(row))).alias("out"))

    return F.aggregate(items, start, step, lambda acc: acc["out"])


def without_sections(items: Column, label: str, pattern: str) -> Column:
    """items without those whose label fits the pattern."""
    return F.filter(items, lambda x: ~F.coalesce(x[label], F.lit("")).rlike(pattern))


def custom_values(items: Column, field_id: int, labels: Sequence[str] = ()) -> Column:
    """Distinct values of array<struct<fieldId, name, value>> with an id, or without one but with one of the labels."""
    named = [x.lower() for x in labels]
    fits = lambda x: (x["fieldId"] == field_id) | (x["fieldId"].isNull() & F.lower(F.trim(x["name"])).isin(*named)) if named else x["fieldId"] == field_id
    return F.array_distinct(F.filter(F.transform(F.filter(items, lambda x: F.coalesce(fits(x), F.lit(False))), lambda x: F.trim(x["value"])), lambda v: v != ""))


def set_fingerprint(rows: DataFrame, key: Sequence[str], *fields: str) -> DataFrame:
    """(key, fingerprint, n): SHA-256 of a group's distinct records whatever their order. Groups are one owner's own records."""
    one = F.sha2(F.to_json(F.struct(*fields)), 256)
    return rows.groupBy(*key).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(one)), ""), 256).alias("fingerprint"), F.count("*").alias("n"))


def compared(rows: DataFrame, key: str, scenario: str, amounts: Sequence[str], base: str, other: str) -> DataFrame:
    """(key, <amount>_difference, <amount>_uplift): another scenario's amounts against a base's; no uplift over 0."""
    pick = lambda s, a: F.max(F.when(F.col(scenario) == s, F.col(a)))
    wide = rows.groupBy(key).agg(*(pick(s, a).alias(f"{a}_{n}") for a in amounts for n, s in (("a", base), ("b", other))))
    out = []
    for a in amounts:
        d = F.col(f"{a}_b") - F.col(f"{a}_a")
        out += [d.alias(f"{a}_difference"), F.when(F.col(f"{a}_a") != 0, F.round(d / F.col(f"{a}_a"), 6)).alias(f"{a}_uplift")]
    return wide.select(key, *out)


def search_grid(sources: DataFrame, titles: DataFrame, limit: int) -> DataFrame:
    """source, title: each of a few chosen sources with each of a few titles, by their ordinals, the first `limit`. Both are parameters of a query, not tables."""
    return sources.join(titles).orderBy(F.col("source_n"), F.col("title_n")).limit(limit).select("source", "title")
