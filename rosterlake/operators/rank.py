"""Sorts, top-k, round-robin, distinct-first."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blanks_last(key: str, descending: bool = False, then: Sequence[str] = ()) -> list[Column]:
    """Sort columns: blanks after all others in either direction, then the key, then ties."""
    c = F.col(key)
    blank = c.isNull() | (F.trim(c.cast("string")) == "")
    return [blank.asc(), c.desc_nulls_last() if descending else c.asc_nulls_last(), *map(F.col, then)]


def blanks_first(key: str, then: Sequence[str] = ()) -> list[Column]:
    c = F.col(key)
    return [(c.isNotNull() & (F.trim(c.cast("string")) != "")).asc(), c.asc_nulls_first(), *map(F.col, then)]


#: Letters with marks that no table of marks takes off, and what they are without.
_PLAIN = {"ø": "o", "ł": "l", "đ": "d", "ħ": "h", "ŧ": "t", "ı": "i"}


def natural_key(text: Column) -> Column:
    """Case- and accent-insensitive key in which 9 is before 10, for numbers of any length: each has the number of its digits before it."""
    low = F.lower(F.coalesce(text, F.lit("")))
    accented = "".join(chr(c) for c in range(0xC0, 0x250) if unicodedata.decomposition(chr(c)) and not unicodedata.decomposition(chr(c)).startswith("<") and chr(c).islower())
    base = "".join(unicodedata.normalize("NFD", c)[0] for c in accented)
    plain = F.translate(low, accented + "".join(_PLAIN), base + "".join(_PLAIN.values()))
    parts = F.regexp_extract_all(plain, F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    number = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.concat(F.lpad(F.length(number(p)).cast("string"), 5, "0"), number(p))).otherwise(p)), "")


def round_robin(rows: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """The first n rows when one of each group in turn is taken; groups in the order of their first row.

    Only the first n of each group are ranked against each other.
    """
    within = rows.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("turn") <= n)
    firsts = within.filter("turn = 1").select(F.col(group), F.struct(*order).alias("__first"))
    return within.join(firsts, group).orderBy("turn", "__first").limit(n).drop("__first")


def first_per_key(rows: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def keep_newest(rows: DataFrame, key: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """The n first rows of each key in the order given; ranks are cut before the shuffle."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def evict_beyond(rows: DataFrame, order: Sequence[Column | str], cap: int) -> DataFrame:
    """The cap first rows of all."""
    return rows.orderBy(*order).limit(cap)


def within_budget(rows: DataFrame, key: Sequence[str], order: Sequence[str], size: Column, budget: int) -> DataFrame:
    """Rows in order of each key while their summed size is within the budget."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(size).over(w)).filter(F.col("running") <= budget)


def dated_in_dated_slots(rows: DataFrame, key: Sequence[str], slot: str, date: str) -> DataFrame:
    """rows with new_slot: dated rows newest first in the places of dated rows, undated ones where they were."""
    dated = rows.filter(F.col(date).isNotNull())
    by_date = dated.withColumn("__k", F.row_number().over(Window.partitionBy(*key).orderBy(F.col(date).desc(), slot)))
    by_slot = dated.select(*key, F.col(slot).alias("new_slot"), F.row_number().over(Window.partitionBy(*key).orderBy(slot)).alias("__k"))
    return by_date.join(by_slot, [*key, "__k"]).drop("__k").unionByName(rows.filter(F.col(date).isNull()).withColumn("new_slot", F.col(slot)))


def filled_under_quotas(rows: DataFrame, key: Sequence[str], line: str, priority: str, place: str, group: str, quotas: Mapping[str, int], most: int) -> DataFrame:
    """rows (one a term) chosen for each key, with `nth`: the best of each line first, then the rest by priority, within a quota for each group and `most` in all.

    Greedy in that order: a row is taken if its group and the whole have room. As
    a group's room and the whole's do not depend on each other, that is a rank
    within the group and then a rank of those that are left, so no state is
    carried. Ties go by `place`; groups without a quota are not limited, nor is a
    null group.
    """
    best = Window.partitionBy(*key, line).orderBy(F.col(priority).desc(), place)
    turned = rows.withColumn("__later", F.row_number().over(best) > 1)
    order = [F.col("__later").asc(), F.col(priority).desc(), F.col(place).asc()]
    room = F.lit(None).cast("int")
    for name, n in quotas.items():
        room = F.when(F.col(group) == name, F.lit(n)).otherwise(room)
    ranked = turned.withColumn("__in_group", F.row_number().over(Window.partitionBy(*key, group).orderBy(*order))).filter(room.isNull() | (F.col("__in_group") <= room))
    return ranked.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("nth") <= most).drop("__later", "__in_group")
