"""Relevance of texts to weighted terms."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import squeezed, term_matches


def term_coverage(text: Column, term: str) -> Column:
    """1 for the whole term; of a two-word term 0.75 for both words apart; of a longer one the share of its words, from a half and two words on; else 0."""
    parts = [w for w in re.findall(r"[A-Za-z0-9+#.]+", term) if len(w) > 1]
    exact = F.when(term_matches(text, term), F.lit(1.0))
    if len(parts) < 2:
        return exact.otherwise(0.0)

    def word(w: str) -> Column:
        hit = term_matches(text, w)
        return hit | term_matches(text, w[:-1]) if len(w) > 4 and w.lower().endswith("s") else hit

    found = sum((word(w).cast("int") for w in parts), F.lit(0))
    if len(parts) == 2:
        return exact.otherwise(F.when(found == 2, 0.75).otherwise(0.0))
    return exact.otherwise(F.when((found >= 2) & (found >= 0.5 * len(parts)), found / float(len(parts))).otherwise(0.0))


def term_weight(term: str) -> float:
    """2 for a phrase, 1.6 for an acronym, else 1."""
    if len(re.findall(r"[A-Za-z0-9+#.]+", term)) >= 2:
        return 2.0
    return 1.6 if re.fullmatch(r"[A-Z0-9+#.]{2,}", term) else 1.0


def weighted_coverage(text: Column, terms: Sequence[str]) -> Column | None:
    """Weighted mean coverage of the different terms; None without terms."""
    clean = list({t.lower(): t for t in reversed([" ".join(t.split()) for t in terms]) if t}.values())[::-1]
    if not clean:
        return None
    total = sum(term_weight(t) for t in clean)
    return sum((term_coverage(text, t) * F.lit(term_weight(t)) for t in clean), F.lit(0.0)) / F.lit(total)


def term_status(coverage: Column) -> Column:
    return F.when(coverage >= 0.999, "exact").when(coverage >= 0.5, "partial").otherwise("missing")


def fit_percent(text: Column, *, jd: Sequence[str] = (), must: Sequence[str] = (), role: Sequence[str] = (), nice: Sequence[str] = (), confirmed: Column | None = None, discovered: Column | None = None) -> Column:
    """Weighted fit in percent, halves to even.

    Weights 55, 25, 10 and 10 with job terms, else 50, 30 and 20, over the parts
    that have terms. A confirmed row has 0.6 of the must terms at least, and a
    discovered one 10 percent.
    """
    with_jd = bool(jd)
    parts: list[tuple[Column, float]] = []
    for terms, weight in ((jd, 55.0), (must, 25.0 if with_jd else 50.0), (role, 10.0 if with_jd else 30.0), (nice, 10.0 if with_jd else 20.0)):
        cover = weighted_coverage(text, terms)
        if cover is None:
            continue
        if terms is must and confirmed is not None:
            cover = F.when(confirmed, F.greatest(cover, F.lit(0.6))).otherwise(cover)
        parts.append((cover, weight))
    total = sum(w for _, w in parts)
    raw = F.bround(sum((c * F.lit(w) for c, w in parts), F.lit(0.0)) / F.lit(total) * 100).cast("int") if parts else F.lit(0)
    return F.when(discovered, F.greatest(raw, F.lit(10))).otherwise(raw) if discovered is not None else raw


def scored(rows: DataFrame, text_col: str, gates: Sequence[tuple[str, Column]], score: Column, keep: int = 10) -> DataFrame:
    """rows with reason (of the first gate that a row fails) and score (null where one fails or the score is under keep)."""
    reason = F.lit(None).cast("string")
    for name, passes in reversed(list(gates)):
        reason = F.when(~F.coalesce(passes, F.lit(False)), F.lit(name)).otherwise(reason)
    with_reason = rows.withColumn("reason", reason).withColumn("score", F.when(F.col("reason").isNull(), score))
    return with_reason.withColumn("reason", F.when(F.col("score") < keep, "score below minimum").otherwise(F.col("reason"))).withColumn("score", F.when(F.col("score") >= keep, F.col("score")))


def sections(rows: DataFrame, id_col: str, text_col: str, headings: dict[str, str], default: str = "core") -> DataFrame:
    """(id, line, text, section): each line's section is the last heading's above it.

    A line counts as a heading if, without its last colon, it equals one. Worked
    out within each row's own text, so rows are never brought together.
    """
    lines = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\n"), squeezed)
    names = F.create_map(*(F.lit(x) for kv in headings.items() for x in kv))
    name = lambda l: F.try_element_at(names, F.lower(F.regexp_replace(l, ":$", "")))
    start = F.array(F.lit(default))
    walked = F.aggregate(lines, start, lambda acc, l: F.concat(acc, F.array(F.coalesce(name(l), F.element_at(acc, -1)))))
    exploded = rows.select(F.col(id_col), F.posexplode(F.arrays_zip(lines.alias("text"), F.slice(walked, F.lit(2), F.size(lines)).alias("section"))).alias("line", "x"))
    return exploded.select(id_col, (F.col("line") + 1).alias("line"), F.col("x.text").alias("text"), F.col("x.section").alias("section")).filter("text <> ''")
