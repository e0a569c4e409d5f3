"""Columns about CVs: languages, sections, bullets, pages in a date range; and usage counters and currencies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dates import MONTHS, date_range, range_parts
from .money import first_positive
from .text import let, match_key, token_overlap, tokens

#: Names of languages and what they are called besides.
LANGUAGES: dict[str, tuple[str, ...]] = {
    "English": ("english",),
    "Malay": ("malay", "bahasa malaysia", "bahasa melayu"),
    "Chinese": ("chinese", "mandarin", "cantonese", "hokkien"),
    "Tamil": ("tamil",),
    "Indonesian": ("indonesian", "bahasa indonesia"),
    "Japanese": ("japanese",),
    "Korean": ("korean",),
    "German": ("german", "deutsch"),
    "French": ("french",),
    "Spanish": ("spanish",),
}
_SKILL = r"(?i)\b(?:native|fluent|professional|business|conversational|basic|intermediate|advanced|written|spoken|read|write|speaking|reading|writing|mother tongue|proficient|bilingual|trilingual|multilingual|languages?)\b"


def language_list(text: Column) -> Column:
    """The languages that a field names, without words of proficiency and bracketed notes."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\([^)]*\)", ""), _SKILL, "")
    parts = F.split(t, r"(?i)[,;|/\n]+|\s+(?:and|or|plus|&)\s+")
    clean = F.transform(parts, lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"[^A-Za-zÀ-ÖØ-öø-ÿ\s\-]", " "), r"\s+", " ")))
    return F.filter(clean, lambda p: p != "")


def canonical_language(name: Column, names: dict[str, tuple[str, ...]] = LANGUAGES) -> Column:
    """The standard name: of an equal alias, else of the longest alias within; else the name in title case."""
    low = F.trim(F.lower(F.regexp_replace(name, r"\s+", " ")), F.lit(" -"))
    pairs = sorted(((a, s) for s, aliases in names.items() for a in aliases), key=lambda p: (len(p[0]), p[0]))
    out = F.initcap(low)
    for alias, standard in pairs:
        out = F.when(low.rlike(rf"(?<![a-z]){alias}(?![a-z])"), F.lit(standard)).otherwise(out)
    for alias, standard in pairs:
        out = F.when(low == alias, F.lit(standard)).otherwise(out)
    return F.when(low == "", "").otherwise(out)


def languages(text: Column, evidence: Column | None = None, names: dict[str, tuple[str, ...]] = LANGUAGES) -> Column:
    """Standard names in the standard order, others after them by name; only those that the evidence names, if there is any evidence."""
    found = F.array_distinct(F.transform(language_list(text), lambda n: canonical_language(n, names)))
    order = F.array(*map(F.lit, names))
    ranked = F.array_sort(F.transform(found, lambda n: F.struct(F.when(F.array_contains(order, n), F.array_position(order, n)).otherwise(F.lit(len(names) + 1)).alias("k"), F.lower(n).alias("low"), n.alias("n"))))
    out = F.transform(ranked, lambda x: x["n"])
    if evidence is not None:
        low = F.lower(F.coalesce(evidence, F.lit("")))
        told = F.array_compact(F.array(*(F.when(low.rlike(rf"(?<![a-z])(?:{'|'.join(a)})(?![a-z])"), F.lit(s)) for s, a in names.items())))
        out = F.when(F.trim(low) == "", out).otherwise(F.filter(out, lambda n: F.array_contains(told, n)))
    return out


def section_lines(text: Column, start: str, stop: str, unified: bool = True) -> Column:
    """Lines after the first heading that fits `start` up to one that fits `stop` (both regular expressions of a whole line); null without a start.

    Lines end at \\n, and at \\r\\n if they are to be unified; no other sign ends one, not for `.` either.
    The text is cut by three matches, each over the text once, so the work is in proportion to its length.
    """
    said = F.coalesce(text, F.lit(""))
    t = F.concat(F.lit("\n"), F.regexp_replace(F.regexp_replace(said, r"\r\n", "\n") if unified else said, r"(?md)^[ ]+|[ ]+$", ""))
    after = lambda x: F.regexp_replace(x, rf"(?d)\A(?s:.*?)\n(?:{start})(?=\n|\z)", "")
    inside = lambda x: F.regexp_replace(after(x), rf"(?d)\n(?:{stop})(?=\n|\z)(?s:.*)", "")
    lines = lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(F.substr(x, F.lit(2)), "\n"))
    return let(t, lambda x: F.when(x.rlike(rf"(?d)\n(?:{start})(?=\n|\z)"), let(inside(x), lines)))


def bullet_count(lines: Column) -> Column:
    """Lines that begin with a bullet; null for no section."""
    return F.when(lines.isNotNull(), F.size(F.filter(lines, lambda l: l.rlike(r"^\s*(?:[-*•●▪◦‣–]|\d{1,2}[.)])\s+\S"))))


def in_date_range(created: Column, modified: Column, start: str = "", stop: str = "", mode: str = "created") -> Column:
    """Whether an ISO stamp lies in the closed range, compared as text; mode created, modified or either. No range holds all, no stamp none."""
    if not start and not stop:
        return F.lit(True)
    stamps = {"created": [created], "modified": [modified], "either": [created, modified]}[mode]
    out = F.lit(False)
    for s in stamps:
        t = F.trim(F.coalesce(s, F.lit("")))
        fits = t != ""
        if start:
            fits = fits & (t >= start)
        if stop:
            fits = fits & (t <= stop)
        out = out | fits
    return out


def usage_counters(inputs: Sequence[Column], outputs: Sequence[Column], hits: Sequence[Column], misses: Sequence[Column]) -> dict[str, Column]:
    """Counters under one name each: the first positive alias; input falls back to cache hits and misses; state tells what is wrong or missing."""
    i, o, h, m = (first_positive(*c) for c in (inputs, outputs, hits, misses))
    i = F.when(i == 0, h + m).otherwise(i)
    given = lambda columns: F.coalesce(*(c.cast("string") for c in columns), F.lit(None)).isNotNull()
    state = F.when((i > 0) & (h + m > i), "inconsistent").when(~given([*inputs, *hits, *misses]) | ~given(outputs), "missing").otherwise("complete")
    return {"input_tokens": i, "output_tokens": o, "cache_hit_tokens": h, "cache_miss_tokens": m, "state": state}


def request_ceiling(payload: Column, in_rate: Column, out_rate: Column, max_output: Column) -> Column:
    """The most that a request can cost: its bytes as input and all its output, by rates for a million."""
    return (F.octet_length(payload) * in_rate + max_output * out_rate) / F.lit(1_000_000)


def currencies(text: Column, patterns: Sequence[tuple[str, str]]) -> Column:
    """Codes in the order in which their pattern first stands in the text, ties by code."""
    t = F.lower(F.coalesce(text, F.lit("")))
    places = F.array_compact(F.array(*(F.when(t.rlike(p), F.struct(F.regexp_instr(t, F.lit(p)).alias("at"), F.lit(code).alias("code"))) for code, p in patterns)))
    return F.transform(F.array_sort(places), lambda x: x["code"])


#: The least share of tokens by which two employers are the same.
SAME_EMPLOYER = 0.67


def employers_match(a: Column, b: Column) -> Column:
    """Equal match keys, or at least SAME_EMPLOYER of the tokens shared."""
    key = match_key(a)
    return ((key != "") & (key == match_key(b))) | (_shared(a, b) >= SAME_EMPLOYER)


def _shared(a: Column, b: Column) -> Column:
    """The overlap of the tokens of two texts, each cut once."""
    return let(F.struct(tokens(a).alias("a"), tokens(b).alias("b")), lambda x: token_overlap(x["a"], x["b"]))


def distinct_employers(names: Column) -> Column:
    """Employers in order, the first spelling of each match key; by sorting, so in proportion to n log n."""
    keyed = F.filter(F.transform(names, lambda n, i: F.struct(match_key(n).alias("key"), i.alias("i"), F.trim(F.coalesce(n, F.lit(""))).alias("n"))), lambda x: x["key"] != "")
    first = let(F.array_sort(keyed), lambda a: F.filter(a, lambda x, k: (k == 0) | (F.get(a, k - 1)["key"] != x["key"])))
    return F.transform(F.array_sort(F.transform(first, lambda x: F.struct(x["i"].alias("i"), x["n"].alias("n")))), lambda x: x["n"])


def first_spellings(rows: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """(group, order, name): the first spelling of each match key in each group, whatever the number of rows; blank names left out."""
    keyed = rows.select(group, order, F.trim(F.coalesce(F.col(name), F.lit(""))).alias(name)).withColumn("__key", match_key(F.col(name))).filter("__key <> ''")
    first = keyed.groupBy(group, "__key").agg(F.min(F.struct(order, name)).alias("__x"))
    return first.select(group, f"__x.{order}", f"__x.{name}")


def row_match_score(row: dict[str, Column], role: dict[str, Column]) -> Column:
    """How well a table's row fits a role, by company (5, 3 or 1.5), title (3, 2 or 1) and dates (2.5, else 1 an end)."""

    def part(a: Column, b: Column, equal: float, near: float, far: float) -> Column:
        apart = let(_shared(a, b), lambda shared: F.when(shared >= 0.67, near).when(shared >= 0.34, far).otherwise(0.0))
        return F.when((match_key(a) != "") & (match_key(a) == match_key(b)), equal).otherwise(apart)

    one = lambda a, b: F.when((a != "") & (a == b), 1.0).otherwise(0.0)

    def dated(x: Column, y: Column) -> Column:
        return F.when((x != "") & (x == y), 2.5).otherwise(sum((one(a, b) for a, b in zip(range_parts(x), range_parts(y), strict=True)), F.lit(0.0)))

    ends = let(F.struct(*(F.lower(date_range(d["dates"])).alias(n) for n, d in (("x", row), ("y", role)))), lambda p: dated(p["x"], p["y"]))
    return part(row["company"], role["company"], 5.0, 3.0, 1.5) + part(row["title"], role["title"], 3.0, 2.0, 1.0) + ends


def employment_label(joined: Column, left: Column, current: Column, shown: Column) -> Column:
    """`Jan 2020 to Present` of ISO months or years; without a start whether it was not shown or not asked for."""
    month = F.array(*(F.lit(m.title()) for m in MONTHS))

    def label(c: Column) -> Column:
        t = F.coalesce(c, F.lit(""))
        return F.when(F.length(t) > 4, F.concat(F.try_element_at(month, F.substring(t, 6, 2).try_cast("int")), F.lit(" "), F.substring(t, 1, 4))).otherwise(t)

    tail = F.when(current, " to Present").when(~current, F.concat(F.lit(" to "), label(left))).otherwise("")
    return F.when(label(joined) != "", F.concat(label(joined), tail)).when(shown == "not_shown", "Not confirmed").otherwise("Not checked")
