"""Columns about people and jobs: residency, notice, families of work, card filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.rank import blanks_last
from .dates import notice_days
from .text import has_any, squeezed, token_or_substring


def residency_classes(text: Column) -> Column:
    """citizen, permanent_resident, no_visa_required and work_visa, those that a text states."""
    t = squeezed(text)
    parts = F.transform(F.split(F.lower(t), r"[|,;/]+"), lambda p: F.trim(F.regexp_replace(p, "[^a-z0-9]+", " ")))
    whole = lambda *names: F.arrays_overlap(parts, F.array(*map(F.lit, names)))
    return F.array_compact(
        F.array(
            F.when(has_any(t, ("local citizen", "malaysian citizen", "singapore citizen", "citizenship", "citizen")), "citizen"),
            F.when(has_any(t, ("permanent resident", "permanent residency", "pr status", "pr holder")) | whole("pr"), "permanent_resident"),
            F.when(has_any(t, ("no visa required", "no sponsorship required", "unrestricted work rights", "full working rights", "right to work without sponsorship")), "no_visa_required"),
            F.when(has_any(t, ("work visa", "employment pass", "s pass", "work permit", "sponsorship required", "requires sponsorship", "visa required")) | whole("ep", "sp", "s pass", "employment pass"), "work_visa"),
        )
    )


def residency_target(status: Column) -> Column:
    s = F.lower(squeezed(status))
    return (
        F.when(s.isin("", "any"), "")
        .when(s.contains("citizen"), "citizen")
        .when(s.contains("permanent") | (s == "pr"), "permanent_resident")
        .when(s.contains("no visa") | s.contains("no sponsorship"), "no_visa_required")
        .when(s.contains("work visa") | s.contains("visa required") | s.contains("employment pass"), "work_visa")
        .otherwise(s)
    )


def option_match(values: Column, selected: Sequence[str], require_all: bool = False) -> Column:
    """match, mismatch or unknown (no values) of any or all selected options, case ignored; inactive without a selection."""
    wanted = sorted({s.strip().lower() for s in selected if s.strip()})
    if not wanted:
        return F.lit("inactive")
    own = F.transform(values, lambda v: F.lower(F.trim(v)))
    n = F.size(F.array_intersect(own, F.array(*map(F.lit, wanted))))
    return F.when(values.isNull() | (F.size(values) == 0), "unknown").when(n == len(wanted) if require_all else n > 0, "match").otherwise("mismatch")


def country_match(code: Column, name: Column, place: Column, wanted_code: str, names: Sequence[str], places: Sequence[str]) -> Column:
    """match, mismatch or unknown: the code decides, then an explicit name, then a name or place in the location."""
    c, n, p = (F.lower(squeezed(x)) for x in (code, name, place))
    known = F.lit(False)
    for x in (*names, *places):
        known = known | token_or_substring(p, x)
    return (
        F.when(c != "", F.when(c == wanted_code.lower(), "match").otherwise("mismatch"))
        .when(n != "", F.when(n.isin(*[x.lower() for x in names]), "match").otherwise("mismatch"))
        .when(known, "match")
        .otherwise("unknown")
    )


def notice(text: Column) -> tuple[Column, Column]:
    """(display, days) of a notice period in words; immediate is 0 days; unreadable ones have none."""
    t = squeezed(text)
    pattern = r"(?i)(\d+(?:\.\d+)?)\s*(day|week|month)s?"
    days = notice_days(F.nullif(F.regexp_extract(t, pattern, 1), F.lit("")).try_cast("double"), F.regexp_extract(t, pattern, 2))
    now = t.rlike(r"(?i)\b(immediate|immediately|asap|available now)\b")
    return F.when(now, "Immediate").otherwise(F.nullif(F.substring(t, 1, 120), F.lit(""))), F.when(now, F.lit(0.0)).otherwise(days)


def family_scores(text: Column, patterns: dict[str, Sequence[str]], boosts: dict[str, Sequence[tuple[str, int]]]) -> Column:
    """array<struct<family, score>> over 0: three for each hit of a pattern, and each boost word's own points once."""
    t = F.lower(squeezed(text))
    out = []
    for family in sorted(patterns):
        hits = sum((F.regexp_count(t, F.lit(p)) for p in patterns[family]), F.lit(0)) * 3
        extra = sum((F.when(t.rlike(f"(?<![a-z0-9])\\Q{w}\\E(?![a-z0-9])"), n).otherwise(0) for w, n in boosts.get(family, ())), F.lit(0))
        out.append(F.struct(F.lit(family).alias("family"), (hits + extra).cast("int").alias("score")))
    return F.filter(F.array(*out), lambda x: x["score"] > 0)


def families(scores: Column, most: int = 3) -> Column:
    """The families of at least 3 points and 65 % of the best, best first, ties by name."""
    best = F.array_max(F.transform(scores, lambda x: x["score"]))
    kept = F.filter(scores, lambda x: (x["score"] >= 3) & (x["score"] >= best * 0.65))
    ordered = F.array_sort(F.transform(kept, lambda x: F.struct((-x["score"]).alias("minus"), x["family"].alias("family"))))
    return F.slice(F.transform(ordered, lambda x: x["family"]), 1, most)


def filter_cards(rows: DataFrame, *, search: str = "", search_cols: Sequence[str] = (), min_score: int = 0, folder: str = "*", shortlisted: bool = False, sort: str = "saved_at", descending: bool = True) -> DataFrame:
    """Saved rows by text, score, folder (`*` all, empty unfiled, `!trash` the trash) and shortlist; blanks last in the order."""
    live = ~F.coalesce(F.col("deleted"), F.lit(False))
    out = rows.filter(~live if folder == "!trash" else live if folder == "*" else live & (F.coalesce("folder", F.lit("")) == folder))
    out = out.filter(F.coalesce("score", F.lit(0)) >= min_score)
    if shortlisted:
        out = out.filter("shortlisted")
    if search:
        out = out.filter(F.contains(F.lower(F.concat_ws(" ", *search_cols)), F.lit(search.strip().lower())))
    return out.orderBy(*blanks_last(sort, descending))


def current_people(rows: DataFrame) -> DataFrame:
    """rows (company_id, url, scanned_at, ...) to one newest row for a person at a company, with ads, the number of rows."""
    key = F.sha2(F.concat_ws("|", F.col("company_id"), F.lower(F.regexp_replace("url", "/+$", ""))), 256)
    rest = [c for c in rows.columns if c != "scanned_at"]
    newest = rows.groupBy(key.alias("key")).agg(F.max(F.struct("scanned_at", *rest)).alias("x"), F.count("*").alias("ads"))
    return newest.select("key", "x.*", "ads")


#: Words of addresses, which no name holds, and words of languages and education, which no fit counts.
ADDRESS_WORDS = (
    "avenue", "ave", "street", "st", "road", "rd", "lane", "ln", "drive", "dr", "boulevard", "blvd", "highway", "jalan", "jln", "lorong", "lrg", "taman", "kampung", "kampong", "kg", "bandar", "persiaran", "lebuh", "lebuhraya",
    "block", "blok", "suite", "unit", "floor", "tingkat", "apartment", "apt", "residency", "residence", "condominium", "postcode", "poskod", "malaysia", "singapore", "indonesia", "brunei", "thailand", "vietnam", "philippines",
    "selangor", "kuala lumpur", "putrajaya", "cyberjaya", "petaling", "subang", "shah alam", "klang", "johor", "penang", "perak", "kedah", "kelantan", "terengganu", "pahang", "melaka", "negeri sembilan", "sarawak", "sabah", "labuan",
    "bangi", "cheras", "ampang", "kajang", "seremban",
)
UNCOUNTED = (
    "language", "languages", "linguistic", "fluent", "fluency", "spoken", "written", "bilingual", "multilingual", "english", "mandarin", "chinese", "cantonese", "hokkien", "hakka", "teochew", "malay", "bahasa", "japanese", "korean",
    "thai", "vietnamese", "tagalog", "filipino", "indonesian", "degree", "diploma", "bachelor", "master", "masters", "phd", "doctorate", "university", "college", "education", "academic", "cgpa", "gpa", "spm", "stpm",
)


def _whole_word(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike(r"(?i)\b(?:" + "|".join(w.replace(" ", r"\s+") for w in words) + r")\b")


def is_place_line(name: Column) -> Column:
    """Whether a name field holds an address or contact line: an at sign, a digit or a word of addresses."""
    t = F.trim(F.coalesce(name, F.lit("")))
    return (t != "") & (t.rlike(r"[@0-9]") | _whole_word(t, ADDRESS_WORDS))


def is_person_name(line: Column) -> Column:
    """Whether a line can be a person's name: two to six words of letters, no comma, nothing of an address."""
    t = F.regexp_replace(F.trim(F.coalesce(line, F.lit(""))), r"^[\s,]+|[\s,]+$", "")
    return t.rlike(r"^[A-Za-z][A-Za-z'.\-/]*(?:\s+[A-Za-z][A-Za-z'.\-/]*){1,5}$") & ~is_place_line(t)


def uncounted_term(term: Column) -> Column:
    """Whether a term is about languages or education, or blank."""
    t = F.trim(F.coalesce(term, F.lit("")))
    return (t == "") | _whole_word(t, UNCOUNTED)


def evidence_text(resume: Column, profile: Column, first: int = 14_000, most: int = 20_000) -> Column:
    """The resume's beginning, then as much of the profile as is left of `most` characters; white space squeezed."""
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))
    head, rest = F.substring(flat(resume), 1, first), flat(profile)
    room = F.greatest(F.lit(most - 1) - F.length(head), F.lit(0))
    return F.when(head == "", F.substring(rest, 1, most)).otherwise(F.trim(F.concat(head, F.lit(" "), F.substr(rest, F.lit(1), room))))
