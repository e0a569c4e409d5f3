"""Filters of job leads by region, role family and stated wishes, and the queries that are made of those.

What a user chose (regions, titles, filters) are parameters of one query, so they
are worked into one expression; rows only meet that.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .redact import business_email
from .text import token_or_substring

#: Names of the whole region, words of remote work and of its scope, titles and title words that tell no role family.
WIDE_REGIONS = ("apac", "asia pacific", "southeast asia", "south east asia", "sea", "asean")
REMOTE = ("remote", "work from home", "wfh", "work-from-home", "hybrid")
WIDE_SCOPE = (*WIDE_REGIONS, "regional")
ANY_TITLE = ("executive", "senior executive", "specialist", "senior specialist", "analyst", "senior analyst", "associate", "consultant", "manager", "senior manager", "assistant manager", "lead")
TITLE_WORDS = ("senior", "junior", "lead", "manager", "head", "director", "executive", "specialist", "analyst", "consultant", "engineer", "developer", "officer", "assistant", "associate", "principal", "staff", "job", "jobs")
NOT_FOUND = "Not found"
EMAIL_NOTE = "Removed personal/free-mail or invalid email; public business-domain email required."


def _any(tests: Sequence[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def blob(*columns: str) -> Column:
    """The columns' texts in one, lower case."""
    return F.lower(F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)))


def region_aliases(regions: Sequence[str], aliases: Mapping[str, Sequence[str]]) -> list[str]:
    """The regions and their aliases, lower case, each once."""
    named = [x for r in map(str.strip, regions) if r for x in (r, *aliases.get(r, ()))]
    return list(dict.fromkeys(x.strip().lower() for x in named if x.strip()))


def location_allowed(text: Column, regions: Sequence[str], aliases: Mapping[str, Sequence[str]], wide_members: Sequence[str] = ()) -> Column:
    """Whether a lead's text names a chosen region; a remote role of a wide scope will do where a region is one of wide_members. A wide region allows all."""
    chosen = [r.strip().lower() for r in regions]
    names = region_aliases(regions, aliases)
    if not names or any(r in WIDE_REGIONS for r in chosen):
        return F.lit(True)
    out = _any([token_or_substring(text, a) for a in names])
    if any(r in map(str.lower, wide_members) for r in chosen):
        out = out | (_any([text.contains(w) for w in REMOTE]) & _any([text.contains(w) for w in WIDE_SCOPE]))
    return F.coalesce((F.trim(text) != "") & out, F.lit(False))


def in_role_family(text: Column, titles: Sequence[str], most: int = 24) -> Column:
    """Whether a lead's text holds a wanted title or a word of one that tells its family; titles that tell none allow all."""
    wanted = [t for t in (x.strip().lower() for x in titles) if t and t not in ANY_TITLE][:most]
    words = dict.fromkeys(w for t in wanted for w in re.findall(r"[a-z][a-z0-9+#.]{2,}", t) if w not in TITLE_WORDS)
    if not wanted or not words:
        return F.lit(True)
    whole = "|".join(f"\\Q{w}\\E" for w in words)
    return F.coalesce(_any([text.contains(t) for t in wanted if len(t) >= 4]) | text.rlike(f"(?<![a-z0-9])(?:{whole})(?![a-z0-9])"), F.lit(False))


def wanted_lead(text: Column, days_open: Column, filters: Mapping[str, object]) -> Column:
    """Whether a lead holds none of the excluded words and companies and is not open for too long; unknown days pass."""
    out = ~_any([text.contains(x.lower()) for k in ("exclude_keywords", "company_exclude") for x in terms(filters.get(k), 20)])
    if filters.get("max_days_open"):
        out = out & F.coalesce(days_open.try_cast("double") <= float(str(filters["max_days_open"])), F.lit(True))
    return out


def terms(said: object, most: int) -> list[str]:
    """Comma, semicolon or line separated terms of a filter, each once."""
    kept: dict[str, str] = {}
    for t in (" ".join(p.split()) for p in re.split(r"[,;\n\r]+", str(said or ""))):
        if 2 <= len(t) <= 80:
            kept.setdefault(t.lower(), t)
    return list(kept.values())[:most]


def query_terms(filters: Mapping[str, object]) -> str:
    """Words to search for: what must be there, seniority, set-up, kind of employment, companies; at most 12."""
    parts: list[str] = []
    for k in ("must_have", "seniority", "work_setup", "employment_type", "company_include"):
        if v := filters.get(k):
            parts += terms(v, 6) if k in ("must_have", "company_include") else [str(v)]
    return " ".join(parts[:12]).strip()


def excluded_terms(filters: Mapping[str, object]) -> str:
    """Words to keep out, as `-word`."""
    found = terms(filters.get("exclude_keywords"), 8) + terms(filters.get("company_exclude"), 6)
    return " ".join("-" + "-".join(t.split()) for t in found)


def plain_job_query(query: Column, most: int = 220) -> Column:
    """A search without sites, ORs, exclusions and quotes, for a search of jobs."""
    q = F.coalesce(query, F.lit(""))
    for pattern in (r"(?i)\bsite:\S+", r"(?i)\bOR\b", r"(?U)[-–]\s*\w+", '"', r"\s+"):
        q = F.regexp_replace(q, pattern, " ")
    q = F.trim(q)
    return F.substring(F.when(F.lower(q).contains(" job"), q).otherwise(F.concat(q, F.lit(" jobs"))), 1, most)


def business_emails_only(people: DataFrame, personal_domains: Sequence[str]) -> DataFrame:
    """people (email, email_confidence, email_source, verification_status, notes): addresses that are no business ones blanked, with a note and status."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    bad = (text("email") != "") & ~business_email(text("email"), tuple(personal_domains))
    none = bad | ((text("email") == "") & (text("verification_status") == ""))
    noted = F.when(text("notes") == "", EMAIL_NOTE).when(text("notes").contains(EMAIL_NOTE), text("notes")).otherwise(F.concat(text("notes"), F.lit(" " + EMAIL_NOTE)))
    blanked = {c: F.when(bad, "").otherwise(F.col(c)) for c in ("email", "email_confidence", "email_source")}
    return people.withColumns({**blanked, "verification_status": F.when(none, NOT_FOUND).otherwise(F.col("verification_status")), "notes": F.when(bad, noted).otherwise(F.col("notes"))})


def people_of_kept_companies(people: DataFrame, companies: DataFrame, allowed: Column, placed: Column, company: str = "company") -> DataFrame:
    """People of a company that is kept (all, where none is), in an allowed place or without a place of their own.

    A semi join on the name; that no company is kept is one row, asked of the companies.
    """
    name = F.lower(F.trim(F.coalesce(F.col(company), F.lit(""))))
    kept = companies.select(name.alias("__kept")).filter("__kept <> ''").distinct()
    own = people.withColumn("__name", name).withColumn("__allowed", allowed).withColumn("__placed", placed)
    if kept.isEmpty():
        return own.filter("__allowed").drop("__name", "__allowed", "__placed")
    met = own.join(kept, F.col("__name") == F.col("__kept"), "left_semi")
    return met.filter(F.col("__allowed") | ~F.col("__placed")).drop("__name", "__allowed", "__placed")
