"""Columns about job leads: what a url is, whose it is, whether a source was chosen, keys and readings of names."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import company_name, let, squeezed, tokens
from .web import canonical_url, url_host, url_path


@dataclass(frozen=True)
class SiteRule:
    """What a job's own page looks like on hosts that hold one of `hosts`: the query fits `query`, or the path `path` and not `never`."""

    hosts: tuple[str, ...]
    path: str = "(?!)"
    query: str = "(?!)"
    never: str = "(?!)"


#: Sites and the shape of their job pages.
SITES: tuple[SiteRule, ...] = (
    SiteRule(("google.",), path=r"^/about/careers/applications/jobs/results/\d+"),
    SiteRule(("linkedin.com",), path=r"/jobs/view", query=r"(^|&)currentjobid=\d+"),
    SiteRule(("jobstreet", "jobsdb"), path=r"^/.{8,}$", query=r"(^|&)job[_-]?id=\d+", never=r"^/(companies|my-activity|profile|sign-in|login|register|account|saved-jobs|saved|applied-jobs|applied|applications)(/|$)|/(jobs|job-search)/|-jobs(/|$)"),
    SiteRule(("indeed",), path=r"/viewjob", query=r"(^|&)jk=[0-9a-z]+"),
    SiteRule(("glassdoor",), path=r"job-listing", query=r"jl="),
    SiteRule(("mycareersfuture",), path=r"/job/"),
    SiteRule(("monster", "foundit"), path=r"/job/", query=r"jobid"),
    SiteRule(("hiredly.", "kalibrr."), path=r"/jobs/[^/]{3,}|/c/[^/]+/jobs/\d+"),
    SiteRule(("greenhouse.io", "lever.co", "ashbyhq.com", "workdayjobs.com", "smartrecruiters.com", "bamboohr.com", "icims.com", "jobvite.com", "workable.com", "recruitee.com", "teamtailor.com", "personio.com"), path=r"^/.{9,}", never=r"/(jobs|careers|search|openings)/?$"),
)
_GENERIC = SiteRule((), path=r"/(?:job|vacancy|position|opening|role)/[^/]*[a-z0-9]|/(?:jobs|careers?|vacancies|positions|openings|roles)/[^/]+/[^/]|/(?:jobs|careers?|vacancies|positions|openings|roles)/[^/]{5,}$", query=r"(jobid|job_id|job=|reqid|req_id|requisition|gh_jid|currentjobid)=", never=r"/(jobs?|careers?|vacancies|positions|openings|search|listings?)/?$")
#: Path parts of articles and guides.
EDITORIAL = ("/blog", "/article", "/advice", "/guide", "/news", "/insights", "/resources", "/career-tips", "/salary-guide", "/press")


def url_query(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)


def url_parts(url: Column) -> Column:
    """struct(host, path, query), lower case."""
    return F.struct(url_host(url).alias("host"), F.lower(url_path(url)).alias("path"), F.lower(url_query(url)).alias("query"))


def is_job_page(url: Column, sites: Sequence[SiteRule] = SITES) -> Column:
    """Whether a url is one job's own page, not a search, list, account or article page. The first rule of its host decides."""
    return let(url_parts(url), lambda p: parts_of_job_page(p, sites))


def parts_of_job_page(parts: Column, sites: Sequence[SiteRule] = SITES) -> Column:
    """is_job_page of url_parts."""
    host, path, query = parts["host"], parts["path"], parts["query"]
    fits = lambda r: query.rlike(r.query) | (~path.rlike(r.never) & path.rlike(r.path))
    out = fits(_GENERIC)
    for rule in reversed(sites):
        out = F.when(host.rlike("|".join(h.replace(".", r"\.") for h in rule.hosts)), fits(rule)).otherwise(out)
    return F.when((host == "") | path.isin("", "/") | host.rlike(r"(^|\.)(bing\.com|yahoo\.com|duckduckgo\.com)$"), F.lit(False)).otherwise(out)


def is_editorial(url: Column, markers: Sequence[str] = EDITORIAL) -> Column:
    path = F.lower(url_path(url))
    return F.array_size(F.filter(F.array(*map(F.lit, markers)), lambda m: F.contains(path, m))) > 0


def source_chosen(url: Column, portal: Column, chosen: Sequence[str], portals: Sequence[str]) -> Column:
    """Whether a lead's source is among the chosen ones; no choice allows all. An unknown board needs `other`."""
    wanted = [c.strip().lower() for c in chosen if c.strip()]
    if not wanted:
        return F.lit(True)
    p, u = F.lower(F.coalesce(portal, F.lit(""))), F.lower(F.coalesce(url, F.lit("")))
    out = F.lit(any("other" in w for w in wanted))
    for name in reversed(portals):
        out = F.when(p.contains(name) | u.contains(name), F.lit(any(name in w for w in wanted))).otherwise(out)
    return out


def contact_key(profile: Column, name: Column, company: Column) -> Column:
    """li: and the profile's canonical url, else nc: and name and company, else empty."""
    url = canonical_url(profile)
    n, c = F.lower(squeezed(name)), F.lower(squeezed(company))
    return F.when(url != "", F.concat(F.lit("li:"), url)).when((n != "") & (c != ""), F.concat(F.lit("nc:"), n, F.lit("|"), c)).otherwise("")


def name_readings(company: Column) -> tuple[Column, Column]:
    """(own, bracketed): a name and its heads before a bracket, comma or dash; and what stands in brackets."""
    t = squeezed(company)
    heads = F.array(t, *(F.regexp_replace(F.element_at(F.split(t, p, 2), 1), r"^[ .,;:-]+|[ .,;:-]+$", "") for p in (r"\s*\(", r"\s*,", r"\s*–", r"\s*—", r"\s+-\s+")))
    own = F.array_distinct(F.filter(heads, lambda h: F.length(h) >= 2))
    inner = F.transform(F.regexp_extract_all(t, F.lit(r"\(([^)]{2,80})\)"), F.lit(1)), lambda x: F.regexp_replace(x, r"^[ .,;:-]+|[ .,;:-]+$", ""))
    return own, F.array_except(F.array_distinct(F.filter(inner, lambda x: x != "")), own)


def company_base(text: Column, places: Sequence[str]) -> Column:
    """A company's match key without a known place after a spaced dash or bar."""
    t = squeezed(text)
    parts = F.split(t, r"\s+(?:[-–—]|\|)\s+", 2)
    key = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    known = [p.lower().replace(" ", "") for p in places]
    return F.when((F.size(parts) == 2) & key(F.try_element_at(parts, F.lit(2))).isin(*known), key(F.element_at(parts, 1))).otherwise(key(t))


def text_similarity(a: Column, b: Column) -> Column:
    """1 for equal first 55 characters (letters and digits, single spaces), else shared words over the larger set; 0 for blanks."""
    flat = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))
    x, y = flat(a), flat(b)
    s, t = tokens(x), tokens(y)
    share = F.size(F.array_intersect(s, t)) / F.greatest(F.size(s), F.size(t), F.lit(1))
    return F.when((x == "") | (y == ""), F.lit(0.0)).when(F.substring(x, 1, 55) == F.substring(y, 1, 55), F.lit(1.0)).otherwise(share)


def is_role_text(company: Column, role: Column, generic: Sequence[str]) -> Column:
    """Whether a company field only repeats the role or is made of generic role words."""
    c, r = company_name(company), company_name(role)
    words = F.split(c, " ")
    return (c != "") & ((c == r) | F.forall(words, lambda w: w.isin(*generic)))


def percent_increase(text: Column) -> tuple[Column, Column]:
    """(low, high) of a raise in percent; `10-15%` is a range; null without a percentage or beyond 500."""
    t = F.replace(F.coalesce(text, F.lit("")), F.lit("％"), F.lit("%"))
    number, unit = r"([+-]?\d+(?:\.\d+)?)", r"(?:%|percent|pct)"
    pair = rf"(?i){number}\s*(?:{unit})?\s*(?:-|–|—|to|until|~)\s*{number}\s*{unit}"
    one = rf"(?i){number}\s*{unit}"
    a = F.coalesce(F.nullif(F.regexp_extract(t, pair, 1), F.lit("")), F.nullif(F.regexp_extract(t, one, 1), F.lit(""))).try_cast("double")
    b = F.coalesce(F.nullif(F.regexp_extract(t, pair, 2), F.lit("")), F.nullif(F.regexp_extract(t, one, 1), F.lit(""))).try_cast("double")
    fine = (F.least(a, b) > -100) & (F.greatest(F.abs(a), F.abs(b)) <= 500)
    return F.when(fine, F.least(a, b)), F.when(fine, F.greatest(a, b))


def pay_display(currency: Column, low: Column, high: Column, equivalent: bool = False) -> Column:
    """`MYR 5,000 to MYR 6,000/month`; one amount if both are equal; empty without a low one."""
    prefix = F.when(F.coalesce(currency, F.lit("")) != "", F.concat(currency, F.lit(" "))).otherwise("")
    part = lambda c: F.concat(prefix, F.format_number(c.cast("long"), 0))
    body = F.when(high.isNotNull() & (high.cast("long") != low.cast("long")), F.concat(part(low), F.lit(" to "), part(high))).otherwise(part(low))
    return F.when(low.isNull(), "").otherwise(F.concat(body, F.lit("/month equivalent" if equivalent else "/month")))


def lead_reviewable(company: Column, role: Column, url: Column, bad_companies: Sequence[str], role_words: Sequence[str]) -> Column:
    """A lead worth a look: a real company, a role with a role word, and a web url."""
    c, r = F.lower(squeezed(company)), F.lower(squeezed(role))
    named = F.lit(False)
    for w in role_words:
        named = named | r.contains(w)
    return F.coalesce((c != "") & ~c.isin(*bad_companies) & named & F.lower(url).rlike(r"^https?://"), F.lit(False))


#: Parts of hosts of portals and of application systems, second levels of domains, words that end or are no company.
PORTALS = ("linkedin", "jobstreet", "indeed", "glassdoor", "foundit", "monster", "hiredly", "jobsdb", "mycareersfuture", "kalibrr", "google")
SYSTEMS = ("jobs", "careers", "workdayjobs", "myworkdayjobs", "greenhouse", "lever", "ashbyhq", "smartrecruiters")
SECOND_LEVELS = ("com", "co", "net", "org")
JOB_WORDS = ("job", "jobs", "career", "careers", "vacancy", "vacancies", "recruitment")
NO_COMPANY = ("jobs", "job", "careers", "career", "malaysia", "singapore", "remote", "hiring", "linkedin", "jobstreet", "indeed", "search", "source")


def company_of_host(url: Column) -> Column:
    """The company that a url's host is named for; empty for portals and application systems."""
    host = url_host(url)
    parts = F.split(F.regexp_replace(host, r"^www\.", ""), r"\.")
    from_end = lambda k: F.try_element_at(parts, F.lit(-k))
    base = F.when((F.size(parts) >= 3) & from_end(2).isin(*SECOND_LEVELS), from_end(3)).when(F.size(parts) >= 2, from_end(2)).otherwise(from_end(1))
    named = F.trim(F.regexp_replace(base, "[-_]+", " "))
    return F.when((host == "") | host.rlike("|".join(PORTALS)) | (named == "") | named.isin(*SYSTEMS), "").otherwise(F.initcap(named))


def guessed_company(text: Column, most: int = 90) -> Column:
    """A company's name out of a title: without what follows words of hiring, jobs and portals, a doubled name once; empty if none is left."""
    strip = lambda c: F.regexp_replace(c, r"^[ \-|,•:]+|[ \-|,•:]+$", "")
    t = strip(squeezed(text))
    ends = [w for w in PORTALS if w != "google"] + ["serpapi", "tavily"]
    for tail in (r"\b(?:is\s+)?hiring\b.*$", r"\bis\s*$", rf"\b(?:{'|'.join(JOB_WORDS)})\b.*$", rf"\b(?:{'|'.join(ends)})\b.*$"):
        t = strip(F.regexp_replace(t, f"(?i){tail}", ""))
    t = F.regexp_replace(t, r"(?i)^(.+) \1$", "$1")
    t = strip(F.regexp_replace(t, r"(?i)^(\S+) (?=\1(?: |$))", ""))
    return let(strip(F.substring(t, 1, most)), lambda x: F.when(F.lower(x).isin(*NO_COMPANY) | (F.length(x) < 2), "").otherwise(x))
