"""Links of job leads: pages of many jobs, searches that verify, and the one link that a lead keeps.

Columns of a lead are text, blank or null where nothing is known; a lead that has
no usable link keeps blank ones.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dates import freshness, posted_date
from .lead_filters import excluded_terms, query_terms, terms
from .leads import EDITORIAL, is_job_page, parts_of_job_page, source_chosen, url_parts
from .links import is_own_search, without_collection
from .people import families, family_scores
from .text import bound, let, squeezed
from .web import url_host

#: Parts of portals' hosts, first path parts of a board's account pages, parameters of searches.
PORTAL_HOSTS = ("linkedin.com", "jobstreet", "jobsdb", "indeed", "glassdoor", "hiredly", "mycareersfuture", "kalibrr", "monster", "foundit")
ACCOUNT_PAGES = ("companies", "my-activity", "profile", "sign-in", "login", "register", "account", "saved-jobs", "saved", "applied-jobs", "applied", "applications")
SEARCH_FIELDS = ("keyword", "keywords", "q", "query", "location", "where", "search", "page", "fromage", "salary")
#: Employers that are none, whole (without signs) and as first words.
NO_EMPLOYER = ("unknown", "unknownemployer", "unknowncompany", "na", "none", "notavailable", "notspecified", "notprovided", "notvisible", "employernotvisible", "companynotvisible", "confidential", "undisclosed", "tbc", "tbd")
NO_EMPLOYER_FIRST = ("unknown", "na", "n/a", "not specified", "not provided", "not visible", "not available", "employer visible", "employer not visible", "company visible", "company not visible", "confidential", "undisclosed")
#: Words for an unknown posting day, qualities of a lead's link, notes.
UNKNOWN_DAY = ("unknown", "n/a", "na", "not available", "not visible", "not shown", "unspecified", "none", "-")
DIRECT, STRUCTURED, TO_VERIFY, NO_DIRECT = "direct_job_ad", "structured_google_job", "needs_verification", "source_or_search_result_only"
NOTE_REPLACED = "The portal only returned a generic title-search page (not specific to this employer); replaced with a targeted search combining the employer, role, and portal so it can actually be verified."
NOTE_STRUCTURED = "Structured Google Jobs returned only a generic/search URL, not a direct job-post permalink; verify before outreach."
NOTE_NO_DIRECT = "Direct job-ad URL was not available; kept the portal/search/company source separately."
#: A portal's search page; {q} are the words, {l} the places, {ql} both.
SEARCH_PAGES = (
    ("linkedin", "https://www.linkedin.com/jobs/search/?keywords={q}&location={l}"),
    ("jobstreet", "https://{board}/jobs?keywords={q}"),
    ("jobsdb", "https://hk.jobsdb.com/jobs?keywords={ql}"),
    ("indeed", "https://www.indeed.com/jobs?q={q}&l={l}"),
    ("glassdoor", "https://www.glassdoor.com/Job/jobs.htm?sc.keyword={q}&locT=&locId=&locKeyword={l}"),
    ("hiredly", "https://my.hiredly.com/jobs?keyword={q}"),
    ("mycareersfuture", "https://www.mycareersfuture.gov.sg/search?search={q}"),
    ("kalibrr", "https://www.kalibrr.com/job-board/te/{q}"),
    ("monster", "https://www.foundit.my/srp/results?query={ql}"),
    ("foundit", "https://www.foundit.my/srp/results?query={ql}"),
)
BOARD_HOSTS = (("singapore", "sg", "www.jobstreet.com.sg"), ("indonesia", "id", "id.jobstreet.com"), ("philippines", "ph", "www.jobstreet.com.ph"))
BOARD_HOST = "www.jobstreet.com.my"
WEB_SEARCH = "https://www.google.com/search?q="


def _given(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def _noted(note: Column, more: Column) -> Column:
    """A note with one more, once."""
    return F.when((more == "") | note.contains(more), note).when(note == "", more).otherwise(F.concat_ws(" ", note, more))


def percent_encoded(text: Column, form: bool = False) -> Column:
    """UTF-8 with signs as %XX: a space is %20 and a slash stays, or in a form's way + and %2F."""
    out = F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    return out if form else F.replace(F.replace(out, F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def is_category_page(url: Column) -> Column:
    """Whether a link shows many employers' jobs, or none: lists, searches and accounts of portals, articles anywhere."""

    def told(p: Column) -> Column:
        host, path = p["host"], p["path"]
        account = host.rlike("jobstreet|jobsdb") & path.rlike(rf"^/(?:{'|'.join(ACCOUNT_PAGES)})(?:/|$)")
        many = path.isin("", "/") | path.rlike(r"-jobs(?:/|$|\.html$)|/(?:jobs|job-search|search)(?:/|$)") | p["query"].rlike(rf"(?:^|&)(?:{'|'.join(SEARCH_FIELDS)})=")
        portal = host.rlike("|".join(x.replace(".", r"\.") for x in PORTAL_HOSTS))
        return ~parts_of_job_page(p) & (path.rlike("|".join(EDITORIAL)) | (portal & (account | many)))

    return let(url_parts(url), told)


def employer_text(company: Column) -> Column:
    """An employer that a search can name; empty for words that stand for none."""
    first = "|".join(w.replace(" ", r"\s+") for w in NO_EMPLOYER_FIRST)

    def told(t: Column) -> Column:
        compact = F.regexp_replace(F.lower(t), "[^a-z0-9]+", "")
        return F.when((compact == "") | compact.isin(*NO_EMPLOYER) | t.rlike(rf"(?i)^(?:{first})\b"), "").otherwise(t)

    return let(squeezed(company), told)


def web_search(company: Column, role: Column, *more: Column) -> Column:
    """A web search of an employer and a role, both in quotes, and further words; blank ones left out."""
    quote = lambda c: let(c, lambda x: F.when(x != "", F.concat(F.lit('"'), x, F.lit('"'))))
    words = F.concat_ws(" ", quote(employer_text(company)), quote(squeezed(role)), *(F.nullif(m, F.lit("")) for m in more))
    return F.concat(F.lit(WEB_SEARCH), percent_encoded(words))


def _host_search(url: Column, company: Column, role: Column) -> Column:
    return web_search(company, role, F.concat(F.lit("site:"), url_host(url)))


def verification_link(url: Column, company: Column, role: Column) -> Column:
    """struct(url, note): a category page as a search for the employer and role on its host; other links as they are."""
    as_search = lambda many: F.struct(F.when(many, _host_search(url, company, role)).otherwise(url).alias("url"), F.when(many, NOTE_REPLACED).otherwise("").alias("note"))
    return let(is_category_page(url), as_search)


def with_one_link(leads: DataFrame) -> DataFrame:
    """leads (company, matched_role, title, job_url, source_url, company_url, job_url_quality, source_note) with job_url a job's own page or blank.

    The first such page among the links becomes job_url; without one, or where the
    quality says so, a link to verify by goes to source_url, a category page as a
    search. Columns that a lead has beside these stay.
    """
    given = {f"__{n}": _given(F.col(c)) for n, c in (("j", "job_url"), ("s", "source_url"), ("c", "company_url"), ("q", "job_url_quality"), ("note", "source_note"))}
    j, s, c, q, note, plan, which, swap, old = (F.col(f"__{n}") for n in ("j", "s", "c", "q", "note", "plan", "which", "swap", "old"))
    many_j, many_s, has_j = F.col("__many_j"), F.col("__many_s"), j != ""
    role = F.coalesce(F.nullif(_given(F.col("matched_role")), F.lit("")), _given(F.col("title")))
    seen = bound(leads.withColumns(given), __many_j=is_category_page(j), __many_s=is_category_page(s), __direct=F.coalesce(*(F.when(is_job_page(u), u) for u in (j, s, c)), F.lit("")))
    said = (
        F.when(q == TO_VERIFY, "verify")
        .when((q == STRUCTURED) & j.rlike("(?i)^https?://") & ~many_j, "structured")
        .when((q == STRUCTURED) & many_j, "demoted")
        .when(F.col("__direct") != "", "direct")
        .otherwise("none")
    )
    planned = bound(seen, __plan=said).withColumn(
        "__which",  # the link that a source is made of, if any
        F.when(plan.isin("structured", "direct"), "")
        .when(plan == "none", F.when(many_s, "s").when(many_j | (has_j & (s == "")), "j").otherwise(""))
        .otherwise(F.when(has_j, "j").when(s != "", "s").otherwise("")),
    )
    ready = planned.withColumns({"__old": F.when(which == "j", j).otherwise(s), "__swap": ((which == "j") & many_j) | ((which == "s") & many_s)})
    more = F.when(swap, NOTE_REPLACED)
    return ready.withColumns(
        {
            "job_url": F.when(plan == "structured", j).when(plan == "direct", without_collection(F.col("__direct"))).otherwise(""),
            "source_url": F.when(swap, _host_search(old, F.col("company"), role)).otherwise(old),
            "job_url_quality": F.when(plan.isin("verify", "demoted"), TO_VERIFY).when(plan == "structured", STRUCTURED).when(plan == "direct", DIRECT).otherwise(NO_DIRECT),
            "source_note": F.when(plan == "demoted", _noted(note, F.concat_ws(" ", F.lit(NOTE_STRUCTURED), more)))
            .when((plan == "none") & has_j, _noted(_noted(note, F.coalesce(more, F.lit(""))), F.lit(NOTE_NO_DIRECT)))
            .otherwise(_noted(note, F.coalesce(more, F.lit("")))),
        }
    ).drop(*given, "__many_j", "__many_s", "__direct", "__plan", "__which", "__old", "__swap")


def with_fit_and_freshness(leads: DataFrame, as_of: date) -> DataFrame:
    """leads with one link each (see with_one_link) and job_fit_percent, match_score, date_posted, days_open and job_freshness filled.

    Fit: the first given of job_fit_percent, match_score and score, else 78 where the
    link is a job's own or the lead was extracted, 68 elsewhere. The day: date_posted,
    posted_date, posted or job_posted, else as_of less days_open; blank if unknown.
    """
    has = lambda n: _given(F.col(n)) if n in leads.columns else F.lit("")
    first = lambda *names: F.coalesce(*(F.nullif(has(n), F.lit("")) for n in names))
    good = F.lower(F.col("job_url_quality")).isin(DIRECT, STRUCTURED) | (F.lower(has("lead_kind")) == "extracted_job_lead")
    fit = F.coalesce(first("job_fit_percent", "match_score", "score"), F.when(good, "78").otherwise("68")).try_cast("double")
    said = F.coalesce(first("date_posted", "posted_date", "posted", "job_posted"), F.lit(""))
    iso, read = posted_date(F.col("__said"), as_of)
    days = F.coalesce(F.col("__read"), has("days_open").try_cast("int"))
    day = F.when(F.col("__read").isNotNull(), F.col("__iso")).when(days.isNotNull(), F.date_sub(F.lit(as_of), F.greatest(days, F.lit(0))).cast("string")).when(F.lower("__said").isin(*UNKNOWN_DAY), "").otherwise(F.col("__said"))
    own = has("job_freshness")
    staged = with_one_link(leads).withColumn("__fit", F.coalesce(F.greatest(F.lit(0), F.least(F.lit(100), F.bround(fit))).cast("int"), F.lit(0))).withColumn("__said", said)
    staged = bound(staged, __iso=iso, __read=read)
    return staged.withColumns({"job_fit_percent": F.col("__fit"), "match_score": F.col("__fit"), "date_posted": day, "days_open": days, "job_freshness": F.when((own == "") | (F.lower(own) == "unknown"), freshness(days)).otherwise(own)}).drop("__fit", "__said", "__iso", "__read")


def without_unchosen_sources(leads: DataFrame, chosen: Sequence[str], portals: Sequence[str], site: str, name: str) -> DataFrame:
    """leads without links to portals that were not chosen; a lead left without a source gets a search of `site` (a blank site: of the word `name`).

    No choice changes nothing; searches that only verify are no portal's.
    """
    if not [x for x in chosen if x.strip()]:
        return leads
    hint, role = _given(F.col("job_portal")), F.coalesce(*(F.nullif(_given(F.col(n)), F.lit("")) for n in ("matched_role", "title")), F.lit(""))
    bad = lambda n: (_given(F.col(n)) != "") & ~is_own_search(F.col(n)) & ~source_chosen(F.col(n), hint, chosen, portals)
    staged = leads.withColumn("__bad", F.struct(bad("job_url").alias("job"), bad("source_url").alias("source")))
    job, source = F.col("__bad")["job"], F.col("__bad")["source"]
    searched = (job | source) & (source | (_given(F.col("source_url")) == ""))
    note = f"Removed a URL from an unselected portal and replaced it with a targeted verification search for {name}."
    return staged.withColumns(
        {
            "job_url": F.when(job, "").otherwise(F.col("job_url")),
            "job_url_quality": F.when(job, TO_VERIFY).otherwise(F.col("job_url_quality")),
            "lead_kind": F.when(job, "job_lead_needs_verification").otherwise(F.col("lead_kind")),
            "source_url": F.when(searched, web_search(F.col("company"), role, F.lit(f"site:{site}" if site else name))).otherwise(F.col("source_url")),
            "source_note": F.when(searched, _noted(_given(F.col("source_note")), F.lit(note))).otherwise(F.col("source_note")),
        }
    ).drop("__bad")


def direct_job_leads(leads: DataFrame, place: str) -> DataFrame:
    """The leads of a job's own page, the first by `place` of those with one link; lead_kind says so."""
    judged = bound(bound(with_one_link(leads), job_url=F.col("job_url")), __page=is_job_page(F.col("job_url")))
    linked = judged.filter("__page").drop("__page").withColumn("lead_kind", F.lit("extracted_job_lead"))
    key = F.regexp_replace(F.lower(F.trim("job_url")), "/+$", "")
    first = linked.groupBy(key.alias("__key")).agg(F.min_by(F.struct(*linked.columns), place).alias("x"))
    return first.select("x.*")


def clean_filters(said: Mapping[str, object]) -> dict[str, str]:
    """The filters that a user gave, in one form; blank ones left out."""
    lists = {"must_have": 12, "exclude_keywords": 12, "company_include": 10, "company_exclude": 10}
    out = {k: ", ".join(terms(said.get(k), most)) for k, most in lists.items()}
    out |= {k: " ".join(str(said.get(k) or "").split()) for k in ("seniority", "work_setup", "employment_type")}
    out["max_days_open"] = "".join(ch for ch in str(said.get("max_days_open") or "") if ch in "0123456789")[:3]
    return {k: v for k, v in out.items() if v}


def portal_search(source: Column, title: Column, regions: Sequence[str], filters: Mapping[str, object] | None = None) -> Column:
    """A portal's search page for a title in the regions; a web search where the portal is not known."""
    places = ", ".join(r.strip() for r in regions if r.strip())
    name = F.coalesce(F.nullif(_given(source), F.lit("")), F.lit("Public job portal"))
    extra = [x for x in (query_terms(filters or {}), excluded_terms(filters or {})) if x]
    words = F.concat_ws(" ", F.coalesce(F.nullif(_given(title), F.lit("")), F.lit("jobs")), *map(F.lit, extra))
    first = regions[0].strip().lower() if regions else ""
    board = next((host for word, code, host in BOARD_HOSTS if word in first or code == first), BOARD_HOST)
    parts = {"q": percent_encoded(words, form=True), "l": percent_encoded(F.lit(places), form=True), "ql": percent_encoded(F.trim(F.concat_ws(" ", words, F.lit(places))), form=True), "board": F.lit(board)}
    out = F.concat(F.lit(WEB_SEARCH), percent_encoded(F.concat_ws(" ", name, words, F.lit(places), F.lit("jobs")), form=True))
    for portal, page in reversed(SEARCH_PAGES):
        filled = F.lit(page)
        for k, v in parts.items():
            filled = F.replace(filled, F.lit("{" + k + "}"), v)
        out = F.when(F.lower(name).contains(portal), filled).otherwise(out)
    return out


def primary_families(target: Column, resume: Column, context: Column, industries: Column, patterns: dict[str, Sequence[str]], boosts: dict[str, Sequence[tuple[str, int]]]) -> Column:
    """At most two families of work: the target's own, else those of the beginnings of resume, context and industries."""
    head = lambda c, n: F.substring(F.coalesce(c, F.lit("")), 1, n)
    own = families(family_scores(target, patterns, boosts), 2)
    rest = families(family_scores(F.concat_ws(" ", head(resume, 3500), head(context, 1200), head(industries, 500)), patterns, boosts), 2)
    return F.when(F.size(own) > 0, own).otherwise(rest)


def search_target(target: Column, resume_families: Column, target_families: Column, titles: Mapping[str, str], other: str = "Relevant open role") -> Column:
    """struct(role, note): the title to search for; the resume's first family's own title where no family is shared or no target is given."""
    t = squeezed(target)
    named = F.create_map(*(F.lit(x) for kv in titles.items() for x in kv))
    own = F.when(F.size(resume_families) > 0, F.coalesce(F.try_element_at(named, F.try_element_at(resume_families, F.lit(1))), F.lit(other))).otherwise("")
    apart = (t != "") & (F.size(target_families) > 0) & (F.size(resume_families) > 0) & ~F.arrays_overlap(target_families, resume_families)
    note = F.concat(F.lit('Target role "'), t, F.lit('" looked inconsistent with the uploaded CV role family; Lead Finder anchored job search to "'), own, F.lit('" to avoid unrelated job leads.'))
    return F.struct(F.when(apart | (t == ""), own).otherwise(t).alias("role"), F.when(apart, note).otherwise("").alias("note"))
