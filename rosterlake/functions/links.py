"""Identities of links: what a url of a network or a job board stands for, whatever else it carries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hosts of one network, and of one job board.
NETWORK = ("linkedin.com", "www.linkedin.com", "my.linkedin.com", "sg.linkedin.com")
BOARDS = ("my.jobstreet.com", "sg.jobstreet.com", "id.jobstreet.com", "ph.jobstreet.com", "www.jobstreet.com.my", "www.jobstreet.com.sg", "www.jobstreet.com.ph", "www.jobstreet.co.id", "jobstreet.com", "www.jobstreet.com")
_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, _URL, k)


def plain_https(url: Column, hosts: Sequence[str]) -> Column:
    """https on just one of the hosts: no user, no port."""
    return (F.lower(_part(url, 1)) == "https") & F.lower(_part(url, 2)).isin(*hosts)


def query_values(url: Column, name: str) -> Column:
    """Values of the parameters whose name fits a regular expression, in order."""
    pairs = F.filter(F.split(_part(url, 4), "&"), lambda p: p.rlike(f"^(?:{name})="))
    return F.transform(pairs, lambda p: F.coalesce(F.try_url_decode(F.regexp_replace(p, "^[^=]*=", "")), F.lit("")))


def _found(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def _one(values: Column, pattern: str) -> Column:
    """The only value, if it fits."""
    return F.when((F.size(values) == 1) & F.element_at(F.concat(values, F.array(F.lit(""))), 1).rlike(pattern), F.element_at(values, 1))


def job_link(url: Column) -> Column:
    """The permalink of the job that a view, search or collection link shows; else empty."""
    u = F.trim(F.coalesce(url, F.lit("")))
    path = _part(u, 3)
    shown = F.when(path.rlike(r"^/jobs(?:/search(?:-results)?|/collections/[^/]+)?/?$"), _one(query_values(u, "currentJobId"), r"^[0-9]{1,24}$"))
    number = F.coalesce(_found(path, r"^/jobs/view/(?:[^/]*-)?([0-9]{1,24})/?$"), shown)
    fine = plain_https(u, NETWORK) & (F.length(url) <= 2048) & ~u.contains("\\")
    return F.coalesce(F.when(fine, F.concat(F.lit("https://www.linkedin.com/jobs/view/"), number)), F.lit(""))


def company_link(url: Column) -> Column:
    """An employer's own page on the network; else empty."""
    name = _found(_part(url, 3), r"^/company/([A-Za-z0-9_-]+)(?:/(?:about|jobs|people))?/?$")
    out = F.concat(F.lit("https://www.linkedin.com/company/"), name, F.lit("/"))
    fine = plain_https(url, NETWORK) & (F.length(url) <= 2048) & ~url.rlike(r"[\x00-\x20\x7f\\]") & (F.length(out) <= 300)
    return F.coalesce(F.when(fine, out), F.lit(""))


def profile_link(url: Column) -> Column:
    """A person's page without tracking; else empty."""
    path = F.regexp_replace(_part(url, 3), "/+$", "")
    open_path = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    fine = plain_https(url, NETWORK[1:2]) & path.rlike(r"^/(?:in/[^/]+|talent/(?:hire/)?profile/[^/]+)$") & ~F.coalesce(open_path, path).rlike(r"[\x00-\x20\\]")
    return F.coalesce(F.when(fine, F.concat(F.lit("https://www.linkedin.com"), path)), F.lit(""))


def board_job(url: Column, hosts: Sequence[str] = BOARDS) -> Column:
    """A board's job number from path and query; empty if they differ or there is none."""
    asked = F.array_distinct(query_values(url, "(?i:job[_-]?id)"))
    own = _found(_part(url, 3), r"^/job/([0-9]{1,24})/?$")
    wrong = F.exists(asked, lambda v: ~v.rlike(r"^[0-9]{1,24}$")) | (F.size(asked) > 1)
    first = F.try_element_at(asked, F.lit(1))
    number = F.when(own.isNotNull(), F.when(first.isNull() | (first == own), own)).otherwise(F.when(F.regexp_replace(_part(url, 3), "/+$", "") == "/jobs", first))
    return F.coalesce(F.when(plain_https(url, hosts) & ~wrong, number), F.lit(""))


def board_detail(url: Column, hosts: Sequence[str] = BOARDS) -> Column:
    """The page of the board's job that a link is of; else empty."""
    number = board_job(url, hosts)
    return F.when(number == "", "").otherwise(F.concat(F.lit("https://"), F.lower(_part(url, 2)), F.lit("/job/"), number))


def without_collection(url: Column) -> Column:
    """A link into a recommended collection as the permalink of its job of at least 5 digits; other links as they are."""
    u = F.trim(F.coalesce(url, F.lit("")))
    low = F.lower(u)
    number = F.try_element_at(query_values(low, "currentjobid"), F.lit(1))
    here = _part(low, 2).contains("linkedin.com") & _part(low, 3).contains("/jobs/collections/recommended") & number.rlike(r"^\d{5,}$")
    return F.when(F.coalesce(here, F.lit(False)), F.concat(F.lit("https://www.linkedin.com/jobs/view/"), number, F.lit("/"))).otherwise(u)


def is_own_search(url: Column) -> Column:
    """Whether a link is a web search that only helps to verify."""
    low = F.lower(F.coalesce(url, F.lit("")))
    return _part(low, 2).contains("google.") & _part(low, 3).startswith("/search")
