"""URL, HTML and JSON columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that break lines.
BLOCKS = ("address", "article", "aside", "blockquote", "br", "div", "dl", "dt", "dd", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul")
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def url_host(url: Column) -> Column:
    """Lower-case host without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def canonical_url(url: Column) -> Column:
    """https, host without www, path without its last slashes; no query, no fragment; all lower case. Empty if there is no host."""
    host = F.regexp_replace(url_host(url), r"^www\.", "")
    return F.when(host == "", "").otherwise(F.lower(F.concat(F.lit("https://"), host, F.regexp_replace(url_path(url), "/+$", ""))))


def host_allowed(url: Column, hosts: Sequence[str]) -> Column:
    """https on one of the hosts or their subdomains."""
    host = url_host(url)
    out = F.lit(False)
    for h in hosts:
        out = out | (host == h.lower()) | host.endswith("." + h.lower())
    return F.coalesce(F.lower(url).startswith("https://") & out, F.lit(False))


def host_label(url: Column, labels: Sequence[tuple[str, str]], default: str) -> Column:
    """The label of the first part that the host holds."""
    host = url_host(url)
    out = F.lit(default)
    for part, label in reversed(labels):
        out = F.when(host.contains(part), F.lit(label)).otherwise(out)
    return out


def numeric_id(url: Column, least_digits: int = 5) -> Column:
    """The first run of at least so many digits in the path, else empty."""
    return F.regexp_extract(url_path(url), rf"(\d{{{least_digits},}})", 1)


def path_has_any(url: Column, markers: Sequence[str]) -> Column:
    path = F.lower(url_path(url))
    out = F.lit(False)
    for m in markers:
        out = out | path.contains(m)
    return out


def html_text(html: Column) -> Column:
    """Text of HTML: scripts, styles and comments out, block elements as line ends, entities decoded, spaces squeezed."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?-->", "")
    t = F.regexp_replace(t, r"(?is)<(script|style|noscript)\b[^>]*>.*?</(script|style|noscript)\s*>", "")
    t = F.regexp_replace(t, r"(?i)</?(?:" + "|".join(BLOCKS) + r")\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", "")
    for name, sign in _ENTITIES:
        t = F.replace(t, F.lit(name), F.lit(sign))
    for pattern, to in ((r"[ \t]+", " "), (r"\n[ \t]+", "\n"), (r"\n{3,}", "\n\n")):
        t = F.regexp_replace(t, pattern, to)
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1))


def links(html: Column) -> Column:
    """Distinct href values in order."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r'(?i)\bhref="([^"]*)"'), F.lit(1))
    return F.array_distinct(found)


def urls_in(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(https?://[^\s<>\"')\]]+)"), F.lit(1)))


def json_ld(html: Column) -> Column:
    """The first JSON-LD block, else empty."""
    return F.trim(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>", 1))


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the parts as text, joined by the unit separator; null counts as empty."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def content_kind(content: Column) -> Column:
    """ole, pdf, zip, png, jpeg, gif or unknown by the first bytes."""
    head = F.hex(F.substring(content, 1, 8))
    out = F.lit("unknown")
    for magic, kind in (("474946", "gif"), ("FFD8FF", "jpeg"), ("89504E47", "png"), ("504B0304", "zip"), ("25504446", "pdf"), ("D0CF11E0A1B11AE1", "ole")):
        out = F.when(head.startswith(magic), F.lit(kind)).otherwise(out)
    return out


def filename_of(disposition: Column, fallback: str = "") -> Column:
    """The file name of a Content-Disposition header, URL-decoded."""
    star = F.regexp_extract(F.coalesce(disposition, F.lit("")), r"(?i)filename\*=(?:UTF-8'')?\"?([^\";]+)", 1)
    plain = F.regexp_extract(F.coalesce(disposition, F.lit("")), r"(?i)filename=\"?([^\";]+)", 1)
    found = F.coalesce(F.nullif(star, F.lit("")), F.nullif(plain, F.lit("")), F.lit(fallback))
    return F.trim(F.coalesce(F.try_url_decode(found), found))
