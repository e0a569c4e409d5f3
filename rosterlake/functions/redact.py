"""Redaction columns: chains of regular expressions, all JVM-side."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"


@dataclass(frozen=True)
class Kind:
    """A kind of private text: names of fields that hold it, or the shape that it has anywhere, and the mark that takes its place.

    A named value follows a colon or an equals sign, or in a url's query its
    parameter, and is a run of `value`; the name stays.
    """

    mark: str
    shape: str = ""
    names: tuple[str, ...] = ()
    value: str = r"[^\s,;}\"']"
    join: str = "[-_]?"
    in_query: bool = False
    lead: str = ""

    def rule(self) -> tuple[str, str]:
        if self.shape:
            return self.shape, self.mark
        name = "(?:" + "|".join(self.join.join(n.split()) for n in self.names) + ")"
        before = rf"[?&]{name}=" if self.in_query else rf"[\"']?{name}[\"']?\s*[:=]\s*{self.lead}"
        return rf"(?i)({before}){self.value}+", "$1" + self.mark


#: Names of fields that hold secrets, the beginnings of keys, marks, and where private paths begin.
_TOKENS = ("access token", "refresh token", "client secret", "api key", "x-api-key", "password", "device code")
_JOURNAL = ("access token", "refresh token", "id token", "token", "client secret", "api key", "password", "device code", "credential", "cookie", "secret")
_KEYS = ("sk-ant-", "sk-proj-", "sk-")
_HOMES = ("/Users/", "/home/")
_BEARER = Kind("[redacted]", names=("authorization",), lead=r"bearer\s+")
EXTERNAL: tuple[Kind, ...] = (
    _BEARER,
    Kind("[redacted]", names=(*_TOKENS, "code"), value=r"[^&\s]", in_query=True),
    Kind("[redacted]", names=(*_TOKENS, "candidate id"), lead="[\"']?"),
    Kind("[redacted]", rf"(?i)\b(?:{'|'.join(_KEYS)})[\w.-]{{8,}}"),
    Kind("[redacted-email]", EMAIL),
)
JOURNAL: tuple[Kind, ...] = (
    _BEARER,
    Kind("[redacted]", names=_JOURNAL, value=r"[^\s,;}]"),
    Kind("[email redacted]", EMAIL),
    Kind("[candidate redacted]", names=("candidate", "candidate id"), value=r"[\w.:-]", join="[-_ ]?"),
    Kind("[private path]", r"(?i)\b[A-Z]:\\[^\r\n]*"),
    Kind("[private path]", rf"(?i)(?:{'|'.join(_HOMES)})[^\s\"']+"),
)


def _marked(text: Column, kinds: Sequence[Kind], limit: int) -> Column:
    for pattern, to in (k.rule() for k in kinds):
        text = F.regexp_replace(text, pattern, to)
    return F.substring(text, 1, limit)


def without_emails(text: Column, mark: str = "[redacted-email]") -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), EMAIL, mark)


def without_phones(text: Column, mark: str = "[redacted-phone]") -> Column:
    """Runs of 8 to 15 digits with the usual signs between them; years and ranges of years stay."""
    t = F.coalesce(text, F.lit(""))
    keep_years = r"(?<![\w.])(?!(?:19|20)\d{2}\s*[-–]\s*(?:19|20)\d{2}(?!\d))(?=(?:\D{0,3}\d){8,15}(?!\d))\+?\d[\d ().-]{6,}\d(?!\w)"
    return F.regexp_replace(t, keep_years, mark)


def external_text(text: Column, limit: int = 4000) -> Column:
    """Without the kinds of EXTERNAL; at most limit characters."""
    return _marked(F.coalesce(text, F.lit("")), EXTERNAL, limit)


def job_text(text: Column, limit: int = 240) -> Column:
    """One line for a journal: control characters out, the kinds of JOURNAL marked."""
    return _marked(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\p{Cntrl}+", " ")), JOURNAL, limit)


def email_in(text: Column) -> Column:
    """The first address, lower case; empty if none or over 254 characters."""
    found = F.lower(F.regexp_extract(F.coalesce(text, F.lit("")), f"({EMAIL})".replace("((?i)", "(?i)("), 1))
    return F.when(F.length(found) <= 254, found).otherwise("")


def email_domain(email: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(email, F.lit("")), r"^[^@\s]+@([A-Za-z0-9.-]+\.[A-Za-z]{2,})$", 1))


def email_state(text: Column) -> Column:
    """ok, invalid, or unsupported (quoted local parts, other scripts)."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return (
        F.when(t.rlike(r'^"|[^\x00-\x7f]'), "unsupported")
        .when((F.length(t) <= 254) & t.rlike(r"^[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+(?:\.[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+)*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,63}$") & (F.instr(t, "@") <= 65), "ok")
        .otherwise("invalid")
    )


def business_email(email: Column, personal_domains: tuple[str, ...]) -> Column:
    domain = email_domain(email)
    return (domain != "") & ~domain.isin(*personal_domains)


def phone_in(text: Column) -> Column:
    """The first run of 8 to 15 digits with phone signs that is no date; else empty."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\+?\d[\d ().-]{6,}\d)"), F.lit(1))
    digits = lambda x: F.regexp_replace(x, r"\D", "")
    good = F.filter(found, lambda x: F.length(digits(x)).between(8, 15) & ~digits(x).rlike(r"^(?:19|20)\d{6,}$") & (F.length(x) <= 50))
    return F.coalesce(F.try_element_at(good, F.lit(1)), F.lit(""))


def secret_field(name: Column) -> Column:
    return F.lower(name).rlike(r"token|secret|password|api[-_]?key|credential|cookie|authorization")
