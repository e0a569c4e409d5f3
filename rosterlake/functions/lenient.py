"""Lenient readers of single values: numbers, flags, rates, years, stamps. What cannot be read is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as true and false, and codes that are shown otherwise.
TRUE, FALSE = ("true", "yes", "1", "on"), ("false", "no", "0", "off", "")
LABELS = {"MYR": "RM"}
MOST = 10**15
_OPEN = r"(?i)\b(?:open|negotiable|nego|discuss|tbd|n/?a|not\s+available|flexible)\b"
#: How a text says that the current pay is fine.
_SAME = (
    r"same\s+as\s+current", r"same\s+current", r"(?:maintain|match)\s+(?:the\s+)?current", r"no\s+(?:increment|increase|change)", r"(?:horizontal|lateral)\s+move",
    r"current\s+(?:salary|package|compensation)\s+(?:is\s+)?(?:ok|okay|fine|acceptable)", r"open\s+to\s+current", r"as\s+current",
)


def number(text: Column) -> Column:
    """A double; else what is left of the text without other signs."""
    plain = F.trim(text.cast("string"))
    direct = F.when(~F.lower(plain).isin("nan", "+nan", "-nan"), plain.try_cast("double"))
    return F.coalesce(direct, F.regexp_replace(plain, r"[^0-9.\-]", "").try_cast("double"))


def exact(text: Column, default: str = "0") -> Column:
    """A decimal of at most MOST in size; blank is the default; null if it is none."""
    given = F.coalesce(F.nullif(text.cast("string"), F.lit("")), F.lit(default))
    d = given.try_cast("decimal(38,12)")
    return F.when(F.abs(d) <= F.lit(MOST), d)


def rate(text: Column) -> Column:
    """A decimal from 0 to 1, else null."""
    d = exact(text)
    return F.when(d.between(0, 1), d)


def bounded(text: Column, least: int = 0, most: int = 10**9) -> Column:
    """A decimal in the closed range, else null."""
    d = text.cast("string").try_cast("decimal(38,12)")
    return F.when(d.between(least, most), d)


def flag(text: Column, default: bool = False) -> Column:
    """A boolean; a null is the default, words other than TRUE and FALSE are null."""
    low = F.lower(F.trim(text.cast("string")))
    return F.when(text.isNull(), F.lit(default)).when(low.isin(*TRUE), F.lit(True)).when(low.isin(*FALSE), F.lit(False))


def tax_year(own: Column, other: Column) -> Column:
    """A whole year from 1900 to 2200 of the first that is given, else null."""
    y = F.coalesce(F.nullif(F.trim(own.cast("string")), F.lit("")), other.cast("string")).try_cast("int")
    return F.when(y.between(1900, 2200), y)


def fresh(stamp: Column, as_of: Column, hours: float) -> Column:
    """Whether an ISO stamp (UTC where it has no zone) is at most so many hours old, and not of the future."""
    t = F.try_to_timestamp(F.when(stamp.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$"), stamp).otherwise(F.concat(stamp, F.lit("Z"))))
    age = F.unix_micros(as_of) - F.unix_micros(t)
    return F.coalesce(age.between(0, int(hours * 3_600_000_000)), F.lit(False))


def amount_given(text: Column) -> Column:
    """Whether a pay note has a real amount: thousands as `k`, or 4 to 8 digits."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit(","), F.lit("")).rlike(r"(?i)\b\d+(?:\.\d+)?\s*k\b|\b\d{4,8}\b")


def currency_label(code: Column) -> Column:
    c = F.upper(F.coalesce(code, F.lit("")))
    out = c
    for k, v in LABELS.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def same_as_current(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(rf"(?i)\b(?:{'|'.join(_SAME)})\b")


def is_open(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(_OPEN)
