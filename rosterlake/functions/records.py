"""Keys, names and safe forms of loosely shaped records, given as maps of text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .redact import external_text

#: Fields in which a record's identity, label, kind of work and name may stand; headers that are secret.
FIELD_IDS = ("fieldId", "fieldID", "customFieldId", "customFieldID", "id")
LABELS = ("name", "label", "fieldName", "customFieldName", "displayName", "title")
WORK_IDS = ("id", "workTypeId", "workTypeID", "typeId", "typeID")
WORK_NAMES = ("workType", "type", "name", "label")
NAMES = ("name", "fullName", "displayName")
SECRET_HEADERS = ("authorization", "proxy-authorization", "cookie", "set-cookie", "x-api-key", "api-key")
_MODEL_SECRETS = ("sk-[a-z0-9]", "api[_-]?key", "access[_-]?token", "client[_-]?secret", "password", "authorization", "bearer(?:[._:/-]|$)")
NO_BILLING = "Provider-authoritative billing was not returned."


def first_of(record: Column, fields: Sequence[str], blank_counts: bool = False) -> Column:
    """The first field that is given: not null, and not empty (not blank either, unless blank_counts)."""
    value = lambda f: F.when((record[f] if blank_counts else F.trim(record[f])) != "", record[f])
    return F.coalesce(*map(value, fields))


def folded(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def label(record: Column) -> Column:
    return F.coalesce(folded(first_of(record, LABELS)), F.lit(""))


def field_key(record: Column) -> Column:
    """id: and the identity, else label: and the label, else empty."""
    own = first_of(record, FIELD_IDS, blank_counts=True)
    return F.when(own.isNotNull(), F.concat(F.lit("id:"), F.lower(F.trim(own)))).when(label(record) != "", F.concat(F.lit("label:"), label(record))).otherwise("")


def work_key(record: Column) -> Column:
    """id: and the identity, else work: and the kind of work, else empty."""
    own, kind = (first_of(record, f, blank_counts=True) for f in (WORK_IDS, WORK_NAMES))
    return F.when(own.isNotNull(), F.concat(F.lit("id:"), F.lower(F.trim(own)))).when(kind.isNotNull(), F.concat(F.lit("work:"), folded(kind))).otherwise("")


def preview_name(record: Column, row_id: Column) -> Column:
    """The record's name, else first and last one, else `Candidate` and the id."""
    both = F.trim(F.concat_ws(" ", F.trim(F.coalesce(record["firstName"], F.lit(""))), F.trim(F.coalesce(record["lastName"], F.lit("")))))
    fallback = F.concat(F.lit("Candidate "), F.substring(F.coalesce(row_id.cast("string"), F.lit("")), 1, 40))
    return F.coalesce(F.substring(first_of(record, NAMES, blank_counts=True), 1, 160), F.substring(F.nullif(both, F.lit("")), 1, 160), fallback)


def safe_headers(headers: Column) -> Column:
    """Headers with secret ones marked and the others' values redacted."""
    return F.transform_values(headers, lambda k, v: F.when(F.lower(k).isin(*SECRET_HEADERS), "[redacted]").otherwise(external_text(v, 1000)))


def safe_model(name: Column) -> Column:
    """A model's name if it is one and no secret; a mark if not; empty for blank."""
    t = F.trim(F.coalesce(name, F.lit("")))
    fine = (F.length(t) <= 160) & t.rlike(r"^[A-Za-z0-9][A-Za-z0-9._:/-]*$") & ~F.lower(t).rlike("|".join(_MODEL_SECRETS))
    return F.when(t == "", "").when(fine, t).otherwise("[redacted-or-invalid-model]")


def billing_reason(text: Column) -> Column:
    """Why there is no bill, secrets marked; at most 500 characters."""
    t = F.trim(F.when(F.coalesce(text, F.lit("")) == "", NO_BILLING).otherwise(text))
    for pattern, to in (
        (r"(?i)(authorization\s*[:=]\s*bearer\s+)[^\s,;]+", "$1[redacted]"),
        (r"(?i)((?:api[_-]?key|access_token|client_secret|password)\s*[:=]\s*)[^\s,;}]+", "$1[redacted]"),
        (r"(?i)\bsk-[\w.-]+", "[redacted]"),
    ):
        t = F.regexp_replace(t, pattern, to)
    return F.substring(t, 1, 500)


def billing_unavailable(provider: Column, observed: Column, reason: Column) -> Column:
    """A bill's row where the provider gives none: no amount, and why."""
    return F.struct(
        F.lower(F.trim(provider)).alias("provider"), F.lit(None).cast("decimal(18,6)").alias("amount"), F.lit("unavailable").alias("status"),
        F.greatest(F.coalesce(observed, F.lit(0)), F.lit(0)).cast("bigint").alias("observed_operations"), billing_reason(reason).alias("reason"),
    )
