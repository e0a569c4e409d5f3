"""Records checked against rules: what is fine goes on, what is not is kept apart with its first reason.

A reason is one word, null for a record that is fine. Nothing raises: a bad record
stops no job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.links import company_link, job_link, profile_link

#: Most characters of a job lead's fields, its statuses, a profile's metadata, a folder's name.
LEAD_FIELDS = {"url": 2048, "company": 200, "role": 240, "contact": 400, "location": 240, "notes": 10000, "description": 20000, "status": 20, "follow_up": 10, "date_posted": 10, "folder": 80, "date_posted_estimate": 10}
LEAD_DAYS = ("follow_up", "date_posted", "date_posted_estimate")
STATUSES = ("new", "to_contact", "contacted", "follow_up", "won", "closed")
PROFILE_FIELDS = {"title": 500, "location": 240}
FOLDER_LENGTH = 80
RESERVED_FOLDERS = ("*", "!trash")
#: Sources of bills that count, statuses of bills that are not final, bounds of amounts, words that switch a limit off.
BILL_SOURCES = ("provider_cost_report", "provider_invoice", "provider_response")
OPEN_BILLS = ("pending", "delayed", "partial", "unavailable")
MOST_AMOUNT = 10**12
MOST_LIMIT, USUAL_LIMIT = Decimal(10000), Decimal(60)
OFF = ("off", "none", "disabled", "no", "false")


def first_reason(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule that is broken (its column true); null if none is. A rule that cannot be told counts as broken."""
    return F.coalesce(*(F.when(F.coalesce(broken, F.lit(True)), name) for name, broken in rules))


def split(rows: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(fine rows, rejected rows with their reason)."""
    told = rows.withColumn("reason", reason)
    return told.filter("reason IS NULL").drop("reason"), told.filter("reason IS NOT NULL")


def folder_reason(name: Column, unfiled: bool = False) -> Column:
    """A folder's name: of at most 80 characters, no control characters, no reserved word; blank only where a record may be unfiled."""
    bare = F.trim(name)
    return first_reason(("missing", name.isNull()), ("long", F.length(name) > FOLDER_LENGTH), ("signs", name.rlike(r"[\x00-\x1f]")), ("reserved", bare.isin(*RESERVED_FOLDERS)), ("blank", F.lit(not unfiled) & (bare == "")))


def is_day(text: Column) -> Column:
    return text.rlike(r"^\d{4}-\d{2}-\d{2}$") & text.try_cast("date").isNotNull()


def clean_leads(rows: DataFrame) -> DataFrame:
    """Job leads (see LEAD_FIELDS, company_url) trimmed, with canonical links and a reason.

    Fields may be null: status is new then, others blank. Other columns stay.
    """
    fields = {c: F.coalesce(F.col(c), F.lit("new" if c == "status" else "")) for c in LEAD_FIELDS}
    whole = rows.withColumns(fields)
    held = [F.length(c) > most for c, most in LEAD_FIELDS.items()] + [F.contains(c, F.lit("\x00")) for c in map(F.col, LEAD_FIELDS)]
    wrong_day = F.exists(F.array(*(F.trim(c) for c in LEAD_DAYS)), lambda d: (d != "") & ~is_day(d))
    own = F.coalesce(F.col("company_url"), F.lit(""))
    bad_field = held[0]
    for h in held[1:]:
        bad_field = bad_field | h
    checked = whole.withColumn("__bad", bad_field).withColumn("__link", job_link(F.col("url"))).withColumn("__own", company_link(own))
    reason = first_reason(
        ("field", F.col("__bad")),
        ("url", F.col("__link") == ""),
        ("name", (F.trim("company") == "") | (F.trim("role") == "")),
        ("company_url", (own != "") & (F.col("__own") == "")),
        ("status", ~F.trim("status").isin(*STATUSES)),
        ("folder", folder_reason(F.col("folder"), unfiled=True).isNotNull()),
        ("day", wrong_day),
    )
    return checked.withColumn("reason", reason).withColumns({**{c: F.trim(c) for c in LEAD_FIELDS}, "url": F.col("__link"), "company_url": F.col("__own")}).drop("__bad", "__link", "__own")


def clean_profile_pages(rows: DataFrame, page: str, most: int = 40) -> DataFrame:
    """Profiles (page, id, url, name, text, title, location) of the pages that hold 1 to `most`, each with a link, an id of its own and a text.

    One bad profile spoils its page. Titles and locations that the text does not hold
    are blanked. Pages are counted in two steps, so a page of any size is one row.
    """
    flat = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " ")))
    said = lambda c: F.coalesce(F.col(c), F.lit(""))
    own = profile_link(F.col("url"))
    bad = (own == "") | ~F.coalesce(F.col("id").rlike(r"^p\d{1,4}$"), F.lit(False)) | (F.trim(said("text")) == "")
    for c, length in PROFILE_FIELDS.items():
        bad = bad | (F.length(said(c)) > length) | said(c).rlike(r"[\x00-\x1f]")
    per = rows.withColumn("__bad", bad).groupBy(page, "id").agg(F.count("*").alias("n"), F.max("__bad").alias("bad"))
    fine = per.groupBy(page).agg(F.sum("n").alias("n"), F.max("n").alias("same"), F.max("bad").alias("bad")).filter((F.col("n") <= most) & (F.col("same") == 1) & ~F.col("bad"))
    kept = rows.join(fine.select(page), page, "left_semi")
    name = F.substring(F.coalesce(F.nullif(F.col("name"), F.lit("")), F.lit("LinkedIn member")), 1, 150)
    grounded = {c: F.when(F.contains(flat("text"), flat(c)), F.col(c)) for c in PROFILE_FIELDS}
    return kept.withColumns({**grounded, "url": own, "name": name, "text": F.substring(F.trim("text"), 1, 14000)})


def plan_reason(query: Column, country: Column, requirements: Column) -> Column:
    """A search plan: a query of 1 to 1000 characters, 1 to 12 requirements of at most 250, a short country that the query does not name."""
    told = lambda t, most: (F.trim(t) != "") & (F.length(F.trim(t)) <= most)
    place = F.lower(F.trim(country))
    padded = lambda t: F.concat(F.lit(" "), F.regexp_replace(F.lower(t), r"(?U)[^\w]+", " "), F.lit(" "))
    return first_reason(
        ("query", ~told(query, 1000)),
        ("requirements", ~F.size(requirements).between(1, 12) | F.exists(requirements, lambda r: ~F.coalesce(told(r, 250), F.lit(False)))),
        ("country", (F.length(country) > 100) | country.rlike(r"[\x00-\x1f\x7f]")),
        ("country_in_query", (place != "") & F.contains(padded(query), padded(place))),
    )


def clean_bills(rows: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Bills (status, authoritative, source, currency, amount, scope, provider, expected_provider) in one form, with a reason.

    names gives a provider's own name for each of its names. amount is text; it ends up
    as a decimal of at most 18 places, null for a bill that is refused.
    """
    low = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    own = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    of = lambda c: F.when(low(c) != "", F.coalesce(F.try_element_at(own, low(c)), F.lit("?")))
    said = F.trim("amount")
    plain = said.rlike(r"^\+?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d{1,3})?$") & (F.length(said) <= 128)
    staged = rows.withColumns({"__amount": F.when(plain, said.try_cast("decimal(38,18)")), "__provider": of("provider"), "__expected": of("expected_provider")})
    amount, provider, expected = F.col("__amount"), F.col("__provider"), F.col("__expected")
    places = F.length(F.regexp_extract(said, r"\.(\d*?)0*$", 1))
    reason = first_reason(
        ("open", low("status").isin(*OPEN_BILLS)),
        ("authority", ~F.coalesce(F.col("authoritative"), F.lit(False))),
        ("source", ~low("source").isin(*BILL_SOURCES)),
        ("currency", ~F.upper(F.trim("currency")).rlike("^[A-Z]{3}$")),
        ("amount", amount.isNull() | (amount > MOST_AMOUNT) | (places > 18)),
        ("scope", low("scope") != "request"),
        ("provider", F.coalesce(provider == "?", F.lit(False)) | F.coalesce(expected == "?", F.lit(False))),
        ("other_provider", F.coalesce(provider != expected, F.lit(False))),
    )
    told = staged.withColumn("reason", reason)
    fine = F.col("reason").isNull()
    return told.withColumns({"source": low("source"), "scope": low("scope"), "currency": F.upper(F.trim("currency")), "amount": F.when(fine, amount), "provider": F.when(fine, F.coalesce(expected, provider))}).drop("__amount", "__provider", "__expected")


def limit_of(said: str | None) -> Decimal | None:
    """The most that a request may cost: blank is the usual limit, a word of OFF none (null); raises for anything else than 0 < x <= 10000."""
    text = (said or "").strip()
    if text.casefold() in OFF:
        return None
    if not text:
        return USUAL_LIMIT
    try:
        limit = Decimal(text[:129])
    except InvalidOperation:
        limit = Decimal("NaN")
    if len(text) > 128 or not limit.is_finite() or not 0 < limit <= MOST_LIMIT or len(limit.normalize().as_tuple().digits) > 30 or -int(limit.normalize().as_tuple().exponent) > 18:
        raise ValueError(f"a limit must be a number over 0 and at most {MOST_LIMIT}")
    return limit


def guarded(ceiling: Column, limit: Decimal | None) -> Column:
    """disabled, allowed or blocked: what becomes of a request that may cost `ceiling`; an unknown ceiling is blocked."""
    if limit is None:
        return F.lit("disabled")
    return F.when(ceiling <= F.lit(limit), "allowed").otherwise("blocked")


def failure_status(attempted: Column, error: Column, evidence: Column, code: Column, bill: Column) -> Column:
    """struct(call, reconciliation, billing, missing, invalid) of a request that failed.

    error: guardrail, reconciliation or any other kind; evidence: usage was returned;
    code: the provider's error code or null; bill: what its bill said (pending,
    delayed, partial, unavailable, invalid) or null. Nothing is charged for what was
    not called.
    """
    kind = F.coalesce(error, F.lit(""))
    call = (
        F.when(~F.coalesce(attempted, F.lit(True)), "not_called")
        .when(kind == "guardrail", "blocked_before_provider_transport")
        .when((kind == "reconciliation") | F.coalesce(evidence, F.lit(False)) | bill.isNotNull(), "provider_response_received")
        .when(code.isNotNull(), "provider_error_response_received")
        .otherwise("ambiguous_no_provider_usage_returned")
    )
    never = call.isin("not_called") | (call.isin("blocked_before_provider_transport") & bill.isNull())
    invalid = F.coalesce(bill == "invalid", F.lit(False)) | (kind == "reconciliation")
    by_bill = F.when(bill == "invalid", "reconciliation_failed").otherwise(F.concat(F.lit("provider_billing_"), bill))
    reconciliation = F.when(never, "not_called").when(bill.isNotNull(), by_bill).when(kind == "reconciliation", "reconciliation_failed").when(call.startswith("ambiguous"), "ambiguous_provider_charge").otherwise("provider_billing_unavailable")
    return F.struct(
        call.alias("call"),
        reconciliation.alias("reconciliation"),
        F.when(never, "not_applicable").otherwise(F.coalesce(bill, F.when(invalid, "invalid").otherwise("unavailable"))).alias("billing"),
        (~never & ~invalid).alias("missing"),
        invalid.alias("invalid"),
    )


def rejected_counts(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, reason, n) of rows with a reason."""
    return rows.filter("reason IS NOT NULL").groupBy(*keys, "reason").agg(F.count("*").alias("n"))
