"""Pay notes by a small grammar: components, and in them numbers whose kind follows from the symbols around them.

A component becomes a list of symbols (numbers, words, signs), each of a class; the
classes next to a number, written as a short text, are its shape, and the first
rule that fits the shape names its kind. Everything else (amounts, ranges, months,
fixed and expected pay) is read from the typed numbers. Columns only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Scales that follow a number.
SCALES = {"k": 10**3, "m": 10**6, "mil": 10**6, "million": 10**6, "millions": 10**6, "l": 10**5, "lac": 10**5, "lacs": 10**5, "lakh": 10**5, "lakhs": 10**5, "lpa": 10**5, "cr": 10**7, "crore": 10**7, "crores": 10**7}
#: Words and signs of currencies, and labels that may be joined to an amount.
CURRENCY_WORDS = ("rm", "myr", "sgd", "s$", "usd", "us$", "inr", "rs", "aud", "a$", "eur", "gbp", "php", "idr", "thb", "vnd", "bnd", "khr", "lak", "mmk", "cny", "hkd", "hk$", "$")
LABELS = ("allowance", "allowances", "allowence", "alowance", "sllowance", "epf", "kwsp", "socso", "eis", "bonus", "commission", "incentive", "claim", "claims", "reimbursement", "reimbursements")
#: The classes of other words.
CLASSES: dict[str, tuple[str, ...]] = {
    "month": ("month", "months", "monnth", "monnths", "mnth", "mnths", "mth", "mths", "mo", "mos"),
    "time": ("day", "days", "week", "weeks", "year", "years", "yr", "yrs"),
    "date": ("date",),
    "ordinal": ("th", "st", "nd", "rd"),
    "percent": ("%", "percent", "pct"),
    "range": ("-", "–", "—", "~", "to", "until"),
    "times": ("x", "×"),
    "paid": ("salary", "pay", "bonus"),
}
#: What a component is, by its words.
ANNUAL = r"\bper (?:annum|year)\b|\bp\.? ?a\.?(?![a-z])|/ ?(?:annum|year)\b|\bannual(?:ly)?\b|\byearly\b|\blpa\b"
EXCLUDED = (
    r"\b(?:bonus|annual wage supplement|aws|epf|kwsp|socso|eis|commission|incentive|variable|performance|rsu|esop|stock|shares?|options?|claims?|claimable|reimburse(?:ment|able)?|medical|insurance|employer contribution)\b"
)
ALLOWANCE = r"(?<![a-z])(?:allowances?|allowence|alowance|sllowance)\b|\b(?:transport|phone|mobile|housing|car|meal)\b"
RECURRING = r"\b(?:fixed|monthly|per month|recurring|regular)\b"
BASE = r"\b(?:current|salary|base|basic|last drawn|monthly pay|package)\b"
BASE_FIRST = r"\b(?:current|base|basic|last drawn)\b"
SUPPLEMENT = r"\b(?:aws|annual wage supplement)\b"
SURE_BONUS = r"\b(?:contractual|guaranteed|fixed) (?:cash )?bonus\b|\bbonus (?:contractual|guaranteed|fixed)\b"
WITHIN = r"\b(?:incl|including|included|inclusive|comprising)\b"
AS_NOW = (
    r"\b(?:same (?:as )?current|(?:maintain|match) (?:the )?current|no (?:increment|increase|change)|(?:horizontal|lateral) move|current (?:salary|package|compensation) (?:is )?(?:ok|okay|fine|acceptable)|open to current|as current)\b"
)
OPEN = r"\b(?:open|negotiable|nego|discuss|tbd|n/?a|not available|flexible)\b"

_ANY = lambda words: "|".join(sorted((w.replace("$", r"\$") for w in words), key=len, reverse=True))
_TAIL = rf"(?:(?:{_ANY(SCALES)})?(?:{_ANY((*LABELS, *CURRENCY_WORDS))})?|{_ANY([*CLASSES['month'], *CLASSES['time'], *CLASSES['ordinal'], *CLASSES['percent'], 'x'])})"
_NUMBER = r"\d+(?:\.\d+)?"
_SYMBOL = rf"{_NUMBER}|[a-z]*\$|[a-z]+|[%x×~–—/+-]"
#: Kinds of a number by the shape around it, first fit: the class before, N, the classes after. `big` stands for a scale.
_SHAPES: tuple[tuple[str, str], ...] = (
    ("percent", r" N percent| N range n percent"),
    ("months", r" N (?:ordinal )?month\b| N ordinal paid\b|^times N\b"),
    ("months", r" N m paid\b"),
    ("time", r" N (?:ordinal )?time\b"),
    ("place", r"^(?:time|month|date) N(?! big)\b"),
)


def _plain(text: Column) -> Column:
    """Lower case, one space between words, thousands without commas, numbers apart from the letters that may follow them."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\S\n]+", " "), r"(?<=\d),(?=\d{3}(?!\d))", ""))
    t = F.regexp_replace(t, rf"{_NUMBER}(?=[a-z])(?!(?<=\d){_TAIL}(?![a-z]))", "#")  # 5abc is a name
    t = F.regexp_replace(t, r"(\d)(?=[a-z$%×])", "$1 ")
    return F.regexp_replace(t, rf"(?<=\d )({_ANY(SCALES)})(?=(?:{_ANY((*LABELS, *CURRENCY_WORDS))})(?![a-z]))", "$1 ")


def component_texts(text: Column) -> Column:
    """The components of a note, cut at +, ;, line ends and commas that are not in a number."""
    return F.filter(F.transform(F.split(_plain(text), r"[+;\n]+|,(?!\d{3}(?!\d))"), lambda p: F.trim(p)), lambda p: p != "")


def _class(symbol: Column) -> Column:
    known = F.create_map(*(F.lit(x) for name, words in CLASSES.items() for w in words for x in (w, name)))
    scale = F.create_map(*(F.lit(x) for w in SCALES for x in (w, "m" if w == "m" else "big")))
    return F.when(symbol.rlike(r"^\d"), "n").otherwise(F.coalesce(F.try_element_at(scale, symbol), F.try_element_at(known, symbol), F.lit("w")))


def _numbers(part: Column, currency: Column, rupees: Column) -> Column:
    """array<struct<n, scale, kind, joined>> of a plain component; `joined` says that a range sign leads to another number."""
    money = F.array(*map(F.lit, CURRENCY_WORDS))
    symbols = F.filter(F.regexp_extract_all(part, F.lit(_SYMBOL), F.lit(0)), lambda w: ~F.array_contains(money, w))
    multiple = F.create_map(*(F.lit(x) for w, f in SCALES.items() for x in (w, f)))

    def typed(s: Column) -> Column:
        def of(c: Column) -> Column:
            at = lambda i: F.coalesce(F.get(c, i), F.lit("."))
            is_scale = lambda i: at(i).isin("big", "m")

            def one(i: Column) -> Column:
                n = F.get(s, i).cast("decimal(24,6)")
                own = is_scale(i + 1)
                shape = F.concat_ws(" ", F.when(i > 0, at(i - 1)).otherwise("."), F.lit("N"), at(i + 1), at(i + 2), at(i + 3))
                return let(F.struct(n.alias("n"), shape.alias("shape"), F.regexp_replace(shape, r" N (?:big|m)(?= |$)", " N").alias("bare")), lambda x: named(i, own, x["n"], x["shape"], x["bare"]))

            def named(i: Column, own: Column, n: Column, shape: Column, bare: Column) -> Column:
                kind = F.when(own & shape.rlike(r" N m paid") & (n > 12), "amount")
                for name, rule in _SHAPES:
                    fits = F.when(F.lit("big" in rule or " m " in rule), shape).otherwise(bare).rlike(rule)
                    if "ordinal paid" in rule:  # of months or pay
                        fits = fits & (~bare.rlike(r" N ordinal paid|^times N") | n.between(12, 36) | bare.rlike(" N (?:ordinal )?month"))
                    if name == "place":
                        fits = fits & ~own & (n < 1000)
                    if name == "months" and " m " in rule:
                        fits = fits & (n <= 12)
                    kind = kind.when(fits, name)
                word = F.when(own, F.get(s, i + 1)).otherwise("")
                vague = ((at(i + 1) == "m") & ~currency) | ((word == "l") & ~rupees)
                joined = F.when(own, (at(i + 2) == "range") & (at(i + 3) == "n")).otherwise((at(i + 1) == "range") & (at(i + 2) == "n"))
                lent = F.when(~own & joined & (n < 1000) & is_scale(i + 3), F.get(s, i + 3)).otherwise("")
                size = lambda w: F.coalesce(F.try_element_at(multiple, w), F.lit(1)).cast("decimal(12,0)")
                told = let(kind.otherwise("amount"), lambda k: F.when(vague & (k == "amount"), "vague").otherwise(k))
                return F.struct(n.alias("n"), word.alias("scale"), size(word).alias("factor"), size(F.when(own, word).otherwise(lent)).alias("span_factor"), told.alias("kind"), joined.alias("joined"))

            places = F.filter(F.transform(c, lambda k, i: F.when(k == "n", i)), lambda i: i.isNotNull())
            return F.transform(places, one)

        return let(F.transform(s, _class), of)

    return let(symbols, typed)


def components(text: Column) -> Column:
    """array<struct<text, numbers, annual, excluded, allowance, recurring, base, base_first, supplement, sure_bonus, within>> of a pay note.

    A number is struct<value, span_value, n, scale, kind, joined>: kind amount,
    percent, months, time (days, weeks, years), place (`day 5`) or vague (`m`
    without a currency, `l` of other money than rupees). value is the monthly
    amount, half up, an annual component's a twelfth; span_value takes the scale
    from the other end of a range.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    currency = low.rlike(rf"(?<![a-z])(?:{_ANY(CURRENCY_WORDS)})(?![a-z])")
    rupees = low.rlike(r"(?<![a-z])(?:inr|rs)(?![a-z])")

    def of(part: Column) -> Column:
        annual = part.rlike(ANNUAL)

        def valued(x: Column) -> Column:
            worth = lambda factor: F.round(x["n"] * factor / F.when(annual | (x["scale"] == "lpa"), F.lit(12)).otherwise(F.lit(1)), 0).cast("long")
            return F.struct(worth(x["factor"]).alias("value"), worth(x["span_factor"]).alias("span_value"), x["n"].cast("double").alias("n"), x["scale"].alias("scale"), x["kind"].alias("kind"), x["joined"].alias("joined"))

        flags = [("excluded", EXCLUDED), ("allowance", ALLOWANCE), ("recurring", RECURRING), ("base", BASE), ("base_first", BASE_FIRST), ("supplement", SUPPLEMENT), ("sure_bonus", SURE_BONUS), ("within", WITHIN)]
        return F.struct(part.alias("text"), F.transform(_numbers(part, currency, rupees), valued).alias("numbers"), annual.alias("annual"), *(part.rlike(rule).alias(name) for name, rule in flags))

    return F.transform(component_texts(text), of)


def _worked_out(text: Column, then: Callable[[Column], Column]) -> Column:
    return let(components(text), then)


def _of_kind(numbers: Column, kind: str) -> Column:
    return F.filter(numbers, lambda x: (x["kind"] == kind) & ((x["value"] > 0) if kind == "amount" else F.lit(True)))


def _all_numbers(parts: Column) -> Column:
    return F.flatten(F.transform(parts, lambda p: p["numbers"]))


def amounts(text: Column) -> Column:
    """Monthly amounts of a note in order; periods, percentages and months left out."""
    return _worked_out(text, _amounts)


def _amounts(parts: Column) -> Column:
    return F.transform(_of_kind(_all_numbers(parts), "amount"), lambda x: x["value"])


def first_amount(text: Column) -> Column:
    """The first monthly amount; null if there is none."""
    return F.get(amounts(text), F.lit(0))


def has_amount(text: Column) -> Column:
    """Whether a number of thousands (`12k`) or of four to eight digits stands in a note."""
    return F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit(",")).rlike(r"\b\d+(?:\.\d+)?\s*k\b|\b\d{4,8}\b")


def _span(parts: Column) -> Column:
    """struct(low, high): two amounts joined by a range sign, else the first amount for both; null if a percentage comes first or there is none."""
    numbers = F.filter(_all_numbers(parts), lambda x: x["kind"].isin("amount", "percent"))
    return let(numbers, _span_of)


def _span_of(numbers: Column) -> Column:
    found = F.filter(numbers, lambda x: (x["kind"] == "amount") & (x["span_value"] > 0))
    first, second = F.get(found, F.lit(0)), F.get(found, F.lit(1))
    pair = F.exists(numbers, lambda x: (x["kind"] == "amount") & x["joined"]) & second.isNotNull()
    a, b = first["span_value"], F.when(pair, second["span_value"]).otherwise(first["span_value"])
    percent_first = F.get(numbers, F.lit(0))["kind"] == "percent"
    return F.when(first.isNotNull() & ~percent_first, F.struct(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")))


def pay_range(text: Column) -> Column:
    """struct(low, high) of a note, monthly; null without an amount."""
    return _worked_out(text, _span)


def percent_range(text: Column) -> Column:
    """struct(low, high) of the first percentage or range of percentages, above -100 and to 500 either way; null if none."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "％", "%")
    number, sign, dash = r"([+-]?\d+(?:\.\d+)?)", r"(?:%|percent|pct)", r"(?:-|–|—|to|until|~)"
    wide, one = rf"{number}\s*(?:{sign})?\s*{dash}\s*{number}\s*{sign}|{number}\s*{sign}\s*{dash}\s*{number}", rf"{number}\s*{sign}"
    got = lambda p, *ks: F.coalesce(*(F.nullif(F.regexp_extract(t, p, k), F.lit("")) for k in ks)).cast("double")
    fits = lambda lo, hi: (lo > -100) & (hi > -100) & (F.greatest(F.abs(lo), F.abs(hi)) <= 500)

    def made(lo: Column, hi: Column) -> Column:
        return F.when(fits(lo, hi), F.struct(F.least(lo, hi).alias("low"), F.greatest(lo, hi).alias("high")))

    return F.coalesce(F.when(t.rlike(wide), made(got(wide, 1, 3), got(wide, 2, 4))), F.when(t.rlike(one), made(got(one, 1), got(one, 1))))


def _months(parts: Column) -> Column:
    """struct(months, base, added, stated): guaranteed months of pay in a year, 12 if none are stated, to 36."""
    total = F.filter(_of_kind(_all_numbers(parts), "months"), lambda x: (x["n"] >= 12) & (x["n"] < 25))
    supplement = F.exists(parts, lambda p: p["supplement"])
    sure = F.filter(parts, lambda p: p["sure_bonus"] & ~p["within"])
    extra = F.filter(_of_kind(_all_numbers(sure), "months"), lambda x: (x["n"] > 0) & (x["n"] < 12))
    most = F.greatest(F.array_max(F.transform(total, lambda x: x["n"])), F.when(supplement, F.lit(13.0)))
    added = F.aggregate(extra, F.lit(0.0), lambda s, x: s + x["n"])
    base = F.coalesce(most, F.lit(12.0))
    return F.struct(F.least(F.greatest(base + added, F.lit(12.0)), F.lit(36.0)).alias("months"), base.alias("base"), added.alias("added"), (most.isNotNull() | (F.size(extra) > 0)).alias("stated"))


def guaranteed_months(text: Column) -> Column:
    """struct(months, base, added, stated): the greatest stated total (13 for a wage supplement), and months of guaranteed bonus that are not included in it."""
    return _worked_out(text, _months)


def _fixed(parts: Column) -> Column:
    """struct(value, base, months, allowances): the base by its guaranteed months a twelfth, and fixed allowances."""
    # every amount with its component, in order
    paired = lambda p, i, own: F.transform(own, lambda x, k: F.struct(i.alias("i"), k.alias("k"), x["value"].alias("value"), ((x["scale"] == "k") | (x["value"] >= 1000)).alias("large"), p.alias("p"), F.size(own).alias("of")))
    pairs = F.flatten(F.transform(parts, lambda p, i: let(_of_kind(p["numbers"], "amount"), lambda own: paired(p, i, own))))
    return let(pairs, lambda found: _fixed_of(parts, found))


def _fixed_of(parts: Column, pairs: Column) -> Column:
    named = lambda x: x["p"]["base"] & ~(x["p"]["allowance"] & ~x["p"]["base_first"])
    usable = F.filter(pairs, lambda x: (named(x) | ~x["p"]["excluded"]) & (x["large"] | named(x)))
    shown = lambda x: x["p"]["base"] & ~(x["p"]["allowance"] & ~(x["p"]["base_first"] | x["p"]["text"].rlike(r"\bsalary\b")))
    first = lambda u: F.coalesce(F.get(F.filter(u, shown), F.lit(0)), F.get(F.filter(u, lambda x: x["large"]), F.lit(0)), F.get(u, F.lit(0)))

    def worth(b: Column) -> Column:
        def adds(x: Column) -> Column:
            p = x["p"]
            marked = F.exists(p["numbers"], lambda n: n["kind"].isin("percent", "months"))
            bare = (x["i"] != b["i"]) & (x["of"] == 1) & (x["value"] >= 50) & F.trim(F.regexp_replace(p["text"], rf"(?<![a-z])(?:{_ANY(CURRENCY_WORDS)})(?![a-z])", "")).rlike(rf"^{_NUMBER} ?k?$")
            return ~((x["i"] == b["i"]) & (x["k"] == b["k"])) & ~p["excluded"] & ~marked & (p["allowance"] | (p["recurring"] & ~p["base"]) | bare)

        allowances = F.aggregate(F.filter(pairs, adds), F.lit(0).cast("long"), lambda s, x: s + x["value"])
        months = _months(parts)["months"]
        exact = b["value"].cast("decimal(20,0)") * months.cast("decimal(6,3)") / F.lit(12) + allowances
        return F.when(b.isNotNull(), F.struct(F.round(exact, 0).cast("long").alias("value"), b["value"].alias("base"), months.alias("months"), allowances.alias("allowances")))

    return let(let(usable, first), worth)


def fixed_pay(text: Column | None = None, parts: Column | None = None) -> Column:
    """struct(value, base, months, allowances) of a current pay note, or of its `components` if these are there already; null without a base.

    The base is the first amount labelled as one, else the first of thousands;
    bonuses, funds and claims never are. Allowances, recurring sums and bare
    amounts of 50 at least add to it.
    """
    return _worked_out(text, _fixed) if parts is None else _fixed(parts)


def expected_pay(text: Column, current: Column) -> Column:
    """struct(type, low, high, percent_low, percent_high) of an expectation: an amount or range, else the current pay, else a percentage on it, else open.

    Types end in _unresolved where the current pay is not known; blank and unparsed say so.
    """
    t = F.trim(F.coalesce(text, F.lit("")))
    low = F.regexp_replace(F.lower(t), r"\s+", " ")
    now = current.cast("long")
    raised = lambda p: F.round(now.cast("decimal(20,0)") * (F.lit(1) + p.cast("decimal(9,4)") / F.lit(100)), 0).cast("long")

    def answer(kind: Column | str, lo: Column | None = None, hi: Column | None = None, p: Column | None = None) -> Column:
        none = F.lit(None).cast("long")
        far = F.lit(None).cast("double")
        return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("type"), (none if lo is None else lo).alias("low"), (none if hi is None else hi).alias("high"), (far if p is None else p["low"]).alias("percent_low"), (far if p is None else p["high"]).alias("percent_high"))

    known = lambda name: F.concat(F.lit(name), F.when(now.isNull(), "_unresolved").otherwise(""))

    def of(found: Column) -> Column:
        r, p = found["range"], found["percent"]
        several = F.when(p["low"] == p["high"], known("percent")).otherwise(known("percent_range"))
        return (
            F.when(t == "", answer("blank"))
            .when(r.isNotNull(), answer(F.when(r["low"] == r["high"], "fixed").otherwise("range"), r["low"], r["high"]))
            .when(low.rlike(AS_NOW), answer(known("same_as_current"), now, now))
            .when(p.isNotNull(), answer(several, raised(p["low"]), raised(p["high"]), p))
            .when(low.rlike(OPEN), answer("open"))
            .otherwise(answer("unparsed"))
        )

    return let(F.struct(pay_range(t).alias("range"), percent_range(t).alias("percent")), of)


def base_confirmed(base: Column, months: Column, additions: Column, text: Column | None, trusted: Column, parts: Column | None = None) -> Column:
    """What speaks against components given for a note: base, months, additions, evidence, missing; null if nothing does.

    The base must be one of the note's amounts to within 1, stated months must be
    equal (none stated: 12), additions may not exceed the other amounts. Without
    amounts in the note the components must be `trusted`. `parts` are the note's `components`, if these are there already.
    """

    def of(found: Column) -> Column:
        given, stated = found["amounts"], found["months"]
        near = F.filter(given, lambda a: F.abs(a - base) <= 1)
        rest = F.aggregate(given, F.lit(0).cast("long"), lambda s, a: s + a) - F.coalesce(F.get(near, F.lit(0)), F.lit(0))
        says = F.when(stated["stated"], stated["months"]).otherwise(F.lit(12.0))
        return (
            F.when(base.isNull(), "missing")
            .when((F.size(given) > 0) & (F.size(near) == 0), "base")
            .when((F.size(given) == 0) & ~F.coalesce(trusted, F.lit(False)), "evidence")
            .when(F.abs(says - F.coalesce(months, F.lit(12.0))) > 0.001, "months")
            .when((additions < 0) | (additions > F.greatest(base * 5, F.lit(10_000_000))) | ((F.size(given) > 0) & (additions > rest + 1)), "additions")
        )

    read = lambda p: F.struct(_amounts(p).alias("amounts"), _months(p).alias("months"))
    return let(_worked_out(text, read) if parts is None else read(parts), of)


def chosen_currency(expected: Column, current: Column, existing: Column) -> Column:
    """The first code of the expected pay, else of the current pay, else the one that is set; arrays of codes in the order of the text."""
    return F.coalesce(F.get(expected, F.lit(0)), F.get(current, F.lit(0)), F.nullif(F.upper(F.trim(existing)), F.lit("")))


def pay_record(current: Column, expected: Column, currency: Column) -> Column:
    """struct of both notes as one: currency, value, base, months, allowances, type, low, high and a fingerprint of these."""

    def of(found: Column) -> Column:
        now, then = found["now"], expected_pay(expected, found["now"]["value"])
        fields = lambda e: F.struct(currency.alias("currency"), *(now[c].alias(c) for c in ("value", "base", "months", "allowances")), *(e[c].alias(c) for c in ("type", "low", "high")))
        return let(let(then, fields), lambda r: r.withField("fingerprint", F.sha2(F.to_json(r), 256)))

    return let(F.struct(fixed_pay(current).alias("now")), of)
