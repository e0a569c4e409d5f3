"""Sentences as spans of a text, and texts without the sentences that a predicate names.

A text is cut into pieces that make it up again, byte for byte: a sentence and
the white space behind it. What is not taken out is not touched. Columns only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Abbreviations that end no sentence, and those that end none before a legal form.
NEVER_LAST = ("Mr", "Mrs", "Ms", "Mdm", "Dr", "Prof", "Sr", "Jr", "St", "No", "vs", "e.g", "i.e", "cf", "approx", "est", "incl", "excl", "Rs", "Fig", "Vol")
LEGAL_NEXT = ("Ltd", "Limited", "Sdn", "Bhd", "Inc", "LLC", "PLC", "Pte", "Corp", "Co")
#: Words that open a statement of pay, so that an initial before them ends its sentence.
PAY_OPENERS = ("Expected", "Current", "Last", "Present", "Asking", "Salary", "Monthly", "Basic", "Gross", "Earning", "Package", "Pay", "Income", "Remuneration", "Seeking")
#: Signs that may cut a text: the first that it does not hold.
_CUTS = ("\ue000", "\ue001", "\ue002")


def _boundary(openers: Sequence[str]) -> str:
    never = "|".join(a.replace(".", r"\.") for a in NEVER_LAST)
    # an abbreviation, or a single initial (unless a statement opens behind it)
    kept = rf"(?<!(?<![\p{{L}}\p{{N}}])(?:{never})\.)(?:(?<!(?<![\p{{L}}\p{{N}}.])\p{{Lu}}\.)|(?=\s+(?:{'|'.join(openers)})\b))"
    return rf"(?<=[.!?…]|[.!?…][\"'”’)\]]){kept}\s+(?=[\"'“‘(\[]?[\p{{Lu}}\p{{N}}₹$€£•*])(?!(?:{'|'.join(LEGAL_NEXT)})\b)|\n+\s*"


def _cut(text: Column) -> Column:
    out = F.lit(_CUTS[-1])
    for sign in reversed(_CUTS[:-1]):
        out = F.when(~text.contains(sign), F.lit(sign)).otherwise(out)
    return out


#: White space that may stand behind a sentence.
_SPACE = " \t\n\r\x0b\x0c"


def pieces(text: Column, openers: Sequence[str] = PAY_OPENERS) -> Column:
    """The sentences of a text, each with the white space behind it; joined they are the text. Null has none.

    A sentence ends at . ! ? or … before a capital, a digit or a currency sign,
    and at a line end. Abbreviations and initials end none, except before
    `openers`; `Co.` none before a legal form.
    """
    marked = lambda cut: F.regexp_replace(text, _boundary(openers), F.concat(F.lit("$0"), cut))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(let(_cut(text), lambda cut: F.filter(F.split(marked(cut), cut), lambda p: p != "")))


def spans(text: Column, openers: Sequence[str] = PAY_OPENERS) -> Column:
    """array<struct<start, stop, sentence>>: where each sentence stands (characters from 0), without the white space behind it."""

    def placed(found: Column) -> Column:
        ends = F.aggregate(found, F.array().cast("array<int>"), lambda ends, p: F.array_append(ends, F.coalesce(F.try_element_at(ends, F.lit(-1)), F.lit(0)) + F.char_length(p)))

        def rows(ends: Column) -> Column:
            bare = lambda p: F.rtrim(p, F.lit(_SPACE))
            start = lambda p, i: F.get(ends, i) - F.char_length(p)
            return F.filter(F.transform(found, lambda p, i: F.struct(start(p, i).alias("start"), (start(p, i) + F.char_length(bare(p))).alias("stop"), bare(p).alias("sentence"))), lambda r: r["sentence"] != "")

        return let(ends, rows)

    return let(pieces(text, openers), placed)


def without(text: Column, fits: Callable[[Column], Column], openers: Sequence[str] = PAY_OPENERS) -> Column:
    """struct(text, removed): a text without the sentences that fit, all else as it was, and how many went.

    Where the last sentence goes, so does the white space before it.
    """

    def judged(found: Column) -> Column:
        return let(F.filter(found, lambda p: ~F.coalesce(fits(F.rtrim(p, F.lit(_SPACE))), F.lit(False))), lambda stay: kept(found, stay))

    def kept(found: Column, stay: Column) -> Column:
        removed = F.size(found) - F.size(stay)
        joined = F.array_join(stay, "")
        last_stays = F.coalesce(F.get(found, F.size(found) - 1) == F.get(stay, F.size(stay) - 1), F.lit(False))
        return F.struct(F.when((removed > 0) & ~last_stays, F.rtrim(joined, F.lit(_SPACE))).otherwise(joined).alias("text"), removed.alias("removed"))

    return F.when(text.isNotNull(), let(pieces(text, openers), judged))


#: Money, words of pay, whose pay it is, and work on other people's pay.
_MONEY = r"(?:(?<![A-Za-z])(?:RM|MYR|SGD|USD|AUD|EUR|GBP|INR|IDR|THB|VND|HKD|Rs\.?)\s?\d|(?<![A-Za-z])PHP\s?\d{2,3}[,\d]{2,}|[$₹€£]\s?\d|\b\d+(?:\.\d+)?\s?(?:LPA|lakhs?|lacs?|crores?)\b)"
_PAY = r"(?:salary|salaries|package|ctc|remuneration|compensation|wages?|income|pay|earnings|take-home|takehome|basic|gross|nett?|base)"
_WHOSE = r"(?:current|expected|last[- ]drawn|asking|present|my|his|her|their|candidate'?s?|desired|previous|drawn)"
_WORK = (
    "manag|administ|oversaw|oversee|process|reconcil|benchmark|negotiat|led|lead|own|design|review|budget|forecast|audit|handl|ran|run|plan|restructur|streamlin|supervis|prepar|calculat|implement|support|reduc|grew|deliver|built|build|maintain|place|placing|fill|specialis|develop|analys|approv|set|expert"
)
_OTHERS = r"(?i)\b(?:payroll|staff|employees?|executives?|sales team|headcount|budget|pool|placements?|placing|vacancies|mandates|for roles|clients?|leaders|increments|payouts|contributions)\b"


def states_pay(sentence: Column) -> Column:
    """Whether a sentence tells the candidate's own pay: an amount of money with a word of pay, of earning or of asking, and no work on others' pay around it.

    Clauses (cut at commas, semicolons, `and` and `with`) are judged one by one.
    """
    clauses = F.split(sentence, r"(?i)(?:[;,](?!\d)|\bwith\b|\band\b)\s*")
    own = rf"(?i)\b{_WHOSE}\b[^.]{{0,24}}\b{_PAY}\b|^\W*(?:(?:monthly|annual|total|basic|gross|net|nett|base)\s+)*{_PAY}\b|\b(?:a\s+)?(?:monthly\s+)?(?:salary|package|income|earnings)\s+of\b|^\W*(?:current|expected)\b\W"
    asks = r"(?i)\b(?:is|are|was)\s+paid\b|\b(?:earn(?:s|ing|ed)?|draw(?:s|ing|n)?|seeking|asking\s+for|looking\s+for|takes?\s+home|receives?|makes|gets)\b"
    work = rf"(?i)^\W*(?:{_WORK})[a-z]*\b"

    def tells(c: Column) -> Column:
        return c.rlike(_MONEY) & (c.rlike(own) | c.rlike(asks) | c.rlike(rf"(?i)\b(?:salary|pay|ctc)\b")) & ~c.rlike(work) & ~c.rlike(_OTHERS)

    return F.exists(clauses, tells)


def pay_removed(text: Column) -> Column:
    """struct(text, removed): a summary without the sentences that tell the candidate's own pay."""
    return without(text, states_pay)


#: Marks that stand for something taken out of a source.
REDACTED = r"(?i)\[?\b(?:redacted|removed|withheld|confidential)\b\]?|█{2,}|▇{2,}"


def redacted_near(text: Column, word: str, before: int = 250, after: int = 450) -> Column:
    """Whether a mark of redaction stands close to a word."""
    mark = REDACTED.removeprefix("(?i)")
    return F.coalesce(text, F.lit("")).rlike(rf"(?is)(?:{mark}).{{0,{before}}}?\b{word}|\b{word}.{{0,{after}}}?(?:{mark})")


def unless_redacted(values: Column, text: Column, word: str = "languages?") -> Column:
    """A list, empty where its source was redacted near the word."""
    return F.when(redacted_near(text, word), F.array().cast("array<string>")).otherwise(values)
