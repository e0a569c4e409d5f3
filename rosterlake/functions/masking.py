"""Masking of term sets: one automaton for the terms of a row, over every text of a column, nested or not.

Terms are found in one pass however many there are. Of those that overlap the
longest stay, as if they were replaced one after another, longest first. Marks of
emphasis (* _ `) do not hide a term and go with it.
"""

from __future__ import annotations

import re
import sys
from collections import OrderedDict
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import LEGAL_FORMS

#: Of terms: array<struct<...>> of the column that holds them.
TERM = "array<struct<term: string, mark: string, cased: boolean, proper: boolean, prefix: boolean>>"
#: Automata that a task keeps.
KEPT = 64
_MARKS = "*_`"
_WORD = frozenset("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


def terms(names: Column, mark: str, *, cased: bool = False, proper: bool = False, prefix: bool = False, least: int = 1) -> Column:
    """A list of names as terms: `cased` ones must be written as they are, `proper` ones not all in lower case, a `prefix` may begin a longer word.

    Blank names and those of fewer than `least` characters are no terms; each counts once, whatever its case.
    """
    clean = F.filter(F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda n: F.trim(F.regexp_replace(F.coalesce(n, F.lit("")), r"\s+", " "))), lambda n: F.char_length(n) >= least)
    return F.transform(F.array_distinct(clean), lambda n: F.struct(n.alias("term"), F.lit(mark).alias("mark"), F.lit(cased).alias("cased"), F.lit(proper).alias("proper"), F.lit(prefix).alias("prefix"))).cast(TERM)


def organisation_names(employers: Column, text: Column, known: Sequence[str] = (), most: int = 250) -> Column:
    """Names of organisations to mask, longest first: employers, known names that a text holds, and words before a legal form."""
    capital = r"[A-Z][A-Za-z0-9&.'-]*"
    form = "|".join(f for f in LEGAL_FORMS if f not in ("group", "company", "co", "holdings"))
    legal = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"\b({capital}(?: {capital}){{0,5}}? (?i:{form})\b\.?(?: (?i:{form})\b\.?)?)"), F.lit(1))
    low = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    held = F.array_compact(F.array(*(F.when(low.rlike(rf"(?<![a-z0-9])\Q{k.lower()}\E(?![a-z0-9])"), F.lit(k)) for k in known)).cast("array<string>")) if known else F.array().cast("array<string>")
    given = F.filter(F.transform(F.coalesce(employers, F.array().cast("array<string>")), lambda n: F.trim(F.coalesce(n, F.lit("")))), lambda n: F.char_length(n) >= 3)
    by_key = F.array_sort(F.transform(F.array_distinct(F.concat(given, held, legal)), lambda n: F.struct((-F.char_length(n)).alias("size"), F.lower(n).alias("low"), n.alias("name"))))
    return F.slice(F.transform(by_key, lambda x: x["name"]), 1, most)


class Masker:
    """Replaces terms (term, mark, cased, proper, prefix) in texts, longest first, at the edges of words."""

    def __init__(self, found: Sequence[tuple]):
        import ahocorasick

        self.rules: dict[str, list[tuple]] = {}
        for term, mark, cased, proper, prefix in found:
            bare = _unmarked(term or "").strip()
            if bare:
                self.rules.setdefault(_low(bare), []).append((term.strip(), bare, mark or "", cased, proper, prefix))
        self.find = ahocorasick.Automaton()
        for low in self.rules:
            self.find.add_word(low, low)
        if self.rules:
            self.find.make_automaton()

    def mask(self, text: str) -> str:
        if not self.rules or not text:
            return text
        kept = [i for i, c in enumerate(text) if c not in _MARKS] if any(m in text for m in _MARKS) else None
        seen = text if kept is None else "".join([text[i] for i in kept])
        claims = []
        for last, low in self.find.iter(_low(seen)):
            start, end = last - len(low) + 1, last + 1
            raw = text[start:end] if kept is None else text[kept[start] : kept[end - 1] + 1]
            mark = self._mark(low, seen, start, end, raw)
            if mark is not None:
                claims.append((start - end, start, end, mark))
        if not claims:
            return text
        claims.sort(key=lambda c: c[:2])
        taken = np.zeros(len(seen), dtype=bool)
        chosen = []
        for _, start, end, mark in claims:
            if not taken[start:end].any():
                taken[start:end] = True
                chosen.append((start, end, mark))
        out, at = [], 0
        for start, end, mark in sorted(chosen):
            a, b = (start, end) if kept is None else (kept[start], kept[end - 1] + 1)
            if kept is not None:  # the marks around it go too
                while a > at and text[a - 1] in _MARKS:
                    a -= 1
                while b < len(text) and text[b] in _MARKS:
                    b += 1
            out += [text[at:a], mark]
            at = b
        return "".join([*out, text[at:]])

    def _mark(self, low: str, text: str, start: int, end: int, raw: str) -> str | None:
        if start and text[start - 1] in _WORD:
            return None
        here, after = text[start:end], text[end : end + 2]
        for term, bare, mark, cased, proper, prefix in self.rules[low]:
            if cased and here != bare or proper and here.islower() or term != bare and _low(term) not in _low(raw):
                continue
            if not after or after[0] not in _WORD:
                return mark
            # GrabFood, Maybank2u: a proper word must be followed by a digit or a capitalised word
            if prefix and (re.match(r"[0-9]|[A-Z][a-z]", after) if proper else len(after) == 2 and after[1] in _WORD):
                return mark
        return None


def _unmarked(text: str) -> str:
    return "".join(c for c in text if c not in _MARKS)


def _low(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _maskers() -> Callable[[list | None], Masker]:
    kept: OrderedDict[tuple, Masker] = OrderedDict()

    def of(found: list | None) -> Masker:
        key = tuple((t["term"], t["mark"], bool(t["cased"]), bool(t["proper"]), bool(t["prefix"])) for t in found or () if t)
        if key not in kept:
            kept[key] = Masker(key)
            if len(kept) > KEPT:
                kept.popitem(last=False)
        kept.move_to_end(key)
        return kept[key]

    return of


def _mask_leaves(values: pa.Array, rows: np.ndarray, terms_of: list, masker: Callable) -> pa.Array:
    """The array with the strings of every depth masked by the terms of their row; maps keep their keys."""
    kind = values.type
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        return pa.array([None if t is None else masker(terms_of[r]).mask(t) for t, r in zip(values.to_pylist(), rows.tolist(), strict=True)], kind)
    if pa.types.is_struct(kind):
        fields = [_mask_leaves(f, rows, terms_of, masker) for f in values.flatten()]
        return pa.StructArray.from_arrays(fields, fields=list(kind), mask=values.is_null()) if fields else values
    if pa.types.is_list(kind) or pa.types.is_map(kind):
        sizes = np.array([n or 0 for n in pa.compute.list_value_length(values.cast(pa.list_(kind.value_type)) if pa.types.is_list(kind) else _as_list(values)).to_pylist()], dtype=np.int64)
        inner_rows = np.repeat(rows, sizes)
        offsets = pa.array(np.r_[0, np.cumsum(sizes)], pa.int32())
        if pa.types.is_list(kind):
            inner = _mask_leaves(values.flatten(), inner_rows, terms_of, masker)
            return pa.ListArray.from_arrays(offsets, inner, type=kind, mask=values.is_null())
        entries = _as_list(values).flatten()
        items = _mask_leaves(entries.field(1), inner_rows, terms_of, masker)
        made = pa.MapArray.from_arrays(offsets, entries.field(0), items, type=kind)
        return pa.compute.if_else(values.is_valid(), made, pa.scalar(None, kind)) if values.null_count else made
    return values


def _as_list(values: pa.Array) -> pa.Array:
    entry = pa.struct([pa.field("key", values.type.key_type), pa.field("value", values.type.item_type)])
    return values.cast(pa.list_(pa.field("entries", entry)))


def mask_columns(df: DataFrame, terms_col: str, columns: Sequence[str]) -> DataFrame:
    """df with every text in the columns (strings at any depth of structs, arrays and map values) masked by the terms of its row.

    `terms_col` is an array of terms (see `terms`), each row's own. A term is found
    whatever its case and whatever marks of emphasis stand in it; letters and
    digits may not stand on either side (a `prefix` may go on). Null texts and
    null term lists stay as they are. All terms are looked up in one pass; where
    they overlap the longer one wins, then the earlier.
    """

    def masked(kind):
        def apply(values: pa.Array, found: pa.Array) -> pa.Array:
            return _mask_leaves(values, np.arange(len(values)), found.to_pylist(), _maskers())

        apply.__annotations__ = {"values": pa.Array, "found": pa.Array, "return": pa.Array}
        return F.arrow_udf(apply, kind)

    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({c: masked(kinds[c])(F.col(c), F.col(terms_col)) for c in columns})


def own_number_masked(text: Column, digits: Column, mark: str = "[phone]") -> Column:
    """A text with one phone number out, however it is punctuated: runs that are the number, or end as it does, and are written as one.

    A run without signs counts only if it is the number itself or its national form
    (from 0); `digits` of fewer than 7 mask nothing.
    """
    own = F.regexp_replace(F.coalesce(digits, F.lit("")), r"\D", "")
    runs = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![\w+])\+?\(?\d(?:[\d ().-]{5,24})\d(?!\w)"), F.lit(0)))

    def is_own(run: Column) -> Column:
        bare = F.regexp_replace(run, r"\D", "")
        same = (bare == own) | bare.endswith(own) | own.endswith(bare)
        national = F.regexp_replace(bare, "^0", "")
        at_home = bare.startswith("0") & own.endswith(national)
        return (F.char_length(bare) >= 7) & (same | at_home) & (run.rlike(r"[ +().-]") | (bare == own) | bare.startswith("0"))

    longest_first = F.array_sort(F.filter(runs, is_own), lambda a, b: F.char_length(b) - F.char_length(a))
    out = F.aggregate(longest_first, text, lambda t, run: F.replace(t, run, F.lit(mark)))
    return F.when(F.char_length(own) >= 7, out).otherwise(text)


def name_identifiers_masked(text: Column, words: Column, mark: str = "the candidate") -> Column:
    """A text with identifiers (parts joined by _) out that hold two of the words, or one of four letters at least."""
    own = F.transform(F.coalesce(words, F.array().cast("array<string>")), F.lower)
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])[A-Za-z0-9]+(?:_[A-Za-z0-9]+)+(?![A-Za-z0-9_])"), F.lit(0)))

    def tells(token: Column) -> Column:
        both = F.array_intersect(F.split(F.lower(token), "_"), own)
        return (F.size(both) >= 2) | ((F.size(both) == 1) & (F.char_length(F.get(both, F.lit(0))) >= 4))

    longest_first = F.array_sort(F.filter(found, tells), lambda a, b: F.char_length(b) - F.char_length(a))
    return F.aggregate(longest_first, text, lambda t, token: F.regexp_replace(t, F.concat(F.lit("(?<![A-Za-z0-9_])"), token, F.lit("(?![A-Za-z0-9_])")), F.lit(mark)))


# Executors need not have this package: its functions travel with the query.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
