"""A search in conjunctive form narrowed to a number of operators. Columns only.

The form is checked by one expression: groups joined by AND, each a term or
alternatives joined by OR in brackets, all within brackets or not. Every group
stays; of its alternatives as many as the operators allow, taken in turn.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Operators that a plain search takes.
MOST_OPERATORS = 3
_WORD = r"(?<![^\s(\"])(?!(?:AND|OR|NOT)\b)[^\s()\"]+"
_TERM = rf"(?:\"(?=[^\"]*[^\"\s])[^\"\x00-\x1f\x7f]*\"|{_WORD}(?: +{_WORD})*)"
_ALTERNATIVES = rf"{_TERM}(?: +OR +{_TERM})*"
_GROUP = rf"(?:\( *{_ALTERNATIVES} *\)|{_TERM})"
_FORM = rf"^(?:{_GROUP}(?: +AND +{_GROUP})*|{_ALTERNATIVES})$"


def operators(query: Column) -> Column:
    """How many AND, OR and NOT stand in a search outside of quoted terms."""
    bare = F.regexp_replace(F.coalesce(query, F.lit("")), "\"[^\"]*\"", '""')
    return F.size(F.regexp_extract_all(bare, F.lit(r"\b(?:AND|OR|NOT)\b"), F.lit(0)))


def narrowed(query: Column, most: int = MOST_OPERATORS) -> Column:
    """A search with at most `most` operators; as it is if it has no more; null if it is too complex to be narrowed.

    Of each group the first alternative stays, then the second ones in the order
    of the groups, and so on, each alternative once whatever its case. What is
    kept holds only for texts for which the whole search holds. Too complex are
    exclusions, groups within alternatives, open brackets or quotes, and more
    than `most` + 1 groups. Null stays null.
    """
    said = F.trim(F.regexp_replace(query, r"\s+", " "))
    in_brackets = said.rlike(rf"^\( *(?:{_GROUP}(?: +AND +{_GROUP})+|{_ALTERNATIVES}) *\)$")
    inner = F.when(in_brackets, F.trim(F.substring(said, F.lit(2), F.char_length(said) - 2))).otherwise(said)

    def of(text: Column) -> Column:
        one_group = text.rlike(rf"^{_ALTERNATIVES}$")
        groups = F.when(one_group, F.array(text)).otherwise(F.regexp_extract_all(F.regexp_replace(text, r" +AND +(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)", "\n"), F.lit(r"[^\n]+"), F.lit(0)))
        terms = F.transform(groups, lambda g: _distinct(F.regexp_extract_all(F.trim(g, F.lit("() ")), F.lit(_TERM), F.lit(0))))
        alone = lambda t: F.when(in_brackets & (F.size(t) == 1), F.concat(F.lit("("), _kept(t, most), F.lit(")"))).otherwise(_kept(t, most))
        return let(terms, lambda t: F.when(text.rlike(_FORM) & (F.size(t) <= most + 1), alone(t)))

    return F.when(operators(query) <= most, query).otherwise(let(inner, of))


def _distinct(terms: Column) -> Column:
    low = lambda a: F.transform(a, lambda x: F.lower(x))
    return F.filter(F.transform(terms, lambda t: F.trim(t)), lambda t, i: F.array_position(low(F.transform(terms, lambda x: F.trim(x))), F.lower(t)) == i + 1)


def _kept(groups: Column, most: int) -> Column:
    others = F.flatten(F.transform(groups, lambda g, k: F.transform(F.slice(g, F.lit(2), F.greatest(F.size(g) - 1, F.lit(0))), lambda t, i: F.struct(i.alias("turn"), k.alias("group")))))
    budget = F.greatest(F.lit(most + 1) - F.size(groups), F.lit(0))

    def of(taken: Column) -> Column:
        more = lambda k: F.size(F.filter(taken, lambda x: x["group"] == k))
        chosen = F.transform(groups, lambda g, k: F.slice(g, F.lit(1), more(k) + 1))
        several = F.size(groups) > 1
        return F.array_join(F.transform(chosen, lambda g: F.when((F.size(g) > 1) & several, F.concat(F.lit("("), F.array_join(g, " OR "), F.lit(")"))).otherwise(F.array_join(g, " OR "))), " AND ")

    return let(F.slice(F.array_sort(others), F.lit(1), budget), of)
