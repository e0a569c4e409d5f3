"""Typos by deletion neighbourhoods: words meet dictionary terms under what is left of both when letters are deleted.

Two words within k edits (a letter more, less or other, or two neighbours
swapped) share a form that has at most k letters fewer than either, so candidates
come from an equality join and no word meets every term. The exact distance
decides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cased_like, let


def deletions(word: Column, most: int) -> Column:
    """The distinct forms of a word without up to `most` of its letters, itself included."""
    forms = F.array(word)
    for _ in range(most):
        shorter = F.flatten(F.transform(forms, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(w), F.lit(1))), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))))
        forms = F.array_distinct(F.concat(forms, shorter))
    return forms


def edit_distance(a: Column, b: Column) -> Column:
    """Edits from a to b: insertions, deletions, replacements and swaps of neighbours, no place edited twice."""

    def rows(x: Column) -> Column:
        first = F.transform(F.sequence(F.lit(0), F.char_length(x["b"])), lambda j: j)
        start = F.struct(first.alias("last"), first.alias("before"))

        def line(state: Column, i: Column) -> Column:
            at = F.substr(x["a"], i, F.lit(1))
            left = F.substr(x["a"], i - 1, F.lit(1))

            def cell(row: Column, j: Column) -> Column:
                here, prior = F.substr(x["b"], j, F.lit(1)), F.substr(x["b"], j - 1, F.lit(1))
                plain = F.least(F.element_at(row, -1) + 1, F.get(state["last"], j) + 1, F.get(state["last"], j - 1) + F.when(at == here, 0).otherwise(1))
                swapped = (i > 1) & (j > 1) & (at == prior) & (left == here)
                return F.array_append(row, F.when(swapped, F.least(plain, F.get(state["before"], j - 2) + 1)).otherwise(plain))

            row = F.when(F.char_length(x["b"]) == 0, F.array(i)).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.char_length(x["b"]), F.lit(1))), F.array(i), cell))
            return F.struct(row.alias("last"), state["last"].alias("before"))

        return F.when(F.char_length(x["a"]) == 0, F.char_length(x["b"])).otherwise(F.element_at(F.aggregate(F.sequence(F.lit(1), F.greatest(F.char_length(x["a"]), F.lit(1))), start, line, lambda s: s["last"]), -1))

    return let(F.struct(a.alias("a"), b.alias("b")), rows)


def by_length(word: Column, term: Column) -> Column:
    """Edits allowed: of words of 8 letters that share their first and last, 1, from 11 letters 2, and a fifth of the longer at most."""
    most = F.greatest(F.char_length(word), F.char_length(term))
    same_ends = (F.left(word, F.lit(1)) == F.left(term, F.lit(1))) & (F.right(word, F.lit(1)) == F.right(term, F.lit(1)))
    return F.when(same_ends & (F.char_length(word) >= 8), F.least(F.when(most >= 11, 2).otherwise(1), F.floor(most * 0.2).cast("int"))).otherwise(0)


def corrections(words: DataFrame, dictionary: DataFrame, most: int = 2, allowed: Callable[[Column, Column], Column] = by_length) -> DataFrame:
    """(word, term, distance): the nearest term of each word that is none itself, within `allowed(word, term)` and `most` edits.

    words has a column `word`, dictionary `term` and optionally `rank` (the lower
    wins among terms equally near; else the alphabet decides). All count in lower
    case, repeats once; null and blank ones not at all.
    """
    own = words.select(F.lower("word").alias("word")).filter("trim(word) <> ''").distinct()
    rank = F.col("rank") if "rank" in dictionary.columns else F.lit(0)
    terms = dictionary.select(F.lower("term").alias("term"), rank.cast("long").alias("rank")).filter("trim(term) <> ''").groupBy("term").agg(F.min("rank").alias("rank"))
    unknown = own.join(terms, own["word"] == terms["term"], "left_anti")
    forms = lambda df, c: df.withColumn("form", F.explode(deletions(F.col(c), most)))
    pairs = forms(unknown, "word").join(forms(terms, "term"), "form").select("word", "term", "rank").distinct()
    within = F.abs(F.char_length("word") - F.char_length("term")) <= most
    limit = F.least(F.lit(most), allowed(F.col("word"), F.col("term")))
    near = pairs.filter(within & (limit > 0)).withColumn("distance", edit_distance(F.col("word"), F.col("term"))).filter(F.col("distance") <= limit)
    best = near.groupBy("word").agg(F.min(F.struct("distance", "rank", "term")).alias("best"))
    return best.select("word", "best.term", "best.distance")


def corrected_texts(texts: DataFrame, id_col: str, text_col: str, dictionary: DataFrame, aliases: dict[str, str] | None = None, kept: tuple[str, ...] = (), most: int = 2, allowed: Callable[[Column, Column], Column] = by_length) -> DataFrame:
    """texts with `corrected` and `changes` (as `word -> term`, in order): each run of ASCII letters as its alias, else its nearest term.

    The case of a word is carried over. `kept` words stay. Words are looked up
    once however often they stand in the texts; a text without a correction, and
    null, comes through as it is.
    """
    rows = texts.withColumn("__row", F.monotonically_increasing_id())
    pieces = rows.select("__row", F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit("[A-Za-z]+|[^A-Za-z]+"), F.lit(0))).alias("__at", "__piece"))
    spark = texts.sparkSession
    known = {k.lower(): v.lower() for k, v in (aliases or {}).items()}
    own = spark.createDataFrame(list(known.items()), "word string, term string")
    words = pieces.filter(F.col("__piece").rlike("^[A-Za-z]")).select(F.lower("__piece").alias("word")).distinct()
    if kept or known:
        words = words.filter(~F.col("word").isin(*{w.lower() for w in kept}, *known))
    found = corrections(words, dictionary, most, allowed).select("word", "term").unionByName(own.filter(~F.col("word").isin(*{w.lower() for w in kept})) if kept else own)
    changed = pieces.join(found, F.lower("__piece") == F.col("word"))
    fixed = cased_like(F.col("__piece"), F.col("term"))
    changed = changed.select("__row", "__at", F.struct("__at", "__piece", fixed.alias("to")).alias("__change")).filter(F.col("__change.to") != F.col("__change.__piece"))
    by = changed.groupBy("__row").agg(F.sort_array(F.collect_list("__change")).alias("__changes"))
    out = rows.join(by, "__row", "left")
    parts = F.regexp_extract_all(F.col(text_col), F.lit("[A-Za-z]+|[^A-Za-z]+"), F.lit(0))
    at = F.map_from_entries(F.transform("__changes", lambda c: F.struct(c["__at"], c["to"])))
    corrected = let(F.struct(parts.alias("p"), at.alias("m")), lambda x: F.array_join(F.transform(x["p"], lambda p, i: F.coalesce(F.try_element_at(x["m"], i), p)), ""))
    changes = F.transform("__changes", lambda c: F.concat_ws(" -> ", c["__piece"], c["to"]))
    none = F.col("__changes").isNull()
    return out.select(*texts.columns, F.when(none, F.col(text_col)).otherwise(corrected).alias("corrected"), F.when(none, F.array().cast("array<string>")).otherwise(changes).alias("changes"))


#: Spellings of units and of an immediate start.
UNITS: dict[str, tuple[str, ...]] = {
    "month": ("month", "months", "monht", "monhts", "monhth", "monhths", "moth", "moths", "mothn", "mothns", "monnth", "monnths", "monthh", "monthhs"),
    "week": ("week", "weeks", "wek", "weks", "weeek", "weeeks"),
    "day": ("day", "days", "daay", "daays", "dayz"),
}
IMMEDIATE = ("imm", "immed", "imdt", "immdiate", "immedaite", "imediate", "immediatey", "immediatly", "immediatley", "immediatelly", "immidiately", "immidiate", "immediate", "immediately")
NUMBERS = {"one": 1, "a": 1, "an": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6}


def notice_corrected(text: Column) -> Column:
    """A notice period in its plain form: `Immediate`, `2 months`; dates and what is not understood stay, with units spelled right.

    Words of 7 to 12 letters within two edits of immediate(ly) count as it; a bare
    number to 12 is of months.
    """
    t = F.trim(F.coalesce(text, F.lit("")))
    dated = t.rlike(r"\b20\d{2}[-/]\d{1,2}[-/]\d{1,2}\b|\b\d{1,2}[/-]\d{1,2}[/-]20\d{2}\b")
    units = F.create_map(*(F.lit(x) for u, ws in UNITS.items() for w in ws for x in (w, u if w[-1] not in "sz" else f"{u}s")))

    def read(pieces: Column) -> Column:
        low = lambda p: F.lower(p)
        near = lambda p: F.char_length(p).between(7, 12) & p.rlike("^[A-Za-z]+$") & ((edit_distance(low(p), F.lit("immediate")) <= 2) | (edit_distance(low(p), F.lit("immediately")) <= 2))
        now = F.exists(pieces, lambda p: low(p).isin(*IMMEDIATE) | near(p))
        spelled = F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(units, low(p)), p)), "")

        def plain(s: Column) -> Column:
            count = F.regexp_extract(F.lower(s), r"^(\d+|one|an?|two|three|four|five|six)\s*(day|week|month)s?$", 1)
            unit = F.regexp_extract(F.lower(s), r"^(?:\d+|one|an?|two|three|four|five|six)\s*(day|week|month)s?$", 1)
            named = F.create_map(*(F.lit(x) for k, v in NUMBERS.items() for x in (k, v)))
            n = F.coalesce(F.try_element_at(named, count), count.try_cast("int"))
            bare = F.when(s.rlike(r"^\d+$"), s.try_cast("int"))
            with_unit = lambda k, u: F.concat(k.cast("string"), F.lit(" "), u, F.when(k == 1, "").otherwise("s"))
            return (
                F.when(now | s.rlike(r"(?i)\b(?:available|availble|avalable)\s+now\b") | F.lower(s).isin("0", "none", "nil", "n/a") | (bare == 0), "Immediate")
                .when((unit != "") & n.isNotNull(), with_unit(n, unit))
                .when(bare.between(1, 12), with_unit(bare, F.lit("month")))
                .otherwise(s)
            )

        return let(F.trim(F.regexp_replace(spelled, r"\s+", " ")), plain)

    return F.when((t == "") | dated, t).otherwise(let(F.regexp_extract_all(t, F.lit("[A-Za-z]+|[^A-Za-z]+"), F.lit(0)), read))


