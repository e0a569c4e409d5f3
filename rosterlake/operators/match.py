"""Joins and entity matching.

Fuzzy joins never compare all pairs: both sides are blocked by tokens that a
match must share, and small sides are broadcast only where Spark's own size
check allows it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from ..functions.text import bound, companies_match, company_name
from . import phrases, set_blocks

#: Most bytes of distinct quotes that are sent to all tasks.
QUOTES = 2**22


def _grams(name: Column, n: int = 4) -> Column:
    """Distinct runs of n characters; of a shorter name, itself."""
    return F.when(F.length(name) < n, F.array(name)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - n + 1, F.lit(1))), lambda k: F.substring(name, k, F.lit(n)))))


def held_in(outer: DataFrame, o: str, inner: DataFrame, i: str, n: int = 4) -> DataFrame:
    """(o, i): the distinct outer texts that hold a distinct inner one of n characters at least.

    An inner text is looked up by the one of its runs of n characters that the
    fewest outer texts have, so a beginning that all share costs nothing.
    """
    long = lambda df, c: df.select(c).filter(F.length(c) >= n).distinct()
    wanted = long(inner, i).select(i, F.explode(_grams(F.col(i), n)).alias("__run"))
    runs = long(outer, o).select(o, F.explode(_grams(F.col(o), n)).alias("__run")).join(wanted.select("__run").distinct(), "__run", "left_semi")
    counted = wanted.join(runs.groupBy("__run").agg(F.count("*").alias("__held")), "__run", "left")
    rare = counted.groupBy(i).agg(F.min(F.struct(F.coalesce("__held", F.lit(0)).alias("held"), "__run")).alias("__rare")).filter("__rare.held > 0").select(i, F.col("__rare.__run").alias("__run"))
    return runs.join(rare, "__run").filter(F.col(o).contains(F.col(i))).select(o, i)


def fuzzy_semi_join(left: DataFrame, right: DataFrame, left_col: str, right_col: str) -> DataFrame:
    """Left rows whose normalised name equals, holds or lies in a right one (four characters at least for the latter two).

    Each distinct name is looked up once, by the rarest of its runs of four
    characters, in both directions. Blank and null names match nothing.
    """
    own = left.withColumn("__name", company_name(F.col(left_col)))
    a = own.select("__name").filter("__name <> ''").distinct()
    b = right.select(company_name(F.col(right_col)).alias("__other")).filter("__other <> ''").distinct()
    equal = a.join(b, F.col("__name") == F.col("__other"), "left_semi")
    found = equal.union(held_in(a, "__name", b, "__other").select("__name")).union(held_in(b, "__other", a, "__name").select("__name")).distinct()
    return own.join(found, "__name", "left_semi").drop("__name")


def best_jaccard(left: DataFrame, right: DataFrame, *, family: str, left_id: str, right_id: str, left_tokens: str, right_tokens: str, least: float, same_rows: bool = False) -> DataFrame:
    """(left id, right id, similarity): for each left row the most similar right row of its family, from `least` on; the least right id of equals.

    same_rows: both sides are the same rows, and none is matched with its own id.
    Rows of null family are one family. Equal sets of a family are one class (by
    128-bit digests): only an equal set has similarity 1, so a row whose class
    holds another right row is done. Classes left over meet by size: sets whose
    sizes allow the similarity are in one band of sizes or in neighbouring ones,
    bands are cut into blocks of a bounded number of tokens, and blocks meet block
    by block, so no pair of sets is ever a row: by signatures first
    (`set_blocks.likely`), which rule out most pairs and none that is similar, then
    the sets that are left by their tokens (`set_blocks.best`). Words are compared
    by 64-bit hashes. Null and empty sets match nothing.
    """

    def rows(df: DataFrame, id_col: str, token_col: str) -> DataFrame:
        made = bound(df.select(F.to_json(F.struct(F.col(family).alias("f"))).alias("fam"), F.col(id_col).alias("id"), F.col(token_col).alias("s")), s=F.sort_array(F.array_distinct(F.array_compact("s")))).filter(F.size("s") > 0)
        return made.withColumn("cls", F.md5(F.concat_ws("\x1f", "fam", F.array_join("s", "\x1f")).cast("binary")))

    a, b = rows(left, left_id, left_tokens), rows(right, right_id, right_tokens)
    # the two least ids of a class are enough: one of them is not the row itself
    ranked = b.select("cls", "id").withColumn("rank", F.dense_rank().over(Window.partitionBy("cls").orderBy("id"))).filter("rank <= 2")
    firsts = ranked.groupBy("cls").agg(F.min("id").alias("first"), F.min(F.when(F.col("rank") == 2, F.col("id"))).alias("second"))
    other = F.when(F.lit(same_rows) & (F.col("id") == F.col("first")), F.col("second")).otherwise(F.col("first"))
    own = a.select("cls", "id").join(firsts, "cls", "left").withColumn("other", other).select("cls", "id", "other")
    alone = own.filter("other is null")

    # only a class whose rows have no other row asks for another class
    side = lambda df, asks, answers: df.select("cls", "fam", F.transform("s", lambda t: F.xxhash64(t)).alias("t"), F.lit(asks).alias("asks"), F.lit(answers).alias("answers"), F.when(F.lit(answers), F.col("id")).alias("id"))
    sets = side(a, True, True) if same_rows else side(a, True, False).union(side(b, False, True))
    sets = sets.groupBy("cls").agg(F.first("fam").alias("fam"), F.first("t").alias("t"), F.max("asks").alias("asks"), F.max("answers").alias("answers"), F.min("id").alias("first"), F.max("id").alias("last"))
    asks = F.col("asks") & (F.col("first").isNull() | (F.lit(same_rows) & (F.col("first") == F.col("last"))))
    hashed = sets.select("cls", "fam", asks.alias("asks"), "answers", "first", F.size("t").alias("n"), "t").filter("asks or answers")
    hashed = hashed.withColumn("band", F.floor(F.log("n") / F.lit(-math.log(least))).cast("int"))
    sizes = hashed.groupBy("fam", "band").agg(F.greatest(F.ceil(F.sum("n") / F.lit(set_blocks.TOKENS)), F.ceil(F.count("*") / F.lit(set_blocks.SETS))).cast("int").alias("parts"))
    dealt = hashed.join(sizes, ["fam", "band"]).withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    # a block meets itself, the later blocks of its band and all of the next band: either end of a meeting is told by the rows' own block
    near = sizes.select("fam", (F.col("band") - 1).alias("band"), F.col("parts").alias("above")), sizes.select("fam", (F.col("band") + 1).alias("band"), F.col("parts").alias("below"))
    ends = dealt.join(near[0], ["fam", "band"], "left").join(near[1], ["fam", "band"], "left")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    meeting = lambda band, p, other_band, q, side: F.struct(band.alias("m1"), p.alias("m2"), other_band.alias("m3"), q.alias("m4"), F.lit(side).alias("side"))
    band, part = F.col("band"), F.col("part")
    meets = F.concat(
        F.transform(upto(F.col("parts")), lambda q: F.when(q >= part, meeting(band, part, band, q, 0)).otherwise(meeting(band, q, band, part, 1))),
        F.transform(upto(F.coalesce("above", F.lit(0))), lambda q: meeting(band, part, band + 1, q, 0)),
        F.transform(upto(F.coalesce("below", F.lit(0))), lambda q: meeting(band - 1, q, band, part, 1)),
    )
    # signatures meet first, then the sets that have a pair there
    meeting_of = ["fam", "m1", "m2", "m3", "m4"]
    places = "fam string, m1 int, m2 int, m3 int, m4 int, side int, cls string"
    signed = ends.select("fam", "cls", "asks", "answers", "n", "band", "part", "parts", "above", "below", "t").mapInArrow(set_blocks.signed(least), "fam string, cls string, asks boolean, answers boolean, n int, band int, part int, parts int, above int, below int, sig binary")
    met = signed.select("fam", "cls", "asks", "answers", "n", "sig", F.inline(meets)).groupBy(*meeting_of).applyInArrow(set_blocks.likely(least), places)
    kind = dict(b.dtypes)["id"]
    scored = met.join(hashed.drop("band"), ["fam", "cls"]).groupBy(*meeting_of).applyInArrow(set_blocks.best(least), f"cls string, similarity double, other {kind}")
    best = scored.groupBy("cls").agg(F.min(F.struct((-F.col("similarity")).alias("minus"), "other")).alias("x"))
    found = own.filter("other is not null").select("id", "other", F.lit(1.0).alias("similarity"))
    found = found.union(alone.join(best, "cls").select("id", F.col("x.other"), -F.col("x.minus")))
    return found.select(F.col("id").alias(left_id), F.col("other").alias(right_id + "_best"), "similarity")


def _flat(c: str) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " "))


def grouped_evidence(quotes: DataFrame, texts: DataFrame, key: str, quote_col: str, text_col: str) -> DataFrame:
    """quotes with grounded: whether the quote stands in the text of its key, white space squeezed."""
    joined = quotes.join(texts.select(key, F.col(text_col).alias("__text")), key, "left")
    return joined.withColumn("grounded", (_flat(quote_col) != "") & _flat("__text").contains(_flat(quote_col))).drop("__text")


def evidence_anywhere(quotes: DataFrame, texts: DataFrame, quote_col: str, id_col: str, text_col: str, most: int = QUOTES) -> DataFrame:
    """quotes with id_col and grounded: a row for each text that holds the quote, white space squeezed; a null id and false where none does.

    Up to `most` bytes of distinct quotes are sent to all tasks, and each text is
    read once and meets all of them there; no text is shuffled. More quotes are
    joined with the texts by words.
    """
    own = quotes.drop(id_col).withColumn("__q", _flat(quote_col))
    wanted = own.select("__q").filter("__q <> ''").distinct()
    if (wanted.agg(F.sum(F.octet_length("__q"))).first()[0] or 0) <= most:
        row = T.StructType([T.StructField("__q", T.StringType()), T.StructField("__id", texts.schema[id_col].dataType)])
        search = phrases.held([r[0] for r in wanted.collect()])
        found = texts.select(F.col(id_col).alias("__id"), F.col(text_col).cast("binary").alias("__t")).mapInArrow(search, row)
    else:
        found = _held_by_words(wanted, texts.select(F.col(id_col).alias("__id"), _flat(text_col).alias("__t")))
    found = found.withColumn("__g", F.lit(True))
    return own.join(found, "__q", "left").select(*quotes.drop(id_col).columns, F.col("__id").alias(id_col), F.coalesce("__g", F.lit(False)).alias("grounded"))


def _held_by_words(wanted: DataFrame, t: DataFrame) -> DataFrame:
    """(__q, __id): the texts __t that hold a quote, for each quote.

    A text that holds a quote has all words of it but the first and last whole,
    the first at the end of a word and the last at the beginning of one, so texts
    are looked up by the one of these that the fewest have. A single word is
    looked up among the distinct words of all texts.
    """
    words = F.split("__q", " ")
    parts = F.when(F.size(words) == 1, F.array(F.struct(F.lit("any").alias("as"), F.col("__q").alias("part")))).otherwise(
        F.concat(
            F.transform(F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))), lambda w: F.struct(F.lit("whole").alias("as"), w.alias("part"))),
            F.array(F.struct(F.lit("end").alias("as"), F.element_at(words, 1).alias("part")), F.struct(F.lit("start").alias("as"), F.element_at(words, -1).alias("part"))),
        )
    )
    asked = wanted.select("__q", F.inline(F.array_distinct(parts)))
    word_of = t.select("__id", F.explode(F.array_distinct(F.split("__t", " "))).alias("w")).filter("w <> ''")
    known = word_of.groupBy("w").agg(F.count("*").alias("n"))
    part_of = lambda kind: asked.filter(F.col("as") == kind).select("part").distinct()
    ends = known.select("w", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("w")), lambda k: F.substr("w", k))).alias("part"))
    starts = known.select("w", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("w")), lambda k: F.left("w", k))).alias("part"))
    tag = lambda df, kind: df.select("w", "n", "part", F.lit(kind).alias("as"))
    single = part_of("any")
    inside = [held_in(known, "w", single, "part").join(known, "w")]
    inside += [known.select("w", "n", F.explode(_grams(F.col("w"), k)).alias("part")).join(single.filter(F.length("part") == k), "part", "left_semi") for k in (1, 2, 3)]
    hits = tag(known.withColumn("part", F.col("w")).join(part_of("whole"), "part", "left_semi"), "whole")
    for df, kind in ((ends.join(part_of("end"), "part", "left_semi"), "end"), (starts.join(part_of("start"), "part", "left_semi"), "start"), *((x, "any") for x in inside)):
        hits = hits.union(tag(df, kind))
    sums = hits.groupBy("as", "part").agg(F.sum("n").alias("n"))
    rare = asked.join(sums, ["as", "part"], "left").groupBy("__q").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "as", "part")).alias("x")).filter("x.n > 0").select("__q", "x.as", "x.part")
    near = rare.join(hits.select("as", "part", "w"), ["as", "part"]).select("__q", "w").join(word_of, "w").select("__q", F.col("__id").alias("__at")).distinct()
    return near.join(t, F.col("__at").eqNullSafe(F.col("__id"))).filter(F.col("__t").contains(F.col("__q"))).select("__q", "__id")


def merge_missing(primary: DataFrame, secondary: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Outer merge by key: the primary's values, its blanks filled from the secondary."""
    p = primary.select(key, *(F.col(c).alias(f"__p_{c}") for c in columns))
    s = secondary.select(key, *(F.col(c).alias(f"__s_{c}") for c in columns))
    fill = lambda c: F.coalesce(F.when(F.trim(F.col(f"__p_{c}").cast("string")) != "", F.col(f"__p_{c}")), F.col(f"__s_{c}")).alias(c)
    return p.join(s, key, "full_outer").select(key, *map(fill, columns))


def lookup_with_fallback(rows: DataFrame, prices: DataFrame, key: str, group: str, values: Sequence[str]) -> DataFrame:
    """rows with the price of their key, else of their group (the row of prices with a null key), and price_source exact, group or none."""
    exact = prices.filter(F.col(key).isNotNull()).select(F.col(key), F.col(group), *(F.col(v).alias(f"__e_{v}") for v in values), F.lit(True).alias("__e"))
    wide = prices.filter(F.col(key).isNull()).select(group, *(F.col(v).alias(f"__g_{v}") for v in values), F.lit(True).alias("__g"))
    out = rows.join(exact, [key, group], "left").join(wide, group, "left")
    source = F.when(F.col("__e"), "exact").when(F.col("__g"), "group").otherwise("none")
    return out.select(*rows.columns, *(F.coalesce(f"__e_{v}", f"__g_{v}").alias(v) for v in values), source.alias("price_source"))


def first_match(text: Column, names: Sequence[str]) -> Column:
    """The name of a manual list that a text means: an equal one, else the first in order that holds or lies in the text; case ignored, null if none.

    The list is part of the expression, so there is no join.
    """
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    out = F.lit(None).cast("string")
    for n in reversed(names):
        key = n.strip().lower()
        out = F.when((low != "") & (low.contains(key) | F.lit(key).contains(low)), F.lit(n)).otherwise(out)
    for n in reversed(names):
        out = F.when(low == n.strip().lower(), F.lit(n)).otherwise(out)
    return out


def nearest_earlier(left: DataFrame, right: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """left with the right value of the same key at or before its time: one union and an ordered window, no range join."""
    a = left.select("*", F.lit(None).cast(dict(right.dtypes)[value]).alias("__v"), F.lit(1).alias("__side"))
    b = right.select(by, at, F.col(value).alias("__v"), F.lit(0).alias("__side"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(f"{value}_as_of", F.last("__v", ignorenulls=True).over(w)).filter("__side = 1").drop("__v", "__side")


def greedy_assignment(pairs: DataFrame, group: str, left: str, right: str, score: str, least: float) -> DataFrame:
    """(group, left, right, score): within each group the best pairs first, each side used once; ties by left, then right.

    A fold over a group's sorted pairs in the JVM. A group is one document's own pairs.
    """
    kinds = dict(pairs.dtypes)
    row = F.struct((-F.col(score)).alias("minus"), F.col(left).alias("l"), F.col(right).alias("r"))
    ordered = F.array_sort(F.collect_set(row))
    start = F.array().cast(f"array<struct<minus:{kinds[score]},l:{kinds[left]},r:{kinds[right]}>>")
    kept = F.aggregate(ordered, start, lambda acc, x: F.when(F.exists(acc, lambda y: (y["l"] == x["l"]) | (y["r"] == x["r"])), acc).otherwise(F.concat(acc, F.array(x))))
    found = pairs.filter(F.col(score) >= least).groupBy(group).agg(kept.alias("kept")).select(group, F.explode("kept").alias("x"))
    return found.select(group, F.col("x.l").alias(left), F.col("x.r").alias(right), (-F.col("x.minus")).alias(score))


def with_rules(scenarios: DataFrame, rules: DataFrame, rates: DataFrame) -> DataFrame:
    """scenarios (country, tax_year, residency, reporting_currency, fx_override) with their rule (null where there is none) and exchange rate.

    A rule is met by country and residency, case ignored, and year; what is
    reported in is the rule's currency if nothing is said. rates: (base, quote,
    rate, fresh); the rate is the override, 1 for one currency, else the fresh
    one or, for want of that, the stale one; fx_source tells which.
    """
    low = lambda c: F.lower(F.trim(c))
    r = rules.withColumns({"__c": low(F.col("country")), "__r": low(F.col("residency"))}).drop("country", "residency").withColumnRenamed("tax_year", "__y")
    met = scenarios.join(r, (low(F.col("country")) == F.col("__c")) & (F.col("tax_year") == F.col("__y")) & (low(F.coalesce("residency", F.lit("Resident"))) == F.col("__r")), "left").drop("__c", "__r", "__y")
    local, quote = F.upper(F.trim("currency")), F.upper(F.trim(F.coalesce(F.nullif("reporting_currency", F.lit("")), "currency")))
    best = rates.groupBy(F.col("base").alias("__b"), F.col("quote").alias("__q")).agg(F.max(F.struct("fresh", "rate")).alias("__x"))
    priced = met.withColumns({"currency": local, "reporting_currency": quote}).join(best, (F.col("currency") == F.col("__b")) & (F.col("reporting_currency") == F.col("__q")), "left")
    rate = F.when(F.col("fx_override").isNotNull(), F.col("fx_override")).when(F.col("currency") == F.col("reporting_currency"), 1.0).otherwise(F.col("__x.rate"))
    source = F.when(F.col("fx_override").isNotNull(), "manual override").when(F.col("currency") == F.col("reporting_currency"), "same").when(F.col("__x.fresh"), "fresh").when(F.col("__x").isNotNull(), "stale")
    return priced.withColumns({"fx_rate": rate, "fx_source": source}).drop("__b", "__q", "__x")


def contact_matches(people: DataFrame, contacts: DataFrame, person_id: str, contact_id: str, score: Callable[[Column, Column, Column], Column], best: int = 10) -> DataFrame:
    """(person, contact, score, company_matches): contacts with a person's name, the best first, at most `best` a person (the operator's own limit).

    people and contacts: (id, name, company). Names meet by a word: the person's
    first or last of three letters at least. score(name, name, same company) is
    null for no match; one company gives 5 more, up to 100. Each pair of distinct
    names is scored once. Of the contacts of a name a person needs the `best`
    first ones and those of the own company, so people and contacts of one common
    name are never paired with each other. Repeated rows count once.
    """
    words = lambda c: F.filter(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 3)
    p = people.select(F.col(person_id).alias("__p"), F.col("name").alias("__pn"), F.col("company").alias("__pc"))
    c = contacts.select(F.col(contact_id).alias("__c"), F.col("name").alias("__cn"), F.col("company").alias("__cc")).distinct()
    ends = F.array_compact(F.array_distinct(F.array(F.try_element_at(words("__pn"), F.lit(1)), F.try_element_at(words("__pn"), F.lit(-1)))))
    asked = p.select("__pn").distinct().select("__pn", F.explode(ends).alias("__w"))
    known = c.select("__cn").distinct().select("__cn", F.explode(F.array_distinct(words("__cn"))).alias("__w"))
    names = asked.join(known, "__w").select("__pn", "__cn").distinct()
    names = names.select("__pn", "__cn", score(F.col("__pn"), F.col("__cn"), F.lit(True)).alias("__with"), score(F.col("__pn"), F.col("__cn"), F.lit(False)).alias("__without")).filter("__with is not null or __without is not null")

    # companies that match: equal or one within the other, each distinct pair once
    normal = lambda df, col: df.select(col).distinct().withColumn("__n", company_name(F.col(col))).filter("__n <> ''")
    ours, theirs = normal(p, "__pc"), normal(c, "__cc").withColumnRenamed("__n", "__m")
    same = ours.select("__n").join(theirs.select("__m"), F.col("__n") == F.col("__m"))
    met = same.union(held_in(ours, "__n", theirs, "__m")).union(held_in(theirs, "__m", ours, "__n").select("__n", "__m")).distinct()
    companies = ours.join(met, "__n").join(theirs, "__m").select("__pc", "__cc").distinct()

    order = Window.partitionBy("__cn").orderBy("__c")
    first = c.withColumn("__k", F.row_number().over(order)).filter(F.col("__k") <= best).drop("__k")
    who = p.select("__pn", "__pc").distinct()
    by_name = who.join(names, "__pn").join(first, "__cn").withColumn("company_matches", companies_match(F.col("__pc"), F.col("__cc")))
    mine = who.join(companies, "__pc").join(names, "__pn").join(c, ["__cn", "__cc"]).withColumn("company_matches", F.lit(True))
    columns = ["__pn", "__pc", "__c", "__cn", "__with", "__without", "company_matches"]
    found = by_name.select(columns).union(mine.select(columns)).distinct().withColumn("score", F.when(F.col("company_matches"), F.col("__with")).otherwise(F.col("__without"))).filter("score is not null")
    found = found.withColumn("score", F.least(F.col("score") + F.when(F.col("company_matches"), 5).otherwise(0), F.lit(100)))
    w = Window.partitionBy("__pn", "__pc").orderBy(F.col("score").desc(), F.col("company_matches").desc(), F.lower("__cn"), "__c")
    top = found.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= best)
    on = (F.col("__pn") == F.col("n2")) & F.col("__pc").eqNullSafe(F.col("c2"))
    out = p.distinct().join(top.select(F.col("__pn").alias("n2"), F.col("__pc").alias("c2"), "__c", "score", "company_matches"), on)
    return out.select(F.col("__p").alias(person_id), F.col("__c").alias(contact_id), "score", "company_matches")


def observed_people(picks: DataFrame, cards: DataFrame, generic: Sequence[str], most: int = 24) -> DataFrame:
    """cards (id, url, name, title, company, text) that were picked (pick, id, title), with evidence: the company's first own word and the title stand in the card's text. One of each url, the first pick of it; of the first `most` picks (the operator's own limit)."""
    first = F.try_element_at(F.filter(F.split(F.lower("company"), "[^a-z0-9]+"), lambda w: (F.length(w) > 1) & ~w.isin(*generic)), F.lit(1))
    p = picks.orderBy("pick").limit(most).select("pick", "id", F.col("title").alias("__said"))
    met = p.join(cards, "id").withColumns({"title": F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.trim("__said")), "__first": first})
    shown = met.filter((F.col("title") != "") & F.lower("text").contains(F.lower("title")) & F.array_contains(F.split(F.lower("text"), "[^a-z0-9_]+"), F.col("__first")))
    w = Window.partitionBy("url").orderBy("pick")
    return shown.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", "__said", "__first")
