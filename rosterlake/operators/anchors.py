"""Items placed in the text that they were read from: headings as anchors, and the regions between them.

Lines meet items by their beginnings, word by word, inside a document, so names
that begin alike cost nothing; a line is an item's heading if it begins with all
words of the name and nothing but dates, places and signs follow. Only an anchor
that stands once tells anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import MONTHS
from ..functions.text import bound, let
from .work_history import BREAKS, cleaned

#: Words of a line's beginning that are looked up; of longer names the first ones are.
MOST_WORDS = 12
#: Words that may follow a name in its heading.
TAIL_WORDS = ("present", "current", "now", "to", "till", "date", "sdn", "bhd", "ltd", "limited", "inc", "pte", "malaysia", "singapore", "full", "time", "part", "contract", "permanent")
_TAIL = rf"^(?:\d{{1,4}}|(?:{'|'.join(MONTHS)})[a-z]*|{'|'.join(TAIL_WORDS)})$"


def word_form(text: Column) -> Column:
    """Lower-case words of letters and digits with one space between them."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def _tail(words: Column) -> Column:
    """How many words at the end of a line may follow a name; its first word is none of them."""
    is_tail = lambda w: w.rlike(_TAIL)
    others = F.slice(F.split(words, " "), F.lit(2), F.size(F.split(words, " ")))
    return F.when(is_tail(F.substring_index(words, " ", -1)), F.aggregate(others, F.lit(0), lambda n, w: F.when(is_tail(w), n + 1).otherwise(0))).otherwise(0)


def flattened(text: Column) -> Column:
    """struct(flat, starts): a text on one line, and where in it the lines that are not blank begin (characters from 0)."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\R"), lambda l: F.trim(F.regexp_replace(l, r"\s+", " "))), lambda l: l != "")
    starts = F.aggregate(lines, F.array().cast("array<int>"), lambda a, l: F.array_append(a, F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + F.char_length(l) + 1))
    return F.struct(F.array_join(lines, " ").alias("flat"), F.slice(F.array_prepend(starts, F.lit(0)), F.lit(1), F.greatest(F.size(lines), F.lit(0))).alias("starts"))


def _marked(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, name_col: str) -> DataFrame:
    """(row, id, n, line, names): the lines of the documents that have items; `names` are those that a line heads.

    A line that is looked up by several beginnings is a row for each that finds
    names, and one of them has the line, the others null. The documents are read
    once and all that is told of one stays where its id is, so `row` numbers them
    in one way only.
    """
    names = items.filter(F.col(id_col).isNotNull() & F.col(name_col).isNotNull()).groupBy(F.col(id_col).alias("item_of")).agg(F.collect_set(name_col).alias("names"))
    both = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), cleaned(F.col(text_col)).alias("text")).join(names, F.col("id") == F.col("item_of"))
    rows = both.select(F.monotonically_increasing_id().alias("row"), "id", "names", F.split("text", BREAKS).alias("lines"))
    # names come first, as lines of number -1, and meet the lines by a key
    kind = lambda n, line, name: F.struct(n.alias("n"), line.alias("line"), name.alias("name"))
    null = F.lit(None).cast("string")
    all_lines = F.concat(F.transform("names", lambda x: kind(F.lit(-1), null, x)), F.filter(F.transform("lines", lambda x, i: kind(i, x, null)), lambda x: F.trim(x["line"], F.lit(" \t")) != ""))
    rows = rows.select("row", "id", F.inline(all_lines))
    rows = bound(rows, words=word_form(F.coalesce("line", "name"))).filter("line is not null or words <> ''")
    rows = bound(rows, total=F.size(F.split("words", " ")), tail=_tail(F.col("words")))
    # a name ends where only tail words follow, so other beginnings need not be looked up; longer names go by their first words
    said = F.when(F.col("line").isNull(), F.col("total")).otherwise(F.greatest(F.col("total") - F.col("tail"), F.lit(1)))
    most = F.least("total", F.lit(MOST_WORDS))
    keys = F.transform(F.sequence(F.least(said, most), most), lambda k: F.xxhash64(F.call_function("substring_index", F.col("words"), F.lit(" "), k)))
    rows = rows.select("row", "id", "n", "line", "name", said.alias("said"), F.posexplode(keys).alias("at", "key"))
    w = Window.partitionBy("id", "row", "key").orderBy("n")
    met = rows.withColumn("names", F.collect_list(F.when(F.col("n") < 0, F.struct("name", "said"))).over(w)).filter("n >= 0 and (at = 0 or size(names) > 0)")
    # equal keys are no proof, and of a long name only the beginning was looked up
    spaced = lambda c: F.concat(word_form(c), F.lit(" "))
    fit = let(spaced(F.col("line")), lambda line: F.filter("names", lambda x: (x["said"] >= F.col("said")) & line.startswith(spaced(x["name"]))))
    met = met.withColumn("names", F.when(F.size("names") > 0, F.transform(fit, lambda x: x["name"])).otherwise(F.array().cast("array<string>")))
    return met.select("row", "id", "n", F.when(F.col("at") == 0, F.col("line")).alias("line"), "names")


def headings(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", name_col: str = "name") -> DataFrame:
    """(row, id, name, line): the lines that read as the heading of a name of their document's items.

    Names are compared by their words, so punctuation decides nothing. Blank names
    and null texts have no headings; repeated items count once, repeated documents
    are rows of their own. Ids that are null meet nothing.
    """
    return _marked(docs, items, id_col, text_col, name_col).select("row", F.col("id").alias(id_col), F.explode("names").alias("name"), F.col("n").alias("line"))


def regions(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", name_col: str = "name") -> DataFrame:
    """(id, name, line, lines): for each item whose heading stands once in its document, the lines from there to the next heading of any item.

    An item with no heading, or several, has no region; its headings still end
    the regions before them.
    """
    # rows of one line are peers of the window, so they get one number
    region = F.count(F.when(F.size("names") > 0, 1)).over(Window.partitionBy("id", "row").orderBy("n"))
    cut = _marked(docs, items, id_col, text_col, name_col).withColumn("region", region).filter("region > 0")
    said = F.sort_array(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("n", F.trim("line").alias("said")))))
    parts = cut.groupBy("id", "row", "region").agg(F.min("n").alias("line"), F.flatten(F.collect_list(F.when(F.size("names") > 0, F.col("names")))).alias("names"), said.alias("said"))
    found = parts.select("id", "row", "line", F.explode("names").alias("name"), F.transform(F.slice("said", F.lit(2), F.size("said")), lambda x: x["said"]).alias("lines"))
    once = found.withColumn("times", F.count("*").over(Window.partitionBy("id", "row", "name"))).filter("times = 1")
    return once.select(F.col("id").alias(id_col), "name", F.col("line").cast("long").alias("line"), "lines")


def restored_from_regions(docs: DataFrame, items: DataFrame, label: str, value_col: str, id_col: str = "doc_id", text_col: str = "text", name_col: str = "name") -> DataFrame:
    """items with value_col filled where it is blank: what follows `label:` in the region of the item, if one line there says it."""
    said = rf"(?i)^\W*{label}\s*[:\-–]\s*(\S.*)$"
    told = regions(docs, items, id_col, text_col, name_col).withColumn("__told", F.filter("lines", lambda l: l.rlike(said))).filter(F.size("__told") == 1)
    one = told.groupBy(F.col(id_col).alias("__id"), F.col("name").alias("__name")).agg(F.min(F.regexp_extract(F.element_at("__told", 1), said, 1)).alias("__value"), F.count("*").alias("__times")).filter("__times = 1")
    out = items.join(one, (F.col(id_col) == F.col("__id")) & (F.col(name_col) == F.col("__name")), "left")
    blank = F.trim(F.coalesce(F.col(value_col), F.lit(""))) == ""
    return out.withColumn(value_col, F.when(blank & F.col("__value").isNotNull(), F.trim("__value")).otherwise(F.col(value_col))).drop("__id", "__name", "__value", "__times")
