"""Work-history rows read from plain text: tables of bars, tabs or aligned columns, and titles above employers.

Lines become rows; sections, headers and rows that wrap over lines are running
values of windows over a text's lines, so the work is in proportion to the text.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import MONTHS, month_index
from ..functions.text import LEGAL_FORMS, bound, let, match_key

#: Headings of sections, by their letters.
WORK_HEADINGS = ("workexperience", "workexperiences", "workingexperience", "professionalexperience", "employmenthistory", "employment", "workhistory", "careerhistory", "jobexperience", "jobhistory", "experience", "experiences")
OTHER_HEADINGS = (
    "education", "educationalbackground", "academicbackground", "qualifications", "skills", "technicalskills", "keyskills", "languages", "references", "professionalreferences", "referees", "projects", "projectexperience",
    "certifications", "training", "awards", "achievements", "publications", "summary", "profile", "interests", "personaldetails", "declaration",
)
#: What a column is, by the words of its header.
HEADERS: dict[str, tuple[str, ...]] = {
    "employer": ("company", "company name", "name of company", "employer", "employer name", "name of employer", "organisation", "organization"),
    "title": ("title", "job title", "position", "position held", "role", "designation"),
    "span": ("date", "dates", "period", "duration", "years", "year", "dates of employment", "from to"),
    "from": ("from", "start", "start date", "date joined", "joined"),
    "to": ("to", "end", "end date", "date left", "left"),
    "other": ("location", "place", "country", "city", "department", "reason for leaving", "salary", "no", "responsibilities"),
}
#: Words that name a role, and open ends.
ROLE_WORDS = (
    "accountant", "administrator", "analyst", "architect", "assistant", "associate", "clerk", "consultant", "coordinator", "designer", "developer", "director", "engineer", "executive",
    "intern", "lead", "leader", "manager", "nurse", "officer", "president", "programmer", "recruiter", "specialist", "supervisor", "teacher", "technician", "trainee",
)
OPEN_ENDS = ("present", "current", "now", "ongoing", "to date", "till date", "date")
#: The longest employer and title taken for one.
MAX_EMPLOYER, MAX_TITLE = 120, 160

_NAMED = "|".join(f"{m}[a-z]{{0,6}}" for m in MONTHS)
_DATE = rf"(?:(?:(?:{_NAMED})\.?,?\s+|(?:0?[1-9]|1[0-2])/)?(?:19|20)\d{{2}})"
_OPEN = "|".join(OPEN_ENDS)
_DASH = r"(?:[-\u2010-\u2015]|\bto\b|\buntil\b)"
_SPAN = rf"(?i)^({_DATE})\s*{_DASH}\s*({_DATE}|{_OPEN})"
_BULLET = r"^\s*(?:[-*•●▪◦‣–—·]|\d{1,2}[.)])\s"
_ROLE = rf"(?i)\b(?:{'|'.join(ROLE_WORDS)})s?\b"
_ORG = rf"(?i)\b(?:{'|'.join(LEGAL_FORMS)}|university|bank|systems|solutions|services|technologies)\b"
#: Between columns of bars or tabs; columns of aligned tables are as far apart as their signs.
_STEP = 1000


#: Where lines end; in brackets of a pattern.
_ENDS = r"\n\r\x0b\x0c\x85\u2028\u2029"


#: Signs whose small form holds one of a to z; in brackets of a pattern.
_LETTERS = r"a-zA-Z\u0130\u212a"


def _spelt(words: tuple[str, ...], between: str) -> str:
    """A pattern of words, in either case, with any run of `between` behind each letter; beginnings that words share are tried once."""
    nexts: dict[str, list[str]] = {}
    for w in words:
        nexts.setdefault(w[:1], []).append(w[1:])
    ends = nexts.pop("", None) is not None
    also = {"i": r"\u0130", "k": r"\u212a"}
    found = "|".join(f"[{c}{c.upper()}{also.get(c, '')}]{between}{_spelt(tuple(rest), between)}" for c, rest in nexts.items())
    return f"(?:{found}){'?' * ends}" if found else ""


def _reads(line: Column, words: tuple[str, ...]) -> Column:
    """Whether the letters of a line are those of one of the words."""
    other = rf"[^{_LETTERS}]*+"
    return line.rlike(rf"^{other}{_spelt(words, other)}\z")


def _shown(date: Column) -> Column:
    """`Aug 2011` or `2011` of a date, `Present` of an open end."""
    year = F.right(date, F.lit(4))
    number = F.nullif(F.regexp_extract(date, r"^(\d{1,2})/", 1), F.lit("")).try_cast("int")  # a cast that fails costs an exception
    name = F.coalesce(F.get(F.array(*(F.lit(m.title()) for m in MONTHS)), number - 1), F.initcap(F.nullif(F.regexp_extract(date, r"^([A-Za-z]{3})", 1), F.lit(""))))
    return F.when(date == "", "").when(F.lower(date).isin(*OPEN_ENDS), "Present").when(name.isNull(), year).otherwise(F.concat_ws(" ", name, year))


def _cells(line: Column) -> Column:
    """Array of (at, text): the filled cells of a line and where their columns start."""
    numbered = lambda parts: F.transform(parts, lambda p, i: F.struct((i * _STEP).cast("int").alias("at"), F.trim(p).alias("text")))
    bars = numbered(F.split(line, r"\|"))
    tabs = numbered(F.split(F.rtrim(line), "\t"))
    runs = F.regexp_extract_all(line, F.lit(r"(?:^ *| {2,})[^ ]+(?: [^ ]+)*"), F.lit(0))

    def aligned(found: Column) -> Column:
        before = lambda i: F.aggregate(F.slice(found, F.lit(1), i), F.lit(0), lambda n, r: n + F.char_length(r))
        return F.transform(found, lambda r, i: F.struct((before(i) + F.char_length(r) - F.char_length(F.ltrim(r))).cast("int").alias("at"), F.trim(r).alias("text")))

    return F.filter(F.when(line.contains("|"), bars).when(F.rtrim(line).contains("\t"), tabs).otherwise(let(runs, aligned)), lambda c: c["text"] != "")


def _kinds(cells: Column) -> Column:
    """What each cell of a header names; null unless the line is a header (two columns or more, all known)."""
    known = F.create_map(*(F.lit(x) for kind, words in HEADERS.items() for w in words for x in (w, kind)))
    key = lambda c: F.trim(F.regexp_replace(F.lower(c["text"]), "[^a-z]+", " "))
    named = F.transform(cells, lambda c: F.struct(c["at"].alias("at"), F.try_element_at(known, key(c)).alias("kind")))
    names = F.transform(named, lambda c: c["kind"])
    return F.when((F.size(cells) >= 2) & F.forall(names, lambda k: k.isNotNull()) & (F.array_contains(names, "employer") | F.array_contains(names, "title")), named)


#: Where lines end.
BREAKS = r"\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]"


def cleaned(text: Column) -> Column:
    """A text with bars and spaces of one kind."""
    return F.when(reduce(or_, (text.contains(c) for c in "｜│¦\u00a0\u3000")), F.regexp_replace(F.regexp_replace(text, "[｜│¦]", "|"), r"[\u00a0\u3000]", " ")).otherwise(text)


def text_lines(docs: DataFrame, id_col: str, text_col: str, *carried: str) -> DataFrame:
    """(row, id, n, line, ...): the lines of each text that are not blank, numbered from 0; `row` tells repeated rows apart.

    `row` holds within one reading of docs; another reading may number the rows otherwise.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), *(F.col(c).alias(f"with_{c}") for c in carried), cleaned(F.col(text_col)).alias("text"))
    lines = rows.select(*(c for c in rows.columns if c != "text"), F.posexplode(F.split("text", BREAKS)).alias("n", "line"))
    return lines.filter(F.trim("line", F.lit(" \t")) != "")


def section_numbers(lines: DataFrame, wanted: tuple[str, ...], others: tuple[str, ...]) -> DataFrame:
    """The lines of the wanted sections, numbered by `section`; headings, told by their letters, belong to none."""
    line = F.col("line")
    heads = lines.withColumn("head", F.when((F.char_length(line) <= 80) & _reads(line, wanted + others), F.when(_reads(line, wanted), 1).otherwise(0)))
    w = Window.partitionBy("row").orderBy("n")
    cut = heads.withColumn("inside", F.last("head", ignorenulls=True).over(w)).withColumn("section", F.count("head").over(w))
    return cut.filter("inside = 1 and head is null").drop("inside", "head")


def _has_heading(text: Column, wanted: tuple[str, ...]) -> Column:
    """Whether section_numbers would find a wanted section, told before lines are made."""
    other = rf"[^{_LETTERS}{_ENDS}]*+"
    return F.concat(F.lit("\n"), text).rlike(rf"[{_ENDS}]{other}{_spelt(wanted, other)}(?:[{_ENDS}]|\z)")


def _of_pair(first: Column, second: Column, title_first: Column) -> Column:
    """struct(title, employer) of two cells: a role word decides, then a company's word, then the order."""
    role = lambda c: c.rlike(_ROLE)
    org = lambda c: c.rlike(_ORG)
    swap = F.when(role(first) != role(second), role(second)).when(org(first) != org(second), org(first)).otherwise(~title_first)
    one, other = F.struct(first.alias("title"), second.alias("employer")), F.struct(second.alias("title"), first.alias("employer"))
    return F.when(swap, other).otherwise(one)


def _unbroken(rest: Column, titles: Column) -> Column:
    """struct(title, employer) of text without columns: a known title at either end, else what follows a legal form; null if neither stands there."""
    low = F.lower(rest)
    ends = F.filter(titles, lambda t: (F.trim(t) != "") & (low.endswith(F.concat(F.lit(" "), F.lower(F.trim(t)))) | low.startswith(F.concat(F.lower(F.trim(t)), F.lit(" ")))))
    best = F.get(F.array_sort(ends, lambda a, b: F.char_length(b) - F.char_length(a)), F.lit(0))
    size = F.char_length(F.trim(best))
    at_end = low.endswith(F.concat(F.lit(" "), F.lower(F.trim(best))))
    known = F.when(
        at_end, F.struct(F.right(rest, size).alias("title"), F.trim(F.left(rest, F.char_length(rest) - size)).alias("employer"))
    ).otherwise(F.struct(F.left(rest, size).alias("title"), F.trim(F.substr(rest, size + 1)).alias("employer")))
    legal = rf"(?i)^(.*\b(?:{'|'.join(LEGAL_FORMS)})\b\.?\)?),?\s+(.+)$"
    by_form = F.when(rest.rlike(legal), F.struct(F.regexp_extract(rest, legal, 2).alias("title"), F.regexp_extract(rest, legal, 1).alias("employer")))
    return F.coalesce(F.when(F.size(ends) > 0, known), by_form)


def work_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", titles_col: str | None = None) -> DataFrame:
    """(id, ordinal, title, employer, start, stop, times, line): the jobs that the work sections of a text state.

    A row begins at a line with a range of dates: `Date | Company | Role` in any
    order, under a header that names its columns or without one; columns are cut
    by bars, tabs or two spaces, and lines that continue a row go to the columns
    in which they start. A company and dates alone take the line above as the
    title. Dates and one unbroken text are split at a known title (array column
    `titles_col`) or behind a legal form, or are left out. Headers may repeat.
    Equal rows of a text count once, `times` says how often they stood there;
    `line` is the first place. Null, empty and other texts have no rows;
    repeated input rows have their own. Headings are told by their letters, so
    `A W A R D S ___` ends a section.
    """
    titles = [titles_col] if titles_col else []
    some = docs.filter(_has_heading(F.col(text_col), WORK_HEADINGS))
    lines = section_numbers(text_lines(some, id_col, text_col, *titles), WORK_HEADINGS, OTHER_HEADINGS)
    form = F.when(F.col("line").contains("|"), "bar").when(F.rtrim("line").contains("\t"), "tab").otherwise("gap")
    lines = bound(lines, cells=_cells(F.col("line")), form=form, bullet=F.col("line").rlike(_BULLET))
    lines = bound(lines, header=_kinds(F.col("cells")))
    dated = F.exists("cells", lambda c: c["text"].rlike(rf"(?i)^{_DATE}(?:$|\s*{_DASH}|\s)"))
    unfinished = F.exists("cells", lambda c: c["text"].rlike(rf"(?i)^{_DATE}\s*{_DASH}$"))
    lines = bound(lines, dated=~F.col("bullet") & F.col("header").isNull() & dated, unfinished=unfinished)

    by_line = Window.partitionBy("row").orderBy("n")
    above = F.lag(F.struct("section", "n", "form", "line", "dated", "bullet", "header", "unfinished", F.size("cells").alias("cells"))).over(by_line)
    lines = lines.withColumn("above", above)
    near = (F.col("above.section") == F.col("section")) & (F.col("above.n") + 1 == F.col("n")) & (F.col("above.form") == F.col("form"))
    partial = (F.col("form") != "gap") | F.col("line").rlike("^ {2,}")
    unseen = F.col("above.unfinished") | ~F.col("dated")
    goes_on = near & ~F.col("bullet") & ~F.col("above.bullet") & F.col("header").isNull() & F.col("above.header").isNull() & partial & unseen & ~((F.col("form") == "bar") & (F.size("cells") >= F.col("above.cells")) & ~F.col("above.unfinished"))
    lines = lines.withColumn("goes_on", F.coalesce(goes_on, F.lit(False)))
    lines = lines.withColumn("part", F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(by_line))
    told = F.last(F.when(F.col("header").isNotNull(), F.struct("section", "form", "header")), ignorenulls=True).over(by_line)
    lines = lines.withColumn("told", told).withColumn("told", F.when(F.col("told.section") == F.col("section"), F.col("told")))

    head = ["id", "section", "form", "told", "above", "dated", *(f"with_{c}" for c in titles)]
    parts = lines.groupBy("row", "part").agg(F.min("n").alias("n"), *(F.min_by(c, "n").alias(c) for c in head), F.min_by("cells", "n").alias("first"), F.sort_array(F.collect_list(F.struct("n", "cells"))).alias("lines"))
    parts = parts.filter("dated")
    with_header = F.when(F.col("told.form") == F.col("form"), F.col("told.header"))
    stated = F.coalesce(with_header, F.transform("first", lambda c: F.struct(c["at"].alias("at"), F.lit("").alias("kind"))))
    all_cells = F.flatten(F.transform("lines", lambda x: x["cells"]))

    def filled(columns: Column) -> Column:
        stop = lambda i: F.coalesce(F.try_element_at(columns, i + 2)["at"], F.lit(1 << 30))
        inside = lambda c, i: F.filter(all_cells, lambda x: (x["at"] + 1 >= F.when(i == 0, F.lit(-1)).otherwise(c["at"])) & (x["at"] + 1 < stop(i)))
        texts = F.transform(columns, lambda c, i: F.struct(c["kind"].alias("kind"), F.array_join(F.transform(inside(c, i), lambda x: x["text"]), " ").alias("text")))
        return F.transform(texts, lambda c: F.struct(c["kind"].alias("kind"), c["text"].alias("text"), c["text"].rlike(_SPAN).alias("spans")))

    parts = bound(parts, columns=let(stated, filled), has_header=with_header.isNotNull())
    of = lambda kind: F.get(F.filter("columns", lambda c: c["kind"] == kind), F.lit(0))["text"]
    parts = bound(parts, span=F.coalesce(F.get(F.filter("columns", lambda c: c["spans"]), F.lit(0))["text"], F.when(of("from").isNotNull(), F.concat_ws(" - ", of("from"), of("to")))))
    parts = parts.filter(F.col("span").rlike(_SPAN))
    parts = bound(parts, start=F.regexp_extract("span", _SPAN, 1), stop=F.regexp_extract("span", _SPAN, 2), rest=F.trim(F.regexp_replace("span", _SPAN, ""), F.lit(" ,;:|-")))
    others = F.transform(F.filter("columns", lambda c: (c["text"] != "") & ~c["spans"]), lambda c: c["text"])
    parts = bound(parts, others=F.when(F.col("rest") != "", F.array_insert(others, 1, F.col("rest"))).otherwise(others))
    title_of = F.coalesce(F.get(F.filter("others", lambda o: o.rlike(_ROLE)), F.lit(0)), F.get("others", F.lit(0)))
    rows = bound(parts, span_first=F.get("columns", F.lit(0))["spans"])
    known = F.col(f"with_{titles_col}") if titles_col else F.array().cast("array<string>")
    over = F.col("above")
    over_title = (over["section"] == F.col("section")) & ~over["dated"] & ~over["bullet"] & over["header"].isNull() & (over["cells"] == 1)
    n = F.size("others")
    third = F.get(F.filter("others", lambda o: o != title_of), F.lit(0))
    pair = (
        F.when(F.col("has_header") & of("title").isNotNull() & of("employer").isNotNull(), F.struct(of("title").alias("title"), of("employer").alias("employer")))
        .when(n > 2, F.when(F.get("others", F.lit(0)).rlike(_ROLE) == F.get("others", F.lit(1)).rlike(_ROLE), _of_pair(F.get("others", F.lit(0)), F.get("others", F.lit(1)), ~F.col("span_first"))).otherwise(F.struct(title_of.alias("title"), third.alias("employer"))))
        .when(n == 2, _of_pair(F.get("others", F.lit(0)), F.get("others", F.lit(1)), ~F.col("span_first")))
        .when(n == 1, F.coalesce(F.when(F.col("span_first"), _unbroken(F.get("others", F.lit(0)), known)), F.when(over_title, _of_pair(F.trim(over["line"]), F.get("others", F.lit(0)), F.lit(True)))))
    )
    rows = bound(rows, pair=pair).select("row", "id", "n", F.trim("pair.title").alias("title"), F.trim("pair.employer").alias("employer"), _shown(F.col("start")).alias("start"), _shown(F.col("stop")).alias("stop"))
    rows = rows.filter(F.col("title").rlike(r"\p{L}") & F.col("employer").rlike(r"\p{L}") & (F.char_length("employer") <= MAX_EMPLOYER) & (F.char_length("title") <= MAX_TITLE))
    rows = bound(rows, title_key=match_key(F.col("title")), employer_key=match_key(F.col("employer")))
    same = Window.partitionBy("row", "title_key", "employer_key", "start", "stop").orderBy("n")
    rows = rows.withColumn("times", F.count("*").over(same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).withColumn("nth", F.row_number().over(same)).filter("nth = 1")
    return rows.select(F.col("id").alias(id_col), F.row_number().over(by_line).cast("long").alias("ordinal"), "title", "employer", "start", "stop", "times", F.col("n").cast("long").alias("line"))


def dates_restored(items: DataFrame, rows: DataFrame, as_of, id_col: str = "doc_id") -> DataFrame:
    """items (id, title, employer, dates, ...) with `restored`: the source's dates where one row and one item have the title and employer.

    Dates stay as they are where the source has none, several, or a range that
    ends before it starts, and where several items of a text share the pair.
    """
    keyed = lambda df: df.withColumn("__title", match_key(F.col("title"))).withColumn("__employer", match_key(F.col("employer")))
    keys = [id_col, "__title", "__employer"]
    span = F.concat_ws(" to ", "start", "stop")
    one = keyed(rows).groupBy(*keys).agg(F.sum("times").alias("__times"), F.min(span).alias("__span"), F.min(F.struct("start", "stop")).alias("__ends"))
    one = one.filter("__times = 1").filter(month_index(F.col("__ends.start"), as_of) <= month_index(F.col("__ends.stop"), as_of, True)).drop("__times", "__ends")
    alone = F.count("*").over(Window.partitionBy(*keys))
    out = keyed(items).withColumn("__alone", alone == 1).join(one, keys, "left")
    fits = F.col("__alone") & (F.col("__title") != "") & (F.col("__employer") != "")
    return out.withColumn("restored", F.coalesce(F.when(fits, F.col("__span")), F.col("dates"))).drop("__title", "__employer", "__alone", "__span")


#: Headings of project sections, and labels that open a block.
PROJECT_HEADINGS = ("projects", "projectexperience", "keyprojects", "projectdetails", "projectsundertaken", "majorprojects")
_BLOCK = r"(?i)^\s*(?:project(?:\s+(?:name|title))?|client)(?:\s*#?\d{1,2})?\s*[:\-–]\s*(\S.*)$"
_FIELD = r"(?i)^\s*(client|role|duration|period|technologies|tools|environment|location)\s*[:\-–]\s*(\S.*)$"


def project_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ordinal, name, fields, bullets): the blocks of project sections, each from a `Project:` or `Client:` line to the next.

    `fields` maps labels (lower case) to their first text, `bullets` are the
    other lines in order without their marks. Lines before a first block belong
    to none. A client right below its project's name is a field of it.
    """
    others = tuple(h for h in (*WORK_HEADINGS, *OTHER_HEADINGS) if h not in PROJECT_HEADINGS)
    some = docs.filter(_has_heading(F.col(text_col), PROJECT_HEADINGS))
    lines = section_numbers(text_lines(some, id_col, text_col), PROJECT_HEADINGS, others)
    w = Window.partitionBy("row").orderBy("n")
    opens = F.col("line").rlike(_BLOCK)
    client = F.col("line").rlike(r"(?i)^\s*client\b")
    below = F.coalesce(F.lag(F.when(opens & ~client, F.struct("section", "n"))).over(w)["section"] == F.col("section"), F.lit(False))
    lines = lines.withColumn("opens", opens & ~(client & below))
    lines = lines.withColumn("block", F.sum(F.col("opens").cast("int")).over(Window.partitionBy("row", "section").orderBy("n"))).filter("block > 0")
    label = F.when(~F.col("opens") & F.col("line").rlike(_FIELD), F.lower(F.regexp_extract("line", _FIELD, 1)))
    lines = lines.withColumn("label", label)
    plain = F.trim(F.regexp_replace("line", r"^\s*(?:[-*•●▪◦‣–—·]|\d{1,2}[.)])\s+", ""))
    first = F.row_number().over(Window.partitionBy("row", "section", "block", "label").orderBy("n")) == 1
    lines = lines.withColumn("entry", F.when(F.col("label").isNotNull() & first, F.struct("label", F.trim(F.regexp_extract("line", _FIELD, 2)).alias("said"))))
    found = lines.groupBy("row", "section", "block").agg(
        F.first("id").alias("id"), F.min("n").alias("n"),
        F.min_by(F.trim(F.regexp_extract("line", _BLOCK, 1)), "n").alias("name"),
        F.map_from_entries(F.array_sort(F.collect_list("entry"))).alias("fields"),
        F.sort_array(F.collect_list(F.when(~F.col("opens") & F.col("label").isNull(), F.struct("n", plain.alias("said"))))).alias("said"),
    )
    return found.select(F.col("id").alias(id_col), F.row_number().over(w).cast("long").alias("ordinal"), "name", "fields", F.transform("said", lambda x: x["said"]).alias("bullets"))
