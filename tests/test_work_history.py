"""Work-history rows in all layouts, from the parts that the texts were made of."""

from __future__ import annotations

import random
import time
from datetime import date

import pytest
from pyspark.sql import functions as F

from rosterlake.operators.work_history import dates_restored, project_blocks, work_rows

JOBS = [("Technical Specialist", "Contoso Systems", "Aug 2011", "May 2015"), ("Senior Analyst", "Northwind Sdn Bhd", "2016", "2019"), ("Sous Chef", "The Long Kitchen", "Jan 2020", "Present")]


def found(spark, text, **more):
    docs = spark.createDataFrame([(1, text, *more.values())], ", ".join(["doc_id long, text string", *(f"{k} array<string>" for k in more)]))
    return [tuple(r)[2:6] for r in work_rows(docs, titles_col=next(iter(more), None)).orderBy("ordinal").collect()]


def laid_out(jobs, form):
    rows = {
        "bar": [f"| {s} - {e} | {c} | {t} |" for t, c, s, e in jobs],
        "bar, title first": [f"{t} | {c} | {s} – {e}" for t, c, s, e in jobs],
        "tab": [f"{s} to {e}\t{c}\t{t}" for t, c, s, e in jobs],
        "aligned": [f"{s + ' - ' + e:<28}{c:<30}{t}" for t, c, s, e in jobs],
        "above": [f"{t}\n{c} | {s} — {e}" for t, c, s, e in jobs],
        "header": ["Period | Company Name | Position", *(f"{s} - {e} | {c} | {t}" for t, c, s, e in jobs)],
        "header, any order": ["Position\tDates\tLocation\tEmployer", *(f"{t}\t{s} - {e}\tPenang\t{c}" for t, c, s, e in jobs)],
        "from and to": ["From  To  Company  Title".replace("  ", "\t"), *(f"{s}\t{e}\t{c}\t{t}" for t, c, s, e in jobs)],
        "repeated header": [x for t, c, s, e in jobs for x in ("Company | Role | Date", f"{c} | {t} | {s} - {e}", "- a duty | with a bar")],
        "wrapped bars": [x for t, c, s, e in jobs for x in (f"{s} - | {c.rsplit(' ', 1)[0]} | {t.split(' ', 1)[0]}", f"{e} | {c.rsplit(' ', 1)[1]} | {t.split(' ', 1)[1]}")],
        "wrapped columns": [x for t, c, s, e in jobs for x in (f"{s + ' - ' + e:<28}{c.rsplit(' ', 1)[0]:<30}{t.split(' ', 1)[0]}", f"{'':<28}{c.rsplit(' ', 1)[1]:<30}{t.split(' ', 1)[1]}")],
        "one wrapped cell": [x for t, c, s, e in jobs for x in (f"{s} - {e} | {c.rsplit(' ', 1)[0]} | {t}", f" | {c.rsplit(' ', 1)[1]} |")],
    }
    return "\n".join(rows[form])


FORMS = ["bar", "bar, title first", "tab", "aligned", "above", "header", "header, any order", "from and to", "repeated header", "wrapped bars", "wrapped columns", "one wrapped cell"]


@pytest.mark.parametrize("form", FORMS)
def test_layouts(spark, form):
    jobs = JOBS[:2] if form in ("bar, title first",) else JOBS
    text = "Jan 2000 - May 2001 | Before | Analyst\nWORK EXPERIENCE:\n" + laid_out(jobs, form) + "\nA W A R D S ____\n2003 - 2006 | After Ltd | Analyst\nEmployment History\n2007 - 2008 | Second Part Ltd | Clerk"
    assert found(spark, text) == [*jobs, ("Clerk", "Second Part Ltd", "2007", "2008")]


def test_unbroken_text(spark):
    text = "Work History\nOct 2022 - Present EY Technology Solutions Sdn Bhd Manager\n2018 - 2020 Some Place Head of Things\n2010 - 2012 Nothing To Split Here"
    assert found(spark, text) == [("Manager", "EY Technology Solutions Sdn Bhd", "Oct 2022", "Present")]
    assert found(spark, text, titles=["Manager", "head of things", "of Things", ""]) == [("Manager", "EY Technology Solutions Sdn Bhd", "Oct 2022", "Present"), ("Head of Things", "Some Place", "2018", "2020")]


@pytest.mark.parametrize("text", ["", None, "   \n\n", "no heading\n2010 - 2012 | A Ltd | Clerk", "WORK EXPERIENCE", "WORK EXPERIENCE\n| | |\n|", "WORK EXPERIENCE\n2010 - 2012 | | | -", "WORK EXPERIENCE\n- 2010 - 2012 | A Ltd | Clerk", "EDUCATION\n2010 - 2012 | A Ltd | Clerk", "WORK EXPERIENCE\n2010 - 2012", "WORK EXPERIENCE\nEDUCATION\n2010 - 2012 | A Ltd | Clerk"])
def test_nothing_to_find(spark, text):
    assert found(spark, text) == []


def test_dates_numbers_and_breaks(spark):
    text = "W O R K   E X P E R I E N C E\r\n08/2011 until 5/2015 │ A\xa0Ltd ｜ Clerk\x0bSept. 2016 ‐ to date | B Ltd | Clerk"
    assert found(spark, text) == [("Clerk", "A Ltd", "Aug 2011", "May 2015"), ("Clerk", "B Ltd", "Sep 2016", "Present")]


def test_repeats_and_rows(spark):
    text = "EXPERIENCE\n2010 - 2012 | A Ltd | Clerk\n2010 - 2012 | A LTD | clerk\n2013 - 2014 | A Ltd | Clerk"
    docs = spark.createDataFrame([(1, text, 5), (1, text, 5), (None, text, 5)], "doc_id long, text string, row long")
    got = sorted(((r.doc_id, r.ordinal, r.start, r.times) for r in work_rows(docs).collect()), key=str)
    one = [(1, "2010", 2), (2, "2013", 1)]
    assert got == sorted([(d, *x) for d in (1, 1, None) for x in one], key=str)
    assert work_rows(docs.limit(0)).collect() == []


def test_restored_dates(spark):
    good = "Technical Specialist\nContoso Systems | Aug 2011 - May 2015"
    cases = [
        ("WORK EXPERIENCE\n" + good, "Aug 2011 to May 2015"),
        (good, "old"),
        ("EDUCATION\n" + good, "old"),
        ("WORK EXPERIENCE\nPROFESSIONAL REFERENCES\n" + good, "old"),
        ("WORK EXPERIENCE\nDifferent Title\nContoso Systems | Aug 2011 - May 2015", "old"),
        ("WORK EXPERIENCE\nTechnical Specialist\nContoso Systems | Aug 2017 - May 2015", "old"),
        ("WORK EXPERIENCE\n" + good + "\n" + good, "old"),
        ("WORK EXPERIENCE\n" + good + "\nTechnical Specialist | Contoso Systems | 2016 - 2017", "old"),
        ("WORK EXPERIENCE\n" + good + "\nEDUCATION\nX\nWORK EXPERIENCE\n2016 - 2017 | Contoso Systems | Technical Specialist", "old"),
        (None, "old"),
    ]
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id long, text string")
    items = docs.select("doc_id", F.lit("TECHNICAL SPECIALIST").alias("title"), F.lit("Contoso Systems").alias("employer"), F.lit("old").alias("dates"))
    got = {r.doc_id: r.restored for r in dates_restored(items, work_rows(docs), date(2026, 1, 1)).collect()}
    assert got == {k: want for k, (_, want) in enumerate(cases)}
    twice = dates_restored(items.union(items), work_rows(docs), date(2026, 1, 1))
    assert {r.restored for r in twice.collect()} == {"old"}


def test_long_texts_take_time_in_proportion(spark):
    def took(n):
        text = "WORK EXPERIENCE\n" + "".join(f"Analyst\nFirm {k} Ltd | Aug 2011 - May 2015\n- duty\n" for k in range(n))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.perf_counter()
        assert work_rows(docs).count() == n
        return time.perf_counter() - began

    took(100)  # compiles
    assert took(20_000) < 12


def test_random_mixes(spark):
    rng = random.Random(4)
    want, rows = {}, []
    for k in range(60):
        jobs = [(f"{rng.choice(['Lead', 'Junior'])} {rng.choice(['Engineer', 'Analyst'])}", f"Firm {k}x{j} Ltd", f"{rng.choice(['Jan ', 'Aug '])}{rng.randrange(1980, 2000)}", rng.choice(["Present", "Dec 2005"])) for j in range(rng.randrange(1, 6))]
        parts, want[k] = [], []
        for job in jobs:
            form = rng.choice([f for f in FORMS if f not in ("wrapped columns",)])
            parts.append(laid_out([job], form) + "\n\n- a duty of 2010")
            want[k].append(job)
        rows.append((k, "Experience\n" + "\n\nEducation\nnothing\nExperience\n".join(parts)))
    got = {k: [] for k in want}
    for r in work_rows(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("ordinal").collect():
        got[r.doc_id].append((r.title, r.employer, r.start, r.stop))
    assert got == want


def test_project_blocks(spark):
    text = "Project: early\nProjects\nnone of it\nProject: Alpha\nClient: Beta\nClient: Gamma\n* did x\nRole - Lead\nClient 2: Delta\n1) did y\nEducation\nProject: late"
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "Projects\nno block")], "doc_id long, text string")
    got = [(r.doc_id, r.ordinal, r.name, r.fields, r.bullets) for r in project_blocks(docs).orderBy("doc_id", "ordinal").collect()]
    assert got == [(1, 1, "Alpha", {"client": "Beta"}, []), (1, 2, "Gamma", {"role": "Lead"}, ["did x"]), (1, 3, "Delta", {}, ["did y"])]
