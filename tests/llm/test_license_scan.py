"""Licence scans on whole licence texts, and the query against its SQL on a second engine."""

from __future__ import annotations

import duckdb
import pytest

from rosterlake.llm.license_scan import ORACLE_SQL, licence_scan
from tests.llm.test_review_r01 import BSD, GPL, MIT, MPL

SF = "/root/testdata/sf0.001"
APACHE = """Copyright 2020 Someone

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER BE LIABLE.
"""
TEXTS = {
    "Apache-2.0": APACHE,
    "MIT": MIT,
    "BSD-3-Clause": BSD + BSD_END,
    "BSD-2-Clause": BSD.split("3. Neither")[0] + BSD_END,
    "MPL-2.0": MPL,
    "GPL-3.0-or-later": GPL.format(":", ",", 3),
    "GPL-3.0-only": "            GNU GENERAL PUBLIC LICENSE\n               Version 3, 29 June 2007\n\n Copyright (C) 2007\n",
    "0BSD": 'Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH\nREGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY\nAND FITNESS.',
}
FORMS = {"plain": str, "hash": lambda t: "".join(f"# {x}\n" for x in t.splitlines()), "stars": lambda t: "/*\n" + "".join(f" * {x}\n" for x in t.splitlines()) + " */", "crlf": lambda t: t.replace("\n", "\r\n"), "within": lambda t: f"Some prose before.\n\n{t}\n\nand prose after" * 2}


@pytest.fixture(scope="module")
def rows():
    made = [(f"{n} {form}", make(t)) for n, t in TEXTS.items() for form, make in FORMS.items()]
    made += [("Apache-2.0,MIT both", APACHE + "\n" + MIT), ("long", ("word " * 300_000) + ".\n" + MIT), ("none", "the mit\nlicense of this"), ("null", None), ("empty", ""), (None, MIT), (None, MIT)]
    made += [("BSD-3-Clause,BSD-2-Clause both", TEXTS["BSD-3-Clause"] + "\n" + TEXTS["BSD-2-Clause"])]
    return made


def test_whole_texts_name_their_licence_alone(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id string, text string, licences string, left int")
    got = sorted((r.doc_id or "", ",".join(r.licences)) for r in licence_scan(docs).collect())
    want = [(d, "MIT" if d in ("long", "") else d.split(" ")[0]) for d, t in (((d or ""), t) for d, t in rows) if d not in ("none", "null", "empty")]
    assert got == sorted(want)
    assert licence_scan(docs.limit(0)).collect() == []


@pytest.mark.parametrize("sf", [None, SF, SF.replace("0.001", "0.01")])
def test_scan_equals_the_sql(spark, rows, sf):
    con = duckdb.connect()
    if sf:
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    else:
        docs = spark.createDataFrame(rows, "doc_id string, text string")
        con.execute("CREATE TABLE documents (doc_id VARCHAR, text VARCHAR)")
        con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    cursor = con.execute(ORACLE_SQL)
    names = [d[0] for d in cursor.description]
    want = sorted(str(dict(sorted(zip(names, r, strict=True)))) for r in cursor.fetchall())
    got = sorted(str(dict(sorted(r.asDict().items()))) for r in licence_scan(docs).collect())
    assert got and got == want
