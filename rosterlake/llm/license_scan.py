"""Licence scans by sentence rules, in DataFrame functions only.

Sentences are normalised and looked up in a table of known licence sentences;
the identifiers of those found, in their order, are matched against ordered
rules, each a sequence of identifiers that names a licence.

All is done within a row: no shuffle, no join; the tables are constants.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of public licence texts and notices, normalised (lower case, other signs as single spaces), and their identifiers.
SENTENCES: dict[str, str] = {
    "licensed under the apache license version 2 0": "apache2-notice",
    "licensed under the apache license version 2 0 the license": "apache2-the",
    "you may not use this file except in compliance with the license": "apache2-comply",
    "you may obtain a copy of the license at": "apache2-copy",
    "see the license for the specific language governing permissions and limitations under the license": "apache2-see",
    "apache license": "apache2-title",
    "version 2 0 january 2004": "apache2-version",
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "the mit license": "mit-title",
    "mit license": "mit-title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-keep",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "this work is licensed under the gnu general public license version 3": "gpl3-notice",
    "licensed under the gnu general public license version 3": "gpl3-notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-later",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "licensed under the mozilla public license version 2 0": "mpl2-notice",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2-form",
    "licensed under cc by 4 0": "ccby-notice",
    "licensed under cc by sa 4 0": "ccbysa-notice",
    "licensed under cc by nc 4 0": "ccbync-notice",
    "this work is licensed under a creative commons attribution 4 0 international license": "ccby-long",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "ccbysa-long",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "ccbync-long",
    "this is free and unencumbered software released into the public domain": "unlicense-free",
    "all rights reserved": "reserved",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2-asis",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liable",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-asis",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "zero-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-asis",
    "gnu general public license": "gpl-title",
    "gnu lesser general public license": "lgpl-title",
    "gnu affero general public license": "agpl-title",
    "mozilla public license version 2 0": "mpl2-title",
    "version 3 29 june 2007": "gnu-version3",
    "version 2 june 1991": "gnu-version2",
    "version 3 19 november 2007": "gnu-agpl3",
    "licensed under the gnu general public license version 2": "gpl2-notice",
    "licensed under the gnu lesser general public license version 3": "lgpl3-notice",
    "licensed under the gnu affero general public license version 3": "agpl3-notice",
    "licensed under the bsd 3 clause license": "bsd3-notice",
    "licensed under the bsd 2 clause license": "bsd2-notice",
    "licensed under the isc license": "isc-notice",
}
#: Rules in order of precedence: identifiers that follow each other among the known sentences of a document, and the licence they name.
RULES: tuple[tuple[tuple[str, ...], str], ...] = (
    (("apache2-title", "apache2-version"), "Apache-2.0"),
    (("apache2-the", "apache2-comply", "apache2-copy", "apache2-asis", "apache2-see"), "Apache-2.0"),
    (("apache2-the", "apache2-comply"), "Apache-2.0"),
    (("apache2-asis", "apache2-see"), "Apache-2.0"),
    (("apache2-notice",), "Apache-2.0"),
    (("mit-title", "mit-grant", "mit-keep", "mit-warranty", "mit-liable"), "MIT"),
    (("mit-grant", "mit-keep", "mit-warranty", "mit-liable"), "MIT"),
    (("mit-grant", "mit-keep", "mit-warranty"), "MIT"),
    (("mit-title", "mit-grant"), "MIT"),
    (("mit-notice",), "MIT"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-asis"), "BSD-3-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-names"), "BSD-3-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-asis"), "BSD-2-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary"), "BSD-2-Clause"),
    (("bsd3-notice",), "BSD-3-Clause"),
    (("bsd2-notice",), "BSD-2-Clause"),
    (("isc-grant", "isc-asis"), "ISC"),
    (("isc-grant",), "ISC"),
    (("isc-notice",), "ISC"),
    (("zero-grant", "isc-asis"), "0BSD"),
    (("lgpl-title", "gnu-version3"), "LGPL-3.0-only"),
    (("agpl-title", "gnu-agpl3"), "AGPL-3.0-only"),
    (("gpl-title", "gnu-version3"), "GPL-3.0-only"),
    (("gpl-title", "gnu-version2"), "GPL-2.0-only"),
    (("agpl3-notice",), "AGPL-3.0-only"),
    (("lgpl3-notice",), "LGPL-3.0-only"),
    (("gpl2-notice",), "GPL-2.0-only"),
    (("gpl3-later", "gpl-warranty"), "GPL-3.0-or-later"),
    (("gpl2-later", "gpl-warranty"), "GPL-2.0-or-later"),
    (("gpl3-notice",), "GPL-3.0-only"),
    (("mpl2-title",), "MPL-2.0"),
    (("mpl2-form",), "MPL-2.0"),
    (("mpl2-notice",), "MPL-2.0"),
    (("ccby-notice",), "CC-BY-4.0"),
    (("ccby-long",), "CC-BY-4.0"),
    (("ccbysa-notice",), "CC-BY-SA-4.0"),
    (("ccbysa-long",), "CC-BY-SA-4.0"),
    (("ccbync-notice",), "CC-BY-NC-4.0"),
    (("ccbync-long",), "CC-BY-NC-4.0"),
    (("unlicense-free",), "Unlicense"),
)
#: Texts that hold sentence ends within, as their licences give them, and their identifiers.
TEXTS: dict[str, str] = {
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "gpl3-later",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.": "gpl2-later",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.": "gpl-warranty",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl2-form",
}
#: Rules after RULES.
LAST_RULES: tuple[tuple[tuple[str, ...], str], ...] = ((("reserved",), "LicenseRef-All-Rights-Reserved"),)
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A sentence end (. ! ? ; : before white space or the end) and a line end in a normalised text, and how it is made: (pattern, replacement) in order.
_END, _LINE = "\x01", "\x02"
_STEPS = (
    (r"[\x01\x02]", " "),
    (r"[.!?;:]+(?=[ \t\n\r]|$)", _END),
    (r"[^a-z0-9\x01\n\r]+", " "),
    (r" *[\n\r][ \n\r]*", _LINE),
    (r"[ \x02]*\x01[ \x01\x02]*", _END),
)


def normalised(text: Column) -> Column:
    """Lower case, other signs as single spaces, but for _END and _LINE; _END at both ends."""
    out = F.translate(F.coalesce(text, F.lit("")), _UPPER, _SMALL)
    for pattern, by in _STEPS:
        out = F.regexp_replace(out, pattern, by)
    return F.concat(F.lit(_END), F.trim(out), F.lit(_END))


def _known() -> dict[str, str]:
    """Normalised sentences and texts, all on one line."""
    found = dict(SENTENCES)
    for text, i in TEXTS.items():
        text = text.translate(str.maketrans(_UPPER, _SMALL))
        for pattern, by in _STEPS:
            text = re.sub(pattern, by, text)
        found[text.strip(" " + _END)] = i
    return found


def identifiers(text: Column) -> Column:
    """Identifiers of the known sentences in order. They begin and end at sentence or line ends and may be wrapped."""
    known = _known()
    wrapped = [s.replace(" ", f"[ {_LINE}]") for s in sorted(known, key=lambda s: (-len(s), s))]
    found = F.regexp_extract_all(normalised(text), F.lit(f"(?<=[{_END}{_LINE}])(?:{'|'.join(wrapped)})(?=[{_END}{_LINE}])"), F.lit(0))
    names = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    return F.transform(found, lambda s: names[F.translate(s, _LINE, " ")])


def licence_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sentence_ids, licences, primary_licence) of the rows in which a licence is recognised.

    sentence_ids: identifiers of the known sentences in order; licences: those
    that rules name, each once, in the order of rules; primary_licence: the
    first. A rule fits where its identifiers follow each other in sentence_ids
    and no rule before it has taken one of them; it takes them wherever they do.

    Null and empty texts have no licence; texts of any length are read whole;
    repeated rows stay; a null id stays null; other columns are ignored,
    whatever their names. A longer rule stands before those that it contains,
    so ties cannot arise. Empty table: no rows.
    """
    found = docs.select(F.col(id_col).alias("doc_id"), identifiers(F.col(text_col)).alias("sentence_ids")).filter(F.size("sentence_ids") > 0)
    rules = F.array(*(F.struct(F.lit(_path(ids)).alias("path"), F.lit(name).alias("name")) for ids, name in RULES + LAST_RULES))
    none = F.array().cast("array<string>")
    path = F.concat(F.lit("|"), F.array_join("sentence_ids", "||"), F.lit("|"))
    named = F.aggregate(
        rules,
        F.struct(path.alias("left"), none.alias("names")),
        lambda at, rule: F.struct(
            F.replace(at["left"], rule["path"], F.lit(_TAKEN)).alias("left"),
            F.when(at["left"].contains(rule["path"]), F.concat(at["names"], F.array(rule["name"]))).otherwise(at["names"]).alias("names"),
        ),
        lambda at: F.array_distinct(at["names"]),
    )
    return found.withColumn("licences", named).filter(F.size("licences") > 0).withColumn("primary_licence", F.element_at("licences", 1))


#: Stands for identifiers that a rule has taken.
_TAKEN = "#"


def _path(ids: tuple[str, ...]) -> str:
    return "".join(f"|{i}|" for i in ids)


def _sql() -> str:
    """Known sentences are looked for one by one in the text on one line, their places held against sentence and line ends; rules take turns."""
    quoted = lambda s: "'" + s.replace(_END, "' || chr(1) || '") + "'"
    known = ", ".join(f"({quoted(s)}, '{i}')" for s, i in _known().items())
    rules = ", ".join(f"({k}, '{_path(ids)}', '{name}')" for k, (ids, name) in enumerate(RULES + LAST_RULES))
    return f"""
WITH RECURSIVE known(s, i) AS (VALUES {known}), rules(k, ids, name) AS (VALUES {rules}),
a AS (SELECT row_number() OVER () AS rid, doc_id, translate(translate(coalesce(text, ''), chr(1) || chr(2), '  '), '{_UPPER}', '{_SMALL}') AS t FROM documents),
b AS (SELECT rid, doc_id, regexp_replace(regexp_replace(t, '[.!?;:]+([ \t\n\r]|$)', chr(1) || '\1', 'g'), '[^a-z0-9\n\r\x01]+', ' ', 'g') AS t FROM a),
c AS (SELECT rid, doc_id, chr(1) || trim(regexp_replace(regexp_replace(t, ' *[\n\r][ \n\r]*', chr(2), 'g'), '[ \x02]*\x01[ \x01\x02]*', chr(1), 'g'), ' ') || chr(1) AS t FROM b),
d AS (SELECT rid, doc_id, t, replace(t, chr(2), ' ') AS flat FROM c),
o AS (SELECT rid, doc_id, t, i, length(s) AS n, string_split(flat, s) AS parts, unnest(range(1, len(string_split(flat, s)))) AS k FROM d JOIN known ON contains(flat, s)),
p AS (SELECT rid, doc_id, t, i, n, 1 + list_sum(list_transform(parts[1:k], lambda x: length(x)))::BIGINT + (k - 1) * n AS pos FROM o),
q AS (SELECT * FROM p WHERE substr(t, pos - 1, 1) IN (chr(1), chr(2)) AND substr(t, pos + n, 1) IN (chr(1), chr(2))),
f AS (SELECT rid, doc_id, list(i ORDER BY pos) AS sentence_ids FROM q WHERE NOT EXISTS (
        SELECT 1 FROM q AS z WHERE z.rid = q.rid AND z.pos < q.pos + q.n AND q.pos < z.pos + z.n AND (z.pos < q.pos OR z.pos = q.pos AND z.n > q.n)) GROUP BY rid, doc_id),
r AS (SELECT rid, doc_id, sentence_ids, 0 AS k, '|' || array_to_string(sentence_ids, '||') || '|' AS path, []::VARCHAR[] AS names FROM f
      UNION ALL
      SELECT rid, doc_id, sentence_ids, r.k + 1, replace(path, rules.ids, '{_TAKEN}'),
        CASE WHEN contains(path, rules.ids) AND NOT list_contains(names, name) THEN list_append(names, name) ELSE names END FROM r JOIN rules ON rules.k = r.k)
SELECT doc_id, sentence_ids, names AS licences, names[1] AS primary_licence FROM r WHERE k = {len(RULES + LAST_RULES)} AND len(names) > 0
"""


ORACLE_SQL = _sql()
