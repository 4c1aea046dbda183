"""Licence scans by sentence rules.

A text is cut into sentences, each is normalised and looked up in a table of known licence
sentences; the identifiers found, in order, are matched against ordered rules. A rule is a
sequence of identifiers that stand one behind the other among the recognised ones; a match takes
its identifiers away from later rules. All of it is column expressions: a scan needs no shuffle.
The table is one pattern, a tree of characters, so a line is given up after as few of them as no
known sentence begins with, however many sentences there are.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_column

#: Normalised sentence (see :func:`normalised`) -> identifier. Fixed values.
SENTENCES = {
    "licensed under the apache license version 2.0": "apache-2.0",
    "licensed under the apache license version 2.0 the license": "apache-2.0",
    "you may not use this file except in compliance with the license": "in-compliance",
    "you may obtain a copy of the license at": "copy-at",
    "http www.apache.org licenses license-2.0": "apache-2.0-url",
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this program is free software": "free-software",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-terms",
    "either version 2 of the license or at your option any later version": "version-2-later",
    "either version 3 of the license or at your option any later version": "version-3-later",
    "licensed under cc by-nc 4.0": "cc-by-nc-4.0",
    "licensed under cc by 4.0": "cc-by-4.0",
    "licensed under cc by-sa 4.0": "cc-by-sa-4.0",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit-grant",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd-grant",
    "this software is released into the public domain": "public-domain",
    "all rights reserved": "all-rights",
}
#: Ordered: earlier rules take their identifiers first.
RULES = (
    ("Apache-2.0", ("apache-2.0", "in-compliance", "copy-at", "apache-2.0-url")),
    ("Apache-2.0", ("apache-2.0", "in-compliance", "copy-at")),
    ("Apache-2.0", ("apache-2.0", "in-compliance")),
    ("Apache-2.0", ("apache-2.0",)),
    ("GPL-2.0-or-later", ("free-software", "gpl-terms", "version-2-later")),
    ("GPL-3.0-or-later", ("free-software", "gpl-terms", "version-3-later")),
    ("GPL", ("gpl-terms",)),
    ("GPL-3.0", ("gpl-3.0",)),
    ("MIT", ("mit",)),
    ("MIT", ("mit-grant",)),
    ("BSD", ("bsd-grant",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4.0",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4.0",)),
    ("CC-BY-4.0", ("cc-by-4.0",)),
    ("Public-Domain", ("public-domain",)),
    ("Proprietary", ("all-rights",)),
)
DROP = r'[^a-z0-9."-]+'
ENDS = r'^[ ."-]+|[ ."-]+$'

_APACHE = ("Apache License Version 2.0, January 2004", 'Licensed under the Apache License, Version 2.0 (the "License")', "licenses this file to you under the Apache License, Version 2.0 (the \"License\")", 'The ASF licenses this file to You under the Apache License, Version 2.0 (the "License")', 'The ASF licenses this file to you under the Apache License, Version 2.0 (the "License")')
_COPY_AT = "You may obtain a copy of the License at"
_URLS = ("http://www.apache.org/licenses/LICENSE-2.0", "https://www.apache.org/licenses/LICENSE-2.0")
_UNLESS = 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
_TERMS = "you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation"
_GNU = {"gpl": "General Public License", "lgpl": "Lesser General Public License", "old-lgpl": "Library General Public License", "agpl": "Affero General Public License"}
_LATER = "either version {} of the License, or (at your option) any later version."
_VERSIONS = ("2", "2.1", "3")
#: Full sentences of the standard texts -> identifiers, parted by blanks. Fixed values.
STANDARD_TEXTS = (
    {x: "apache-2.0" for x in _APACHE}
    | {x: "apache-2.0-url" for x in _URLS}
    | {f"{_COPY_AT} {x}{more}": "copy-at apache-2.0-url" for x in _URLS for more in ("", f" {_UNLESS}")}
    | {f"{x} {_UNLESS}": "apache-2.0-url" for x in _URLS}
    | {f"This {x} is free software": "free-software" for x in ("program", "library", "file")}
    | {_LATER.format(n): f"version-{n}-later" for n in _VERSIONS}
    | {_TERMS.format(x): f"{k}-terms" for k, x in _GNU.items()}
    | {f"{_TERMS.format(x)}, {_LATER.format(n)}": f"{k}-terms version-{n}-later" for k, x in _GNU.items() for n in _VERSIONS}
    | {_TERMS.format(f"{_GNU['gpl']} version {n}"): f"gpl-{n}.0-only" for n in (2, 3)}
    | {
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:': "mit-grant",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "bsd-grant",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.": "bsd-source",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.": "bsd-binary",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.": "bsd-endorsement",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "isc-grant",
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "isc-grant",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v.": "mpl-2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.": "mpl-copy",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.": "mpl-copy",
    }
)
_GRANTS = (
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorsement")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD", ("bsd-grant", "bsd-source")),
    ("BSD", ("bsd-grant",)),
    ("MIT", ("mit-grant",)),
    ("ISC", ("isc-grant",)),
)
#: Before RULES: the line that the copyright note of a grant may end with is not a licence.
TEXT_RULES = (
    *((name, (*more, *ids)) for name, ids in _GRANTS for more in (("all-rights",), ())),
    ("MPL-2.0", ("mpl-2.0", "mpl-copy")),
    ("MPL-2.0", ("mpl-2.0",)),
    *((f"{name}-{n}{'' if '.' in n else '.0'}-or-later", ("free-software", f"{k}-terms", f"version-{n}-later")) for k, name in (("gpl", "GPL"), ("lgpl", "LGPL"), ("old-lgpl", "LGPL"), ("agpl", "AGPL")) for n in _VERSIONS),
    *((f"GPL-{n}.0-only", ("free-software", f"gpl-{n}.0-only")) for n in (2, 3)),
    ("LGPL", ("lgpl-terms",)),
    ("AGPL", ("agpl-terms",)),
)
#: A sentence's end, behind a character that is no blank and no mark of a comment, gets an empty
#: line, which no sentence runs over; WRAP is a single line feed.
STOP = r"([.;:!?])(?<=[^ \t\r\f\n;].)(?:[ \t\r\f]+|(?=\n))"
DROP_IN_LINES = r'[^a-z0-9."\n-]+'
WRAP = r"[ -]*\n[ -]*"


def normalised(sentence: Column) -> Column:
    """Lower case; runs of other characters than a-z, 0-9 and . " - are one blank; none of
    blank . " - at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(sentence), DROP, " "), ENDS, "")


def normalised_text(sentence: str) -> str:
    """:func:`normalised` of a text at hand."""
    return re.sub(ENDS, "", re.sub(DROP, " ", sentence.lower()))


def _token(name: str) -> str:
    return f"<{name}>"


ALL_SENTENCES = SENTENCES | {normalised_text(k): v for k, v in STANDARD_TEXTS.items()}
ALL_RULES = TEXT_RULES + RULES


def sentence_pattern(keys: Iterable[str], wrap: str) -> str:
    """A pattern of any of the keys, of two the longer one, whose blanks may be ``wrap`` too."""
    root: dict = {}
    for key in keys:
        node = root
        for char in key:
            node = node.setdefault(char, {})
        node[""] = {}

    def form(node: dict) -> str:
        out = ""
        while len(node) == 1 and "" not in node:
            (char, node), = node.items()
            out += f"(?: |{wrap})" if char == " " else re.escape(char)
        more = [form({c: x}) for c, x in sorted(node.items()) if c]
        if not more:
            return out
        return f"{out}(?:{'|'.join(more)}){'?' if '' in node else ''}"

    return form(root)


def scan(docs: DataFrame, sentences: dict[str, str] = ALL_SENTENCES, rules=ALL_RULES) -> DataFrame:
    """(doc_id, sentence_ids, licenses, n_unmatched) of each row of docs.

    ``sentences``: normalised sentence -> identifiers parted by blanks. sentence_ids: the
    identifiers recognised in the text, in order, each in angle brackets; licenses: the licences
    of the rules that match, in rule order, joined by commas, each once; n_unmatched: identifiers
    that no rule took. A sentence begins and ends at a line feed or at . ; : ! or ? before a blank,
    and may run over single line feeds (with marks of comments about them); of sentences with the
    same begin the longest known one counts. Null and empty texts have none; doc_id may be null or
    repeated; an empty table gives no rows; other columns are not read.
    """
    known = F.create_map(*[F.lit(x) for k, v in sentences.items() for x in (k, "".join(map(_token, v.split())))])
    lines = F.regexp_replace(F.lower(F.regexp_replace(text_column(docs), STOP, "$1\n\n")), DROP_IN_LINES, " ")
    lines = F.concat(F.lit("\n"), lines, F.lit("\n"))
    parts = F.regexp_extract_all(lines, F.lit(rf'(?<=\n)[ ."-]*+({sentence_pattern(sentences, WRAP)})(?=[ ."-]*+\n)'), F.lit(1))
    found = F.transform(parts, lambda s: F.element_at(known, F.regexp_replace(s, WRAP, " ")))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.array_join(found, "").alias("sentence_ids"))
    ordered = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("".join(map(_token, ids))).alias("ids")) for name, ids in rules])
    start = F.struct(F.col("sentence_ids").alias("left"), F.array().cast("array<string>").alias("hits"))
    apply = lambda state, rule: F.struct(
        F.replace(state["left"], rule["ids"], F.lit("|")).alias("left"),
        F.when(F.contains(state["left"], rule["ids"]), F.array_union(state["hits"], F.array(rule["name"]))).otherwise(state["hits"]).alias("hits"),
    )
    out = out.withColumn("_matched", F.when(F.col("sentence_ids") != "", F.aggregate(ordered, start, apply)))
    left = F.col("_matched.left")
    licenses = F.coalesce(F.array_join(F.col("_matched.hits"), ","), F.lit(""))
    unmatched = F.coalesce(F.length(left) - F.length(F.replace(left, F.lit("<"), F.lit(""))), F.lit(0)).cast("long")
    return out.select("doc_id", "sentence_ids", licenses.alias("licenses"), unmatched.alias("n_unmatched"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """Line feeds are doubled, so that neighbouring sentences do not share one: the SQL's patterns
    cannot look around. A wrap is then two of them."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    wrap = WRAP.replace(r"\n", r"\n\n")
    known = "MAP {" + ", ".join(f"{quote(k)}: {quote(''.join(map(_token, v.split())))}" for k, v in ALL_SENTENCES.items()) + "}"
    steps, hits, left = [], [], "sentence_ids"
    for i, (name, ids) in enumerate(ALL_RULES):
        pattern = quote("".join(map(_token, ids)))
        hits.append(f"CASE WHEN contains({left}, {pattern}) THEN {quote(name)} END")
        steps.append(f"replace({left}, {pattern}, '|') AS left{i}")
        left = f"left{i}"
    return rf"""
WITH cut AS (
  SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '([^ \t\r\f\n;][.;:!?])[ \t\r\f]+', '\1' || chr(10) || chr(10), 'g'), '([^ \t\r\f\n;][.;:!?])\n', '\1' || chr(10) || chr(10), 'g') AS text
  FROM documents
), lines AS (SELECT doc_id, replace(chr(10) || regexp_replace(lower(text), '{DROP_IN_LINES}', ' ', 'g') || chr(10), chr(10), chr(10) || chr(10)) AS lines FROM cut),
ids AS (
  SELECT doc_id, coalesce(array_to_string(list_transform(regexp_extract_all(lines, {quote(rf'\n[ ."-]*({sentence_pattern(ALL_SENTENCES, wrap)})[ ."-]*\n')}, 1),
    lambda s: ({known})[regexp_replace(s, '{wrap}', ' ', 'g')]), ''), '') AS sentence_ids
  FROM lines
), matched AS (SELECT *, {", ".join(steps)} FROM ids)
SELECT doc_id, sentence_ids, array_to_string(list_distinct_ordered, ',') AS licenses, CAST(length({left}) - length(replace({left}, '<', '')) AS BIGINT) AS n_unmatched
FROM (SELECT *, list_filter([{", ".join(hits)}], lambda x, i: x IS NOT NULL AND list_position([{", ".join(hits)}], x) = i) AS list_distinct_ordered FROM matched)
"""


ORACLE_SQL = _oracle()
