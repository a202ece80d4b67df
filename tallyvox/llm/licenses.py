"""Licence scans by sentence rules, in DataFrame functions only.

A text is cut into pieces at line ends and punctuation; each is normalised (lower case, runs of other than a-z and 0-9
one space). One or more whole pieces in a row that together are a known licence sentence become its identifier, so
neither wrapped lines nor punctuation inside a sentence matter; other pieces become none. The identifiers in order
form a sequence, in which ordered rules are looked for, longer ones first; what a rule has matched no later rule takes.
"""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of public licences and notices, normalised, by identifier.
SENTENCES = {
    "mit-title": "mit license",
    "mit-title-the": "the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "mit-line": "released under the mit license",
    "mit-line-licensed": "licensed under the mit license",
    "mit-spdx": "spdx license identifier mit",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-warranty": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "isc-spdx": "spdx license identifier isc",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-spdx-2": "spdx license identifier bsd 2 clause",
    "bsd-spdx-3": "spdx license identifier bsd 3 clause",
    "apache-use": "licensed under the apache license version 2 0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-obtain": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "apache-line": "licensed under the apache license version 2 0",
    "apache-spdx": "spdx license identifier apache 2 0",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "gpl-line": "this work is licensed under the gnu general public license version 3",
    "gpl-spdx": "spdx license identifier gpl 3 0 only",
    "gpl-spdx-later": "spdx license identifier gpl 3 0 or later",
    "mpl-subject": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "mpl-spdx": "spdx license identifier mpl 2 0",
    "cc-by-line": "licensed under cc by 4 0",
    "cc-by-sa-line": "licensed under cc by sa 4 0",
    "cc-by-nc-line": "licensed under cc by nc 4 0",
    "cc0-line": "licensed under cc0 1 0",
    "reserved": "all rights reserved",
    "apache-title": "apache license",
    "apache-date": "version 2 0 january 2004",
    "gpl-title": "gnu general public license",
    "gpl-2-date": "version 2 june 1991",
    "gpl-3-date": "version 3 29 june 2007",
    "gpl-2-or-later": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-2-only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "lgpl-title": "gnu lesser general public license",
    "lgpl-2-1-date": "version 2 1 february 1999",
    "lgpl-2-1-or-later": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl-3-or-later": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-3-or-later-program": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-title": "gnu affero general public license",
    "agpl-date": "version 3 19 november 2007",
    "agpl-or-later": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "mpl-title": "mozilla public license version 2 0",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "boost-title": "boost software license version 1 0 august 17th 2003",
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-liability": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "epl-available": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "ofl-font": "this font software is licensed under the sil open font license version 1 1",
    "wtfpl-title": "do what the fuck you want to public license",
}

#: Names of licences as notices say them, normalised, by licence.
NAMES = {
    "MIT": ["mit license", "mit licence", "expat license"],
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache license v2 0", "apache 2 0 license", "apache 2 0"],
    "BSD-2-Clause": ["bsd 2 clause license", "2 clause bsd license", "simplified bsd license"],
    "BSD-3-Clause": ["bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license"],
    "ISC": ["isc license"],
    "GPL-2.0-or-later": ["gnu general public license version 2 or later", "gnu general public license v2 0 or later", "gplv2 or later", "gpl 2 0 or later"],
    "GPL-2.0": ["gnu general public license version 2", "gnu general public license v2 0", "gplv2", "gpl v2", "gpl 2 0"],
    "GPL-3.0-or-later": ["gnu general public license version 3 or later", "gnu general public license v3 0 or later", "gplv3 or later", "gpl 3 0 or later"],
    "GPL-3.0": ["gnu general public license version 3", "gnu general public license v3 0", "gplv3", "gpl v3", "gpl 3 0"],
    "LGPL-2.1": ["gnu lesser general public license version 2 1", "gnu lesser general public license v2 1", "lgplv2 1", "lgpl 2 1"],
    "LGPL-3.0": ["gnu lesser general public license version 3", "gnu lesser general public license v3 0", "lgplv3", "lgpl 3 0"],
    "AGPL-3.0": ["gnu affero general public license version 3", "gnu affero general public license v3 0", "agplv3", "agpl 3 0"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license 2 0", "mpl 2 0"],
    "EPL-2.0": ["eclipse public license version 2 0", "eclipse public license 2 0", "epl 2 0"],
    "BSL-1.0": ["boost software license version 1 0", "boost software license 1 0"],
    "Unlicense": ["unlicense"],
    "Zlib": ["zlib license"],
    "Artistic-2.0": ["artistic license 2 0", "artistic license version 2 0"],
    "OFL-1.1": ["sil open font license version 1 1", "sil open font license 1 1"],
    "WTFPL": ["wtfpl"],
    "CC0-1.0": ["cc0 1 0", "cc0 1 0 universal", "creative commons zero v1 0 universal"],
    "CC-BY-4.0": ["cc by 4 0", "creative commons attribution 4 0 international license"],
    "CC-BY-SA-4.0": ["cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"],
    "CC-BY-NC-4.0": ["cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"],
}
#: How a notice leads up to a name, and what may follow it.
LEADS = ["released under", "licensed under", "distributed under", "available under", "published under"]
SUBJECTS = ["this project is", "this software is", "this work is", "this file is", "this code is", "the code is"]
FOLLOWS = ["see license", "see license for details", "see the license file", "see the license file for details", "see the license file for more details", "see license txt", "see license md"]
#: Licence identifiers of the public list, as they stand after SPDX-License-Identifier, and those that have a rule of their own below.
SPDX = [
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Artistic-2.0", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later",
    "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "OFL-1.1", "Unlicense", "WTFPL", "Zlib",
]

#: (licence, sentences that must follow each other). Rules are tried in this order.
RULES = [
    ("Apache-2.0", ("apache-use", "apache-comply", "apache-obtain", "apache-as-is", "apache-see")),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-see")),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("ISC", ("isc-grant", "isc-warranty")),
    ("ISC", ("isc-grant",)),
    ("MPL-2.0", ("mpl-subject", "mpl-copy")),
    ("MPL-2.0", ("mpl-subject",)),
    ("Apache-2.0", ("apache-use", "apache-comply")),
    ("Apache-2.0", ("apache-line",)),
    ("MIT", ("mit-grant",)),
    ("MIT", ("mit-line",)),
    ("MIT", ("mit-line-licensed",)),
    ("GPL-3.0", ("gpl-line",)),
    ("CC-BY-4.0", ("cc-by-line",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-line",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-line",)),
    ("CC0-1.0", ("cc0-line",)),
    ("MIT", ("mit-spdx",)),
    ("ISC", ("isc-spdx",)),
    ("BSD-2-Clause", ("bsd-spdx-2",)),
    ("BSD-3-Clause", ("bsd-spdx-3",)),
    ("Apache-2.0", ("apache-spdx",)),
    ("GPL-3.0", ("gpl-spdx",)),
    ("GPL-3.0-or-later", ("gpl-spdx-later",)),
    ("MPL-2.0", ("mpl-spdx",)),
    ("all-rights-reserved", ("reserved",)),
    ("Apache-2.0", ("apache-title", "apache-date")),
    ("GPL-2.0", ("gpl-title", "gpl-2-date")),
    ("GPL-3.0", ("gpl-title", "gpl-3-date")),
    ("LGPL-2.1", ("lgpl-title", "lgpl-2-1-date")),
    ("LGPL-3.0", ("lgpl-title", "gpl-3-date")),
    ("AGPL-3.0", ("agpl-title", "agpl-date")),
    ("Zlib", ("zlib-as-is", "zlib-liability", "zlib-grant")),
]
#: Sentences, notice lines and identifiers of the public list that name one licence each, whatever stands around them; they are looked up, not searched for.
ALONE = {
    "GPL-2.0-or-later": ["gpl-2-or-later"],
    "GPL-2.0": ["gpl-2-only"],
    "LGPL-2.1-or-later": ["lgpl-2-1-or-later"],
    "LGPL-3.0-or-later": ["lgpl-3-or-later", "lgpl-3-or-later-program"],
    "AGPL-3.0-or-later": ["agpl-or-later"],
    "MPL-2.0": ["mpl-title"],
    "Unlicense": ["unlicense-free"],
    "BSL-1.0": ["boost-title", "boost-grant"],
    "Zlib": ["zlib-grant"],
    "0BSD": ["0bsd-grant"],
    "EPL-2.0": ["epl-available"],
    "OFL-1.1": ["ofl-font"],
    "WTFPL": ["wtfpl-title"],
}
ONE_EACH = {i: name for name, ids in ALONE.items() for i in ids} | {f"line-{name}": name for name in NAMES} | {f"spdx-{name}": name.removesuffix("-only") for name in SPDX}
#: Every known sentence holds one of these, so a text without them has no known sentence.
ANCHORS = ("license", "licence", "released under", "distributed under", "available under", "published under", "unencumbered", "without fee", "version 2", "version 3", "any purpose", "licensed", "permission", "warrant", "redistribut", "liab", "copyright", "free software", "mozilla", "mpl", "rights reserved")
#: Sentences that stand in lists, after a number or letter.
LISTED = ("bsd-source", "bsd-binary", "bsd-endorse")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
END_OF_SENTENCE = r"([.!?;:])[ \t\r\n]+"


def sentences(text: Column | str) -> Column:
    """Normalised sentences that are not empty: lines, and what . ! ? ; or : and white space end."""
    lower = split_expressions(F.translate(text, _UPPER, _LOWER))
    parts = F.split(F.regexp_replace(lower, END_OF_SENTENCE, "$1\n"), "\n")
    return F.filter(F.transform(parts, lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))), lambda s: s != "")


def known_sentences() -> str:
    """A regular expression for known sentences in pieces joined with bars; its two groups are the sentence without its list mark."""
    by_length = sorted(SENTENCES.items(), key=lambda x: -len(x[1]))
    one_of = lambda listed: "|".join(said.replace(" ", "[ |]") for name, said in by_length if (name in LISTED) == listed)
    return rf"(?<=\|)(?:(?:(?:[0-9]{{1,2}}|[a-z]|[ivx]{{1,4}})[ |])?({one_of(True)})|({one_of(False)}))(?=\|)"


def normal(words: str) -> str:
    return re.sub("[^a-z0-9]+", " ", words.lower()).strip()


def _any_of(said: list[str]) -> str:
    return "|".join(x.replace(" ", "[ |]") for x in sorted(said, key=len, reverse=True))


def notice_lines() -> str:
    """A regular expression for a notice in whole pieces, "this project is licensed under the ... license, see LICENSE"; its group is the licence's name."""
    names = [n for said in NAMES.values() for n in said]
    return rf"(?<=\|)(?:(?:{_any_of(SUBJECTS)})[ |])?(?:{_any_of(LEADS)})[ |](?:the[ |])?({_any_of(names)})(?:[ |](?:{_any_of(FOLLOWS)}))?(?=\|)"


def spdx_identifiers() -> str:
    """A regular expression for a piece that names an identifier of the public list; its group is the identifier."""
    return rf"(?<=\|)spdx[ |]license[ |]identifier[ |]({_any_of([normal(x) for x in SPDX])})(?=\|)"


#: Licences that an expression after SPDX-License-Identifier may join with AND, OR or WITH, at most; each gets a line of its own.
JOINED = 8
_EXPRESSION, _ONE_LINE = r"(spdx-license-identifier:[ \t]*)\(*([a-z0-9.+-]+)\)*[ \t]+(?:and|or|with)[ \t]+", "$1$2\n$1"


def split_expressions(lower: Column) -> Column:
    """Texts in lower case with a line for each licence of an SPDX expression."""
    lines = lower
    for _ in range(JOINED - 1):
        lines = F.regexp_replace(lines, _EXPRESSION, _ONE_LINE)
    return F.when(lower.contains("spdx-license-identifier"), lines).otherwise(lower)


def pattern(ids: tuple[str, ...]) -> str:
    return "".join(f"<{i}>" for i in ids)


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, n_known, sentence_ids and licenses for every row of docs (doc_id, text; other columns are ignored).

    n_sentences counts the pieces. sentence_ids joins the identifiers of known sentences with commas; unknown pieces in
    between part a rule's sentences, but for those of digits only (list and page numbers). licenses has the distinct licences found, sorted, joined with commas; empty if none. Null and empty
    texts have no sentences. Each row is scanned on its own, so rows may repeat; an empty table stays empty.
    """
    known = {f"<{said}>": f"<{name}>" for name, said in SENTENCES.items()} | {f"<line {n}>": f"<line-{name}>" for name, said in NAMES.items() for n in said} | {f"<spdx {normal(x)}>": f"<spdx-{x}>" for x in SPDX}
    known = F.create_map(*map(F.lit, chain.from_iterable(known.items())))
    lower = F.translate("text", _UPPER, _LOWER)
    may = lower.rlike("|".join(a.replace(" ", "[^a-z0-9]+") for a in ANCHORS))
    cut_up = docs.select("doc_id", sentences(F.coalesce("text", F.lit(""))).alias("said"), F.coalesce(may, F.lit(False)).alias("may"))
    marked = F.regexp_replace(F.concat(F.lit("|"), F.array_join("said", "|"), F.lit("|")), known_sentences(), "<$1$2>")
    for found, kind in ((notice_lines(), "line"), (spdx_identifiers(), "spdx")):
        marked = F.regexp_replace(marked, found, f"<{kind} $1>")
    pieces = F.regexp_extract_all(marked, F.lit("(<[^>]+>|[^|<>]+)"), F.lit(1))
    named = F.transform(pieces, lambda s: F.when(s.startswith("<"), F.element_at(known, F.translate(s, "|", " "))).when(s.rlike("^[0-9 ]+$"), "").otherwise("-"))
    mapped = cut_up.select("doc_id", F.size("said").cast("long").alias("n_sentences"), F.when(F.col("may"), F.array_join(named, "")).otherwise("").alias("sequence"))
    # Each step notes whether its rule matches and takes the match out; the columns are carried in one struct.
    out = mapped.withColumns({"rest": F.col("sequence"), "found": F.array().cast("array<string>")})
    hit = F.col("sequence").contains("<")
    for name, ids in RULES:
        said = F.lit(pattern(ids))
        matched = hit & F.contains("rest", said)
        out = out.select("doc_id", "n_sentences", "sequence", F.when(matched, F.replace("rest", said, F.lit("-"))).otherwise(F.col("rest")).alias("rest"), F.when(matched, F.concat("found", F.array(F.lit(name)))).otherwise(F.col("found")).alias("found"))
    ids = F.regexp_extract_all("sequence", F.lit("<([^>]+)>"), F.lit(1))
    one_each = F.create_map(*map(F.lit, chain.from_iterable(ONE_EACH.items())))
    out = out.withColumn("found", F.concat("found", F.filter(F.transform(ids, lambda i: F.element_at(one_each, i)), lambda x: x.isNotNull())))
    return out.select("doc_id", "n_sentences", F.size(ids).cast("long").alias("n_known"), F.array_join(ids, ",").alias("sentence_ids"), F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("licenses"))


def oracle() -> str:
    """The result in SQL, from the same fixed values, for texts whose known sentences are one piece each (as in the given tables)."""
    values = ", ".join(f"('<{name}>', '{said}')" for name, said in SENTENCES.items())
    names = [n for said in NAMES.values() for n in said]
    one_of = lambda said: "(?:" + "|".join(sorted(said, key=len, reverse=True)) + ")"
    line = f"^(?:{one_of(SUBJECTS)} )?{one_of(LEADS)} (?:the )?({'|'.join(sorted(names, key=len, reverse=True))})(?: {one_of(FOLLOWS)})?$"
    spdx = f"^spdx license identifier ({'|'.join(sorted(map(normal, SPDX), key=len, reverse=True))})$"
    named = ", ".join([f"('line', '{n}', '<line-{name}>')" for name, said in NAMES.items() for n in said] + [f"('spdx', '{normal(x)}', '<spdx-{x}>')" for x in SPDX])
    each = ", ".join(f"('{i}', '{name}')" for i, name in ONE_EACH.items())
    lower = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
    for _ in range(JOINED - 1):
        lower = f"regexp_replace({lower}, '{_EXPRESSION}', '\\1\\2' || chr(10) || '\\1', 'g')"
    steps = []
    for i, (name, ids) in enumerate(RULES):
        steps.append(f"r{i} AS (SELECT doc_id, n_sentences, sequence, replace(rest, '{pattern(ids)}', '-') AS rest, CASE WHEN contains(rest, '{pattern(ids)}') THEN list_append(found, '{name}') ELSE found END AS found FROM {'r' + str(i - 1) if i else 'm'})")
    return f"""
WITH k(id, said) AS (VALUES {values}), k2(kind, said, id) AS (VALUES {named}), o(id, license) AS (VALUES {each}),
s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace({lower}, '([.!?;:])[ \\t\\r\\n]+', '\\1' || chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') AS said FROM documents),
e AS (SELECT doc_id, unnest(said) AS x, generate_subscripts(said, 1) AS i FROM s),
q AS (SELECT doc_id, string_agg(coalesce(k.id, a.id, b.id, CASE WHEN regexp_matches(x, '^[0-9 ]+$') THEN '' ELSE '-' END), '' ORDER BY i) AS sequence FROM e LEFT JOIN k ON k.said = e.x
LEFT JOIN k2 a ON a.kind = 'line' AND a.said = regexp_extract(e.x, '{line}', 1) LEFT JOIN k2 b ON b.kind = 'spdx' AND b.said = regexp_extract(e.x, '{spdx}', 1) GROUP BY doc_id),
m AS (SELECT s.doc_id, len(s.said)::BIGINT AS n_sentences, coalesce(q.sequence, '') AS sequence, coalesce(q.sequence, '') AS rest, []::VARCHAR[] AS found FROM s LEFT JOIN q USING (doc_id)),
{", ".join(steps)},
f AS (SELECT doc_id, n_sentences, regexp_extract_all(sequence, '<([^>]+)>', 1) AS ids, found FROM r{len(RULES) - 1}),
g AS (SELECT doc_id, list(license) AS more FROM (SELECT doc_id, unnest(ids) AS id FROM f) JOIN o USING (id) GROUP BY 1)
SELECT f.doc_id, n_sentences, len(ids)::BIGINT AS n_known, array_to_string(ids, ',') AS sentence_ids, array_to_string(list_sort(list_distinct(list_concat(found, coalesce(more, [])))), ',') AS licenses FROM f LEFT JOIN g USING (doc_id)
"""
