"""Licence scan by sentence rules.

A text is cut into pieces at sentence marks and line ends; pieces are
normalised (lower case, runs of other characters than a-z and 0-9, so also
comment signs, as one space).  A known licence sentence is found where its
words begin at the begin of a piece and end at the end of one, whatever cuts
lie between: hard-wrapped lines, blank lines before an address, marks inside
the sentence.  Longer sentences are taken first and use up their words, which
gives a sequence of sentence identifiers in the order of the text.  Licence
rules are ordered sequences of identifiers; longer rules are tried first, and
the sentences a rule explains are taken out before the next one is tried.
Sentences that are not known are skipped, so a rule matches across them.

Only built-in functions are used; there is no shuffle.  Defined cases: null
or empty texts have no sentences and no licences; a sentence that repeats
counts each time; other columns of the input are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences as they stand in the public licence texts.
SENTENCES: dict[int, str] = {
    1: "All rights reserved.",
    2: "Released under the MIT License.",
    3: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    4: "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    5: "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    6: "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    7: "Licensed under the Apache License, Version 2.0.",
    8: "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    9: "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    10: "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    11: "See the License for the specific language governing permissions and limitations under the License.",
    12: "This work is licensed under the GNU General Public License, version 3.",
    13: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    14: "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    15: "See the GNU General Public License for more details.",
    16: "Licensed under CC BY-NC 4.0.",
    17: "Licensed under CC BY 4.0.",
    18: "Licensed under CC BY-SA 4.0.",
    19: "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    20: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    21: "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    22: "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    23: "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    24: "This is free and unencumbered software released into the public domain.",
}

# (licence, identifiers in order); longer rules first, then by place here
LICENCE_RULES: tuple[tuple[str, tuple[int, ...]], ...] = (
    ("MIT", (3, 4, 5, 6)),
    ("Apache-2.0", (8, 9, 10, 11)),
    ("BSD-3-Clause", (20, 21, 22, 23)),
    ("GPL-3.0-or-later", (13, 14, 15)),
    ("BSD-2-Clause", (20, 21, 22)),
    ("MIT", (2,)),
    ("Apache-2.0", (7,)),
    ("Apache-2.0", (8,)),
    ("GPL-3.0", (12,)),
    ("CC-BY-NC-4.0", (16,)),
    ("CC-BY-4.0", (17,)),
    ("CC-BY-SA-4.0", (18,)),
    ("CC-BY-4.0", (19,)),
    ("Unlicense", (24,)),
    ("all-rights-reserved", (1,)),
)

# Sentences beside those the SQL knows; "..." stands for 1 to 12 words.
MORE_SENTENCES: dict[int, str] = {
    25: "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    26: "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    27: "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991",
    28: "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    29: "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    30: "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    31: "Apache License Version 2.0, January 2004",
    32: "... licenses this file to you under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    33: "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0",
    34: "Mozilla Public License Version 2.0",
    35: "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    36: "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License.",
    37: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    38: "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    39: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    40: "Eclipse Public License - v 1.0",
    41: "Eclipse Public License - v 2.0",
    42: "CC0 1.0 Universal",
    43: "To the extent possible under law, ... waived all copyright and related or neighboring rights to ...",
    44: "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    45: "Boost Software License - Version 1.0 - August 17th, 2003",
    46: "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    47: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    48: "Neither the name of ... nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    49: "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.",
    50: "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    51: "Do What The Fuck You Want To Public License",
}
MORE_RULES: list[tuple[str, tuple[int, ...]]] = [
    ("BSD-4-Clause", (20, 21, 22, 50, 23)), ("BSD-4-Clause", (20, 21, 22, 50, 48)), ("BSD-4-Clause", (20, 21, 22, 50, 49)),
    ("BSD-3-Clause", (20, 21, 22, 48)), ("BSD-3-Clause", (20, 21, 22, 49)), ("Apache-2.0", (8, 33, 10, 11)),
    ("Apache-2.0", (32, 9, 10, 11)), ("Apache-2.0", (32, 33, 10, 11)), ("GPL-3.0-or-later", (13,)), ("GPL-2.0", (25,)),
    ("GPL-3.0", (26,)), ("LGPL-2.0", (27,)), ("LGPL-2.1", (28,)), ("LGPL-3.0", (29,)), ("AGPL-3.0", (30,)),
    ("Apache-2.0", (31,)), ("Apache-2.0", (32,)), ("MPL-2.0", (34,)), ("MPL-2.0", (35,)), ("MPL-1.1", (36,)),
    ("ISC", (37,)), ("ISC", (38,)), ("0BSD", (39,)), ("EPL-1.0", (40,)), ("EPL-2.0", (41,)), ("CC0-1.0", (42,)),
    ("CC0-1.0", (43,)), ("Zlib", (44,)), ("BSL-1.0", (45,)), ("BSL-1.0", (46,)), ("MIT-0", (47,)), ("WTFPL", (51,)),
]

# Names of licences in notices, as patterns over normalised words.
_V = " ?(?:version ?|v ?)?"
_LATER = "(?: of the licen[sc]e)? or(?: at your option)?(?: any)? (?:later|newer|higher)(?: versions?)?"
NAMES: dict[str, str] = {
    "MIT": "(?:mit|expat|mit x11|mit expat)", "MIT-0": "mit (?:0|no attribution)",
    "Apache-2.0": f"(?:apache(?: software)?(?: licen[sc]e)?|asl){_V}2(?: 0)?",
    "BSD-2-Clause": "(?:bsd (?:2|two) clause(?: simplified)?|(?:2|two) clause bsd|simplified bsd)",
    "BSD-3-Clause": "(?:bsd (?:3|three) clause(?: new or revised)?|(?:3|three) clause bsd|(?:new|modified|revised) bsd)",
    "BSD-4-Clause": "(?:bsd (?:4|four) clause|(?:4|four) clause bsd|original bsd)",
    "0BSD": "(?:0bsd|bsd zero clause|zero clause bsd)", "ISC": "isc", "Zlib": "zlib(?: libpng)?", "Unlicense": "unlicen[sc]e",
    "WTFPL": "wtfpl(?: ?v(?:ersion )?2)?", "BSL-1.0": f"(?:boost(?: software licen[sc]e)?|bsl){_V}1 0",
    "Artistic-2.0": f"artistic(?: licen[sc]e)?{_V}2(?: 0)?", "PostgreSQL": "postgresql", "NCSA": "(?:ncsa|university of illinois ncsa open source)",
    "MS-PL": "(?:ms pl|microsoft public licen[sc]e)", "EUPL-1.2": f"(?:european union public licen[sc]e|eupl){_V}1 2",
    "CDDL-1.0": f"(?:common development and distribution licen[sc]e|cddl)(?: cddl)?{_V}1 0",
    "CC0-1.0": f"(?:creative commons )?(?:cc0|cc zero)(?:{_V}1 0)?(?: universal)?(?: public domain dedication)?",
}
for _v in ("1.1", "2.0"):
    NAMES[f"MPL-{_v}"] = f"(?:mozilla public licen[sc]e|mpl)(?: mpl)?{_V}{_v.replace('.', ' ')}"
for _v in ("1.0", "2.0"):
    NAMES[f"EPL-{_v}"] = f"(?:eclipse public licen[sc]e|epl)(?: epl)?{_V}{_v.replace('.', ' ')}"
for _part, _words in (("BY", ""), ("BY-SA", "(?:sa|share ?alike)"), ("BY-NC", "(?:nc|non ?commercial)"),
                      ("BY-ND", "(?:nd|no ?derivatives|no ?derivs)"), ("BY-NC-SA", "(?:nc|non ?commercial) (?:sa|share ?alike)"),
                      ("BY-NC-ND", "(?:nc|non ?commercial) (?:nd|no ?derivatives|no ?derivs)")):
    for _v in ("2.0", "2.5", "3.0", "4.0"):
        _w = f" {_words}" if _words else ""
        NAMES[f"CC-{_part}-{_v}"] = (f"(?:(?:creative commons|cc) (?:attribution|by){_w}(?: licen[sc]e)?{_V}{_v.replace('.', ' ')}"
                                     "(?: international| unported| generic)?(?: public)?)")
for _short, _g, _versions in (("GPL", "general public licen[sc]e", ("1.0", "2.0", "3.0")), ("AGPL", "affero general public licen[sc]e", ("3.0",)),
                              ("LGPL", "(?:lesser|library) general public licen[sc]e", ("2.0", "2.1", "3.0"))):
    for _v in _versions:
        _n = f"{_v[0]}(?: 0)?" if _v.endswith(".0") else _v.replace(".", " ")
        _name = f"(?:gnu )?(?:{_g}|{_short.lower()})(?: {_short.lower()})?"
        _full = f"(?:{_name}{_V}{_n}|version {_n} of the {_name})"
        NAMES[f"{_short}-{_v}"] = f"{_full}(?: of the licen[sc]e)?(?: only)?"
        NAMES[f"{_short}-{_v}-or-later"] = f"{_full}{_LATER}"
        # the notice at the head of a file, with and without later versions
        _text = (f"... is free software; you can redistribute it and/or modify it under the terms of the "
                 f"GNU {'Affero ' if _short == 'AGPL' else ''}%sGeneral Public License")
        for _kind in ("Lesser ", "Library ") if _short == "LGPL" else ("",):
            _said = _v.removesuffix(".0")
            for _licence, _end in ((f"{_short}-{_v}-or-later", f" as published by the Free Software Foundation, either version {_said} of the License, or (at your option) any later version."),
                                   (f"{_short}-{_v}", f" as published by the Free Software Foundation, version {_said}."),
                                   (f"{_short}-{_v}", f" as published by the Free Software Foundation, version {_said} of the License."),
                                   (f"{_short}-{_v}", f" version {_said} as published by the Free Software Foundation.")):
                MORE_SENTENCES[max(MORE_SENTENCES) + 1] = _text % _kind + _end
                MORE_RULES.append((_licence, (max(MORE_SENTENCES),)))

#: identifier of the notice of each licence in NAMES
NOTICES: dict[str, int] = {name: 200 + k for k, name in enumerate(NAMES)}
# ("This project is licensed under the", "License:", "SPDX-License-Identifier:") name (", see LICENSE")
_BEFORE = ("(?:(?:(?!not~|never~)[a-z0-9]+~){0,12}?(?:licen[sc]ed|released|distributed|published|provided|available) under "
           "(?:(?:the|a|an) )?(?:terms of (?:the )?)?|licen[sc]e (?:the )?|spdx license identifier )")
_AFTER = "(?: licen[sc]e)?(?: (?:see|which)(?: [a-z0-9]+){0,20}?)?"
_PLUS = "(gpl[ -]?v?[0-9](?:\\.[0-9])?)\\+"  # GPL-2.0+, LGPLv3+
# between the licences of an expression such as MIT OR Apache-2.0
_OPERATOR = " (?:or(?! later)|and|with) (?<=\\|spdx[ |]license[ |]identifier[ |][a-z0-9 ]{1,200})"
_NOTICE = "[ |](?:licen[sc]ed|released|distributed|published|provided|available)[ |]under[ |]|\\|(?:licen[sc]e|spdx[ |]license[ |]identifier)[ |]"

# a piece ends after . ! ? : before white space, or at a line end
SENTENCE_END = "(?<=[.!?:])[\\x20\\x09\\x0B-\\x0D]+|\\n+"


def normalised(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip(" ")


def _sequence(ids: tuple[int, ...]) -> str:
    return "".join(f"<{i}>" for i in ids)


def _pattern(sentence: str) -> str:
    parts = [normalised(p).replace(" ", "[ |]") for p in sentence.split("...")]
    gap = "(?:[a-z0-9]+[ |]){%s,12}?"
    out = parts[0]
    for k, p in enumerate(parts[1:], 1):
        if k == len(parts) - 1 and not p:  # words at the end
            out += "(?:[ |][a-z0-9]+){1,12}?"
        else:
            out += ("[ |]" if out else "") + gap % 1 + p
    return "\\|" + out + "(?=\\|)"


def _known() -> list[tuple[str, str, str]]:
    """(words, pattern, replacement) of the known sentences, longer ones first,
    then of the notices; only a text with the words can match the pattern.  In
    the text that is searched, ``|`` stands where two pieces meet."""
    rows = [(s, i) for i, s in {**SENTENCES, **MORE_SENTENCES}.items()]
    known = [(f" {max(map(normalised, s.split('...')), key=len)} ", _pattern(s), f"|<{i}>")
             for s, i in sorted(rows, key=lambda r: (-len(normalised(r[0]).split()), r[1]))]
    spaced = lambda p: p.replace(" ", "[ |]").replace("~", " ")
    return known + [(" ", "(?<!not)(?<!never)\\|" + spaced(_BEFORE) + spaced(NAMES[n]) + spaced(_AFTER) + "(?=\\|)", f"|<{i}>")
                    for n, i in NOTICES.items()]


def _rules() -> list[tuple[str, tuple[int, ...], bool]]:
    """(licence, identifiers, whether it is listed again when it is listed)."""
    rules = [(n, ids, True) for n, ids in LICENCE_RULES] + [(n, ids, False) for n, ids in MORE_RULES]
    rules += [(n, (i,), False) for n, i in NOTICES.items()]
    return sorted(rules, key=lambda r: -len(r[1]))


def _openings() -> str:
    """Matches every text that holds a known sentence or notice, and few others."""
    start, inner = set(), set()
    for s in (*SENTENCES.values(), *MORE_SENTENCES.values()):
        first = s.startswith("...")
        (inner if first else start).add("[ |]".join(normalised(s.split("...")[first]).split()[:4]))
    return "\\|(?:" + "|".join(sorted(start)) + ")|[ |](?:" + "|".join(sorted(inner)) + ")|" + _NOTICE


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_sentences, n_known, sentence_ids, licences, n_licences):
    ``n_sentences`` counts the pieces, ``sentence_ids`` as ``<id><id>``,
    ``licences`` in rule order, joined by commas, one entry per rule that
    matched at least once."""
    text = F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    text = F.when(F.contains(text, F.lit("gpl")), F.regexp_replace(text, _PLUS, "$1-or-later")).otherwise(text)
    parts = F.filter(F.split(text, SENTENCE_END), lambda s: s.rlike("[a-z0-9]"))

    def words(s: Column) -> Column:
        return F.btrim(F.regexp_replace(s, "[^a-z0-9]+", " "), F.lit(" "))

    known = F.array(*[F.struct(F.lit(w).alias("words"), F.lit(p).alias("pattern"), F.lit(r).alias("code"))
                      for w, p, r in _known()])

    def find(a: Column, k: Column) -> Column:
        return F.when(F.contains(F.col("plain"), k["words"]), F.regexp_replace(a, k["pattern"], k["code"])).otherwise(a)

    d = docs.select(F.col(id_col).alias("doc_id"), parts.alias("s"))
    d = d.select("doc_id", F.size("s").cast("long").alias("n_sentences"),
                 F.concat(F.lit("|"), F.array_join(F.transform("s", words), "|"), F.lit("|")).alias("pieces"))
    d = d.select("doc_id", "n_sentences", "pieces",
                 F.when(F.col("pieces").rlike(_openings()), F.translate("pieces", "|", " ")).alias("plain"))
    each = F.when(F.contains("plain", F.lit(" spdx license identifier ")),
                  F.regexp_replace("pieces", _OPERATOR, "|spdx license identifier|")).otherwise(F.col("pieces"))
    found = F.when(F.col("plain").isNotNull(), F.aggregate(known, each, find)).otherwise(F.lit(""))
    d = d.select("doc_id", "n_sentences", F.regexp_extract_all(found, F.lit("<[0-9]+>"), F.lit(0)).alias("ids"))
    d = d.select("doc_id", "n_sentences", F.size("ids").cast("long").alias("n_known"),
                 F.array_join("ids", "").alias("sentence_ids"))
    rules = F.array(*[F.struct(F.lit(_sequence(ids)).alias("seq"), F.lit(name).alias("name"), F.lit(again).alias("again"))
                      for name, ids, again in _rules()])
    start = F.struct(F.col("sentence_ids").alias("rest"), F.array().cast("array<string>").alias("hits"))

    def step(a: Column, r: Column) -> Column:
        found = F.contains(a["rest"], r["seq"])
        return F.struct(
            F.when(found, F.replace(a["rest"], r["seq"], F.lit("|"))).otherwise(a["rest"]).alias("rest"),
            F.when(found & (r["again"] | ~F.array_contains(a["hits"], r["name"])),
                   F.concat(a["hits"], F.array(r["name"]))).otherwise(a["hits"]).alias("hits"))

    hits = F.when(F.col("n_known") > 0, F.aggregate(rules, start, step, lambda a: a["hits"])
                  ).otherwise(F.array().cast("array<string>"))
    return d.withColumn("hits", hits).select(
        "doc_id", "n_sentences", "n_known", "sentence_ids",
        F.array_join("hits", ",").alias("licences"), F.size("hits").cast("long").alias("n_licences"))
