"""Licence scans by sentence rules (native).

A text is cut into sentences; each is normalised and looked up among known
licence sentences, whose identifiers, in text order, form a sequence. Ordered
rules over identifiers name the licences. All of it is one projection: no
shuffle, no Python. Only texts that hold a trigger word are cut up, and every
rule has a sentence that holds one.

Sentences end at . ! ? : ; before white space and at lines without letters or
digits, so line breaks and comment marks inside them do not matter. The known
sentences are what this very cut makes of the licences' words. Where a sentence is not
known, its lines are looked up one by one, and then its last lines together: a
title or a copyright line may stand right above a known sentence.
"""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Identifier and words of licences and of their usual notices; several sentences of one entry are numbered.
WORDS = [
    ("apache_line", "Licensed under the Apache License, Version 2.0"),
    ("apache_license", 'Licensed under the Apache License, Version 2.0 (the "License")'),
    ("apache_may_not", "you may not use this file except in compliance with the License."),
    ("apache_copy", "You may obtain a copy of the License at"),
    ("apache_url", "http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache_url", "https://www.apache.org/licenses/LICENSE-2.0"),
    ("apache_url", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache_url", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"),
    ("apache_as_is", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("apache_see", "See the License for the specific language governing permissions and limitations under the License."),
    ("apache_title", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("apache_title", "Apache License Version 2.0, January 2004 https://www.apache.org/licenses/"),
    ("mit_line", "Released under the MIT License"),
    ("mit_line", "Licensed under the MIT License"),
    ("mit_line", "This project is licensed under the MIT License"),
    ("mit_title", "MIT License"),
    ("mit_title", "The MIT License (MIT)"),
    ("mit_title", "The MIT License"),
    ("mit_grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("mit_notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit_as_is", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ("isc_grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc_grant", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc_as_is", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'),
    ("bsd_forms", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd_source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd_binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd_endorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd_endorse", "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("gpl3_line", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl3_line", "Licensed under the GNU General Public License, version 3"),
    ("gpl2_line", "Licensed under the GNU General Public License, version 2"),
    ("gpl3_title", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("gpl2_title", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("lgpl3_title", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("lgpl21_title", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("agpl3_title", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("gpl_terms", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl_terms", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl_terms", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("either_2", "either version 2 of the License, or (at your option) any later version."),
    ("either_21", "either version 2.1 of the License, or (at your option) any later version."),
    ("either_3", "either version 3 of the License, or (at your option) any later version."),
    ("gpl2_terms", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version."),
    ("gpl2_terms", "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("gpl3_terms", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl21_terms", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl3_terms", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl3_terms", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl_hope", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("gpl_see", "See the GNU General Public License for more details."),
    ("lgpl_see", "See the GNU Lesser General Public License for more details."),
    ("agpl_see", "See the GNU Affero General Public License for more details."),
    ("mpl_title", "Mozilla Public License Version 2.0"),
    ("mpl_subject", "This Source Code Form is subject to the terms of the Mozilla Public License, v"),
    ("mpl_copy", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("mpl_copy", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    ("unlicense_free", "This is free and unencumbered software released into the public domain."),
    ("unlicense_anyone", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc_by_nc_line", "Licensed under CC BY-NC 4.0"),
    ("cc_by_line", "Licensed under CC BY 4.0"),
    ("cc_by_sa_line", "Licensed under CC BY-SA 4.0"),
    ("cc_by_line", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc_by_sa_line", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc_by_nc_line", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc0_line", "Released under the CC0 1.0 License"),
    ("cc0_title", "CC0 1.0 Universal"),
]

# Licence and its names in one-line identifiers.
SPDX = {
    "MIT": ["MIT"],
    "Apache-2.0": ["Apache-2.0"],
    "GPL-2.0": ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"],
    "GPL-3.0": ["GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"],
    "LGPL-2.1": ["LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later"],
    "LGPL-3.0": ["LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"],
    "AGPL-3.0": ["AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"],
    "MPL-2.0": ["MPL-2.0"],
    "BSD-2-Clause": ["BSD-2-Clause"],
    "BSD-3-Clause": ["BSD-3-Clause"],
    "ISC": ["ISC"],
    "Unlicense": ["Unlicense"],
    "CC0-1.0": ["CC0-1.0"],
    "CC-BY-4.0": ["CC-BY-4.0"],
    "CC-BY-SA-4.0": ["CC-BY-SA-4.0"],
    "CC-BY-NC-4.0": ["CC-BY-NC-4.0"],
}

# Licence and the identifiers that, in this order, state it.
RULES = [
    ("Apache-2.0", ["apache_license", "apache_may_not", "apache_as_is", "apache_see"]),
    ("Apache-2.0", ["apache_license", "apache_may_not"]),
    ("Apache-2.0", ["apache_line"]),
    ("Apache-2.0", ["apache_title"]),
    ("MIT", ["mit_grant", "mit_notice", "mit_as_is"]),
    ("MIT", ["mit_line"]),
    ("ISC", ["isc_grant", "isc_as_is"]),
    ("BSD-3-Clause", ["bsd_forms", "bsd_source", "bsd_binary", "bsd_endorse"]),
    ("BSD-2-Clause", ["bsd_forms", "bsd_source", "bsd_binary"]),
    ("GPL-3.0", ["gpl3_terms"]),
    ("GPL-3.0", ["gpl_terms", "either_3"]),
    ("GPL-3.0", ["gpl3_line"]),
    ("GPL-3.0", ["gpl3_title"]),
    ("GPL-2.0", ["gpl2_terms"]),
    ("GPL-2.0", ["gpl_terms", "either_2"]),
    ("GPL-2.0", ["gpl2_line"]),
    ("GPL-2.0", ["gpl2_title"]),
    ("LGPL-3.0", ["lgpl3_terms"]),
    ("LGPL-3.0", ["lgpl_terms", "either_3"]),
    ("LGPL-3.0", ["lgpl3_title"]),
    ("LGPL-2.1", ["lgpl21_terms"]),
    ("LGPL-2.1", ["lgpl_terms", "either_21"]),
    ("LGPL-2.1", ["lgpl21_title"]),
    ("AGPL-3.0", ["agpl3_terms"]),
    ("AGPL-3.0", ["agpl_terms", "either_3"]),
    ("AGPL-3.0", ["agpl3_title"]),
    ("MPL-2.0", ["mpl_subject", "mpl_copy"]),
    ("MPL-2.0", ["mpl_title"]),
    ("Unlicense", ["unlicense_free", "unlicense_anyone"]),
    ("CC-BY-NC-4.0", ["cc_by_nc_line"]),
    ("CC-BY-SA-4.0", ["cc_by_sa_line"]),
    ("CC-BY-4.0", ["cc_by_line"]),
    ("CC0-1.0", ["cc0_line"]),
    ("CC0-1.0", ["cc0_title"]),
]

#: A licence whose finding makes another one's rule moot.
COVERS = {"BSD-2-Clause": "BSD-3-Clause"}
#: Known sentences of other texts that may stand between two of a rule.
GAP = 2
TRIGGER = "(?i)licen[sc]e|copyright|redistribut|permission|warrant|public domain|creative commons|cc0"
#: Words that comments of some languages begin lines with, and the colon of one-line identifiers, which ends no sentence.
COMMENT, IDENTIFIER = r"(?m)^[ \t]*(?:dnl|rem|REM|;+)[ \t]", r"(?i)spdx-license-identifier:"
SENTENCE_END = r"[.!?:;]+(?:\s+|$)|\n[^A-Za-z0-9\n]*\n"


def _cut(words: str) -> list[str]:
    """The normalised sentences of known words, by the rules of the module."""
    parts = re.split(SENTENCE_END, words.lower())
    plain = [re.sub("[^a-z0-9]+", " ", p).strip() for p in parts]
    return [p for p in plain if p]


def _known() -> list[tuple[str, str]]:
    out = []
    for name, words in WORDS:
        parts = _cut(words)
        out += [(name if not i else f"{name}_{i + 1}", p) for i, p in enumerate(parts)]
    return out + [(f"spdx_{i}", f"spdx license identifier {_cut(x)[0]}") for i, names in enumerate(SPDX.values()) for x in names]


#: Identifier and normalised sentence (lower case, runs of other characters than a-z and 0-9 as one space).
SENTENCES = _known()
ALL_RULES = [*RULES, *((name, [f"spdx_{i}"]) for i, name in enumerate(SPDX))]
#: No known sentence has more words, so none stands in more lines.
MOST_LINES = max(len(s.split()) for _, s in SENTENCES)


def prepared(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, COMMENT, ""), IDENTIFIER, "spdx-license-identifier ")


def normalised(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))


def rule_pattern(ids: list[str]) -> str:
    between = "(?:[a-z0-9_]+;){0,%d}" % GAP
    return ";" + between.join(f"{x};" for x in ids)


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    known = F.create_map(*[F.lit(x) for x in chain.from_iterable((s, i) for i, s in SENTENCES)])
    look = lambda s: F.try_element_at(known, normalised(s))
    none = F.array().cast("array<string>")

    def of_lines(s: Column) -> Column:
        lines = F.filter(F.split(s, "\n"), lambda x: x.rlike("[A-Za-z0-9]"))

        def found(n: Column) -> Column:
            one = F.transform(F.slice(lines, F.lit(1), n - 1), look)
            # the most last lines that are a known sentence
            last = F.transform(F.sequence(F.greatest(F.lit(1), n - MOST_LINES + 1), n), lambda j: look(F.array_join(F.slice(lines, j, n - j + 1), " ")))
            return F.filter(F.concat(one, F.array(F.get(F.filter(last, lambda i: i.isNotNull()), F.lit(0)))), lambda i: i.isNotNull())

        return F.when(F.size(lines) == 0, none).otherwise(found(F.size(lines)))

    per = F.transform(F.split(prepared(text), SENTENCE_END), lambda s: F.when(look(s).isNotNull(), F.array(look(s))).when(F.instr(s, "\n") > 0, of_lines(s)).otherwise(none))
    return F.when(text.rlike(TRIGGER), F.flatten(per)).otherwise(none)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_sentences (known ones), licenses (names
    in alphabetical order, comma-separated; '' for none).

    A null or empty text has none; rows are judged one by one, so repeated
    rows, null ids and an empty table need no rule of their own. Licences after
    others' wordings, in expressions of several identifiers or in other languages
    are not known."""
    seq = F.concat(F.lit(";"), F.array_join("_ids", ";"), F.lit(";"))
    found = {}
    for name in sorted({n for n, _ in ALL_RULES}):
        hit = None
        for n, ids in ALL_RULES:
            if n == name:
                one = seq.rlike(rule_pattern(ids))
                hit = one if hit is None else hit | one
        found[name] = hit
    names = F.array_compact(F.array(*[F.when(hit & ~found[COVERS[n]] if n in COVERS else hit, F.lit(n)) for n, hit in found.items()]))
    ids = docs.select("doc_id", F.coalesce(sentence_ids(F.col("text")), F.array().cast("array<string>")).alias("_ids"))
    some = F.size("_ids") > 0
    return ids.select("doc_id", F.size("_ids").cast("long").alias("n_sentences"), F.when(some, F.array_join(names, ",")).otherwise("").alias("licenses"))


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The cut by other means: ends are marked one kind after the other, then the text is parted at the marks."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    known = f"map([{', '.join(text(s) for _, s in SENTENCES)}], [{', '.join(text(i) for i, _ in SENTENCES)}])"
    plain = lambda v: f"trim(regexp_replace(lower({v}), '[^a-z0-9]+', ' ', 'g'))"
    look = lambda v: f"m[{plain(v)}]"
    hits = {n: " OR ".join(f"regexp_matches(seq, {text(rule_pattern(ids))})" for m, ids in ALL_RULES if m == n) for n in sorted({n for n, _ in ALL_RULES})}
    case = ", ".join(f"CASE WHEN ({h})" + (f" AND NOT ({hits[COVERS[n]]})" if n in COVERS else "") + f" THEN {text(n)} END" for n, h in hits.items())
    return rf"""
WITH k AS (SELECT {known} AS m),
t AS (SELECT doc_id, regexp_replace(regexp_replace(text, '(?m)^[ \t]*(dnl|rem|REM|;+)[ \t]', '', 'g'), 'spdx-license-identifier:', 'spdx-license-identifier ', 'gi') AS x, regexp_matches(text, {text(TRIGGER)}) AS hit FROM documents),
b AS (SELECT doc_id, hit, regexp_replace(regexp_replace(x, '[.!?:;]+(\s+|$)', chr(1), 'g'), '\n[^A-Za-z0-9\n\x01]*\n', chr(1), 'g') AS x FROM t),
l AS (SELECT doc_id, pos, s, list_filter(string_split(s, chr(10)), lambda y: regexp_matches(y, '[A-Za-z0-9]')) AS lines FROM (SELECT doc_id, unnest(string_split(x, chr(1))) AS s, generate_subscripts(string_split(x, chr(1)), 1) AS pos FROM b WHERE hit)),
i AS (SELECT doc_id, pos, CASE WHEN {look('s')} IS NOT NULL THEN [{look('s')}] WHEN NOT contains(s, chr(10)) OR len(lines) = 0 THEN []::VARCHAR[]
  ELSE list_filter(list_append(list_transform(lines[:-2], lambda y: {look('y')}),
    list_filter(list_transform(range(greatest(1, len(lines) - {MOST_LINES - 1}), len(lines) + 1), lambda j: {look("array_to_string(lines[j:], ' ')")}), lambda y: y IS NOT NULL)[1]), lambda y: y IS NOT NULL) END AS ids FROM l, k),
q AS (SELECT d.doc_id, coalesce(len(a.ids), 0)::BIGINT AS n_sentences, ';' || coalesce(array_to_string(a.ids, ';'), '') || ';' AS seq
  FROM documents d LEFT JOIN (SELECT doc_id, flatten(list(ids ORDER BY pos)) AS ids FROM i GROUP BY doc_id) a ON a.doc_id = d.doc_id)
SELECT doc_id, n_sentences, array_to_string(list_filter([{case}], lambda x: x IS NOT NULL), ',') AS licenses FROM q
"""


OP10_SQL = _sql()
