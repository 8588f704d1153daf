"""Mixing, decontamination and licence scans: SQL, brute force and edge cases."""

import pytest
from pyspark.sql import functions as F

from conftest import compared
from verdigris.llm import decontaminate, licenses, mixing
from verdigris.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = DOCS + ", size long, _h string, _threshold double, _i int, k1 string, doc string"
OWN = (1, "x", 2.0, 7, "k", "d")


def docs_of(spark, rows, schema=DOCS):
    return spark.createDataFrame([(*r[:2], "en", r[2] if len(r) > 2 else "s", 0) + OWN * (schema is EXTRA) for r in rows], schema)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    ours, theirs = compared(spark, QUERIES[name], SQL[name], FOLDER)
    assert ours == theirs


def fair(sizes, cap=3):
    """Targets by resharing until none is above its cap."""
    left, open_, out = float(sum(sizes.values())), dict(sizes), {}
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level > cap * sizes[s]]
        if not over:
            return out | {s: weight[s] * level for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            del open_[s]
    return out


def test_targets_and_taken(spark):
    rows = [(i, "w " * (1 + i % 9), "abcde"[min(i % 40, 4)]) for i in range(2000)] + [(None, None, "a"), (9999, "", None), (10000, "x", None)]
    got = mixing.mix_report(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes, taken, target = {}, {}, {}
    by = {r[0]: r[2] for r in rows}
    for r in got:
        s = (by[r.doc_id] or "~") if r.doc_id is not None else "a"
        sizes[s] = sizes.get(s, 0) + r.size
        taken[s] = taken.get(s, 0) + r.taken
        target[s] = r.target
        assert r.taken <= 3 * r.size
    want = fair(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= 9
    again = mixing.mix_report(docs_of(spark, rows)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_many_sources_use_the_salted_join(spark, monkeypatch):
    rows = [(i, "w " * (1 + i % 5), f"s{i % 7}") for i in range(500)]
    a = sorted(map(str, mixing.mix_report(docs_of(spark, rows)).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, mixing.mix_report(docs_of(spark, rows)).collect())) == a


def test_smaller_budgets_nest(spark):
    df = docs_of(spark, [(i, "w " * (1 + i % 7), "s") for i in range(400)])
    less = {r.doc_id: r.taken for r in mixing.mix_report(df, share=0.3).collect()}
    more = {r.doc_id: r.taken for r in mixing.mix_report(df, share=0.6).collect()}
    assert all(more[i] >= t for i, t in less.items()) and sum(less.values()) < sum(more.values())


def test_mix_repeats_rows_and_keeps_columns(spark):
    df = docs_of(spark, [(i, "w " * 10, "ab"[i >= 90]) for i in range(100)] + [(500, None, "a")], EXTRA)
    out = mixing.mix(df)
    assert out.columns == df.columns and {tuple(r)[5:] for r in out.collect()} == {OWN}
    n = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert all(n[i] == 3 for i in range(90, 100)) and n[500] == 1
    assert mixing.mix(df.limit(0)).collect() == [] and mixing.mix_report(df.limit(0)).collect() == []


def test_repeated_rows_are_cut_where_the_budget_ends(spark):
    rows = [(1, "w w w", "a")] * 50 + [(2, "v " * 100, "b")]
    got = mixing.mix_report(docs_of(spark, rows)).collect()
    taken, target = {}, {}
    for r in got:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
        target[r.doc_id] = r.target
    assert abs(taken[1] - target[1]) <= 1.5 and 0 < taken[1] < 150
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_report(docs_of(spark, rows)).collect()))
    assert mixing.mix(docs_of(spark, rows)).where("doc_id = 1").count() * 3 == taken[1]


def test_very_long_texts(spark):
    long = " ".join(words(5, 300_000))
    rows = [(1, long), (2, long + " " + " ".join(words(1, 30))), (3, "x")]
    assert {r.doc_id: r.size for r in mixing.mix_report(docs_of(spark, rows)).collect()} == {1: 300_000, 2: 300_030, 3: 1}
    bench = spark.createDataFrame([(10, " ".join(words(1, 30)))], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.overlaps(docs_of(spark, rows), bench, ["doc_id"]).collect()] == [(2, 10, 12)]
    assert [r.licenses for r in licenses.scan(docs_of(spark, [(1, long + ". Released under the MIT License.")])).collect()] == ["MIT"]


def words(a, n):
    return [f"word{a}x{i}" for i in range(n)]


def test_every_two_substitutions_are_found():
    from itertools import combinations

    for bad in combinations(range(decontaminate.SPAN), decontaminate.SPAN - decontaminate.NEED):
        assert any(not {o + i for i in m} & set(bad) for m in decontaminate.MASKS for o in range(decontaminate.SPAN - m[-1]))


def test_overlaps_tolerate_substitutions(spark):
    item = words(1, 30)
    fuzzy = item[:]
    for i in (4, 9, 16, 22, 28):
        fuzzy[i] = "other"
    far = [w if i % 3 else "other" for i, w in enumerate(item)]
    rows = [(1, " ".join(words(2, 40) + fuzzy + words(3, 9))), (2, " ".join(far)), (3, "Word1x0, WORD1x1! " + " ".join(item[2:14])), (4, None), (5, ""), (None, " ".join(item)), (6, " ".join(words(4, 5))), (7, " ".join(words(4, 4))), (8, " ".join(item)), (8, " ".join(words(9, 30)))]
    bench = spark.createDataFrame([(10, " ".join(item)), (10, " ".join(item)), (11, " ".join(words(4, 5))), (12, None), (13, "a b")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.matched) for r in decontaminate.overlaps(docs_of(spark, rows), bench, ["doc_id"]).collect()}
    assert {(d, i) for d, i, _ in got} == {(1, 10), (3, 10), (None, 10), (6, 11), (8, 10)}
    assert (3, 10, 12) in got and (6, 11, 5) in got
    left = decontaminate.decontaminate(docs_of(spark, rows, EXTRA), bench)
    assert left.columns == docs_of(spark, rows, EXTRA).columns and {tuple(r)[5:] for r in left.collect()} == {OWN}
    assert sorted(r.doc_id for r in left.collect()) == [2, 4, 5, 7, 8]
    assert decontaminate.decontaminate(docs_of(spark, rows), bench.limit(0)).count() == len(rows)
    assert decontaminate.overlaps(docs_of(spark, rows).limit(0), bench, ["doc_id"]).count() == 0


def test_shuffled_seeds_agree(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "benchmark"))
    a = sorted(map(tuple, decontaminate.overlaps(docs, bench, ["doc_id"]).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 0)
    assert sorted(map(tuple, decontaminate.overlaps(docs, bench, ["doc_id"]).collect())) == a and a


def test_shuffled_seeds_keep_null_ids(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 0)
    item = words(1, 30)
    rows = [(None, " ".join(item)), (None, " ".join(words(2, 30))), (None, " ".join(item[:14])), (8, " ".join(item)), (8, " ".join(words(9, 30)))]
    bench = spark.createDataFrame([(10, " ".join(item)), (11, " ".join(words(9, 30)))], "item_id long, text string")
    got = {tuple(r) for r in decontaminate.overlaps(docs_of(spark, rows), bench, ["doc_id"]).collect()}
    assert got == {(None, 10, 12), (8, 10, 12), (8, 11, 12)}


def names(spark, *texts):
    df = docs_of(spark, [(i, x) for i, x in enumerate(texts)], EXTRA)
    return [r.licenses for r in licenses.scan(df).orderBy("doc_id").collect()]


def test_license_rules(spark):
    words = dict(reversed(licenses.WORDS))
    mit = "MIT License\n\nCopyright (c) 2020 A\n\n" + "\n\n".join(words[i] for i in ("mit_grant", "mit_notice", "mit_as_is"))
    swapped = "\n\n".join(words[i] for i in ("mit_as_is", "mit_notice", "mit_grant"))
    cut = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License"
    bsd = "\n".join(f"{n}. {words[i]}" for n, i in enumerate(("bsd_forms", "bsd_source", "bsd_binary", "bsd_endorse")))
    assert names(spark, mit, swapped, "foo bar.\nLicensed under the Apache License, Version 2.0.", None, "", "a license of my own", cut, bsd, "Released under the MIT License. " * 3, "Released under the MIT License.\nLicensed under CC BY 4.0.") == ["MIT", "", "Apache-2.0", "", "", "", "", "BSD-3-Clause", "MIT", "CC-BY-4.0,MIT"]
    assert licenses.scan(docs_of(spark, [(1, mit)]).limit(0)).count() == 0


GPL2 = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
GPL3 = GPL2.replace("software; you", "software: you").replace("Foundation; either version 2", "Foundation, either version 3")
LGPL = GPL2.replace("GNU General", "GNU Lesser General").replace("version 2 ", "version 2.1 ")
AGPL = GPL3.replace("GNU General", "GNU Affero General")
APACHE = """Copyright 2024 The Authors

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
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
HEADERS = {"GPL-2.0": GPL2, "GPL-3.0": GPL3, "LGPL-2.1": LGPL, "AGPL-3.0": AGPL, "Apache-2.0": APACHE, "MPL-2.0": MPL}


@pytest.mark.parametrize("mark", ["", "# ", "// ", " * ", ";; ", "dnl "])
def test_headers_in_comments(spark, mark):
    texts = ["#!/bin/sh\n" + "\n".join((mark + x).rstrip() for x in t.split("\n")) + "\ncode = 1;\n" for t in HEADERS.values()]
    assert names(spark, *texts) == list(HEADERS)


def test_one_line_identifiers_and_titles(spark):
    assert names(spark, "// SPDX-License-Identifier: GPL-2.0-or-later\n#include <x.h>", "/* SPDX-License-Identifier: MIT */\nint x;", "The MIT License\nCopyright (c) 2001 X\n" + dict(licenses.WORDS)["isc_grant"] + "\n" + dict(licenses.WORDS)["isc_as_is"]) == ["GPL-2.0", "MIT", "ISC"]


FULL = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0"}


def test_full_texts(spark):
    """Unedited licences, where the system ships them."""
    from pathlib import Path

    have = {n: p for n in FULL if (p := Path("/usr/share/common-licenses") / n).is_file()}
    if not have:
        pytest.skip("no licence texts on this machine")
    got = dict(zip(have, names(spark, *[p.read_text(errors="replace") for p in have.values()])))
    assert {n: FULL[n] in x.split(",") for n, x in got.items()} == dict.fromkeys(have, True)


def test_rules_match_their_own_words(spark):
    known = {i for i, _ in licenses.SENTENCES}
    assert {x for _, ids in licenses.ALL_RULES for x in ids} <= known and len({s for _, s in licenses.SENTENCES}) == len(licenses.SENTENCES)
    words = {i: w for i, w in reversed(licenses.WORDS)}
    texts = [(n, "\n\n".join(words[i] for i in ids)) for n, ids in licenses.RULES]
    assert [n in x.split(",") for (n, _), x in zip(texts, names(spark, *[t for _, t in texts]))] == [True] * len(texts)


def plain_ids(text):
    """The sequence by hand: ends and blank lines are found character by character."""
    import re

    text = re.sub(r"(?i)spdx-license-identifier:", "spdx-license-identifier ", re.sub(r"(?m)^[ \t]*(?:dnl|rem|REM|;+)[ \t]", "", text))
    parts, now, i = [], "", 0
    while i < len(text):
        c = text[i]
        j = i
        while j < len(text) and text[j] in ".!?:;":
            j += 1
        line_end = text.find("\n", i + 1)
        if j > i and (j == len(text) or text[j].isspace()):
            while j < len(text) and text[j].isspace():
                j += 1
            parts, now, i = [*parts, now], "", j
        elif c == "\n" and line_end > 0 and not any(x.isascii() and x.isalnum() for x in text[i:line_end]):
            parts, now, i = [*parts, now], "", line_end + 1
        else:
            now, i = now + text[i : max(j, i + 1)], max(j, i + 1)
    known = {s: i for i, s in licenses.SENTENCES}
    plain = lambda s: " ".join("".join(x if x.isascii() and x.isalnum() else " " for x in s.lower()).split())
    out = []
    for s in [*parts, now]:
        lines = [x for x in s.split("\n") if plain(x)]
        if plain(s) in known:
            out.append(known[plain(s)])
        elif "\n" in s and lines:
            last = next((known[p] for k in range(len(lines)) if (p := plain(" ".join(lines[k:]))) in known), None)
            out += [known[plain(x)] for x in lines[:-1] if plain(x) in known] + ([last] if last else [])
    return out


def test_sentences_by_hand_and_by_sql(spark, tmp_path):
    words = [w for _, w in licenses.WORDS]
    texts = [*HEADERS.values(), "\n#\n# ".join(words), ". ".join(words[:20]) + "... and so on", "Title\n" + words[18] + "\nmore\n\n\n--\n" + words[20], "a.b license\nMIT License\n// SPDX-License-Identifier: ISC\nx"]
    df = docs_of(spark, list(enumerate(texts)))
    got = [r.ids for r in df.select("doc_id", licenses.sentence_ids(F.col("text")).alias("ids")).orderBy("doc_id").collect()]
    assert got == [plain_ids(t) for t in texts]
    df.write.parquet(str(tmp_path / "documents.parquet"))
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(con.execute(licenses.OP10_SQL).fetchall()) == sorted(map(tuple, licenses.scan(df).collect()))
