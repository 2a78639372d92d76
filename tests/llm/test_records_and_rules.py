"""WARC archives, top-k, language, rules and licences on small cases."""

import hashlib
import random

import numpy as np
import pytest

from dyadic.llm import langid, licenses, quality, topk, warc

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:777>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


@pytest.mark.parametrize("split", [300, 1 << 22])
def test_warc_round_trip_with_magic_in_payloads(spark, tmp_path, split):
    rnd = random.Random(3)
    pages = []
    for i in range(250):
        html = rnd.choice([None, "", "a", "x" * 1200, FAKE, FAKE * 20, "WARC/1.1\r\n", "é" * 600,
                           "\r\n\r\nWARC/1.1\r\n" + "z" * rnd.randrange(2000)])
        pages.append((i if i % 17 else None, rnd.choice([None, "http://x/ y\n"]), html, "clash"))
    pages.append(pages[5])
    df = spark.createDataFrame(pages, "page_id long, url string, html string, payload string").repartition(3)
    folder = warc.write_archives(df, str(tmp_path / "w"))
    got = [tuple(r) for r in warc.read_archives(spark, folder, split, keep_payload=True).drop("url").collect()]
    best, want = {}, []
    for p, _, h, _ in pages:
        if p is not None and len((h or "").encode()) >= 1000:
            best[h] = max(best.get(h, -1), p)
    for p, _, h, _ in pages:
        b = (h or "").encode()
        r = best.get(h) if len(b) >= 1000 else None
        r = None if r == p else r
        want.append((p, len(b), hashlib.sha1(b).hexdigest(), "response" if r is None else "revisit", r, "" if r is not None else h or ""))
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_warc_empty_table(spark):
    assert warc.round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_chain_ends_where_an_archive_is_cut(spark, tmp_path):
    df = spark.createDataFrame([(i, None, "p" * 50) for i in range(20)], "page_id long, url string, html string").coalesce(1)
    folder = warc.write_archives(df, str(tmp_path / "w"))
    part = next(p for p in (tmp_path / "w").iterdir() if p.name.startswith("part"))
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "a.warc").write_bytes(part.read_bytes()[:-30])
    assert folder and warc.read_archives(spark, str(tmp_path / "cut"), 400).count() == 19


@pytest.mark.parametrize("split", [30_000, 1 << 22])
def test_long_urls_lose_no_page(spark, tmp_path, split):
    urls = ["http://x/" + "u" * (100_000 if i in (7, 12) else i) for i in range(20)]
    rows = [(i, u, FAKE + "p" * 50) for i, u in enumerate(urls)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    folder = warc.write_archives(df, str(tmp_path / "w"))
    got = warc.read_archives(spark, folder, split, keep_payload=True, whole=True).select("page_id", "url", "payload").collect()
    assert sorted(map(tuple, got)) == rows


@pytest.mark.parametrize("at", [-30, 700, 5])
def test_whole_archives_are_asked_for(spark, tmp_path, at):
    df = spark.createDataFrame([(i, None, "p" * 50) for i in range(20)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(df, str(tmp_path / "w"))
    part = next(p for p in (tmp_path / "w").iterdir() if p.name.startswith("part"))
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "a.warc").write_bytes(part.read_bytes()[:at])
    with pytest.raises(ValueError, match="do not end at its size"):
        warc.read_archives(spark, str(tmp_path / "cut"), 400, whole=True)


def _top(ids, v, k=5, every=50):
    out = []
    for i in [i for i in ids if i % every == 0]:
        s = sorted(((-int(v[i] @ v[j]), j) for j in ids if j != i))[:k]
        out += [(i, r, j, -x) for r, (x, j) in enumerate(s, 1)]
    return sorted(out)


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 60)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    monkeypatch.setattr(topk, "CHUNK", 16)
    rng = np.random.default_rng(1)
    vecs = {i: [float(x) for x in np.round(rng.normal(0, 0.05, 8), 2)] for i in range(300)}  # many ties
    rows = [(i, v, 1) for i, v in vecs.items()] + [(None, vecs[3], 1), (400, None, 1), (450, [1.0, None] * 4, 1),
                                                   (451, [float("nan")] * 8, 1), (500, [float("inf")] * 8, 1), (7, vecs[7], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int").repartition(4)
    got = sorted(map(tuple, topk.top_k(df).collect()))
    assert got == _top([*vecs, 7], {i: np.floor(256 * np.array(v)) for i, v in vecs.items()})  # 7 stands there twice
    assert topk.top_k(df.limit(0)).count() == 0


def test_top_k_keeps_rows_of_equal_ids(spark, tmp_path, monkeypatch):
    import duckdb
    from dyadic.llm.queries import OP8_SQL
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 50)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(5)
    rows = [(i % 120, [float(x) for x in np.round(rng.normal(0, 0.2, 6), 2)]) for i in range(300)]
    rows += [rows[50]] * 2 + [(8, rows[3][1])] * 90  # a repeated query, one hot row
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(map(tuple, topk.top_k(spark.read.parquet(str(tmp_path / "embeddings.parquet"))).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert got == sorted(con.execute(OP8_SQL).fetchall())


def test_top_k_bounds_hold_and_large_scores_are_exact():
    rng = np.random.default_rng(2)
    v = rng.integers(-9, 9, (500, 20)).astype(float)
    for n in topk.LEVELS:
        bound = topk.segment_stats(v, n) @ topk.segment_stats(v, n).T
        assert (bound + 1e-6 >= v @ v.T).all()
    ids = rng.permutation(500)
    small = list(topk.cell_top(ids[:20], v[:20], ids, v, 5))
    big = list(topk.cell_top(ids[:20], v[:20] * 2.0**30, ids, v * 2.0**30, 5))
    assert big == [(i, j, s << 60) for i, j, s in small]


WORDS = {"en": "the of and to in that with which from there", "de": "der die und das nicht ist ein auch für über",
         "fr": "le les des est une que pour dans être où", "es": "el los del que una por con más está niño"}


def _speech(n, seed=1):
    rnd = random.Random(seed)
    langs = [rnd.choice(list(WORDS)) for _ in range(n)]
    return [" ".join(rnd.choices(WORDS[v].split(), k=rnd.randrange(5, 80))) for v in langs], langs


def test_language_id_learns_and_rejects(docs_of):
    texts, langs = _speech(400)
    texts, langs = texts + [None, "", "12 345 !!", "Und der"], langs + ["en", "en", None, None]
    docs = docs_of(texts, langs)
    rows = langid.identify(docs).collect()
    assert len(rows) == len(texts)
    truth = dict(docs.filter("doc_id is not null").select("doc_id", "lang").collect())
    held = [r for r in rows if r["held_out"] and r["lang_pred"] != "und"]
    assert held and sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert sum(r["lang_pred"] == "und" for r in rows) == 3
    assert all((r["score"] == 0 and not r["accepted"]) if r["lang_pred"] == "und" else 0 < r["score"] <= 1 for r in rows)
    kept = langid.keep_known(docs, langid.train(docs))
    assert kept.schema == docs.schema and kept.count() >= 0.99 * 400


def test_language_id_does_not_depend_on_partitions_and_ignores_held_out_rows(docs_of):
    texts, langs = _speech(150)
    a = langid.train(docs_of(texts, langs, 1))
    b = langid.train(docs_of(texts, langs, 7))
    assert a.languages == b.languages and np.allclose(a.table, b.table)
    assert langid.train(docs_of(texts, langs).filter(langid.held_out())).languages == []
    assert langid.identify(docs_of(texts, langs).limit(0)).count() == 0


def test_features_do_not_depend_on_slices(monkeypatch):
    text = "Größe und Maß, 12 über alles " * 50
    want = langid.features(text)
    monkeypatch.setattr(langid, "SLICE", 37)
    assert (langid.features(text) == want).all()


def test_quality_edges_and_ablation(docs_of, edge_texts):
    texts = edge_texts + ["word " * 30, "one line of words here\n" * 9, " ".join(f"w{i}" for i in range(40)), "a|b " * 25]
    docs = docs_of(texts).withColumn("n_words", __import__("pyspark").sql.functions.lit("clash"))
    led = quality.apply_policy(quality.ledger(docs)).collect()
    assert len(led) == len(texts)
    assert all(not r["kept"] for r in led if r["base_failed"])
    n, mask = len(led), quality.mask_of("v2")
    for r in quality.ablation(quality.ledger(docs)).collect():
        bit = quality.BIT[r["rule"]]
        bits = [x["rule_bits"] & mask for x in led]
        assert r["n_failed"] == sum(b & bit != 0 for b in bits)
        assert r["n_only"] == sum(b == bit for b in bits)
        assert r["n_kept_without"] == sum(b & ~bit == 0 for b in bits) <= n
    kept = quality.keep_good(docs)
    assert kept.schema == docs.schema and kept.count() == sum(r["kept"] for r in led)
    assert quality.ledger(docs.limit(0)).count() == 0


def test_repeated_words_by_brute_force(spark):
    rnd = random.Random(6)
    texts = [" ".join(rnd.choices("abc", k=rnd.randrange(0, 60))) for _ in range(60)] + ["x " * 200, "a b c d e f g h " * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.measure(df).collect():
        w = texts[r["doc_id"]].split()
        win = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
        cover = {i + k for i, x in enumerate(win) if win.count(x) > 1 for k in range(8)}
        assert (r["n_words"], r["n_repeat_words"]) == (len(w), len(cover))


def test_licences(spark):
    s = licenses.SENTENCES
    texts = {1: None, 2: "", 3: "Nothing here. At all.", 4: f"Intro text. {s[3]}\n\n{s[4].upper()} {s[5]}\nwords between. {s[6]}",
             5: "Redistribution: " + " ".join(s[i] for i in (20, 21, 22, 23)) + " All rights reserved.",
             6: "all RIGHTS,  reserved!\nReleased under the MIT license.", 7: s[4]}
    rows = spark.createDataFrame([(k, v, "x") for k, v in texts.items()], "doc_id long, text string, licences string")
    got = {r["doc_id"]: r["licences"] for r in licenses.scan(rows).collect()}
    assert got == {1: "", 2: "", 3: "", 4: "MIT", 5: "BSD-3-Clause,all-rights-reserved", 6: "MIT,all-rights-reserved", 7: ""}
    assert licenses.scan(rows.limit(0)).count() == 0


MIT_WRAPPED = """MIT License
Copyright (c) 2020 A. Person
Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
APACHE_WRAPPED = """Copyright 2020 A. Person

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
BSD_WRAPPED = """Copyright (c) 2020, A. Person
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL_WRAPPED = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""


@pytest.mark.parametrize("text, licences, ids", [
    (MIT_WRAPPED, "MIT", "<3><4><5><6>"), (APACHE_WRAPPED, "Apache-2.0", "<8><9><10><11>"),
    (BSD_WRAPPED, "BSD-3-Clause,all-rights-reserved", "<1><20><21><22><23>"), (GPL_WRAPPED, "GPL-3.0-or-later", "<13><14><15>"),
    ("Licensed under the Apache License,\nVersion 2.0.\nNo full stop\nall rights reserved\nand more", "Apache-2.0,all-rights-reserved", "<7><1>"),
    ("We say all rights\nreserved. All rights reserved by us.", "", "")])
def test_licences_in_wrapped_lines(spark, text, licences, ids):
    lines = text.split("\n")
    forms = [text, text.replace("\n", "\r\n"), *("\n".join(p + x for x in lines) for p in ("# ", "// ", " * ", "    "))]
    forms.append("/*\n" + forms[4] + "\n */\nint main() { return 0; }\n")
    got = licenses.scan(spark.createDataFrame(list(enumerate(forms)), "doc_id long, text string")).collect()
    assert [(r["licences"], r["sentence_ids"]) for r in got] == [(licences, ids)] * len(forms)


WIDER = {
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.",
    "LGPL-2.1-or-later": "Foo is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0-or-later": "// This program is free software: you can redistribute it and/or modify\n// it under the terms of the GNU Affero General Public License as published\n// by the Free Software Foundation, either version 3 of the License, or\n// (at your option) any later version.",
    "MPL-2.0": "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
    "EPL-2.0": "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/",
    "CC0-1.0": "SPDX-License-Identifier: CC0-1.0", "Zlib": "Licensed under the zlib license.",
    "BSL-1.0": "// Distributed under the Boost Software License, Version 1.0.\n// (See accompanying file LICENSE_1_0.txt)",
    "MIT": "This project is licensed under the MIT License - see the LICENSE file for details.",
    "GPL-3.0": "Released under GPLv3.", "GPL-3.0-or-later": "The code is distributed under the terms of the GNU GPL v3 or later.",
    "LGPL-3.0-or-later": "License: LGPLv3+", "GPL-2.0": "/* SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note */",
    "Apache-2.0,MIT": "# SPDX-License-Identifier: (MIT OR Apache-2.0)", "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "BSD-3-Clause": BSD_WRAPPED.replace("All rights reserved.", "").replace("the copyright holder nor", "Some Company nor"),
}


def test_licences_and_notices_beyond_the_given_rows(spark):
    no = ["This is not licensed under the MIT license.", "This is not\nlicensed under the MIT license.", "She was released under the old bridge.", "MIT students read."]
    rows = spark.createDataFrame(list(enumerate([*WIDER.values(), *no])), "doc_id long, text string")
    got = {r["doc_id"]: ",".join(sorted(r["licences"].split(","))) for r in licenses.scan(rows).collect()}
    assert [got[k] for k in range(len(got))] == [*WIDER, *[""] * len(no)]
