"""Line dedup, URL rules, licences, quality, secrets: small fixtures with the awkward rows."""

import hashlib
import random
import re
import textwrap
import time
from itertools import combinations

import numpy as np
import pytest
from agvlens.llm import licenses, line_dedup, quality, secrets, url_rules
from pyspark.sql import functions as F


def test_lines_over_the_ratio_go(documents):
    docs = documents(*[("Menu\nown %d\nMenu" % i, "en", "s") for i in range(6)], (None, "en", "s"), ("", "en", "s"), ("Menu\nx", "en", None), ("Menu", "en", "t"), extra=True)
    got = {r["doc_id"]: r for r in line_dedup.document_lines(docs).collect()}
    assert got[0]["text"] == "own 0" and got[0]["n_chars"] == 5 and got[0]["pool"] == 1
    assert got[6]["text"] is None and got[7]["text"] == ""
    assert got[8]["text"] == "Menu\nx" and got[9]["text"] == "Menu"
    assert line_dedup.document_lines(docs).columns == docs.columns
    assert line_dedup.document_lines(docs.limit(0)).count() == 0


def test_lines_against_brute_force(spark, documents, prose):
    texts = [("\n".join(prose(i * 7 % 5 + k, 3) for k in range(i % 4 + 1)), "en", "s%d" % (i % 3)) for i in range(60)]
    docs = documents(*texts)
    sites = {}
    for t, _, s in texts:
        sites.setdefault(s, []).append(t)
    often = {s: {x for t in v for x in t.split("\n") if (n := sum(x in u.split("\n") for u in v)) >= 5 and n > 0.3 * len(v)} for s, v in sites.items()}
    got = {r["doc_id"]: r["text"] for r in line_dedup.document_lines(docs, max_ratio=0.3).collect()}
    assert got == {i: "\n".join(x for x in t.split("\n") if x not in often[s]) for i, (t, _, s) in enumerate(texts)}
    assert any(often.values())


def test_hidden_parts_end_at_their_first_end(spark):
    pieces = ["<script", "<STYLE>", "</script>", "</Style>", "</script >", "<!--", "-->", "--", "-", ">", "<", "a\n", " b ", "<p>", "scripts", "e<"]
    dice = random.Random(2)
    pages = ["".join(dice.choice(pieces) for _ in range(dice.randint(0, 14))) for _ in range(3000)] + ["<script>" + "<x>-" * 50_000 + "</style>z", "<!--" + "-<" * 50_000]
    pages += ["<script>" + "<" * 100_000, None]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "id int, html string").repartition(4)
    got = {r["id"]: r["t"] for r in df.select("id", line_dedup.html_lines(F.col("html")).alias("t")).collect()}
    for i, p in enumerate(pages[:3000]):
        bare = re.sub(r"(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->", "\n", p, flags=re.ASCII)
        assert got[i] == re.sub(r"(?s)<[^>]*>", "\n", bare), p
    assert got[3000] == "\nz" and got[3003] is None


def test_pages_are_stripped_and_looked_up_once(spark):
    """Neither is a regular expression run twice on a page in one pass, nor are its lines hashed twice; the rows are by hand."""
    pages = [(i, f"http://A.org/{i}", f"<p>Menu<script>x</script></p> own {i} <br>end {i}<b") for i in range(6)]
    pages += [(6, "http://a.org/6", "<p>Menu <!-- > --> </p>"), (7, "http://a.org/7", None), (8, None, "<p>Menu</p>x"), (9, "http://a.org/9", "")]
    got = line_dedup.page_lines(spark.createDataFrame(pages, "page_id long, url string, html string"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(s) for s in ("script|style)\\b", "regexp_replace(", "split(__text", "xxhash64(trim(")] == [1, 2, 2, 1]  # one split for n_lines
    docs = spark.createDataFrame([("a\nb", "s")], "text string, source string")
    assert line_dedup.document_lines(docs)._jdf.queryExecution().optimizedPlan().toString().count("split(__text") == 1  # only where a line goes
    rows = {r["page_id"]: (r["host"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()}
    assert rows[3] == ("a.org", "own 3\nend 3<b", 3, 1) and rows[6] == ("a.org", "", 1, 1)
    assert rows[7] == ("a.org", None, 0, 0) and rows[8] == ("", "Menu\nx", 2, 0) and rows[9] == ("a.org", "", 0, 0)


@pytest.mark.parametrize("url,host,path,rule,verdict", [
    ("http://A.Org/x?y#z", "a.org", "/x", "org/", "allow"), ("https://example.org/es/1", "example.org", "/es/1", "example.org/es/", "block"),
    ("http://m.example.org/en/12", "m.example.org", "/en/12", "example.org/en/1", "block"), ("http://x.com/de/", "x.com", "/de/", "com/de/", "block"),
    ("http://x.com/fr/", "x.com", "/fr/", "com/fr/", "allow"), ("http://badexample.org/es/", "badexample.org", "/es/", "org/", "allow"),
    ("http://org?x=/a", "org", "", None, "allow"), ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("://h#f/p", "h", "", None, "allow"),
])
def test_listed_rules(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url)], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    r = url_rules.judge(pages, labels).first()
    assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)


def test_mined_rules_block_without_a_listed_one(spark):
    urls = [(i, f"http://{'spam' if i % 2 else 'fine'}.example.net/en/{i}") for i in range(40)] + [(99, "http://www.spam.example.net/x"), (None, None)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i % 2 else 1, None) for i in range(40)] + [(1, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: (r["verdict"], r["mined_tokens"]) for r in url_rules.judge(pages, labels).collect()}
    assert got[99] == ("block", ["h:spam"]) and got[1][0] == "block" and got[0] == ("allow", None) and got[None][0] == "allow"
    assert len(got) == len(urls)


def test_rules_equal_brute_force(spark):
    """All token sets over the bounds whose subsets are no rules, as few tokens a page make it possible to list them."""
    dice = random.Random(6)
    baskets = [(["a", "b", "c", "d", "e"][:dice.randint(1, 5)] + dice.sample(["p", "q", "r", "s"], dice.randint(0, 3)), dice.random() < 0.4) for _ in range(400)]
    baskets = [(t, bad or ("p" in t and "q" in t) or "e" in t) for t, bad in baskets]
    share, want = sum(bad for _, bad in baskets) / 400, {}
    for k in range(1, 9):
        for c in combinations("abcdepqrs", k):
            hits = [bad for t, bad in baskets if set(c) <= set(t)]
            sure = sum(hits) / len(hits) if hits else 0
            if sum(hits) >= 20 and sure >= 0.5 and sure >= 1.2 * share and not any(set(w) < set(c) for w in want):
                want[c] = (sure, sum(hits) / 400)
    rules = url_rules.mine(spark.createDataFrame(baskets + [([], True), (["a"], None)], "tokens array<string>, bad boolean"), url_rules.Mining(min_lift=1.2))
    got = {tuple(r["tokens"]): (r["confidence"], r["support"]) for r in rules.collect()}
    assert set(got) == set(want) and len(want) > 1
    assert all(got[c] == pytest.approx(want[c]) for c in want)


def test_rules_of_tokens_behind_many_more_telling_ones(spark):
    """Two tokens that only say bad together, on pages with twelve tokens of a higher share of bad labels each."""
    fill = [f"f{chr(97 + i)}" for i in range(12)]
    baskets = [(["x", "y", *fill], True)] * 30 + [(["x", *fill], False)] * 35 + [(["y", *fill], False)] * 35 + [(["x"], False), (["y"], False)] * 40
    rules = url_rules.mine(spark.createDataFrame(baskets, "tokens array<string>, bad boolean")).collect()
    assert [(r["tokens"], r["confidence"], r["support"]) for r in rules] == [(["x", "y"], 1.0, pytest.approx(30 / 180))]


def test_rules_longer_than_ten_tokens(spark):
    """Twelve tokens that say bad only all together: every good page lacks one of them."""
    all_of = [chr(97 + i) for i in range(12)]
    baskets = [(all_of, True)] * 25 + [([t for t in all_of if t != gone], False) for gone in all_of for _ in range(30)]
    rules = url_rules.mine(spark.createDataFrame(baskets, "tokens array<string>, bad boolean")).collect()
    assert [(r["tokens"], r["confidence"]) for r in rules] == [(all_of, 1.0)]


def test_long_urls_with_few_labels(spark):
    deep = "http://spam.example.net/" + "/".join(f"part{chr(97 + i)}" for i in range(25))
    pages = spark.createDataFrame([(i, deep if i < 31 else f"http://fine.example.net/{chr(97 + i - 31)}") for i in range(41)] + [(99, deep + "/" + "x/" * 50_000)], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i >= 31), 0) for i in range(41)], "doc_id long, quality int, toxic int")
    began = time.time()
    got = {r["page_id"]: r["verdict"] for r in url_rules.judge(pages, labels, url_rules.Mining(min_lift=1.1)).collect()}
    assert time.time() - began < 60
    assert got == {i: "block" if i < 31 or i == 99 else "allow" for i in [*range(41), 99]}
    few = url_rules.judge(pages, labels.limit(19)).collect()
    assert {r["verdict"] for r in few} == {"allow"} and len(few) == 42
    assert url_rules.judge(pages.limit(0), labels).count() == 0


def test_licence_sequences(documents):
    apache = "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License. You may obtain a copy of the License at\nhttp://x"
    docs = documents(apache, "Some text. Released under the MIT License.\nMore", "Copyright Nobody.", None, "", "Released under the MIT License. Released under the MIT License.", "x " * 50_000)
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    names = {k: [tuple(x) for x in r["licences"]] for k, r in got.items()}
    assert names[0] == [("Apache-2.0", 1)] and got[0]["sentence_ids"] == ["apache2", "apacheuse", "apachecopy"]
    assert names[1] == [("MIT", 1)] and names[2] == [] and got[2]["n_unknown"] == 1
    assert names[3] == names[4] == names[6] == [] and names[5] == [("MIT", 2)]


MIT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
GPL = """This program is free software{0} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation{1} either version {2} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
BSD = """Copyright (c) 2020, Somebody
All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED."""


def test_standard_texts_wrapped_and_unwrapped(documents):
    texts = {"MIT": MIT, "BSD-3-Clause": BSD, "BSD-2-Clause": BSD.replace(BSD[BSD.index("3. Neither"):BSD.index("THIS SOFTWARE")], "")}
    wanted = [*texts.items(), *[("GPL-2.0-or-later", GPL.format(";", x, 2)) for x in ";,"], *[("GPL-3.0-or-later", GPL.format(a, b, 3)) for a, b in (":,", ";;", ";,")]]
    wrap = lambda t, mark: "\n".join(mark + x for line in t.split("\n") for x in (textwrap.wrap(line, 70) or [""]))
    cases = [(name, form) for name, text in wanted for form in (text, wrap(text, ""), wrap(text, "# "))]
    got = {r["doc_id"]: r for r in licenses.scan(documents(*[t for _, t in cases])).collect()}
    for i, (name, text) in enumerate(cases):
        assert [tuple(x) for x in got[i]["licences"]] == [(name, 1)], (text, got[i])
        assert got[i]["n_unknown"] == text.count("Copyright (c)")


ISC = """ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
NOTICES = {
    "ISC": ISC, "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "LGPL-2.1-or-later": "This library is free software; " + GPL.format(";", ";", 2).split("; ", 1)[1].replace("GNU General", "GNU Lesser General").replace("version 2 ", "version 2.1 ").split(" This program is dist")[0],
    "Unlicense": "This is free and unencumbered software released into the public domain.", "CC0-1.0": "// SPDX-License-Identifier: CC0-1.0\n", "AGPL-3.0-or-later": "SPDX-License-Identifier: AGPL-3.0-or-later",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
}


def test_more_notices_and_the_sql_is_the_same_program(documents):
    import duckdb
    from agvlens.llm.queries import _license_sql, license_report

    wrap = lambda t, mark: "\n".join(mark + x for line in t.split("\n") for x in (textwrap.wrap(line, 60) or [""]))
    named = [(n, f) for n, t in NOTICES.items() for f in (t, wrap(t, ""), wrap(t, " * "), "Intro words. " + t + "\n\nMore words.")]
    dice, pieces = random.Random(4), [MIT, BSD, ISC, *[GPL.format(a, b, v) for a in ":;" for b in ",;" for v in (2, 3)], *NOTICES.values()]
    torn = []
    for _ in range(150):
        words = " \n".join(dice.choice(pieces) for _ in range(2)).split(" ")
        a = dice.randrange(len(words))
        torn.append(" ".join(words[a:a + dice.randrange(400)]).replace(" ", dice.choice([" ", " ", "\n", "  "])))
    texts = [f for _, f in named] + torn + [None, "", "Licensed under the\nApache License, Version 2.0", "All rights reserved"]
    docs = documents(*texts)
    got = {r["doc_id"]: tuple(r) for r in license_report(docs).collect()}
    for i, (name, text) in enumerate(named):
        assert got[i][2] == f"{name}:1", (text, got[i])
    given = docs.select("doc_id", "text").toPandas()  # noqa: F841 duckdb finds it by name
    want = duckdb.connect().execute(_license_sql("given")).fetchall()
    assert sorted(got.values()) == sorted(want)


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    inside = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)


@pytest.mark.parametrize("text", [None, "", " \n\t", "a b c d e f g h " * 3, "é#ü a b\n\nx\nx\n x", "a " * 40 + "b c d e f g h i j", "\x1c|\x85 <y>\r\nz"])
def test_counts(text):
    assert quality.counts_of(text)[:5] == brute_counts(text)


def test_outliers_go_and_clean_documents_stay(documents, prose):
    clean = [(prose(i, 60 + i % 50), "en", "a" if i % 3 else None) for i in range(120)]
    junk = [(" ".join(w + "###" for w in prose(900 + i, 60).split()), "en", "a") for i in range(4)]
    docs = documents(*clean, *junk, ("short text", "en", "a"), (None, None, None), ("a b c d e f g h " * 20, "de", "z"))
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    assert all(got[i]["kept"] for i in range(120)) and not any(got[i]["kept"] for i in range(120, 127))
    assert got[124]["base_failed"] and got[125]["base_failed"] and got[126]["base_failed"] and not got[120]["base_failed"]
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(range(120))
    assert quality.judge(docs.limit(0)).count() == 0


def test_texts_are_counted_once_where_documents_go(documents):
    plan = quality.keep_good(documents("a b c", None))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1  # not again below the filter on the counts


def test_trigram_queries_are_mandatory():
    assert not next(r for r in secrets.RULES if r.kind == "assign").scans_all
    assert [r.kind for r in secrets.RULES if r.scans_all] == ["hex"]
    assert secrets.trigram_query("abc|d.f") == secrets.EVERY
    assert secrets.trigram_query("ab(cd)?ef") == frozenset({frozenset({b"abc", b"bcd", b"cde", b"def"}), frozenset({b"abe", b"bef"})})


SECRETS = ['token = "0123456789abcdef0123"', "AKIAABCDEFGHIJKLMN AKIASHORT", "xPASSWORD:abcdefghijkl Api_Key=short secret='abc/def+ghi=='", None, "", "é token=token=abcdefghijkl",
           "ghp_" + "a1" * 20, "paſſword=abcdefghijklm", "deadbeef" * 2000, "-----BEGIN RSA PRIVATE KEY-----"]


def test_secrets_against_plain_matching(documents):
    got = {r["doc_id"]: r for r in secrets.digest(secrets.scan(documents(*SECRETS))).collect()}
    base = [("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12), ("access", r"AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16)]
    for i, text in enumerate(SECRETS):
        spans = sorted((m.start(), k, kind, m.end()) for k, (kind, p, g, least) in enumerate(base) for m in re.finditer(p, text or "") if len(m.group(g)) >= least)
        shown = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans)
        assert got[i]["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k, *_ in base] == [sum(s[2] == k for s in spans) for k, *_ in base]
    assert "github:0:44" in got[6]["spans"] and got[9]["spans"] == "pem:0:31"


def _made_up_stats(dice, n, outliers):
    """Counts of texts that scatter evenly, and of some that do not."""
    rows = []
    for i in range(n + outliers):
        words = int(dice.integers(150, 900))
        odd = i >= n
        rows.append((words, int(words * (dice.normal(9, 0.2) if odd else dice.normal(5, 0.25))), int(words * 0.2) if odd else int(dice.integers(0, 3)),
                     int(dice.integers(0, 2)), 0, 12, int(words * dice.uniform(0.1, 0.15)), int(words * dice.uniform(0.08, 0.12))))
    return rows


def test_estimate_equals_a_search_over_many_starts(spark):
    dice = np.random.default_rng(7)
    counts = _made_up_stats(dice, 320, 60)
    kind = "lang string, source string, stats struct<" + ",".join(f"{c}:bigint" for c in quality.COUNTS) + ">"
    stats = spark.createDataFrame([("en", "web", c) for c in counts], kind)
    got = [r["distance2"] for r in quality.verdicts(stats.withColumn("at", F.monotonically_increasing_id()), quality.fit(stats)).orderBy("at").collect()]
    x = np.array([[r[f"x{i}"] for i in range(quality.P)] for r in stats.select(*[v.alias(f"x{i}") for i, v in enumerate(quality.vector("stats"))]).collect()])
    h, best = int(np.ceil(0.75 * len(x))), (np.inf, None)
    for _ in range(150):
        inner = dice.choice(len(x), quality.P + 2, replace=False)
        for _ in range(12):
            center, scatter = x[inner].mean(0), np.cov(x[inner].T, bias=True) + np.diag(quality.FLOOR**2)
            d2 = np.einsum("ij,jk,ik->i", x - center, np.linalg.inv(scatter), x - center)
            inner = np.argsort(d2)[:h]
        best = min(best, (np.linalg.slogdet(scatter)[1], inner.tolist()), key=lambda b: b[0])
    inner = np.array(best[1])
    scatter = np.cov(x[inner].T, bias=True) * quality.consistency(0.75) + np.diag(quality.FLOOR**2)
    d2 = np.einsum("ij,jk,ik->i", x - x[inner].mean(0), np.linalg.inv(scatter), x - x[inner].mean(0))
    assert ((np.array(got) > 40) == (d2 > 40)).all() and (d2[320:] > 40).all() and (d2[:320] < 40).all()
    assert abs(np.median(np.array(got) / d2) - 1) < 0.1


def test_rare_languages_are_held_against_all_rows(spark):
    dice = np.random.default_rng(8)
    kind = "lang string, source string, stats struct<" + ",".join(f"{c}:bigint" for c in quality.COUNTS) + ">"
    rare = _made_up_stats(dice, 20, 5)
    rows = [("en", "web", c) for c in _made_up_stats(dice, 400, 0)] + [("xx", "web", c) for c in rare]
    stats = spark.createDataFrame(rows, kind)
    kept = quality.verdicts(stats.withColumn("at", F.monotonically_increasing_id()), quality.fit(stats)).orderBy("at").collect()[400:]
    assert [r["kept"] for r in kept] == [True] * 20 + [False] * 5
    few = spark.createDataFrame(rows[400:], kind)
    assert all(r["kept"] for r in quality.verdicts(few, quality.fit(few)).collect())  # no estimate: not by distance
