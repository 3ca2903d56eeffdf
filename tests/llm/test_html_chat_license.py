import random

import pytest
from pyspark.sql import functions as F

from brandloom.llm import chat, html_extract, licenses
from tests.llm.helpers import ODD, documents

ARTICLE = "<p>First &amp; foremost, prose that goes on, and on, for a while.</p><p>Second  part\nof it,<br>which ends&nbsp;here.</p>"
TEXT = "First & foremost, prose that goes on, and on, for a while.\n\nSecond part of it, which ends here."
TEMPLATES = [
    "<html><head><title>T</title><style>p{}</style></head><body><nav><a href=/>Home</a></nav><article>%s</article><div class=ad>Buy this now, it is cheap, really.</div><footer>(c)</footer></body></html>",
    "<body><div id='header'>Top</div><div class='row'><div class='post-body entry-12'>%s</div><div class='sidebar'><ul><li>One</ul></div></div><div id=comments><p>Nice post, thanks, I read it, all of it, twice.</p></div><script>var x='<p>no</p>'</script>",
    "<body><main>%s<form>Name <input></form><!-- <p>hidden</p> --></main><aside>Related, things, to read, and more things, of all kinds.</aside>",
    "<body><div class='cookie-notice'>We use cookies, lots of cookies, for you.</div><div class=content>%s<div class='share'>Share</div></div>",
]


@pytest.mark.parametrize("template", TEMPLATES)
def test_templates(template):
    page = html_extract.parse(template % ARTICLE)
    assert html_extract.text_under(page, max(html_extract.votes(page), key=lambda v: (v[2], -v[1]))[0])[0] == TEXT


@pytest.mark.parametrize("source", ["", "<", "<p", "<!-- x", "<script>y", "</div></p>", "<a href='x", "<p><b><i>", "\x00", "<p>" * 500, "<div>" * 500 + "x"])
def test_broken_pages(source):
    page = html_extract.parse(source)
    text, _ = html_extract.text_under(page, None)
    assert "<p" not in text or source in ("<p", "<a href='x")


def test_consensus(spark):
    # the host's template holds its article in div.story; one page has a longer list beside it
    usual = "<body><div class=story>%s</div><div class=more>%s</div>"
    rows = [(i, "http://h.example/%d" % i, usual % (ARTICLE, "<p>x</p>")) for i in range(5)]
    rows += [(5, "http://H.example:80/5", usual % ("<p>Short news, indeed.</p>", ARTICLE * 3))]
    rows += [(6, "http://other.example/", TEMPLATES[0] % ARTICLE), (7, None, None), (8, "http://h.example/8", "<main>" + ARTICLE), (9, "x", ""), (9, "x", "")]
    got = {r["page_id"]: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[5]["text"] == "Short news, indeed." and got[0]["text"] == got[6]["text"] == got[8]["text"] == TEXT
    assert got[7]["text"] == got[9]["text"] == "" and got[7]["n_chars"] == 0 and got[0]["n_chars"] == len(TEXT)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.extract(empty).count() == 0


NESTED = [
    "<body><nav>Home</nav><article><h1>Title</h1><p>A lead, in short.</p><div class='entry-content'>%s</div><p>By Ann.</p></article><footer>(c)</footer>",
    "<body><div class=post><h1>Title</h1><p>A lead, in short.</p><div class=content>%s</div><p>By Ann.</p></div><div class=sidebar>Links</div>",
    "<body class='single-post'><div>Site name</div><main><h1>Title</h1><p>A lead, in short.</p><div><article class=post>%s</article></div><p>By Ann.</p></main>",
    "<body><div class='Post wide'><h1><a href=/>Title</a></h1><div class=lead><p>A lead, in short.</p></div><div><div class=content>%s</div></div><p>By Ann.</p></div>",
]


@pytest.mark.parametrize("template", NESTED)
@pytest.mark.parametrize("times", [1, 5, 40, 400])
def test_heading_and_lead_stay(template, times):
    page = html_extract.parse(template % (ARTICLE * times))
    wanted = "\n\n".join(["Title", "A lead, in short.", *[TEXT] * times, "By Ann."])
    assert html_extract.text_under(page, None)[0] == wanted


def test_long_pages_cut_nothing_off_short_ones(spark):
    rows = [(100 * h + i, f"http://h{h}.example/{i}", t % (ARTICLE * times)) for h, t in enumerate(NESTED) for i, times in enumerate([1, 400, 400, 400])]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows) and all(r["text"].startswith("Title\n\nA lead, in short.\n\nFirst & ") and r["text"].endswith("By Ann.") for r in got)


def test_many_open_articles():
    page = html_extract.parse("<div class=post>" * 1000 + ARTICLE)
    assert max(html_extract.votes(page), key=lambda v: (v[2], -v[1])) == (html_extract.path_hash(["div.post"]), 1, 1000)


def plain_views(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is None, t or 0, s or "unknown", x or "") for c, t, s, x in rows if c == conv))
        for view in {s for *_, s, _ in turns} - {"system"}:
            text, masks = "", []
            for *_, s, x in turns:
                who = s if s == "system" else "assistant" if s == view else f"user name={s}"
                text += f"<|im_start|>{who}\n"
                if s == view:
                    masks.append((len(text), len(text) + len(x) + len("<|im_end|>\n")))
                text += x + "<|im_end|>\n"
            out[conv, view] = (text, masks)
    return out


CHAT = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hello"), (1, 2, "bob", "Hi é"), (1, 3, "ann", None), (1, 3, "ann", None), (1, None, "cy", "late"), (2, 5, None, "who"), (2, 4, "", "me"), (3, 1, "system", "alone"), (None, 1, "ann", "no id")]
CHAT += [(4, k, ["ann", "bob", "cy"][k % 3], f"turn {k} " * (k % 5)) for k in range(200)]


def test_rotation(spark):
    segments = chat.rotate(spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string"), ranges=7)
    got = {}
    for r in segments.orderBy("conv_id", "perspective", "seq").collect():
        text, masks = got.setdefault((r["conv_id"], r["perspective"]), ["", []])
        assert (r["start"], r["length"]) == (len(text), len(r["segment"]))
        got[r["conv_id"], r["perspective"]][0] += r["segment"]
        if r["train_start"] < r["train_end"]:
            masks.append((r["train_start"], r["train_end"]))
    assert {k: (t, m) for k, (t, m) in got.items()} == plain_views(CHAT)
    whole = {}
    for r in chat.assemble(segments, 50).orderBy("piece").collect():
        text, masks = whole.get((r["conv_id"], r["perspective"]), ("", []))
        whole[r["conv_id"], r["perspective"]] = (text + r["text"], masks + [(m["from"] + r["start"], m["to"] + r["start"]) for m in r["masks"]])
    assert whole == plain_views(CHAT)
    assert chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_turns_without_numbers_are_spread(spark):
    rows = [(5, None if k % 2 else 7, ["ann", "bob"][k % 3 % 2], f"{k * 7919 % 1000:04d} said") for k in range(1000)] + [(6, 1, "ann", "x")] * 3
    segments = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), ranges=8)
    views = {}
    for r in segments.orderBy("conv_id", "perspective", "seq").collect():
        text = views.setdefault((r["conv_id"], r["perspective"]), [""])
        assert r["start"] == len(text[0])
        text[0] += r["segment"]
    assert {k: v[0] for k, v in views.items()} == {k: t for k, (t, _) in plain_views(rows).items()}
    staged = spark.read.parquet(segments.inputFiles()[0].rsplit("/", 1)[0])
    assert staged.where("conv_id = 5 AND turn IS NULL").select("part").distinct().count() > 2


def test_chat_columns_may_clash(spark):
    rows = [(1, 1, "ann", "hi", 3, "c", "p", 9)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int, conv string, perspective string, start long")
    assert [(r["perspective"], r["start"]) for r in chat.rotate(turns).collect()] == [("ann", 0)]


def test_native_plans(spark):
    turns = spark.createDataFrame([(1, 1, "a", "x")], "conv_id long, turn long, role string, text string")
    for df in (chat.rotate(turns), chat.assemble(chat.rotate(turns)), licenses.scan(documents(spark, ODD))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
NOTICES = [
    ("Some prose.\nReleased under the MIT License.\nMore", "MIT"),
    ("Intro. Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
    ("Licensed under CC BY-NC 4.0.\nReleased under the MIT License.", "CC-BY-NC-4.0,MIT"),
    ("SPDX-License-Identifier: MIT", "MIT"),
    ("We were not licensed under the MIT License at all times.", ""),
    ("Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.", "Apache-2.0"),
    ("", ""),
    (None, ""),
]


def test_licenses(spark):
    docs = documents(spark, [(i, t, None, "s", 0) for i, (t, _) in enumerate(NOTICES)] + [(99, BSD.replace("1. ", "").replace("2. ", ""), None, "s", 0)])
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(docs).collect()}
    assert [got[i] for i in range(len(NOTICES))] == [x for _, x in NOTICES]
    assert got[99] == "BSD-2-Clause"
    assert licenses.scan(documents(spark, ODD)).where("licensed").count() == 0 and licenses.scan(documents(spark, [])).count() == 0


def test_every_known_sentence_has_a_trigger(spark):
    table = spark.createDataFrame([(s,) for s in licenses.sentence_table()], "s string")
    assert table.where(~F.col("s").rlike(licenses.TRIGGER)).count() == 0
    ids = set(licenses.sentence_table().values())
    assert all(i in ids for _, rule in licenses.rule_table() for i in rule.strip(",").split(","))


GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:
"""
WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE FOR ANY CLAIM.
"""
MIT = f"""MIT License

Copyright (c) 2024 Jane Doe

{GRANT}
The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

{WARRANTY}"""
ISC = """ISC License

Copyright (c) 2024, Jane Doe

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE.
"""
BSD0 = ISC.replace("ISC License", "Zero-Clause BSD").replace(""", provided that the above
copyright notice and this permission notice appear in all copies.""", ".")


def licences(spark, texts):
    got = licenses.scan(documents(spark, [(i, t, None, "s", 0) for i, t in enumerate(texts)])).collect()
    return [r["licenses"] for r in sorted(got, key=lambda r: r["doc_id"])]


def commented(text):
    return "/*\n" + "".join(f" * {x}".rstrip() + "\n" for x in text.splitlines()) + " */\nint x;\n"


def test_whole_licence_files(spark):
    files = {"MIT": MIT, "ISC": ISC, "0BSD": BSD0}
    for change in (lambda t: t, commented, lambda t: t.replace("\n", "\r\n"), lambda t: t.replace("\n", "\r"), lambda t: t.replace("\n\n", "\n \t\n")):
        assert licences(spark, [change(t) for t in files.values()]) == list(files)
    # a blank line inside a sentence ends none of the plain prose
    assert licences(spark, ["Licensed under\n\nthe MIT License."]) == ["MIT"]


GPL = """This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""


def test_gpl_headers(spark):
    third = GPL.replace("version 2", "version 3")
    texts = [GPL, commented(GPL), " ".join(GPL.split()), third, third.replace("software;", "software:").replace("Foundation;", "Foundation,"), GPL.replace("either version 2", "version 9")]
    assert licences(spark, texts) == ["GPL-2.0-or-later"] * 3 + ["GPL-3.0-or-later"] * 2 + [""]
    whole = licenses.scan(documents(spark, [(1, " ".join(GPL.split()), None, "s", 0)])).first()
    assert whole["sentence_ids"] == "gpl-terms,gpl2-or-later,gpl-hope,gpl-no-warranty"


def test_mpl_header(spark):
    text = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
    assert licences(spark, [text, commented(text), " ".join(text.split()), text.replace("v. 2", "v. 3")]) == ["MPL-2.0"] * 3 + [""]


def test_spdx_notices(spark):
    plain = sorted({*licenses.NAMES, *licenses.RULES})
    only = [f"{x}-only" for x in licenses.FAMILIES]
    later = [f"{x}-or-later" for x in licenses.FAMILIES]
    plus = [f"{x}+" for x in licenses.FAMILIES]
    forms = ("SPDX-License-Identifier: %s", "# SPDX-License-Identifier: %s\n\nint x;", "/* SPDX-License-Identifier: %s */")
    for form in forms:
        assert licences(spark, [form % x for x in plain + only + later + plus]) == plain + list(licenses.FAMILIES) + later + later
    assert licences(spark, ["SPDX-License-Identifier: Apache-2.0+", "SPDX-License-Identifier: GPL-2.0-with-x"]) == ["Apache-2.0", ""]


def test_every_piece_has_a_trigger(spark):
    table = spark.createDataFrame([(s,) for s in licenses.known_sentences()], "s string")
    assert table.where(~F.col("s").rlike(licenses.TRIGGER)).count() == 0
    ids = set(licenses.known_sentences().values())
    assert all(i in ids for _, rule in licenses.known_rules() for i in rule.strip(",").split(","))
    assert licenses.sentence_table().items() <= licenses.known_sentences().items()


def test_no_document_is_passed_over(spark):
    texts = ["Released\nunder MIT.", "Released  under Apache 2.0.", "Distributed\tunder the GPLv3.", "Available\r\n# under the GPLv2.", "This is free and unencumbered software released into the public\ndomain."]
    assert licences(spark, texts) == ["MIT", "Apache-2.0", "GPL-3.0", "GPL-2.0", "Unlicense"]
    # every known sentence, its words apart in ways that normalising undoes
    known = [x for x in licenses.known_sentences() if x]
    for gap in ("  ", "\n", "\t", "\r\n * ", " -- ", "\u00a0", ", "):
        table = spark.createDataFrame([(x.replace(" ", gap).title(),) for x in known], "s string")
        assert table.where(~F.col("s").rlike(licenses.TRIGGER)).count() == 0


def by_sql(docs):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [d[:2] for d in docs])
    return sorted(con.execute(f"SELECT doc_id, sentence_ids, n_known, licenses, licensed FROM ({licenses.duckdb_sql()})").fetchall())


def by_spark(spark, docs):
    return sorted(tuple(r) for r in licenses.scan(documents(spark, docs)).select("doc_id", "sentence_ids", "n_known", "licenses", "licensed").collect())


def test_the_sql_finds_the_same(spark):
    texts = ["Released\nunder MIT.", "Released  under Apache 2.0.", "Distributed\tunder the GPLv3.", MIT, ISC, GPL, BSD, commented(MIT), commented(GPL), None, "", *(x for x, _ in NOTICES)]
    docs = [(i, t, None, "s", 0) for i, t in enumerate(texts)]
    assert by_spark(spark, docs) == by_sql(docs)


@pytest.mark.parametrize("seed", range(3))
def test_the_sql_finds_the_same_in_random_white_space(spark, seed):
    r = random.Random(seed)
    known = [x for x in licenses.known_sentences() if x]
    gaps = [" ", "  ", "\n", "\r\n", "\r", "\t", "\n\n", "\n # ", "\n \t\n", ", ", "\f", "\u00a0", " - "]
    ends = [".", ". ", ";\n", ":", "! ", "\n", "\n\n", " ", "? ", ".\r\n", "."]
    texts = []
    for _ in range(400):
        out = []
        for _ in range(r.randint(1, 6)):
            words = r.choice(known).split() if r.random() < 0.8 else r.choice(["v. 2 of it", "Neither the name of Acme Inc nor the names of its contributors may be used", "some prose, été", "SPDX-License-Identifier: GPL-2.0+"]).split()
            usual = r.random() < 0.6
            text = "".join(w + (" " if usual else r.choice(gaps)) for w in words).strip()
            out.append(r.choice([str.upper, str.title, str.lower, str])(text) + r.choice(ends))
        texts.append(r.choice(["", " ", "\n"]).join(out))
    docs = [(i, t, None, "s", 0) for i, t in enumerate(texts)]
    got = by_spark(spark, docs)
    assert got == by_sql(docs) and sum(x[4] for x in got) > 100


ZLIB = """Copyright (c) 2020 Jane Doe

This software is provided 'as-is', without any express or implied warranty. In
no event will the authors be held liable for any damages arising from the use
of this software.

Permission is granted to anyone to use this software for any purpose, including
commercial applications, and to alter it and redistribute it freely, subject to
the following restrictions:

1. The origin of this software must not be misrepresented.
"""
BSD3 = BSD + """3. Neither the name of the University of Somewhere, Dept. 7, nor the names of its
   contributors may be used to endorse or promote products derived from this
   software without specific prior written permission.
""".replace(", Dept. 7,", "")
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.
"""
AGPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as
published by the Free Software Foundation, either version 3 of the
License, or (at your option) any later version.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""
TITLE = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc.
"""


def test_further_licences_and_named_holders(spark):
    files = [ZLIB, BSD3, LGPL, AGPL, APACHE, TITLE]
    for change in (lambda t: t, commented, lambda t: t.replace("\n", "\r\n")):
        assert licences(spark, [change(t) for t in files]) == ["Zlib", "BSD-2-Clause,BSD-3-Clause", "LGPL-2.1-or-later", "AGPL-3.0-or-later", "Apache-2.0", "GPL-3.0"]
    docs = [(i, t, None, "s", 0) for i, t in enumerate(files)]
    assert by_spark(spark, docs) == by_sql(docs)


def test_license_columns_may_clash(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License.", "mine", True)], "doc_id long, text string, licenses string, by_line boolean")
    assert licenses.scan(docs).first()["licenses"] == "MIT"
