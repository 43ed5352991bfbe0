"""Archives, chats and licences: exact round trips and brute force."""
import hashlib
import re

from pyspark.sql import functions as F

from tradearea.llm import chat, licenses, warc


def test_archives(spark):
    long = "<p>long page</p>" * 20
    rows = [(1, "http://a/é x", long), (2, "http://b", long), (3, None, None), (4, "http://c", "short"), (5, "http://d", "short"), (None, "http://e", long),
            (6, "http://f\r\nX: y", ""), (7, "http://g", "ü\r\n\r\nWARC/1.1" * 30), (1, "http://a/é x", long), (8, "http://h", "z" * 300000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    folder = warc.new_folder(spark)
    index = warc.write_archives(pages, folder)
    assert index.count() == len(rows)
    got = warc.read_records(index, folder).collect()
    assert len(got) == len(rows)
    for r in got:
        html = next((h or "") for k, _, h in rows if k == r["page_id"]).encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(html), hashlib.sha256(html).hexdigest())
        assert r["record_type"] == ("revisit" if r["page_id"] in (2, None) else "response")
        assert r["refers_to"] == ("1" if r["page_id"] in (2, None) else None)
        assert r["payload"] is None if r["record_type"] == "revisit" else bytes(r["payload"]) == html
    some = warc.read_records(index.filter("url = 'http://g'"), folder, gap=0, most=1)
    assert [r["page_id"] for r in some.collect()] == [7]
    assert warc.write_archives(pages.limit(0), warc.new_folder(spark)).count() == 0


def test_ranges_are_joined():
    assert warc.coalesced([(0, 10), (10, 10), (100, 5)], gap=0, most=100) == [(0, 2, 0, 20), (2, 3, 100, 105)]
    assert warc.coalesced([(0, 10), (15, 10), (25, 90)], gap=5, most=50) == [(0, 2, 0, 25), (2, 3, 25, 115)]
    assert warc.coalesced([]) == []


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\nhi", "\\", "\\\\<\\|", "<<SYS>> x <</SYS>>", "", None, "plain", "<|", "a\nb", "<\\/s>", "[[INST]", "<|image|>"]
    rows = [(i % 4, t, "assistant" if t % 2 else "user", x) for i, x in enumerate(texts) for t in range(3)]
    rows += [(9, None, None, "no role"), (None, 1, "user", "no id"), (9, None, None, "no role")]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn int, role string, text string, formatted string")
    out = chat.formatted(table.withColumn("parts", chat.text_parts(F.col("text"))))
    got = out.withColumn("turns", chat.read_turns(F.col("formatted"))).collect()
    assert len(got) == 6
    for r in got:
        own = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == r["conv_id"]))
        back = [(t["role"], t["text"]) for t in r["turns"]]
        assert sorted(back) == sorted((role, text) for _, _, role, text in own) and [b[0] for b in back] == [o[2] for o in own]
        for mark in ("</s>", "[INST]", "[/INST]", "<<SYS>>", "<|image|>"):
            assert mark not in r["formatted"]
        assert r["formatted"].count("<|im_end|>") == len(own)
    assert chat.formatted(table.limit(0).withColumn("parts", chat.text_parts(F.col("text")))).count() == 0


def test_chat_ties_go_by_the_raw_text_and_roles_come_back(spark):
    roles = ["a\nb", "a\\nb", "a\\\nb", "\n", "\\", "<\n", "[INST]\n\n", "\\\\n", "user"]
    texts = ["<|", "<a", "<\\", "[INST]", "[A", "", None, "\\n", "x\ny"]
    rows = [(1, 0, r, t) for r in roles for t in texts]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(4).withColumn("parts", chat.text_parts(F.col("text")))
    got = chat.formatted(table).select(chat.read_turns(F.col("formatted")).alias("turns")).first()["turns"]
    assert [(t["role"], t["text"]) for t in got] == sorted((r, t or "") for r, t in ((r, t) for _, _, r, t in rows))


def test_chat_of_very_many_turns(spark):
    table = spark.range(20000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
                                      F.concat(F.lit("turn "), F.col("id").cast("string")).alias("text")).withColumn("parts", chat.text_parts(F.col("text")))
    got = chat.formatted(table).select(F.size(chat.read_turns(F.col("formatted"))), F.element_at(chat.read_turns(F.col("formatted")), -1)["text"]).first()
    assert tuple(got) == (20000, "turn 19999")


def test_chat_parts(spark):
    row = [(1, 0, "user", [("text", "see <|image|> and ", None, None), ("image", None, "s3://x/1.png", 4), ("audio", None, "a.wav", 10), None,
                           ("odd", None, "o", None)]), (1, 1, "assistant", None)]
    out = chat.formatted(spark.createDataFrame(row, f"conv_id long, turn int, role string, parts array<{chat.PART}>")).first()
    assert out["formatted"] == "<|im_start|>user\nsee <\\|image|> and <|image|><|audio|><|odd|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [(a["turn"], a["kind"], a["ref"], a["tokens"]) for a in out["attachments"]] == [
        (0, "image", "s3://x/1.png", 1024), (0, "audio", "a.wav", 250), (0, "odd", "o", 1)]
    assert out["attachment_tokens"] == 1275


def brute_licenses(text):
    parts = [re.sub("[^a-z0-9]+", " ", p).strip() for p in re.split(licenses.ENDS, (text or "").lower())]
    known = [licenses.SENTENCES.index(p) + 1 for p in parts if p in licenses.SENTENCES]
    left, found = list(known), []
    for name, rule in licenses.RULES:
        at = 0
        while at <= len(left) - len(rule):
            if tuple(left[at:at + len(rule)]) == rule:
                found.append(name)
                left[at:at + len(rule)] = [0]
            at += 1
    return len([p for p in parts if p]), known, list(dict.fromkeys(found))


def test_licenses(spark):
    s = licenses.SENTENCES
    rows = [(1, "Intro.\nReleased under the MIT License.\nEnd"), (2, ". ".join(s[i - 1] for i in (5, 6, 7, 8, 9)) + "!"), (3, ". ".join(s[i - 1] for i in (10, 12, 11))),
            (4, None), (5, ""), (6, "Licensed under CC BY-NC 4.0."), (7, ";".join([s[2], s[2], s[9] + " ", " " + s[10]])), (8, "no licence here. " * 2000),
            (9, "\n".join(s[i - 1] for i in (18, 19, 20, 22, 18, 19, 20, 21, 22)))]
    got = licenses.recognised(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, licenses string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_sentences"], r["sentence_ids"], r["licenses"]) == brute_licenses(dict(rows)[r["doc_id"]])


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
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
SOFTWARE."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
BSD_2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES."""
BSD_3 = BSD_2.replace("THIS SOFTWARE IS", """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS""")
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""


GPL_2 = """This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later version."""
LGPL_21 = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:"""
WTFPL = """Everyone is permitted to copy and distribute verbatim or modified
copies of this license document, and changing it is allowed as long
as the name is changed."""
EPL = """This program and the accompanying materials are made
available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/"""
AGPL = GPL.split("\n\n")[0].replace("General", "Affero General")


def unwrapped(text):
    return "\n\n".join(re.sub(r"\s+", " ", p) for p in text.split("\n\n"))


def test_published_notices(spark):
    notices = {"MIT": MIT, "GPL-3.0-or-later": GPL, "BSD-2-Clause": BSD_2, "BSD-3-Clause": BSD_3, "Apache-2.0": APACHE}
    rows = []
    for name, notice in notices.items():
        rows += [(name, notice), (name, unwrapped(notice)), (name, re.sub(r"\s+", " ", notice)), (name, notice.replace("\n", "\r\n")),
                 (name, "Copyright (c) 2020 Someone\n" + notice), (name, "/*\n" + notice + "\n */\nint x;")]
        rows += [(name, "".join(f"{mark}{line}\n" for line in notice.split("\n"))) for mark in ("# ", "// ", " * ", ";; ", "-- ", "    ", "dnl ")]
    rows += [("BSD-3-Clause", BSD_3.replace("the copyright holder nor", holder + " nor")) for holder in ("Google Inc.", "the University", "ACME, Ltd. of\n   Town")]
    rows += [("BSD-2-Clause", BSD_2.replace("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE AUTHOR")),
             ("GPL-3.0-or-later", GPL.replace("software:", "software;").replace("Foundation,", "Foundation;")), ("GPL-3.0-or-later", GPL.replace("This program", "Foo")),
             ("MIT,GPL-3.0-or-later", MIT + "\n\n" + GPL), ("Apache-2.0", APACHE.replace("\n\n", "\n")), ("Apache-2.0", re.sub(r"\s+", " ", APACHE).replace("http:", "https:"))]
    more = {"GPL-2.0-or-later": GPL_2, "LGPL-2.1-or-later": LGPL_21, "ISC": ISC, "MPL-2.0": MPL, "Zlib": ZLIB, "WTFPL": WTFPL, "EPL-2.0": EPL, "AGPL-3.0-or-later": AGPL,
            "LGPL-3.0-or-later": AGPL.replace("Affero", "Lesser"), "0BSD": ISC.replace(", provided", ".\n\nProvided")}
    rows += [(name, t) for name, notice in more.items() for t in (notice, unwrapped(notice), "/*\n * " + notice.replace("\n", "\n * ") + "\n */\nint x;")]
    # holders' names of any length
    rows += [("BSD-3-Clause", BSD_3.replace("the copyright holder nor", " ".join(f"Name{i}" for i in range(n)) + " nor")) for n in (13, 14, 20, 60)]
    # one-liners and SPDX lines
    rows += [("MIT", "// SPDX-License-Identifier: MIT\ncode"), ("Apache-2.0,MIT", "# SPDX-License-Identifier: (MIT OR Apache-2.0)\n"), ("LicenseRef-x".lower(), "SPDX-License-Identifier: LicenseRef-X"),
             ("GPL-2.0-only,BSD-3-Clause", "/* SPDX-License-Identifier: GPL-2.0-only AND BSD-3-Clause */"), ("ISC", "Distributed under the ISC license."), ("Zlib", "Note:\nLicensed under the zlib License\n")]
    rows += [(x, f"SPDX-License-Identifier: {x}") for x in licenses.IDENTIFIERS]
    # no whole sentence, or none that stands alone
    rows += [("", MIT.split(", including")[0]), ("", "We say: not " + re.sub(r"\s+", " ", APACHE.split(";")[0]) + " today"), ("", MIT.replace("\n", "\n\n"))]
    got = licenses.recognised(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")).collect()
    for r in got:
        name, text = rows[r["doc_id"]]
        assert set(r["licenses"]) == set(filter(None, name.split(","))), (name, text, r["sentence_ids"])
        assert r["n_sentences"] == brute_licenses(text)[0]
    assert len({n for n, _ in licenses.ALL_RULES} | set(licenses.IDENTIFIERS)) > 50
    # the DuckDB statement finds the same, in wrapped texts and under other names too
    import duckdb
    import pandas as pd
    from tradearea.llm.queries import ORACLES
    documents = pd.DataFrame({"doc_id": range(len(rows)), "text": [t for _, t in rows]})  # noqa: F841
    want = {r[0]: r[1:] for r in duckdb.sql(ORACLES["op2_licenses"]).fetchall()}
    for r in got:
        assert want[r["doc_id"]] == (r["n_sentences"], r["n_known"], ",".join(map(str, r["sentence_ids"])), ",".join(r["licenses"])), rows[r["doc_id"]]
