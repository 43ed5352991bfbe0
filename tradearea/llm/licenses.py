"""Licence recognition by sentences: known sentences become numbers, and rules are ordered lists of numbers.

A text is normalised (lower case, letters and digits, single blanks) and known sentences are searched that fill
the room between two sentence ends. A line feed is such an end, but a known sentence may also run over single line
feeds and the comment marks after them, so hard-wrapped notices are found like unwrapped ones. Sentences with a name
in them are known by their beginning and their end, which must follow each other with nothing known between
(`NAMED`); the name may be of any length. The numbers found, in order, are read by the rules from the first to the last: where a
rule's list stands without another known sentence between, the licence is recognised and its sentences are used up.
Longer rules stand before shorter ones, so a whole notice is not also reported as its parts. An SPDX line
is a rule over the identifiers in it.

All patterns are free of look-around, so that engines with automata read them too: the DuckDB statement uses the same ones.
One row per document is all it takes: a projection without shuffle, of built-in functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UNLESS = "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"
_COPY = "you may obtain a copy of the license at"
_REDISTRIBUTE = "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"
_LATER = "either version 3 of the license or at your option any later version"
_ENDORSE = "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_DISCLAIMED = "as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"

#: known sentences, normalised, whole up to the next mark; the number is the place in the list, from 1 on
SENTENCES: tuple[str, ...] = (
    "this work is licensed under the gnu general public license version 3",
    "licensed under cc by nc 4 0",
    "released under the mit license",
    "licensed under the apache license version 2 0",
    "licensed under the apache license version 2 0 the license",
    "you may not use this file except in compliance with the license",
    _COPY,
    _UNLESS,
    "see the license for the specific language governing permissions and limitations under the license",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "this program is free software",
    _REDISTRIBUTE,
    _LATER,
    "this program is distributed in the hope that it will be useful but without any warranty",
    "you should have received a copy of the gnu general public license along with this program",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    f"neither the name of the copyright holder {_ENDORSE}",
    f"this software is provided by the copyright holders and contributors {_DISCLAIMED}",
    "this work is licensed under a creative commons attribution 4 0 international license",
    "licensed under cc by 4 0",
    "licensed under cc by sa 4 0",
    "this is free and unencumbered software released into the public domain",
    "spdx license identifier mit",
    "spdx license identifier apache 2 0",
    "spdx license identifier gpl 3 0 or later",
    "all rights reserved",
    # the same notices with other marks, and with the address of the licence in the line
    f"{_REDISTRIBUTE} {_LATER}",
    f"{_COPY} http www apache org licenses license 2 0",
    f"{_COPY} https www apache org licenses license 2 0",
    f"{_COPY} http www apache org licenses license 2 0 {_UNLESS}",
    f"{_COPY} https www apache org licenses license 2 0 {_UNLESS}",
)

_REDIST = "you can redistribute it and or modify it under the terms of the"
_FSF = "as published by the free software foundation"
_ANY = "or at your option any later version"
_CC = "this work is licensed under a creative commons attribution"

#: sentences of further published notices, and the licence of each list of them, longer lists first
NOTICES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("GPL-2.0-or-later", ("this program is free software", f"{_REDIST} gnu general public license {_FSF}", f"either version 2 of the license {_ANY}")),
    ("GPL-2.0-or-later", (f"{_REDIST} gnu general public license {_FSF} either version 2 of the license {_ANY}",)),
    ("GPL-2.0-only", (f"{_REDIST} gnu general public license version 2 {_FSF}",)),
    ("LGPL-2.0-or-later", (f"{_REDIST} gnu library general public license {_FSF}", f"either version 2 of the license {_ANY}")),
    ("LGPL-2.1-or-later", (f"{_REDIST} gnu lesser general public license {_FSF}", f"either version 2 1 of the license {_ANY}")),
    ("LGPL-2.1-or-later", (f"{_REDIST} gnu lesser general public license {_FSF} either version 2 1 of the license {_ANY}",)),
    ("LGPL-3.0-or-later", (f"{_REDIST} gnu lesser general public license {_FSF}", f"either version 3 of the license {_ANY}")),
    ("LGPL-3.0-or-later", (f"{_REDIST} gnu lesser general public license {_FSF} either version 3 of the license {_ANY}",)),
    ("AGPL-3.0-or-later", (f"{_REDIST} gnu affero general public license {_FSF}", f"either version 3 of the license {_ANY}")),
    ("AGPL-3.0-or-later", (f"{_REDIST} gnu affero general public license {_FSF} either version 3 of the license {_ANY}",)),
    ("ISC", ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",)),
    ("ISC", ("permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",)),
    ("0BSD", ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",)),
    ("PostgreSQL", ("permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",)),
    ("HPND", ("permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted provided that the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation",)),
    ("MIT-0", ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",)),
    ("JSON", ("the software shall be used for good not evil",)),
    ("Zlib", ("this software is provided as is without any express or implied warranty", "in no event will the authors be held liable for any damages arising from the use of this software")),
    ("Zlib", ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",)),
    ("MPL-1.1", ("the contents of this file are subject to the mozilla public license version 1 1 the license",)),
    ("MPL-2.0", ("this source code form is subject to the terms of the mozilla public license v",)),
    ("MPL-2.0", ("this source code form is subject to the terms of the mozilla public license v 2 0",)),
    ("EPL-1.0", ("this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html",)),
    ("EPL-2.0", ("this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",)),
    ("BSL-1.0", ("distributed under the boost software license version 1 0",)),
    ("OFL-1.1", ("this font software is licensed under the sil open font license version 1 1",)),
    ("WTFPL", ("everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",)),
    ("CC0-1.0", ("to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",)),
    ("Artistic-1.0-Perl", ("you can redistribute it and or modify it under the same terms as perl itself",)),
    ("CDDL-1.0", ("the contents of this file are subject to the terms of the common development and distribution license the license",)),
    ("EUPL-1.2", ("licensed under the eupl version 1 2",)),
    ("CC-BY-SA-4.0", (f"{_CC} sharealike 4 0 international license",)),
    ("CC-BY-NC-4.0", (f"{_CC} noncommercial 4 0 international license",)),
    ("CC-BY-ND-4.0", (f"{_CC} noderivatives 4 0 international license",)),
    ("CC-BY-NC-SA-4.0", (f"{_CC} noncommercial sharealike 4 0 international license",)),
    ("CC-BY-NC-ND-4.0", (f"{_CC} noncommercial noderivatives 4 0 international license",)),
    ("CC-BY-ND-4.0", ("licensed under cc by nd 4 0",)),
    ("CC-BY-NC-SA-4.0", ("licensed under cc by nc sa 4 0",)),
    ("CC-BY-NC-ND-4.0", ("licensed under cc by nc nd 4 0",)),
)

#: names under which a one-line notice may call a licence; "<verb> under the <name> license"
CALLED: dict[str, str] = {
    "mit": "MIT", "isc": "ISC", "apache 2 0": "Apache-2.0", "bsd 2 clause": "BSD-2-Clause", "bsd 3 clause": "BSD-3-Clause", "mozilla public 2 0": "MPL-2.0",
    "zlib": "Zlib", "boost software": "BSL-1.0", "artistic 2 0": "Artistic-2.0", "gpl 2 0": "GPL-2.0-only", "gpl 3 0": "GPL-3.0-only", "lgpl 2 1": "LGPL-2.1-only",
    "lgpl 3 0": "LGPL-3.0-only", "agpl 3 0": "AGPL-3.0-only", "postgresql": "PostgreSQL", "python software foundation": "PSF-2.0", "ruby": "Ruby", "php": "PHP-3.01", "ncsa": "NCSA", "x11": "X11",
}
VERBS = ("licensed", "released", "distributed")

#: identifiers of SPDX lines, as they are written
IDENTIFIERS = (
    "0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-1.0-Perl Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 "
    "CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.2 GPL-2.0-only "
    "GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later HPND ISC JSON LGPL-2.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 "
    "MPL-1.1 MPL-2.0 MS-PL NCSA OFL-1.1 PHP-3.01 PSF-2.0 PostgreSQL Python-2.0 Ruby Unlicense Vim WTFPL X11 Zlib").split()

#: sentences with any name between a beginning and an end, and the number that they stand for
NAMED: dict[int, tuple[str, str]] = {21: ("neither the name of", _ENDORSE), 22: ("this software is provided by", _DISCLAIMED)}

#: licence and its sentences, in the order in which the rules are tried
RULES: tuple[tuple[str, tuple[int, ...]], ...] = (
    ("Apache-2.0", (5, 6, 7, 8, 9)),
    ("Apache-2.0", (5, 6, 32, 8, 9)),
    ("Apache-2.0", (5, 6, 33, 8, 9)),
    ("Apache-2.0", (5, 6, 34, 9)),
    ("Apache-2.0", (5, 6, 35, 9)),
    ("GPL-3.0-or-later", (13, 14, 15, 16, 17)),
    ("GPL-3.0-or-later", (13, 31, 16, 17)),
    ("BSD-3-Clause", (18, 19, 20, 21, 22)),
    ("BSD-2-Clause", (18, 19, 20, 22)),
    ("MIT", (10, 11, 12)),
    ("GPL-3.0-or-later", (13, 14, 15)),
    ("GPL-3.0-or-later", (13, 31)),
    ("MIT", (10, 11)),
    ("GPL-3.0-only", (1,)),
    ("CC-BY-NC-4.0", (2,)),
    ("MIT", (3,)),
    ("Apache-2.0", (4,)),
    ("Apache-2.0", (5,)),
    ("CC-BY-4.0", (23,)),
    ("CC-BY-4.0", (24,)),
    ("CC-BY-SA-4.0", (25,)),
    ("Unlicense", (26,)),
    ("MIT", (27,)),
    ("Apache-2.0", (28,)),
    ("GPL-3.0-or-later", (29,)),
    ("GPL-3.0-or-later", (31,)),
    ("All-Rights-Reserved", (30,)),
)

_MORE = tuple(dict.fromkeys(x for _, notice in NOTICES for x in notice if x not in SENTENCES))
_LINES = {f"{verb} under the {name} license": licence for verb in VERBS for name, licence in CALLED.items() if f"{verb} under the {name} license" not in SENTENCES}
#: all that may be found: SENTENCES, those of NOTICES, the one-liners, then beginnings and ends of NAMED
EVERY: tuple[str, ...] = (*SENTENCES, *_MORE, *(x for x in _LINES if x not in _MORE))
NUMBER = {sentence: i + 1 for i, sentence in enumerate(EVERY)}
#: longer lists go first, also over those of RULES
ALL_RULES: tuple[tuple[str, tuple[int, ...]], ...] = tuple(sorted(
    [*RULES, *((licence, tuple(NUMBER[x] for x in notice)) for licence, notice in NOTICES), *((licence, (NUMBER[x],)) for x, licence in _LINES.items())],
    key=lambda rule: -len(rule[1])))

#: a sentence ends at a line feed, or at one of these marks before white space or the end
MARKS = r"[.;:!?]+(?=[\x20\x09-\x0D]|$)"
ENDS = r"\n|" + MARKS
#: the normal form, step by step: H at a mark or an empty line, S at a single line feed, and no blanks beside them; whatever
#: stands before the first letter or digit of a line, comment marks above all, goes with the line feed
STEPS = ((r"(^|\n)[^a-z0-9\n]+", r"\1"), (r"(^|\n)(?:dnl|rem)[\x20\x09]+", r"\1"), (r"[.;:!?]+([\x20\x09-\x0D]|\z)", r"H\1"), (r"\n\n+", "H"), (r"\n", "S"),
         ("[^a-z0-9HS]+", " "), (" ?([HS]) ?", r"\1"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPDX = r"spdx-license-identifier:[\x20\x09]*([a-z0-9(][a-z0-9.+()-]*(?:[\x20\x09]+(?:or|and)[\x20\x09]+[a-z0-9(][a-z0-9.+()-]*)*)"
SPDX_SPLIT = r"[\x20\x09()]+(?:or[\x20\x09(]+|and[\x20\x09(]+)?|^\(+"


def sentences(text: Column) -> Column:
    """Normalised sentences of a text, without empty ones."""
    cleaned = F.transform(F.split(F.lower(text), ENDS, -1), lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")))
    return F.filter(cleaned, lambda s: s != "")


def marked(text: Column) -> Column:
    """The normal form of a text, with H and S doubled so that each of two neighbours has an end of its own.

    No upper-case letter is left of the text itself; only A-Z have a lower case here.
    """
    out = F.translate(text, UPPER, LOWER)
    for pattern, put in STEPS:
        out = F.regexp_replace(out, pattern, put.replace("\\1", "$1"))
    return F.concat(F.lit("H"), F.replace(F.replace(F.trim(out), F.lit("H"), F.lit("HH")), F.lit("S"), F.lit("SS")), F.lit("H"))


def pattern(sentences_: Sequence[str]) -> str:
    """Known sentences between two ends; of named ones the beginning and the end."""
    gap = "(?: |SS)"
    whole = sorted((x for x in sentences_ if x not in {sentences_[n - 1] for n in NAMED if n <= len(sentences_)}), key=len, reverse=True)
    listed = [x.replace(" ", gap) for x in whole]
    begins, ends = ([x.replace(" ", gap) for x in side] for side in zip(*NAMED.values()))
    return f"[HS](?:{'|'.join(listed)})[HS]|[HS](?:{'|'.join(begins)})(?: |S)|(?: |[HS])(?:{'|'.join(ends)})[HS]"


def numbers_of(sentences_: Sequence[str]) -> dict[str, int]:
    """The number of each thing that may be found; beginnings and ends of named sentences come last."""
    out = {x: i + 1 for i, x in enumerate(sentences_)}
    for pair in NAMED.values():
        for x in pair:
            out[x] = len(out) + 1
    return out


def signs(sentences_: Sequence[str]) -> list[str]:
    """Few words, of which each sentence holds at least one."""
    left, found = {*sentences_, *(f"{a} {b}" for a, b in NAMED.values())}, []
    while left:
        words = sorted({w for s in left for w in s.split(" ")})
        found.append(max(words, key=lambda w: (sum(w in s.split(" ") for s in left) * (len(w) > 5), len(w))))
        left = {s for s in left if found[-1] not in s.split(" ")}
    return found


def known(text: Column, sentences_: Sequence[str] = EVERY) -> Column:
    """The numbers of the known sentences of a text, in order, as text (' 5  6 '); of several from one place the longest."""
    numbers = numbers_of(sentences_)
    names = F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair])
    # a text without any of the words that sentences are made of needs no search
    may = F.translate(text, UPPER, LOWER).rlike("|".join(signs(sentences_)))
    found = F.when(may, F.regexp_extract_all(marked(text), F.lit(pattern(sentences_)), F.lit(0))).otherwise(F.array().cast("array<string>"))
    out = as_text(F.transform(found, lambda x: F.element_at(names, F.trim(F.regexp_replace(x, "[HS ]+", " ")))))
    for n, (a, b) in NAMED.items():
        out = F.replace(out, F.lit(rule_text((numbers[a], numbers[b]))), F.lit(rule_text((n,))))
    for pair in NAMED.values():  # a beginning or an end alone says nothing
        for x in pair:
            out = F.replace(out, F.lit(rule_text((numbers[x],))), F.lit(""))
    return out


def spdx(text: Column) -> Column:
    """The licences that SPDX lines name, in order, each once; identifiers that are not known as they stand, in lower case."""
    spelled = F.create_map(*[F.lit(x) for name in IDENTIFIERS for x in (name.lower(), name)])
    lines = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(SPDX), F.lit(1))
    names = F.filter(F.flatten(F.transform(lines, lambda x: F.split(x, SPDX_SPLIT))), lambda x: x != "")
    return F.array_distinct(F.transform(names, lambda x: F.coalesce(F.try_element_at(spelled, x), x)))


def as_text(numbers: Column) -> Column:
    """Numbers as ' 5  6  7 ', each with a blank on either side."""
    return F.array_join(F.transform(numbers, lambda n: F.concat(F.lit(" "), n.cast("string"), F.lit(" "))), "")


def rule_text(rule: Sequence[int]) -> str:
    return "".join(f" {n} " for n in rule)


def recognised(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Sequence[tuple[str, Sequence[int]]] = ALL_RULES,
               sentences_: Sequence[str] = EVERY) -> DataFrame:
    """One row per row of docs: key, n_sentences, n_known, sentence_ids, matches (rule number, licence, times), spdx, licenses.

    `licenses` are the distinct names, those of the rules in their order, then those of SPDX lines. n_sentences counts each line of
    a wrapped sentence. Null and empty texts have no sentences, texts of any length are read whole. Rows that
    repeat a document are answered row by row; other columns are passed over, an empty table gives no rows.
    """
    source = F.coalesce(F.col(text), F.lit(""))
    out = docs.select(F.col(key), F.size(sentences(source)).cast("bigint").alias("n_sentences"), known(source, sentences_).alias("_left"), spdx(source).alias("spdx"))
    ids = F.transform(F.filter(F.split("_left", " +"), lambda x: x != ""), lambda x: x.cast("int"))
    out = out.withColumn("sentence_ids", ids).withColumn("n_known", F.size("sentence_ids").cast("bigint"))
    # a rule after the other: what a rule has used up becomes a bar, so that later rules can't reach across it
    tried = F.array(*[F.struct(F.lit(i + 1).alias("rule"), F.lit(name).alias("license"), F.lit(rule_text(rule)).alias("wanted")) for i, (name, rule) in enumerate(rules)])
    none = F.array().cast("array<struct<rule:int,license:string,times:bigint>>")

    def use(state: Column, rule: Column) -> Column:
        after = F.replace(state["left"], rule["wanted"], F.lit("|"))
        times = ((F.length(state["left"]) - F.length(after)) / F.greatest(F.length(rule["wanted"]) - 1, F.lit(1))).cast("bigint")
        hit = F.struct(rule["rule"].alias("rule"), rule["license"].alias("license"), times.alias("times"))
        return F.struct(after.alias("left"), F.when(times > 0, F.concat(state["hits"], F.array(hit))).otherwise(state["hits"]).alias("hits"))

    matches = F.when(F.col("n_known") > 0, F.aggregate(tried, F.struct(F.col("_left").alias("left"), none.alias("hits")), use)["hits"]).otherwise(none)
    return out.withColumn("matches", matches).withColumn(
        "licenses", F.array_distinct(F.concat(F.transform("matches", lambda m: m["license"]), F.col("spdx")))).drop("_left")
