"""Licence recognition by sentence rules, in DataFrame functions alone.

A text is prepared as licences are shipped: comment leaders and list numbers at line starts go, copyright and title
lines stand by themselves, a colon before a list ends a sentence, a full stop after Inc., Ltd. and the like does not.
It is then cut into sentences at . ! ? before white space and at blank lines; single line breaks within are white space,
so wrapped texts count. A sentence is normalised (lower case, every run of other characters than a-z and 0-9 one blank;
holders' names, subjects and the ways to say "licensed under" become one form each) and looked up among the known
sentences, a fixed table; where the whole is unknown, its lines are looked up. What is found are identifiers in text
order, with ``?`` for each sentence that is not known. Copyright lines, "all rights reserved", titles, numbers and empty
pieces are left out.

The sequence is matched against the licence rules in their order: a rule is a sequence of identifiers that must follow
one another, an unknown sentence breaks it, and what a rule matches is used up, so that a longer rule takes precedence.
A rule may ask for the end of the text (``$``): two-clause BSD needs its disclaimer or the end after its clauses, so a
text with one more clause, known or not, is never called by that name. What the rules leave is named by sentences that
stand for a licence alone. A grant that is followed by a sentence that is not known, at once or after sentences of its
own licence, is no such name: the text is an "unknown variant of" that licence (a grant with one more condition, say).
All of it happens within a row: nothing is shuffled.

Defined results: null and empty texts have no sentences; a licence that occurs twice is named once; documents
without known sentences get empty lists; repeated documents each get their row; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.llm.common import ASCII_LOWER, ASCII_UPPER, ascii_lower

# Public licence sentences.
SENTENCES = {
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-notice-2": "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "apache-grant": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-copy-s": "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0",
    "apache-copy-at": "You may obtain a copy of the License at",
    "apache-url": "http://www.apache.org/licenses/LICENSE-2.0",
    "apache-url-s": "https://www.apache.org/licenses/LICENSE-2.0",
    "apache-warranty": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-limits": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-details": "See the GNU General Public License for more details.",
    "lgpl-details": "See the GNU Lesser General Public License for more details.",
    "agpl-details": "See the GNU Affero General Public License for more details.",
    "mpl2-grant": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "mpl2-copy-http": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "epl2-grant": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "epl1-grant": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-advert": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "bsd-includes": "This product includes software developed by HOLDER",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-provided": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "bsd-liability": "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-grant-2": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "isc-warranty": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "isc-liability": "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "zlib-warranty": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-liability": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "bsl-grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "bsl-line": "Distributed under the Boost Software License, Version 1.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc0-line": "This work is dedicated to the public domain under CC0 1.0.",
    "cc0-waived": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
}

# Licences that a line can name, by the names it can give them after "licensed under".
NAMES = {
    "MIT": ["MIT License", "MIT Licence", "MIT"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0", "Apache License v2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "BSD-2-Clause", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD-3-Clause", "3-Clause BSD License", "New BSD License"],
    "ISC": ["ISC License", "ISC"],
    "MPL-2.0": ["Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "MPL-2.0", "MPL 2.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License - v 2.0", "EPL-2.0"],
    "EPL-1.0": ["Eclipse Public License 1.0", "Eclipse Public License - v 1.0", "EPL-1.0"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0", "BSL-1.0"],
    "Zlib": ["zlib License", "zlib/libpng License"],
    "Artistic-2.0": ["Artistic License 2.0", "Artistic-2.0"],
    "Unlicense": ["Unlicense"],
    "WTFPL": ["WTFPL", "Do What The Fuck You Want To Public License, Version 2"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal", "CC0-1.0"],
}

# The GNU licences by name and version, the Creative Commons licences by their parts and versions.
GNU = {"GPL": ("GNU General Public License", ["2", "3"]), "LGPL": ("GNU Lesser General Public License", ["2.1", "3"]), "AGPL": ("GNU Affero General Public License", ["3"])}
CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
CC_VERSIONS = ["2.0", "2.5", "3.0", "4.0"]

# Licence rules of several sentences, the most specific first; ``$`` is the end of the text.
_BSD = ["bsd-grant", "bsd-source", "bsd-binary"]
_BSD_END = ["bsd-provided", "bsd-liability"]
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-notice-2", "mit-warranty", "mit-liability"]),
    ("BSD-4-Clause", [*_BSD, "bsd-advert", "bsd-includes", "bsd-endorse", *_BSD_END]),
    ("BSD-3-Clause", [*_BSD, "bsd-endorse", *_BSD_END]),
    ("BSD-3-Clause", [*_BSD, "bsd-endorse"]),
    ("BSD-2-Clause", [*_BSD, *_BSD_END]),
    ("BSD-2-Clause", [*_BSD, "bsd-provided"]),
    ("BSD-2-Clause", [*_BSD, "$"]),
    ("Apache-2.0", ["apache-grant", "apache-copy", "apache-warranty", "apache-limits"]),
    ("Apache-2.0", ["apache-grant", "apache-copy-s", "apache-warranty", "apache-limits"]),
    ("Apache-2.0", ["apache-grant", "apache-copy-at", "apache-url", "apache-warranty", "apache-limits"]),
    ("Apache-2.0", ["apache-grant", "apache-copy-at", "apache-url-s", "apache-warranty", "apache-limits"]),
    ("ISC", ["isc-grant", "isc-warranty", "isc-liability"]),
    ("ISC", ["isc-grant-2", "isc-warranty", "isc-liability"]),
    ("0BSD", ["0bsd-grant", "isc-warranty", "isc-liability"]),
    ("Zlib", ["zlib-warranty", "zlib-liability", "zlib-grant"]),
    ("MPL-2.0", ["mpl2-grant", "mpl2-copy"]),
    ("MPL-2.0", ["mpl2-grant", "mpl2-copy-http"]),
]

# Sentences that name a licence by themselves.
ALONE = {"mit-grant": "MIT", "apache-grant": "Apache-2.0", "isc-grant": "ISC", "isc-grant-2": "ISC", "0bsd-grant": "0BSD", "zlib-grant": "Zlib", "bsl-grant": "BSL-1.0", "bsl-line": "BSL-1.0", "unlicense": "Unlicense", "cc0-line": "CC0-1.0", "cc0-waived": "CC0-1.0", "mpl2-grant": "MPL-2.0", "epl2-grant": "EPL-2.0", "epl1-grant": "EPL-1.0"}

# Grants that name a licence only where no stranger stands between them and the sentences that belong to them.
GRANTS = {
    "MIT": (["mit-grant"], ["mit-notice", "mit-notice-2", "mit-warranty", "mit-liability"]),
    "ISC": (["isc-grant", "isc-grant-2"], ["isc-warranty", "isc-liability"]),
    "0BSD": (["0bsd-grant"], ["isc-warranty", "isc-liability"]),
    "Zlib": (["zlib-grant"], ["zlib-warranty", "zlib-liability"]),
    "BSL-1.0": (["bsl-grant"], ["mit-warranty", "mit-liability"]),
}
#: The same as (pattern, replacement) on the joined identifiers: a grant, its own sentences, a sentence that is not known.
VARIANTS = [(f",(?:{'|'.join(grants)}),(?:,(?:{'|'.join(own)}),)*,[?],", f",variant-{name},") for name, (grants, own) in GRANTS.items()]

#: Every known sentence holds one of these (single words, as texts may be wrapped anywhere), so other texts need no closer look.
ANCHORS = ["licen", "permission", "redistribut", "domain", "warrant", "liable", "endorse", "advertising", "developed", "apache", "mpl", "released", "distributed", "available", "published", "provided", "spdx"]

# How a text is prepared: (pattern, replacement), written so that Java's and RE2's expressions agree; ^ and $ are line ends.
PREPARE = [
    (r"^[ \t]*(?:/\*+|\*+/|//+|\*+|#+|--+|;+|%+|<!--|dnl |rem |REM )*[ \t]*", ""),
    (r"[ \t]*(?:\*+/|-->)[ \t\r]*$", ""),
    (r"^(?:\(?[0-9][0-9]?[.)]|\(?[a-zA-Z][.)]|[o\-*])[ \t]+", ""),
    (r"\b(Inc|Ltd|Corp|Co|LLC|GmbH|[vV])\.([ \t\r\n])", r"\1\2"),
    (r"^((?:Copyright|COPYRIGHT|\([Cc]\)|©)[^\n]*|[Aa]ll [Rr]ights [Rr]eserved\.?[ \t\r]*)$", "\n\\1\n\n"),
    (r"^((?:[Tt]he |THE )?[A-Za-z0-9][A-Za-z0-9 .\-]* (?:[Ll]icen[sc]e|LICENSE)(?: \([^)\n]*\))?[ \t\r]*)$", "\n\\1\n\n"),
    (r"(conditions are met|following conditions|following restrictions|[Aa]cknowledge?ment|to the following):", r"\1."),
    (r":[ \t\r]*\n", ".\n\n"),
    (r":[ \t\r]+\(?(?:[0-9]|[a-z]|[*o\-])[.)]?[ \t]+", ". "),
]
CUT = "[.!?]+[\"')\\]]*[ \\t\\r\\n]+|\\n[ \\t\\r]*\\n"

# How a normalised sentence is unified: (pattern, replacement).
UNIFY = [
    (r"^neither the names? of .{1,120} nor the names? of (?:its|their|his|her|any) contributors may ", "neither the name of the copyright holder nor the names of its contributors may "),
    (r"^this software is provided by .{1,120} as is and any express ", "this software is provided by the copyright holders and contributors as is and any express "),
    (r"^in no event shall .{1,120} be liable for any direct indirect ", "in no event shall the copyright holder or contributors be liable for any direct indirect "),
    (r"^this product includes software developed by .*$", "this product includes software developed by holder"),
    (r"^(?:this|the) (?:program|library|software|file|package|project|code|work|module|script) is free software ", "this program is free software "),
    (r"^(?:this|the) (?:program|library|software|file|package|project|code|work|module|script) is distributed in the hope ", "this program is distributed in the hope "),
    (r"^[a-z0-9]+ is free software ", "this program is free software "),
    (r"^(?:(?:this|the) (?:project|work|software|file|program|code|source code|library|repository|material|package|document|text) is )?(?:released|licensed|licenced|distributed|available|published|provided|made available) under (?:the terms of )?(?:the |an? )?", "under "),
]
#: Pieces that neither count nor break a sequence.
SKIPPED = r"^(?:[0-9a-z]?|[0-9]+|copyright .*|c [0-9]{4}.*|all rights reserved.*|(?:the )?[a-z0-9 ]{1,40} licen[sc]e(?: mit| version [0-9 ]+)?)$"


def normalise(sentence: str) -> str:
    """What :func:`normalised` makes of an ASCII sentence."""
    out = re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()
    for pattern, by in UNIFY:
        out = re.sub(pattern, by, out)
    return out


def normalised(sentence: Column) -> Column:
    out = F.trim(F.regexp_replace(ascii_lower(sentence), "[^a-z0-9]+", " "))
    for pattern, by in UNIFY:
        out = F.regexp_replace(out, pattern, by)
    return out


def known_sentences() -> tuple[dict[str, str], dict[str, str]]:
    """(identifier by normalised sentence, licence by identifier of those that name one alone)."""
    ids = {normalise(re.sub(r"\bv\. ", "v ", s)): k for k, s in SENTENCES.items()}
    alone = ALONE | {f"variant-{name}": f"unknown variant of {name}" for name in GRANTS}

    def line(sid: str, license_name: str, *sentences: str) -> None:
        for s in sentences:
            ids.setdefault(normalise(s), sid)
        alone[sid] = license_name

    for name, titles in NAMES.items():
        line(f"under-{name}", name, *[f"Licensed under the {re.sub(r'v[.] ', 'v ', t)}" for t in titles])
        line(f"spdx-{name}", name, f"SPDX-License-Identifier: {name}")
    for short, (title, versions) in GNU.items():
        for v in versions:
            full = v if "." in v else f"{v}.0"
            grant = f"This program is free software: you can redistribute it and/or modify it under the terms of the {title}"
            by = "as published by the Free Software Foundation"
            later, only = f"{short}-{full}-or-later", f"{short}-{full}-only"
            line(f"grant-{later}", later, f"{grant} {by}, either version {v} of the License, or (at your option) any later version.", f"{grant} {by}; either version {v}, or (at your option) any later version.", f"Licensed under the {title}, version {v} or later", f"Licensed under the {title} v{full} or later")
            line(f"grant-{only}", only, f"{grant} {by}, version {v} of the License.", f"{grant} {by}; version {v}.", f"{grant} version {v} {by}.", f"{grant}, version {v}, {by}.", f"Licensed under the {title}, version {v}.", f"Licensed under the {title} v{full}.", f"Licensed under the {title} version {full}", f"Licensed under the {short} v{v}", f"Licensed under {short}-{full}")
            line(f"spdx-{later}", later, f"SPDX-License-Identifier: {later}", f"SPDX-License-Identifier: {short}-{full}+")
            line(f"spdx-{only}", only, f"SPDX-License-Identifier: {only}", f"SPDX-License-Identifier: {short}-{full}")
    for short, title in CC.items():
        for v in CC_VERSIONS:
            name = f"CC-{short}-{v}"
            words = title.replace("-", " ")
            kinds = ["International", "Unported", "Generic", ""]
            line(f"under-{name}", name, f"Licensed under CC {short} {v}.", f"Licensed under the CC {short} {v} License", *[f"Licensed under a Creative Commons {x} {v} {k} License." for x in (title, words) for k in kinds])
            line(f"spdx-{name}", name, f"SPDX-License-Identifier: {name}")
    return ids, alone


SPDX = "spdx license identifier "
#: In a normalised expression: what must not be taken for an operator, and the operators.
OR_LATER, OPERATORS = (" or later", " or_later"), " (?:or|and|with) "


def _expression(norm: Column, table: Column) -> Column:
    """The identifiers that a normalised SPDX expression names, ``?`` for those that are not known, joined by ``,,``."""
    parts = F.split(F.replace(F.substring(norm, len(SPDX) + 1, 1 << 30), F.lit(OR_LATER[0]), F.lit(OR_LATER[1])), OPERATORS)
    ids = F.transform(parts, lambda p: F.coalesce(F.try_element_at(table, F.concat(F.lit(SPDX), F.replace(p, F.lit(OR_LATER[1]), F.lit(OR_LATER[0])))), F.lit("?")))
    return F.array_join(ids, ",,")


def _prepared(text: Column) -> Column:
    for pattern, by in PREPARE:
        text = F.regexp_replace(text, "(?md)" + pattern, re.sub(r"\\(\d)", r"$\1", by))
    return text


def identifiers(text: Column) -> Column:
    """The known sentences' identifiers in text order, ``?`` for others, and ``$`` at the end."""
    ids, _ = known_sentences()
    table = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])
    # A piece's normal form is computed once: an element of an array that a lambda walks over.
    name = lambda norm: F.coalesce(F.try_element_at(table, norm), F.when(norm.rlike(SKIPPED), F.lit("")).otherwise(F.lit("?")))
    named = lambda pieces: F.transform(F.transform(pieces, normalised), name)
    # An expression of several identifiers is one line.
    spelled = lambda norm: F.when(norm.startswith(SPDX) & F.try_element_at(table, norm).isNull(), _expression(norm, table)).otherwise(name(norm))
    lines = lambda piece: F.transform(F.transform(F.split(piece, "\n"), normalised), spelled)
    pieces = F.split(_prepared(text), CUT)
    whole = F.arrays_zip(pieces.alias("piece"), named(pieces).alias("id"))
    closer = lambda p: (p["id"] == "?") & (F.contains(p["piece"], F.lit("\n")) | p["piece"].rlike("(?i)spdx"))
    found = F.flatten(F.transform(whole, lambda p: F.when(closer(p), lines(p["piece"])).otherwise(F.array(p["id"]))))
    found = F.flatten(F.transform(found, lambda x: F.split(x, ",,")))
    return F.concat(F.filter(found, lambda x: x != ""), F.array(F.lit("$")))


def match_rules(seq: Column, rules: list[tuple[str, list[str]]], alone: dict[str, str]) -> Column:
    """The names of the licences in the identifiers ``seq`` (",a,,b,"), sorted and distinct."""
    table = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("," + ",,".join(ids) + ",").alias("ids")) for name, ids in rules])
    start = F.struct(seq.alias("seq"), F.array().cast("array<string>").alias("found"))
    step = lambda acc, r: F.when(
        F.contains(acc["seq"], r["ids"]), F.struct(F.replace(acc["seq"], r["ids"], F.lit(",*,")).alias("seq"), F.array_append(acc["found"], r["name"]).alias("found"))
    ).otherwise(acc)
    names = F.create_map(*[F.lit(x) for pair in alone.items() for x in pair])

    def left(seq: Column) -> Column:
        for pattern, by in VARIANTS:
            seq = F.regexp_replace(seq, pattern, by)
        return seq

    rest = lambda acc: F.concat(acc["found"], F.filter(F.transform(F.split(left(acc["seq"]), ","), lambda x: F.try_element_at(names, x)), lambda x: x.isNotNull()))
    return F.array_sort(F.array_distinct(F.aggregate(table, start, step, rest)))


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """One row per document: id, sentence_ids (in text order) and licenses."""
    text = F.col(text_col)
    low = ascii_lower(text)
    worth = F.lit(False)
    for anchor in ANCHORS:
        worth = worth | F.contains(low, F.lit(anchor))
    none = F.array().cast("array<string>")
    rows = docs.select(F.col(id_col).alias("id"), F.when(F.coalesce(worth, F.lit(False)), identifiers(text)).alias("seq"))
    known = F.filter("seq", lambda x: ~x.isin("?", "$"))
    found = F.when(F.col("seq").isNotNull() & (F.size(known) > 0), match_rules(F.concat(F.lit(","), F.array_join("seq", ",,"), F.lit(",")), rules or RULES, known_sentences()[1]))
    return rows.select(F.col("id").alias(id_col), F.coalesce(known, none).alias("sentence_ids"), F.coalesce(found, none).alias("licenses"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(id_col, F.size("sentence_ids").cast("long").alias("n_known"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"), (F.size("licenses") > 0).alias("has_license"))


def oracle_sql() -> str:
    ids, alone = known_sentences()
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    sql_map = lambda m: f"map([{', '.join(quoted(k) for k in m)}], [{', '.join(quoted(v) for v in m.values())}])"
    text = "coalesce(text, '')"
    for pattern, by in PREPARE:
        text = f"regexp_replace({text}, {quoted('(?m)' + pattern)}, {quoted(by)}, 'g')"

    def norm(x: str) -> str:
        out = f"trim(regexp_replace(translate({x}, '{ASCII_UPPER}', '{ASCII_LOWER}'), '[^a-z0-9]+', ' ', 'g'))"
        for pattern, by in UNIFY:
            out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(by)}, 'g')"
        return out

    fold = "SELECT doc_id, l, ',' || array_to_string(l, ',,') || ',' AS seq, '' AS found FROM s"
    for name, seq in RULES:
        pat = "," + ",,".join(seq) + ","
        fold = f"SELECT doc_id, l, CASE WHEN contains(seq, '{pat}') THEN replace(seq, '{pat}', ',*,') ELSE seq END AS seq, CASE WHEN contains(seq, '{pat}') THEN found || '{name},' ELSE found END AS found FROM ({fold})"
    left = "seq"
    for pattern, by in VARIANTS:
        left = f"regexp_replace({left}, {quoted(pattern)}, {quoted(by)}, 'g')"
    spdx = sql_map({k: v for k, v in ids.items() if k.startswith(SPDX)})
    parts = f"string_split_regex(replace(substr(norm, {len(SPDX) + 1}), '{OR_LATER[0]}', '{OR_LATER[1]}'), '{OPERATORS}')"
    expression = f"array_to_string(list_transform({parts}, lambda p: coalesce({spdx}['{SPDX}' || replace(p, '{OR_LATER[1]}', '{OR_LATER[0]}')], '?')), ',,')"
    named = lambda x: f"coalesce(i.id, CASE WHEN regexp_matches({x}, {quoted(SKIPPED)}) THEN '' ELSE '?' END)"
    return f"""
WITH i AS (SELECT unnest(map_keys(m)) AS k, unnest(map_values(m)) AS id FROM (SELECT {sql_map(ids)} AS m)),
a AS (SELECT unnest(map_keys(m)) AS k, unnest(map_values(m)) AS name FROM (SELECT {sql_map(alone)} AS m)),
p AS (SELECT doc_id, unnest(c) AS piece, generate_subscripts(c, 1) AS pos FROM (SELECT doc_id, string_split_regex({text}, {quoted(CUT)}) AS c FROM documents)),
n AS (SELECT doc_id, pos, 0 AS ln, piece, {norm("piece")} AS norm FROM p),
w AS (SELECT doc_id, pos, ln, piece, CASE WHEN i.id IS NULL AND starts_with(norm, '{SPDX}') AND NOT contains(piece, chr(10)) THEN {expression} ELSE {named("norm")} END AS id FROM n LEFT JOIN i ON i.k = norm),
x AS (SELECT doc_id, pos, unnest(c) AS line, generate_subscripts(c, 1) AS ln FROM (SELECT doc_id, pos, string_split(piece, chr(10)) AS c FROM w WHERE id = '?' AND contains(piece, chr(10)))),
y AS (SELECT doc_id, pos, ln, {norm("line")} AS norm FROM x),
z AS (SELECT doc_id, pos, ln, CASE WHEN i.id IS NULL AND starts_with(norm, '{SPDX}') THEN {expression} ELSE {named("norm")} END AS id FROM y LEFT JOIN i ON i.k = norm),
q AS (SELECT doc_id, pos, ln, id FROM w WHERE NOT (id = '?' AND contains(piece, chr(10))) UNION ALL SELECT doc_id, pos, ln, id FROM z),
s AS (SELECT doc_id, list_append(flatten(list_transform(coalesce(list(id ORDER BY pos, ln) FILTER (WHERE id <> ''), []), lambda t: string_split(t, ',,'))), '$') AS l FROM q GROUP BY doc_id),
f AS ({fold}),
r AS (SELECT doc_id, l, list_concat(string_split(found, ','), list_transform(string_split({left}, ','), lambda t: {sql_map(alone)}[t])) AS names FROM f),
o AS (SELECT doc_id, list_filter(l, lambda t: t <> '?' AND t <> '$') AS known, list_sort(list_distinct(list_filter(names, lambda t: t IS NOT NULL AND t <> ''))) AS licenses FROM r)
SELECT d.doc_id, CAST(coalesce(len(known), 0) AS BIGINT) AS n_known, coalesce(array_to_string(known, ','), '') AS sentence_ids, coalesce(array_to_string(licenses, ','), '') AS licenses, coalesce(len(licenses), 0) > 0 AS has_license
FROM documents d LEFT JOIN o ON o.doc_id = d.doc_id
"""
