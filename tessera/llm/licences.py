"""Licence scans: canonical digests of whole texts and lines, joined with digests of known licences."""

from __future__ import annotations

import re
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._shared import row_id, table

# Public licence texts and notices, by SPDX identifier.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
ZERO_BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
WTFPL = """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION
0. You just DO WHAT THE FUCK YOU WANT TO."""
KNOWN = [
    ("MIT", MIT), ("MIT", "The MIT License (MIT)\n" + MIT), ("MIT", "MIT License\n" + MIT),
    ("ISC", ISC), ("ISC", "ISC License\n" + ISC), ("0BSD", ZERO_BSD), ("Zlib", ZLIB), ("WTFPL", WTFPL),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."), ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
]
# Standard headers, and lines that start one or state a licence.
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at
{}://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at {}://mozilla.org/MPL/2.0/."""
GPL_HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <{}://www.gnu.org/licenses/>."""
HEADERS = [(licence, text.format(scheme)) for licence, text in (("Apache-2.0", APACHE_HEADER), ("MPL-2.0", MPL_HEADER), ("GPL-3.0", GPL_HEADER)) for scheme in ("http", "https")]
HEADERS += [("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");')]
HEADERS += [(i, f"{verb} under the {name}.") for i, name in (("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("BSL-1.0", "Boost Software License, Version 1.0"), ("MPL-2.0", "Mozilla Public License, Version 2.0")) for verb in ("Released", "Licensed")]
HEADERS += [(i, f"SPDX-License-Identifier: {i}{end}") for i in ("LGPL-2.1", "LGPL-3.0", "GPL-2.0", "GPL-3.0") for end in ("", "-only", "-or-later")]
HEADERS += [(i, f"SPDX-License-Identifier: {i}") for i in ("BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "ISC", "MPL-2.0", "Unlicense", "Zlib", "0BSD")]
#: What may stand above a text that does not name itself.
TITLES = {"BSD-2-Clause": ("BSD 2-Clause License", 'BSD 2-Clause "Simplified" License'), "BSD-3-Clause": ("BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License')}


@cache
def full_texts() -> list[tuple[str, str]]:
    """Whole licences from the folder beside this module, with and without their appendix, title and clause numbers."""
    found = []
    for path in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")):
        text, licence = path.read_text(encoding="utf-8"), path.stem.removesuffix(".regents")
        forms = [text]
        if licence.startswith("BSD-"):
            forms.append(re.sub(r"(?m)^\s*\d\.\s", "", text))
            forms += [f"{title}\n{form}" for form in forms[:2] for title in TITLES[licence]]
        elif m := re.search(r"END OF TERMS AND CONDITIONS", text):
            forms += [text[: m.start()], text[: m.end()]]
        found += [(licence, form) for form in forms]
    return found


# Spellings that count as one, after lower-casing.
SPELLINGS = [("licence", "license"), ("organisation", "organization"), ("non-commercial", "noncommercial"), ("sub-license", "sublicense"), ("©", "(c)"), ("&", " and ")]
# Fixed value: lines that only name a holder, or reserve all rights.
HOLDER = r"(?m)^[^a-z0-9\n]*(copyright|\(c\)|all rights reserved)[^\n]*$"
# Where a statement starts that stays when its line names a holder, and words that show that none is named.
_STATES = r"\b(?:(?:re)?licensed|released|distributed|available|published|provided) under\b|\bspdx-license-identifier\b|\bpermission (?:is|to)\b|\bthis (?:work|file|software|program|project|code|source) is\b"
_PROSE = r"(?:you|your|the|if|a|an|any|all|in|on|to|use|for|that|this|of|as|is|are|or|and|by the|notices?|holders?|owners?|laws?|licenses?|licensed|rights|act|interests?|statements?|disclaimers?|infringement|treaty|permission|prominent|such|conveying|redistribution|accompany|each|where|under|may|must|shall|will|not|no|with|from)\b"
#: A holder's part of a line: to its end, or to a statement of the licence.
HOLDER_PART = rf"(?m)^[^a-z0-9\n]*(?:(?:copyright\s*\(c\)|\(c\)\s*copyright|copyright\b|\(c\))(?![^\S\n]*{_PROSE})(?![^\S\n]*[,.;)\n])(?![^\S\n]*$)|all rights reserved)(?:(?!{_STATES})[^\n])*"
_MARKS = r"[^\p{L}\p{N}\n]+"


def canonical_lines(text: Column) -> Column:
    """Lower case, one spelling, no holders of copyright, words and numbers apart by single spaces; line breaks stay."""
    text = F.lower(F.coalesce(text, F.lit("")))
    for old, new in SPELLINGS:
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.regexp_replace(F.regexp_replace(text, HOLDER_PART, ""), _MARKS, " ")


def _digest(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def whole(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """``licence, digest`` of the list in the program, its headers and the folder of whole texts, or of ``known``."""
    rows = spark.createDataFrame(KNOWN + HEADERS + full_texts() if known is None else known, "licence string, known string")
    return rows.select("licence", whole(canonical_lines(F.col("known"))).alias("form")).where("form <> ''").select("licence", _digest(F.col("form")).alias("digest")).dropDuplicates(["digest"])


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_id, text_licence, line_licences`` for every row of ``docs``.

    ``text_licence`` is the licence that the entire text is; ``line_licences`` the sorted licences that a line of it
    states. Digests of the canonical text (position 0) and of each different line are hash-joined with ``known``, which
    has a row per licence text or notice of a list in the program and so is small enough to broadcast; only matches
    and one row per document are then gathered. Null and empty texts, and those that are only punctuation or
    copyright lines, match nothing; repeated rows match alike; no rows, no result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), row_id(F.col(text_col)).alias("text_id"), canonical_lines(F.col(text_col)).alias("form"))
    lines = F.array_distinct(F.transform(F.filter(F.transform(F.split("form", "\n"), lambda x: F.trim(x)), lambda x: x != ""), _digest))
    rows = rows.select("doc_id", "text_id", F.posexplode(F.concat(F.array(_digest(whole(F.col("form")))), lines)).alias("place", "digest"))
    rows = rows.join(F.broadcast(known), "digest", "left").where("place = 0 or licence is not null")
    text_licence = F.max(F.when(F.col("place") == 0, F.col("licence")))
    line_licences = F.sort_array(F.collect_set(F.when(F.col("place") > 0, F.col("licence"))))
    found = rows.groupBy("doc_id", "text_id").agg(text_licence.alias("text_licence"), line_licences.alias("line_licences"), F.count_if(F.col("place") == 0).cast("int").alias("copies"))
    return found.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).drop("copy", "copies")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), known_digests(spark))
    return found.select("doc_id", "text_licence", F.array_join("line_licences", ",").alias("line_licences"))


def _sql_lines(text: str) -> str:
    text = f"lower(coalesce({text}, ''))"
    for old, new in SPELLINGS:
        text = f"replace({text}, '{old}', '{new}')"
    return f"regexp_replace(regexp_replace({text}, '{HOLDER}', '', 'g'), '{_MARKS}', ' ', 'g')"


_SQL_KNOWN = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in KNOWN)
#: The SQL has the list of KNOWN and drops a holder's whole line; on the test tables both give the same rows.
ORACLE_SQL = rf"""
with known as (
  select distinct licence, trim(regexp_replace({_sql_lines("known")}, '[ \n]+', ' ', 'g'), ' ') as form
  from (values {_SQL_KNOWN}) k(licence, known)),
d as (
  select doc_id, {_sql_lines("text")} as form from documents),
w as (
  select d.doc_id, k.licence as text_licence from d left join known k on trim(regexp_replace(d.form, '[ \n]+', ' ', 'g'), ' ') = k.form),
l as (
  select distinct s.doc_id, k.licence from (select doc_id, trim(unnest(string_split(form, chr(10))), ' ') as line from d) s
  join known k on s.line = k.form)
select w.doc_id, w.text_licence, coalesce(string_agg(l.licence, ',' order by l.licence), '') as line_licences
from w left join l using (doc_id) group by w.doc_id, w.text_licence
"""
