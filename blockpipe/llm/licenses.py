"""Licence scan by canonical digest.

A text is brought into a canonical form (letter case, punctuation, copyright
lines, equivalent spellings), hashed, and the digest is looked up among the
digests of known licences: one hash join, in SQL functions only.
"""

from __future__ import annotations

import functools
import re
import textwrap
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that count as the same word (matching guidelines of
# the public SPDX licence list).
EQUIVALENT_SPELLINGS = [
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"),
    ("catalogue", "catalog"),
    ("categorise", "categorize"),
    ("centre", "center"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "wilfull"),
    ("noncommercial", "non commercial"),
    ("percent", "per cent"),
    ("sublicence", "sublicense"),
    ("copyright holder", "copyright owner"),
]

# Texts of public licences and their customary notices.
KNOWN_LICENSES = [
    ("MIT", "MIT License\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "ISC License\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.\nYou should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
]

# Whole texts kept as files beside this one, as (licence, file, where the
# text without a title begins, where the terms end if a sample notice follows).
_GNU = ("Copyright (C)", "END OF TERMS AND CONDITIONS")
WHOLE_TEXTS = [
    ("Apache-2.0", "Apache-2.0", "TERMS AND CONDITIONS FOR USE", "END OF TERMS AND CONDITIONS"),
    ("Artistic-1.0-Perl", "Artistic", "Preamble", None),
    ("BSD-3-Clause", "BSD", None, None),
    ("CC0-1.0", "CC0-1.0", "CREATIVE COMMONS CORPORATION", None),
    ("CC0-1.0", "CC0-1.0", "CC0 1.0 Universal", None),
    ("CC0-1.0", "CC0-1.0", "Statement of Purpose", None),
    ("GFDL-1.2-only", "GFDL-1.2", "Copyright (C)", "ADDENDUM:"),
    ("GFDL-1.3-only", "GFDL-1.3", "Copyright (C)", "ADDENDUM:"),
    ("GPL-1.0-only", "GPL-1", *_GNU),
    ("GPL-2.0-only", "GPL-2", *_GNU),
    ("GPL-3.0-only", "GPL-3", *_GNU),
    ("LGPL-2.0-only", "LGPL-2", *_GNU),
    ("LGPL-2.1-only", "LGPL-2.1", *_GNU),
    ("LGPL-3.0-only", "LGPL-3", "Copyright (C)", None),
    ("MPL-1.1", "MPL-1.1", "1. Definitions.", "EXHIBIT A"),
    ("MPL-2.0", "MPL-2.0", "1. Definitions", "Exhibit A - Source"),
]

# Customary title lines of the short licences.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "0BSD License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License", "BSD License"],
    "Zlib": ["zlib License", "The zlib License", "The zlib/libpng License"],
}
_THIRD_CLAUSE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"


def _rewrapped(text: str, width: int) -> str:
    """With the copyright statements of the licence's own authors filled to ``width``:
    the rest of a statement that was wrapped stays in the canonical text."""
    statement = r"(?mi)^[ \t]*copyright \(c\) \d{4}.*$"
    return re.sub(statement, lambda m: textwrap.fill(m[0].strip(), width), text) if width else text


@functools.cache
def _known() -> list[tuple[str, str]]:
    short = [(name, text) for name, text in KNOWN_LICENSES if name in TITLES and len(text) > 500]
    two = dict(short)["BSD-2-Clause"]
    short.append(("BSD-3-Clause", two.replace("THIS SOFTWARE IS", _THIRD_CLAUSE + "THIS SOFTWARE IS", 1)))
    found = list(KNOWN_LICENSES)
    files = resources.files(__package__) / "known_licenses"
    for name, file, begin, end in WHOLE_TEXTS:
        text = (files / f"{file}.txt").read_text(encoding="utf-8")
        at = [0] + ([text.index(begin)] if begin else [])
        stops = [len(text)]
        if end:
            last = text.rindex(end)
            stops += [last, last + len(end)] if end.startswith("END OF") else [last]
        if name in TITLES:
            short.append((name, text))
        found += [(name, _rewrapped(text[lo:hi], width)) for lo in at for hi in stops for width in (0, 58, 60, 70, 72)]
    for name, text in short:
        title, _, body = text.partition("\n")
        body = body if title in TITLES[name] else text
        bodies = [body, re.sub(r"(?m)^\d\. ", "* ", body)] if name.startswith("BSD") else [body]
        found += [(name, f"{t}\n\n{b}") for b in bodies for t in ["", *TITLES[name]]]
    return list(dict.fromkeys(found))


def known_licenses() -> list[tuple[str, str]]:
    """(licence, text): the texts and notices above and the files' whole texts, with
    and without their titles, and with and without the sample notice at the end."""
    return list(_known())


# A line that only states a copyright is no part of the licence itself: one that
# begins with the word and (c), the sign or a year, or with one of those and a year.
_YEAR = r"([<\[{]?\d\d(\d\d|yy)|[<\[{](year|yyyy))"
COPYRIGHT_LINE = (
    r"(^|\n)[ \t]*(copyright[ \t:]*(\(c\)|©|" + _YEAR + r")|(\(c\)|©)[ \t]*(copyright[ \t]*)?" + _YEAR + r")[^\n]*"
)

# Applied in turn to the lower-cased text; every pattern means the same to
# Java's and to RE2's regular expressions. Afterwards each word has a blank of
# its own on either side, so a spelling is replaced as a plain string.
PATTERNS = [
    (r"\r\n?", "\n"),
    (COPYRIGHT_LINE, "\n"),
    (r"all rights reserved\.?", " "),
    (r"[^\p{L}\p{N}\n]+", "  "),
    (r"\n", " \n "),
]


def _padded(words: str) -> str:
    return " " + words.replace(" ", "  ") + " "


def _spellings() -> list[tuple[str, str]]:
    """What to replace in the padded words; spellings of several words also where
    the text was wrapped inside them."""
    out = [(_padded(spelling), _padded(same)) for spelling, same in EQUIVALENT_SPELLINGS]
    for spelling, same in EQUIVALENT_SPELLINGS:
        if " " in spelling:
            for gap in (" \n ", "   \n ", " \n   ", "   \n   "):
                out.append((f" {spelling.replace(' ', gap)} ", f" {same.replace(' ', gap)} "))
    return out


def canonical_lines(text: Column) -> Column:
    """The lower-cased text without copyright lines, its words parted by blanks,
    in equivalent spellings, lines kept. Null stays null."""
    c = F.lower(text)
    for pattern, new in PATTERNS:
        c = F.regexp_replace(c, F.lit(pattern), F.lit(new))
    c = F.concat(F.lit(" "), c, F.lit(" "))
    for spelling, same in _spellings():
        c = F.replace(c, F.lit(spelling), F.lit(same))
    return c


def one_line(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, F.lit(r"[ \n]+"), F.lit(" ")))


def canonical(text: Column) -> Column:
    """The whole canonical text as one line of words."""
    return one_line(canonical_lines(text))


def canonical_lines_sql(text: str) -> str:
    """``canonical_lines`` as DuckDB SQL."""
    c = f"lower({text})"
    for pattern, new in PATTERNS:
        quoted = new.replace("\n", "' || chr(10) || '")
        c = f"regexp_replace({c}, '{pattern}', '{quoted}', 'g')"
    c = f"' ' || {c} || ' '"
    for spelling, same in _spellings():
        c = f"replace({c}, '{spelling}', '{same}')"
    return c


def one_line_sql(lines: str) -> str:
    return f"trim(regexp_replace({lines}, '[ \\n]+', ' ', 'g'))"


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(license_digest, license), one row per distinct canonical text; of two
    names for one text the smaller is kept, texts that are empty once canonical
    are left out. As long as the list given."""
    rows = spark.createDataFrame(known_licenses() if known is None else known, "license string, text string")
    return (
        rows.select("license", canonical(F.col("text")).alias("canon"))
        .where("canon <> ''")
        .groupBy(F.sha2("canon", 256).alias("license_digest"))
        .agg(F.min("license").alias("license"))
    )


def scan_licenses(
    docs: DataFrame,
    text_col: str = "text",
    known: list[tuple[str, str]] | None = None,
) -> DataFrame:
    """``docs`` plus ``license_digest`` (SHA-256 of the whole canonical text),
    ``license`` (the known licence that the whole text is, else null) and
    ``license_lines`` (licences of which some line is the entire text or
    notice: distinct, sorted, joined by commas; empty if none).

    The known list is a parameter and so small that it is broadcast; the
    documents are neither shuffled nor grouped, so neither copies nor long texts
    make a hot task. Digests for lines are looked up in an array of as many
    entries as the list has.

    A null text has null digest, licence and lines; an empty text, or one with
    no letter or digit, has a null digest and licence and no lines. Repeated
    rows stay repeated. Columns of ``docs`` that have one of the three names are
    replaced. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    names = {r.license_digest: r.license for r in known_digests(spark, known).collect()}  # as long as the list
    table = spark.createDataFrame(list(names.items()), "license_digest string, license string")
    kept = docs.drop("license_digest", "license", "license_lines")
    lines, flat = "__lines", "__flat"
    out = kept.withColumn(lines, canonical_lines(F.col(text_col))).withColumn(flat, one_line(F.col(lines)))
    out = out.withColumn("license_digest", F.when(F.col(flat) != "", F.sha2(F.col(flat), 256)))
    digests = F.transform(F.split(F.col(lines), "\n"), lambda x: F.sha2(one_line(x), 256))
    hits = F.array_intersect(digests, F.array(*[F.lit(d) for d in sorted(names)]).cast("array<string>"))
    if names:
        lookup = F.create_map(*[F.lit(v) for d in sorted(names) for v in (d, names[d])])
        found = F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda d: lookup[d]))), ",")
    else:
        found = F.when(F.col(text_col).isNotNull(), F.lit(""))
    out = out.withColumn("license_lines", found).drop(lines, flat)
    return out.join(F.broadcast(table), "license_digest", "left").select(
        *kept.columns, "license_digest", "license", "license_lines"
    )


def scan_sql(source: str = "documents", known: list[tuple[str, str]] | None = None) -> str:
    """``scan_licenses`` for (doc_id, text) of ``source`` as DuckDB SQL."""
    values = ", ".join(
        "('" + n + "', '" + t.replace("'", "''") + "')" for n, t in (known_licenses() if known is None else known)
    )
    return f"""
    with known as (
        select sha256(canon) as d, min(license) as license
        from (select license, {one_line_sql(canonical_lines_sql("body"))} as canon
              from (values {values}) as k(license, body))
        where canon <> '' group by 1
    ), canon as (
        select row_number() over () as r, doc_id, {canonical_lines_sql("text")} as lines from {source}
    ), flat as (
        select r, doc_id, lines, {one_line_sql("lines")} as flat from canon
    ), hits as (
        select r, string_agg(distinct license, ',' order by license) as names
        from (select r, {one_line_sql("unnest(string_split(lines, chr(10)))")} as line from flat) as l
        join known on sha256(l.line) = known.d group by r
    )
    select doc_id, case when flat <> '' then sha256(flat) end as license_digest, license,
           case when flat is not null then coalesce(names, '') end as license_lines
    from flat left join known on flat <> '' and sha256(flat) = known.d left join hits using (r)
    """
