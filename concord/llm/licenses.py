"""License scans (operator 3): canonical digests of entire texts, hash-joined to known licences; DataFrame functions only.

Canonical form: lower case; equivalent spellings become one; every run of other characters than letters and digits
becomes one space. A line that begins with a copyright statement goes; since a licence may follow the statement on its
line, what stands after the statement's first and after its last sentence is tried as well.

Three scopes are digested (SHA-256) and joined with the digests of a registry of licences: a whole document, each of its
lines, and passages: where a document holds the first HEAD words of a registered text of LONG words or more, as many
characters from there on as that text has. Digests are equal only for equal canonical texts, however lines are wrapped.

The registry is a table (license, text), KNOWN by default. It is broadcast only up to BROADCAST_ROWS; its distinct
(first words, length) pairs, at most one for each long text, become expressions of the scan.

Defined results: null, empty and letterless texts match nothing; repeated rows of a doc_id add up; rows without a
doc_id are counted together; a line that is the whole text is reported for both scopes; a text that is the whole document
is no passage of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm.common import let, salted_rows_bound, table

#: Equivalent spellings, applied in this order to lower-cased text.
SPELLINGS = [("licence", "license"), ("sub-license", "sublicense"), ("sub license", "sublicense"), ("non-commercial", "noncommercial"), ("non commercial", "noncommercial"), ("merchantibility", "merchantability"), ("https://", "http://"), ("&", " and ")]
COPYRIGHT = r"^[ \t]*(?:copyright|\(c\)|©)"
FIRST, LAST = COPYRIGHT + r"[^\n]*?\.[ \t]+", COPYRIGHT + r"[^\n]*\.[ \t]+"  # up to the end of the statement's first, last sentence
OTHER = r"[^\p{L}\p{N}]+"
HEAD, LONG = 6, 20
BROADCAST_ROWS = 100_000

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_HEAD = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_TAIL = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_GNU = """{This} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.
{This} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""

#: Public licence texts and the notices that name licences.
KNOWN = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("0BSD", _ISC_HEAD + ".\n" + _ISC_TAIL),
    ("ISC", _ISC_HEAD + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_TAIL),
    ("BSD-2-Clause", _BSD_HEAD + "\n" + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _BSD_TAIL),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("Apache-2.0", _APACHE),
    ("MPL-2.0", _MPL),
    ("Zlib", _ZLIB),
    ("Unlicense", _UNLICENSE),
    *((f"{code}-{version}.0-or-later", _GNU.format(This=this, name=name, version=version)) for code, name, versions in (("GPL", "General Public License", (2, 3)), ("LGPL", "Lesser General Public License", (3,)), ("AGPL", "Affero General Public License", (3,))) for version in versions for this in ("This program", "This library")),
]


def _spelled(text: Column) -> Column:
    for a, b in SPELLINGS:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def _canon(line: Column) -> Column:
    return F.trim(F.regexp_replace(_spelled(line), OTHER, " "))


def _joined(lines: Column) -> Column:
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def canonical(text: Column) -> Column:
    """struct(lines, texts): canonical lines, and the whole text as one line; several where lines begin with a copyright
    statement, which goes with its line (the first text), to the end of its first sentence, or to the end of its last."""

    def cut(line: Column) -> Column:
        mark, rest = line.rlike(COPYRIGHT), lambda p: F.when(line.rlike(p), F.regexp_replace(line, p, "")).otherwise("")
        return F.struct(mark.alias("mark"), _canon(F.when(mark, rest(FIRST)).otherwise(line)).alias("first"), F.when(mark, _canon(rest(LAST))).alias("last"))

    def both(per: Column) -> Column:
        lines = F.flatten(F.transform(per, lambda x: F.when(x["mark"], F.array_distinct(F.array(x["first"], x["last"]))).otherwise(F.array(x["first"]))))
        bare = _joined(F.transform(F.filter(per, lambda x: ~x["mark"]), lambda x: x["first"]))
        texts = F.array(bare, _joined(F.transform(per, lambda x: x["first"])), _joined(F.transform(per, lambda x: F.coalesce(x["last"], x["first"]))))
        return F.struct(F.filter(lines, lambda x: x != "").alias("lines"), F.when(F.exists(per, lambda x: x["mark"]), F.array_distinct(texts)).otherwise(F.array(bare)).alias("texts"))

    def plain(low: Column) -> Column:
        """The same for a text without such a line: whole-text functions, one split."""
        lines = F.transform(F.split(F.regexp_replace(_spelled(low), OTHER.replace("]", r"\n]"), " "), "\n"), lambda x: F.trim(x))
        return let(F.filter(lines, lambda x: x != ""), lambda x: F.struct(x.alias("lines"), F.array(F.array_join(x, " ")).alias("texts")))

    return let(F.lower(text), lambda low: F.when(low.rlike("(?m)" + COPYRIGHT), let(F.transform(F.split(low, "\n"), cut), both)).otherwise(plain(low)))


def known(spark: SparkSession, texts: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """The registry of a list of (license, text)."""
    return registry(spark.createDataFrame(texts, "license string, text string"))


def registry(texts: DataFrame) -> DataFrame:
    """license, digest, head (first words), size (characters), long: of a table (license, text) of any size."""
    t = texts.select("license", canonical(F.col("text"))["texts"][0].alias("t")).where("t <> ''")
    words = F.split("t", " ")
    return t.select("license", F.sha2("t", 256).alias("digest"), F.array_join(F.slice(words, 1, HEAD), " ").alias("head"), F.length("t").alias("size"), (F.size(words) >= LONG).alias("long")).distinct()


def units(docs: DataFrame, marks: list[tuple[str, int]]) -> DataFrame:
    """doc_id, scope ('text', 'line', 'passage'), digest of every whole text, line and passage that begins with a mark (first
    words, size)."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text <> ''")

    def runs(flat: Column, cuts: Column, head: str):
        """From the i-th stand of the head on, as many characters as each text with that head has."""

        def of(i: Column) -> Column:
            tail = F.concat(F.lit(head + " "), F.array_join(F.slice(cuts, i, F.size(cuts)), f" {head} "))
            sizes = [n for h, n in marks if h == head]
            return let(tail, lambda x: F.array(*(F.when((F.length(flat) > n) & (F.substring(x, n + 1, 1) == " "), F.substring(x, 1, n)) for n in sizes)))

        return of

    def passages(flat: Column) -> Column:
        none = F.array().cast("array<string>")

        def of(whole: Column, head: str) -> Column:
            found = let(F.split(whole, rf"\Q {head} \E"), lambda cuts: F.flatten(F.transform(F.sequence(F.lit(2), F.size(cuts)), runs(flat, cuts, head))))
            return F.when(F.contains(whole, F.lit(f" {head} ")), found).otherwise(none)

        every = let(F.concat(F.lit(" "), flat, F.lit(" ")), lambda whole: F.flatten(F.array(*(of(whole, h) for h in sorted({h for h, _ in marks})))))
        return F.filter(every, lambda x: x.isNotNull())

    def unit(scope: str):
        return lambda x: F.struct(F.lit(scope).alias("scope"), x.alias("t"))

    def parts(c: Column) -> Column:
        found = [F.transform(c["texts"], unit("text")), F.transform(c["lines"], unit("line"))]
        return F.concat(*found, *([F.transform(let(c["texts"][0], passages), unit("passage"))] if marks else []))

    return text.select("doc_id", F.explode(let(canonical(F.col("text")), parts)).alias("u")).where("u.t <> ''").select("doc_id", F.col("u.scope").alias("scope"), F.sha2("u.t", 256).alias("digest"))


def scan(docs: DataFrame, known_texts: DataFrame) -> DataFrame:
    """doc_id, scope, license, n: the known licences (see ``registry``) that are a document, one of its lines or a passage."""
    marks = [(r["head"], r["size"]) for r in known_texts.where("long").select("head", "size").distinct().collect()]  # one for each long text at most
    side = known_texts.select("digest", "license", "long").distinct()
    hits = units(docs, marks).join(F.broadcast(side) if salted_rows_bound(side, BROADCAST_ROWS) else side, "digest")
    return hits.where("long or scope <> 'passage'").groupBy("doc_id", "scope", "license").agg(F.count(F.lit(1)).alias("n"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), known(spark))


def _sql() -> str:
    line = "l"
    for a, b in SPELLINGS:
        line = f"replace({line}, '{a}', '{b}')"

    def canon(x: str) -> str:
        return "trim(regexp_replace(" + line.replace("(l,", f"({x},", 1) + f", '{OTHER}', ' ', 'g'))"

    def rest(p: str) -> str:
        return f"CASE WHEN regexp_matches(l, '{p}') THEN regexp_replace(l, '{p}', '') ELSE '' END"

    def flat(x: str) -> str:
        return f"coalesce(string_agg({x}, ' ' ORDER BY i) FILTER (WHERE {x} <> ''), '')"

    def lines(source: str, key: str) -> str:
        cut = f"SELECT {key}, i, l, regexp_matches(l, '{COPYRIGHT}') AS mark FROM (SELECT {key}, unnest(string_split(lower(text), chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {source} WHERE text <> '')"
        return f"SELECT {key}, i, mark, CASE WHEN mark THEN {canon('(' + rest(FIRST) + ')')} ELSE {canon('l')} END AS f, CASE WHEN mark THEN {canon('(' + rest(LAST) + ')')} END AS z FROM ({cut})"

    rows = ", ".join("('" + a + "', '" + b.replace("'", "''") + f"', {k})" for k, (a, b) in enumerate(KNOWN))
    bare = "coalesce(string_agg(f, ' ' ORDER BY i) FILTER (WHERE NOT mark AND f <> ''), '')"
    return f"""
WITH v(license, text, k) AS (VALUES {rows}), kl AS ({lines('v', 'k')}),
k AS (SELECT DISTINCT license, t FROM (SELECT k, {bare} AS t FROM kl GROUP BY k) JOIN v USING (k)),
d AS (SELECT doc_id, text, row_number() OVER () AS r FROM documents), dl AS ({lines('d', 'r')}),
dt AS (SELECT r, {bare} AS a, {flat('f')} AS b, {flat('coalesce(z, f)')} AS c FROM dl GROUP BY r),
u AS (SELECT r, 'text' AS scope, unnest(list_distinct([a, b, c])) AS t FROM dt UNION ALL SELECT r, 'line', f FROM dl UNION ALL SELECT r, 'line', z FROM dl WHERE mark AND z <> f),
m AS (SELECT r, scope, license, 1 AS n FROM u JOIN k USING (t) WHERE t <> ''
 UNION ALL SELECT r, 'passage', license, (length(' ' || a || ' ') - length(replace(' ' || a || ' ', ' ' || t || ' ', ' '))) // (length(t) + 1) FROM dt JOIN k ON contains(' ' || a || ' ', ' ' || t || ' ')
 WHERE len(string_split(t, ' ')) >= {LONG} AND length(a) > length(t))
SELECT doc_id, scope, license, CAST(sum(n) AS BIGINT) AS n FROM m JOIN d USING (r) GROUP BY ALL"""


QUERIES = {"op3_license_scan": query}
ORACLES = {"op3_license_scan": _sql()}
