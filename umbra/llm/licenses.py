r"""Licence scan by canonical digests, natively (operator 2).

A text is normalised (case, punctuation, copyright lines, equivalent spellings), digested, and
hash-joined to the digests of known licence texts. Whole texts are looked up, and so is each line
that mentions a licence: licence lines stand in otherwise unrelated documents. A line that begins with "(c)" is
a copyright line if it has a year or reserves rights; else it is a clause of an enumeration. `KNOWN` holds the
short licences in full and the notices of the long ones, `DIGESTS` the digests of the long ones' whole texts; give
further ones as `texts` and `digests`. Texts whose canonical
forms are equal under two licences count as the first by name.

Defined cases: a null or wordless text has a null digest and no licence; repeated rows are treated
alike; an id on several rows, or null, gets the licence lines of all its rows; extra columns are dropped; empty
tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Known texts. Fixed values.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""
BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {} for more details. You should have received a copy of the {} along with this program. If not, see <https://www.gnu.org/licenses/>."
KNOWN = [
    ("MIT", MIT),
    ("MIT", "The MIT License (MIT) " + MIT),
    ("MIT", "MIT License " + MIT),
    ("MIT", "Released under the MIT License."),
    ("ISC", ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies. " + ISC_END),
    ("0BSD", ISC_GRANT + ". " + ISC_END),
    ("BSD-2-Clause", f"{BSD_HEAD} {BSD_END}"),
    ("BSD-3-Clause", f"{BSD_HEAD} {BSD_NAME} {BSD_END}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("MIT-0", MIT.replace(", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", ".")),
    ("MIT-0", "MIT No Attribution " + MIT.replace(", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", ".")),
    ("Zlib", ZLIB),
    ("Zlib", "zlib License " + ZLIB),
    ("BSL-1.0", BOOST),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003 " + BOOST),
    ("Unlicense", UNLICENSE),
    ("Unlicense", UNLICENSE + " For more information, please refer to <https://unlicense.org>"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("GPL-3.0-or-later", GNU.format("GNU General Public License", "3", "GNU General Public License", "GNU General Public License")),
    ("GPL-2.0-or-later", GNU.format("GNU General Public License", "2", "GNU General Public License", "GNU General Public License")),
    ("AGPL-3.0-or-later", GNU.format("GNU Affero General Public License", "3", "GNU Affero General Public License", "GNU Affero General Public License")),
    ("LGPL-3.0-or-later", GNU.format("GNU Lesser General Public License", "3", "GNU Lesser General Public License", "GNU Lesser General Public License")),
]
#: Digests of the canonical whole texts of long licences, as their stewards publish them. Fixed values.
DIGESTS = [
    ("Apache-2.0", "184d4af64a58c708bcf4cb2468396a96"),
    ("CC0-1.0", "93a180096f6cfcf2c0dd24f75c2eec48"),
    ("GFDL-1.2", "c969fdb4b731dadf7173c1ffbe49a117"),
    ("GFDL-1.3", "eb6b86c0fad89753a5a36c484fa0ada2"),
    ("GPL-1.0", "9a6d41337fa0145d93e534071bfae3f8"),
    ("GPL-2.0", "8e4925da11f68cc625b11b0a628fdcc5"),
    ("GPL-3.0", "5eaa767cc0a56c87c3852144458a3bf1"),
    ("LGPL-2.0", "74cf7fcef3b29a39165a795b2cad3a3a"),
    ("LGPL-2.1", "f998bc436710cfece156aaa84fd26dd4"),
    ("LGPL-3.0", "b31b7335bc37919e8cdd79154e04d88d"),
    ("MPL-1.1", "9cdb0c94cb45abb55c616e067859d4ad"),
    ("MPL-2.0", "db12a21e89062c14ac06f7d6aa8123d5"),
]
#: Spellings that mean the same: left becomes right. Fixed values.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("authorised", "authorized"), ("centre", "center"), ("favour", "favor"),
    ("fulfil", "fulfill"), ("http", "https"), ("licence", "license"), ("licenced", "licensed"), ("noncommercial", "non commercial"), ("organisation", "organization"),
    ("organisations", "organizations"), ("per cent", "percent"), ("sub license", "sublicense"), ("sublicence", "sublicense"), ("v2", "version 2"),
    ("v3", "version 3"), ("wilful", "willful"),
]
COPYRIGHT_LINE = r"(?m)^[ \t*#/;.-]*(?:copyright[ \t]*(?:\(c\)|©|[0-9<\[{]|by\b)|\(c\).*(?:(?:19|20)[0-9][0-9]|rights reserved)|©|all rights reserved).*$"
MENTION = "licen|permission|redistribution"
#: Known texts are broadcast up to this many; beyond, the join shuffles.
BROADCAST_ROWS = 10_000


def canonical(text: Column) -> Column:
    """Lower-case words, each between spaces of its own, without copyright lines, in one spelling."""
    words = F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT_LINE, ""), r"[^\p{L}\p{N}]+", "  ")
    words = F.concat(F.lit(" "), words, F.lit(" "))
    for a, b in SPELLINGS:
        words = F.replace(words, F.lit(f" {a.replace(' ', '  ')} "), F.lit(f" {b.replace(' ', '  ')} "))
    return F.trim(F.replace(words, F.lit("  "), F.lit(" ")))


def digest(text: Column) -> Column:
    c = canonical(text)
    return F.when(F.length(c) > 0, F.md5(c))


def known(spark: SparkSession, texts: list[tuple[str, str]], digests: list[tuple[str, str]]) -> DataFrame:
    df = spark.createDataFrame(texts, "license string, text string").select("license", digest(F.col("text")).alias("digest"))
    df = df.union(spark.createDataFrame(digests, "license string, digest string"))
    df = df.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("license").alias("license"))
    return F.broadcast(df) if len(texts) + len(digests) <= BROADCAST_ROWS else df


def scan(df: DataFrame, texts: list[tuple[str, str]] = KNOWN, id_col: str = "doc_id", text_col: str = "text", digests: list[tuple[str, str]] = DIGESTS) -> DataFrame:
    """(id, digest, license of the whole text or null, line_licenses: those of its lines, distinct, comma-joined, n_license_lines)."""
    base = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    look = known(df.sparkSession, texts, digests)
    whole = base.select("id", digest(F.col("text")).alias("digest")).join(look, "digest", "left")
    lines = base.where(F.lower("text").rlike(MENTION)).select("id", F.explode(F.filter(F.split("text", "\n"), lambda x: F.lower(x).rlike(MENTION))).alias("line"))
    hits = lines.select("id", digest(F.col("line")).alias("digest")).join(look, "digest").groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("line_licenses"), F.count("*").alias("n"))
    hits = hits.withColumnRenamed("id", "hit")
    return whole.join(hits, F.col("id").eqNullSafe(F.col("hit")), "left").select(F.col("id").alias(id_col), "digest", "license", F.coalesce("line_licenses", F.lit("")).alias("line_licenses"), F.coalesce("n", F.lit(0)).alias("n_license_lines"))


def oracle_sql(table: str = "documents") -> str:
    """The same scan for DuckDB."""
    q = lambda s: "'" + s.replace("'", "''") + "'"

    def canon(x: str) -> str:
        x = f"' ' || regexp_replace(regexp_replace(lower({x}), {q(COPYRIGHT_LINE)}, '', 'g'), '[^\\p{{L}}\\p{{N}}]+', '  ', 'g') || ' '"
        for a, b in SPELLINGS:
            x = f"replace({x}, {q(' ' + a.replace(' ', '  ') + ' ')}, {q(' ' + b.replace(' ', '  ') + ' ')})"
        return f"trim(replace({x}, '  ', ' '))"

    rows = ", ".join(f"({q(i)}, {q(t)})" for i, t in KNOWN)
    more = ", ".join(f"({q(i)}, {q(d)})" for i, d in DIGESTS)
    return f"""
    WITH known AS (SELECT min(license) AS license, digest FROM (SELECT license, md5({canon('t')}) AS digest FROM (VALUES {rows}) AS v(license, t) UNION ALL VALUES {more}) GROUP BY 2),
    whole AS (SELECT doc_id, text, nullif({canon('text')}, '') AS c FROM {table}),
    lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM {table}),
    hits AS (SELECT l.doc_id, string_agg(DISTINCT k.license, ',' ORDER BY k.license) AS line_licenses, count(*) AS n
             FROM (SELECT doc_id, md5({canon('line')}) AS digest FROM lines WHERE regexp_matches(lower(line), '{MENTION}')) AS l JOIN known AS k USING (digest) GROUP BY 1)
    SELECT w.doc_id, md5(w.c) AS digest, k.license, coalesce(h.line_licenses, '') AS line_licenses, coalesce(h.n, 0) AS n_license_lines
    FROM whole AS w LEFT JOIN known AS k ON k.digest = md5(w.c) LEFT JOIN hits AS h ON h.doc_id IS NOT DISTINCT FROM w.doc_id"""
