"""License scans (operator 8), in DataFrame functions only.

Words are runs of letters and digits, A-Z lower-cased; shingles are K words.
Templates are license texts and notices, cut into segments of at most SEGMENT
words (the last one of a long text overlaps the one before); whole_licenses()
says how many of a license's segments a document has. Segments of at least 4/5
of a length L are looked for together: a document is seen in windows of 2 L words,
a new one every L words, so each run of L words lies whole in some window. Windows
without any template shingle can't match and go first, exactly. The others are
min-hashed with BANDS bands of one row: a window that holds at least 80 % of a
segment has a similarity of at least 1/4 to it, so it is missed with a chance
of at most 0.75 ** 48 = 1e-6. Candidates are verified by exact containment of
the segment's shingles in the window's (as 64-bit hashes).

Templates go through the same expressions as documents, so any text matches itself.
Their shingles are one array in one row that is sent to all tasks (MOST_SHINGLES bounds it), and a
document is intersected with it once; what that costs grows with both. Their bands are
broadcast up to BROADCAST_BANDS rows, and joined by a shuffle beyond. Nothing else is shuffled
but the few windows that retrieve a template.

Edge cases: null, empty and short texts have no shingles and no match; a
null doc_id is grouped as one document; rows that repeat a doc_id are counted
together; an empty table, or no templates, gives an empty table; other columns
are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

K = 3
SEGMENT = 12
PERCENT = 80
BANDS = 48

#: Most shingles of all templates (8 MB), some 2000 texts of 500 words; more are an error.
MOST_SHINGLES = 1 << 20
BROADCAST_BANDS = 200_000

_AS_IS = (
    " IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
    " IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;"
    " LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS"
    " SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
)

#: Texts and notices of public licenses, by name; a parameter.
TEMPLATES = {
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights"
    " to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."
    " IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,"
    " ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd-3-clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    " 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    " THIS SOFTWARE" + _AS_IS,
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."
    " Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"
    " 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required."
    " 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    " Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    " See the License for the specific language governing permissions and limitations under the License.",
    "gpl-2.0-header": _GPL.format(2),
    "gpl-3.0-header": _GPL.format(3),
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-apache-2.0": "SPDX-License-Identifier: Apache-2.0",
    "spdx-gpl-2.0": "SPDX-License-Identifier: GPL-2.0",
    "spdx-gpl-3.0": "SPDX-License-Identifier: GPL-3.0",
    "spdx-bsd-3-clause": "SPDX-License-Identifier: BSD-3-Clause",
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "mit": "Released under the MIT License",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "lgpl-3.0": "under the terms of the GNU Lesser General Public License, version 3",
    "mpl-2.0": "subject to the terms of the Mozilla Public License, v. 2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "cc-by-4.0": "Licensed under CC BY 4.0",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "all-rights-reserved": "All rights reserved",
}


def segments(templates: dict[str, str]) -> list[tuple[str, int, list[str]]]:
    """license, part (from 0), words."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = []
    for name in sorted(templates):
        words = re.findall(r"[^\W_]+", templates[name].translate(lower))
        starts = [*range(0, len(words) - SEGMENT, SEGMENT), max(0, len(words) - SEGMENT)]
        found += [(name, i, words[at : at + SEGMENT]) for i, at in enumerate(starts)]
    return found


def window_lengths(lengths: list[int]) -> dict[int, int]:
    """For each length of segments the length that its windows are made for."""
    found, now = {}, 0
    for n in sorted(set(lengths), reverse=True):
        now = now if 5 * n >= 4 * now > 0 else n
        found[n] = now
    return found


def _words(text):
    return F.regexp_extract_all(common.lower_ascii(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _hashed(words):
    return F.when(F.size(words) >= K, F.transform(F.sequence(F.lit(0), F.size(words) - K), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(K)))))


def shingles(text):
    """The hashes of a text's shingles, in order."""
    return common.let(_words(text), _hashed)


def template_table(spark: SparkSession, templates: dict[str, str] | DataFrame) -> DataFrame:
    """license, part, words (array), own (distinct hashes) of each segment of templates: a dict, or a table
    (license, text; rows with a null in either are left out)."""
    if isinstance(templates, dict):
        templates = spark.createDataFrame(pa.table({"license": pa.array(list(templates), pa.string()), "text": pa.array(list(templates.values()), pa.string())}))
    rows = templates.select("license", "text").dropna().select("license", _words(F.col("text")).alias("words")).withColumn("n", F.size("words"))
    inner = F.greatest(F.lit(0), F.ceil((F.col("n") - SEGMENT) / SEGMENT)).cast("int")
    starts = F.concat(F.transform(F.slice(F.sequence(F.lit(0), inner), F.lit(1), inner), lambda k: k * SEGMENT), F.array(F.greatest(F.lit(0), F.col("n") - SEGMENT)))
    cut = rows.select("license", "words", F.posexplode(starts).alias("part", "at")).select("license", F.col("part").cast("long").alias("part"), F.slice("words", F.col("at") + 1, SEGMENT).alias("words"))
    table = common.written(cut.withColumn("own", F.array_distinct(_hashed(F.col("words")))), 1)
    short = table.where(F.size("words") < K).select("license").limit(5).collect()
    if short:
        raise ValueError(f"notices of under {K} words: {[r[0] for r in short]}")
    return table


def every_shingle(table: DataFrame) -> DataFrame:
    """One row: every, the array of the distinct hashes in own."""
    hashes = table.select(F.explode("own").alias("h")).distinct()
    if hashes.count() > MOST_SHINGLES:
        raise ValueError(f"more than {MOST_SHINGLES} shingles of templates")
    return hashes.agg(F.array_sort(F.collect_list("h")).alias("every"))


def minima(window):
    """One minimum for each band."""
    return F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda b: F.array_min(F.transform(window, lambda x: F.xxhash64(x, b))))


def scan(docs: DataFrame, templates: dict[str, str] | DataFrame | None = None) -> DataFrame:
    """doc_id, license, part, n_windows, first_word, best, size: a row for each
    document and segment with a match; best: most of the segment's size shingles in one window."""
    spark = docs.sparkSession
    parts = template_table(spark, TEMPLATES if templates is None else templates)
    counted = {r["n"]: r["segments"] for r in parts.groupBy(F.size("words").alias("n")).agg(F.count("*").alias("segments")).collect()}  # at most SEGMENT lengths
    if not counted:
        return spark.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, license string, part long, n_windows long, first_word long, best long, size long")
    sizes = window_lengths(list(counted))
    lengths = sorted(set(sizes.values()))
    rows = docs.select("doc_id", shingles(F.col("text")).alias("shingles")).join(F.broadcast(common.written(every_shingle(parts), 1)))  # one row
    rows = rows.select("doc_id", "shingles", F.array_intersect("shingles", "every").alias("hits")).where(F.size("hits") > 0)
    sized = rows.withColumn("length", F.explode(F.array(*(F.lit(n) for n in lengths))))
    starts = F.sequence(F.lit(0), F.size("shingles") - 1, F.col("length"))
    cut = lambda s: F.struct(s.alias("at"), F.slice("shingles", s + 1, 2 * F.col("length") - K + 1).alias("window"))
    windows = sized.select("doc_id", "length", F.explode(F.filter(F.transform(starts, cut), lambda x: F.arrays_overlap(x["window"], "hits"))).alias("w"))
    windows = windows.select("doc_id", "length", "w.at", F.array_distinct("w.window").alias("window"))
    banded = windows.select("*", F.posexplode(minima(F.col("window"))).alias("band", "least"))
    length = F.element_at(F.create_map(*(F.lit(x) for n in sizes for x in (n, sizes[n]))), F.size("words"))
    table = parts.select("license", "part", length.alias("length"), "own", F.posexplode(minima(F.col("own"))).alias("band", "least"))
    found = banded.join(F.broadcast(table) if BANDS * sum(counted.values()) <= BROADCAST_BANDS else table, ["length", "band", "least"])
    found = found.withColumn("best", F.size(F.array_intersect("window", "own"))).withColumn("size", F.size("own"))
    found = found.where(100 * F.col("best") >= PERCENT * F.col("size"))
    found = found.groupBy("doc_id", "license", "part", "at", "size").agg(F.max("best").alias("best"))
    return found.groupBy("doc_id", "license", "part").agg(
        F.count("*").alias("n_windows"), F.min("at").cast("long").alias("first_word"), F.max("best").cast("long").alias("best"), F.max("size").cast("long").alias("size")
    )


def whole_licenses(found: DataFrame, templates: dict[str, str] | DataFrame | None = None) -> DataFrame:
    """doc_id, license, n_parts, of_parts: how many of a license's segments scan() found in a document."""
    of = template_table(found.sparkSession, TEMPLATES if templates is None else templates).groupBy("license").agg(F.count("*").alias("of_parts"))
    return found.groupBy("doc_id", "license").agg(F.count("*").alias("n_parts")).join(of, "license", "left").select("doc_id", "license", "n_parts", "of_parts")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))


def _op8_sql() -> str:
    parts = segments(TEMPLATES)
    sizes = window_lengths([len(w) for *_, w in parts])
    values = ", ".join(f"('{n}', {p}, {sizes[len(w)]}, {[' '.join(w[i : i + K]) for i in range(len(w) - K + 1)]!r})" for n, p, w in parts)
    return rf"""
WITH t(license, part, length, own) AS (VALUES {values}),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\p{{L}}\p{{N}}]+') AS ws FROM documents),
s AS (SELECT doc_id, list_transform(range(0, len(ws) - 2), lambda i: ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) AS sh FROM w WHERE len(ws) >= 3),
c AS (SELECT doc_id, sh FROM s WHERE list_has_any(sh, (SELECT flatten(list(own)) FROM t))),
l AS (SELECT DISTINCT length FROM t),
x AS (SELECT doc_id, length, unnest(range(0, len(sh), length)) AS "at", sh FROM c, l),
v AS (SELECT doc_id, x.length, x."at", license, part, len(list_distinct(own)) AS size, len(list_intersect(list_distinct(sh[x."at" + 1 : x."at" + 2 * x.length - 2]), own)) AS best FROM x JOIN t ON x.length = t.length),
m AS (SELECT DISTINCT * FROM v WHERE 100 * best >= 80 * size)
SELECT doc_id, license, part::BIGINT AS part, count(DISTINCT "at") AS n_windows, min("at")::BIGINT AS first_word, max(best)::BIGINT AS best, max(size)::BIGINT AS size FROM m GROUP BY doc_id, license, part
"""


OP8_SQL = _op8_sql()
