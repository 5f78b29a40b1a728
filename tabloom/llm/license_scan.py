"""License scans: sparse TF-IDF cosine to templates, then inheritance from directories.

Units are, of each text that mentions a licence term: every such line, compared with short
phrases; every identifier of an ``SPDX-License-Identifier`` line, compared with the SPDX names;
and the header (the leading comment) and the whole text, compared with the notices and the full
texts of the licences.  Unit and template terms get TF-IDF weights, with document frequencies
counted over all units of the corpus (only the templates' terms matter, so the counts are
bounded).  Units join the templates' terms, which are few by construction, and the sums of
matching weights give the cosine.  Term counts of headers and whole texts weigh by their
logarithm, so that common words do not make prose and licences alike.  A document takes its best
template at ``CLOSE`` or more, for a whole text at ``CLOSE_TEXT``.

A document without a licence of its own inherits that of the nearest ancestor directory that
holds a licence file (``LICENSE``, ``COPYING``, ``NOTICE`` ...): every document's ancestor
directories join the licensed directories, and the longest one wins.  Where paths have no names
of files, a licence file is a document whose whole text, not just its header, is that of a
licence; a licence line or a header speaks for its own document only.  The documents are read
twice: once for the terms of their units, which are counted per task before they move, and once
for the keys and paths of the result.  No text is shuffled.

Defined cases: null or empty texts have no unit; a null path has no ancestor; several licence
files of one directory: the closest match, then the first name, wins; repeated rows each get
the result of their text and path; ties between templates go to the first name; extra columns
are ignored.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, functions as F

from ..session import checkpoint_dir

#: Least cosine of a match, and the terms that make a line a unit.
CLOSE, CLOSE_TEXT = 0.6, 0.8
UNIT = r"(?i)licen[sc]e|copyright|\bspdx\b|public domain|\bCC[ -]BY|\bCC0\b"
LICENSE_FILE = r"(?i)^(?:licen[sc]e|copying|notice|unlicense)(?:[.\-_].*)?$"
COMMENT = r"^\s*(?:#|//|/\*|\*|--|;|%|<!--|$)"
BLOCK = r'(?s)\A\s*(/\*.*?\*/|<!--.*?-->|""".*?""")'
SPDX = r"(?i)SPDX-License-Identifier:(.*)"
TERM = r"[a-z0-9]+(?:[.\-][a-z0-9]+)*"
#: One or more typical header lines of each licence.
TEMPLATES = {
    "MIT": "Released under the MIT License",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-2.0": "This program is licensed under the GNU General Public License, version 2",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3",
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3",
    "BSD-3-Clause": "Redistribution and use under the BSD 3-Clause License",
    "BSD-2-Clause": "Redistribution and use under the BSD 2-Clause License",
    "MPL-2.0": "Subject to the terms of the Mozilla Public License, version 2.0",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0",
    "ISC": "Released under the ISC License",
    "Unlicense": "Released into the public domain under the Unlicense",
}


_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
%sTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GNU = """This %(what)s is free software%(colon)s you can redistribute it and/or modify it under the terms of the GNU %(name)sGeneral Public License as published by the Free Software Foundation%(either)s version %(version)s of the License, or (at your option) any later version.
This %(what)s is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU %(name)sGeneral Public License for more details.
You should have received a copy of the GNU %(name)sGeneral Public License along with this %(what)s. If not, see <https://www.gnu.org/licenses/>."""


def _gnu(name: str, version: str, what: str = "program") -> str:
    return _GNU % {"what": what, "name": name, "version": version, "colon": ":" if version == "3" else ";", "either": ", either" if version == "3" else "; either"}


#: (licence, notice) as they stand at the head of files, and short full texts.
NOTICES = [
    ("MIT", """MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """ISC License. Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", _BSD % ""),
    ("BSD-3-Clause", _BSD % "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-2.0", _gnu("", "2")), ("GPL-3.0", _gnu("", "3")), ("AGPL-3.0", _gnu("Affero ", "3")),
    ("LGPL-2.1", _gnu("Lesser ", "2.1", "library")), ("LGPL-3.0", _gnu("Lesser ", "3")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
]
#: What the Affero licence adds to the text of GPL-3.0.
REMOTE = """13. Remote Network Interaction; Use with the GNU General Public License.
Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network (if your version supports such interaction) an opportunity to receive the Corresponding Source of your version by providing access to the Corresponding Source from a network server at no charge, through some standard or customary means of facilitating copying of software."""
#: SPDX names by licence; those of the GNU licences with their endings.
SPDX_NAMES = [(k, n) for k in [*TEMPLATES, "LGPL-2.1"] for n in [k, *([f"{k}-only", f"{k}-or-later"] if "GPL" in k else [])]]


def templates() -> list[tuple[str, int, str, str]]:
    """(form, number, licence, body): all templates by the form of the units they are compared with."""
    full = [(f.name.removesuffix(".txt"), f.read_text(encoding="utf-8")) for f in sorted(Path(__file__).with_name("licenses").glob("*.txt"))]
    gpl = dict(full)["GPL-3.0"]
    affero = gpl.replace("GNU GENERAL PUBLIC", "GNU AFFERO GENERAL PUBLIC").replace("GNU General Public", "GNU Affero General Public")
    full.append(("AGPL-3.0", affero + REMOTE))
    every = [("line", *x) for x in TEMPLATES.items()] + [("spdx", *x) for x in SPDX_NAMES] + [("text", *x) for x in NOTICES + full]
    return [(form, i, name, body) for i, (form, name, body) in enumerate(every)]


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def header(text: Column) -> Column:
    """The leading comment of a text: a block comment, or its first lines that are comments or blank."""
    lines = F.split(text, "\n", -1)
    code = F.array_position(F.transform(lines, lambda x: x.rlike(COMMENT)), False).cast("int")
    leading = F.array_join(F.when(code == 0, lines).otherwise(F.slice(lines, F.lit(1), F.greatest(code - 1, F.lit(0)))), "\n")
    block = F.regexp_extract(text, BLOCK, 1)
    return F.when(F.length(block) > F.length(leading), block).otherwise(leading)


def units(text: Column) -> Column:
    """Array of (form, part, unit, line): licence lines and their SPDX names, whole text and header of one text."""
    unit = lambda form, part, no, line: F.struct(F.lit(form).alias("form"), part.alias("part"), no.alias("unit"), line.alias("line"))
    lines = F.filter(F.transform(F.split(text, "\n", -1), lambda x, i: unit("line", F.lit(0), i, x)), lambda u: u["line"].rlike(UNIT))
    names = lambda x: F.split(F.trim(F.regexp_replace(F.regexp_extract(x, SPDX, 1), r"(?i)\bWITH\s+\S+|\b(?:OR|AND)\b|[()]", " ")), r"\s+")
    spdx = F.flatten(F.transform(F.filter(lines, lambda u: u["line"].rlike(SPDX)), lambda u: F.transform(
        names(u["line"]), lambda x, j: unit("spdx", j, u["unit"], x))))
    return F.concat(lines, spdx, F.array(unit("text", F.lit(0), F.lit(0), text), unit("text", F.lit(1), F.lit(0), header(text))))


def term_counts(docs: DataFrame, text: str, key: str, path: Column) -> DataFrame:
    """(row, form, part, unit, term, tf) of all units, from one pass over the documents; a null term counts its unit once.

    Rows that repeat are one row: each unit emits its null term once a copy, and counts are divided by the copies.
    """
    rows = docs.where(F.col(text).rlike(UNIT)).select(F.xxhash64(F.col(key), F.col(text), path).alias("row"), F.explode(units(F.col(text))).alias("u"))
    own = ("row", "form", "part", "unit")
    counts = rows.select("row", "u.form", "u.part", "u.unit", F.explode(F.concat(F.array(F.lit(None).cast("string")), terms(F.col("u.line")))).alias("term")).groupBy(
        *own, "term").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    copies = counts.where("form = 'text' and part = 0 and term is null").select("row", F.col("n").alias("copies"))
    return counts.join(copies, "row").select(*own, "term", (F.col("n") / F.col("copies")).cast("long").alias("tf"))


def best_match(found: DataFrame) -> DataFrame:
    """(row, license, cosine, line_no, whole): the closest template of each document with a unit, from :func:`term_counts`.

    ``whole``: the text as a whole is that of a licence, and not because of its header.
    """
    spark = found.sparkSession
    weight = F.when(F.col("form") == "text", F.log(F.col("tf")) + 1).otherwise(F.col("tf"))
    template = spark.createDataFrame(templates(), "form string, number int, license string, body string").select(
        "form", "number", "license", F.explode(terms(F.col("body"))).alias("term")).groupBy("form", "number", "license", "term").agg(
        F.count(F.lit(1)).alias("tf")).withColumn("tf", weight)
    own = ("row", "form", "part", "unit")
    bag = found.where("term is not null").withColumn("tf", weight)
    df = bag.join(F.broadcast(template.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = found.where("term is null").agg(F.count(F.lit(1)).alias("n"))
    # a term that no template has gets the weight of one unit; it only lengthens the vector
    idf = lambda n, d: F.log((n + 1) / (F.coalesce(d, F.lit(0)) + 1)) + 1
    one = F.lit(0).alias("one")
    weights = template.select("term").distinct().join(df, "term", "left").withColumn("one", one).join(
        F.broadcast(total.withColumn("one", one)), "one").select("term", idf(F.col("n"), F.col("df")).alias("idf"))
    weights = F.broadcast(weights)
    wt = template.join(weights, "term").select("form", "number", "license", "term", (F.col("tf") * F.col("idf")).alias("tw"))
    norm = wt.groupBy("number").agg(F.sqrt(F.sum(F.col("tw") ** 2)).alias("tn"))
    wt = F.broadcast(wt.join(norm, "number").select("form", "number", "license", "term", (F.col("tw") / F.col("tn")).alias("tw")))
    bag = bag.join(weights, "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(1.0)))
    length = bag.groupBy(*own).agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("len"))
    dot = bag.join(wt, ["form", "term"]).groupBy(*own, "number", "license").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    part = lambda no: (F.col("form") == "text") & (F.col("part") == no)
    least = F.when(part(0), CLOSE_TEXT).otherwise(CLOSE)
    close = dot.join(length, list(own)).withColumn("cosine", F.round(F.col("dot") / F.col("len"), 6)).where(F.col("cosine") >= least)
    best = close.groupBy("row").agg(
        F.min(F.struct(-F.col("cosine"), "license", "unit")).alias("b"), (F.bool_or(part(0)) & ~F.bool_or(part(1))).alias("whole"))
    return best.select("row", F.col("b.license").alias("license"), (-F.col("b.col1")).alias("cosine"), F.col("b.unit").cast("bigint").alias("line_no"), "whole")


def ancestors(path: Column) -> Column:
    """All directories above a path, the root as the empty string; null: none."""
    parts = F.split(path, "/", -1)
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def scan(docs: DataFrame, path: Column, text: str = "text", key: str = "doc_id", named: bool = True) -> DataFrame:
    """doc_id, license, cosine, line_no, inherited_from (the directory, null for an own licence).

    ``named``: paths end in names of files, which tell the licence files; otherwise the texts tell them.
    """
    checkpoint_dir(docs.sparkSession)
    best = best_match(term_counts(docs, text, key, path))
    rows = docs.select(F.col(key).alias("doc_id"), path.alias("path"), F.xxhash64(F.col(key), F.col(text), path).alias("row"))
    own = rows.join(best, "row", "left").checkpoint()  # no texts; read three times below
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    license_file = F.regexp_extract("path", "[^/]*$", 0).rlike(LICENSE_FILE) if named else F.col("whole") & F.col("path").isNotNull()
    files = own.where(F.col("license").isNotNull() & license_file)
    dirs = files.groupBy(folder.alias("dir")).agg(F.min(F.struct(-F.col("cosine"), "path", "license")).alias("b")).select("dir", F.col("b.license").alias("dir_license"))
    above = own.where("license is null and path is not null").select("path").distinct().select("path", F.explode(ancestors(F.col("path"))).alias("dir"))
    nearest = above.join(dirs, "dir").groupBy("path").agg(F.max(F.struct(F.length("dir"), "dir", "dir_license")).alias("b")).select(
        "path", F.col("b.dir").alias("inherited_from"), F.col("b.dir_license").alias("dir_license"))
    own_license = F.col("license").isNotNull()
    return own.join(nearest, "path", "left").select(
        "doc_id", F.coalesce("license", "dir_license").alias("license"), "cosine", "line_no",
        F.when(~own_license, F.col("inherited_from")).alias("inherited_from"))
