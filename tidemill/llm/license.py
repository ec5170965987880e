"""Licence scans: TF-IDF cosine of headers and licence files to templates, then inheritance from directories.

Words are runs of ASCII letters and digits, lower-cased. A header begins at a line of a file with a licence word; that line,
and the first words from it on in windows of several lengths, are compared as sparse TF-IDF vectors with the templates
of about their length: full texts of the short licences, notices, titles, usual one-line forms and SPDX tags. A cosine says
how alike two texts are, not which version is meant, so a window can only have a licence whose decisive words it has
(`DECISIVE`). The best cosine of at least `THRESHOLD` gives the header's licence; if none that is decided
reaches it but another does, the licence is `unknown`. A licence file is one whose name says so and that isn't blank (its
licence is `unknown`, if nothing is found), or whose whole text has a cosine of at least `FILE_THRESHOLD`; its licence holds for
its directory. A file without a header inherits the licence of the nearest directory on its path that has one, by joining
each directory's ancestors to the licensed directories.

Document frequencies of the templates' words are counted over all files; other words count as if no file had them.

Defined results: null and empty texts have no header and can inherit; a null path has no directory; of several headers
the best wins, ties going to the first line, then to the shorter window, then to the template's name; of several licence files in one
directory the best wins, ties by path; repeated rows are judged alike; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import chunks, join_skewed, map_chunks
from tidemill.llm.decontam import LOWER, Words
from tidemill.session import cut, ship

THRESHOLD = 0.6
#: From this cosine of its whole text on, a file is a licence file whatever its name.
FILE_THRESHOLD = 0.95
UNKNOWN = "unknown"
#: The lengths of windows in words, beside the line itself; a template meets windows of a third to three times its length.
WINDOWS = (8, 20, 45, 110, 180, 260)
WORD = re.compile("[a-z0-9]+")
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(48, 58), *range(97, 123)]] = True

#: The short licences' texts.
_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
    "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
    "this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
    "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
    "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
    "and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING "
    "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
    "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
    "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_REDISTRIBUTION = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions "
    "of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
    "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_ENDORSE = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without "
    "specific prior written permission. "
)
_HOLDERS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, "
    "OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
    "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_UNENCUMBERED = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
    "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, "
    "the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the "
    "public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and "
    "future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this "
    "software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject "
    "to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this "
    "software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as "
    "such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
)
_APACHE_NOTICE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License "
    "at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
    "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
    "limitations under the License."
)
_MPL_NOTICE = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
    "http://mozilla.org/MPL/2.0/."
)


def _gnu_notice(what: str, name: str, version: str, later: str) -> str:
    """The notice that the GNU licences recommend, in their common wording."""
    return (
        f"{what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, "
        f"either version {version} of the License, or (at your option) any later version. {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
        f"without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy "
        f"of the GNU {name} along with this program{later}"
    )


_WRITE = "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
_SEE = ". If not, see <https://www.gnu.org/licenses/>."
_GNU = {
    "AGPL-3.0": ("Affero General Public License", "3", _SEE, "19 November 2007"),
    "GPL-2.0": ("General Public License", "2", _WRITE, "June 1991"),
    "GPL-3.0": ("General Public License", "3", _SEE, "29 June 2007"),
    "LGPL-2.1": ("Lesser General Public License", "2.1", _WRITE, "February 1999"),
    "LGPL-3.0": ("Lesser General Public License", "3", _SEE, "29 June 2007"),
}
_CC = {"CC-BY-4.0": ("BY", "Attribution"), "CC-BY-NC-4.0": ("BY-NC", "Attribution-NonCommercial"), "CC-BY-SA-4.0": ("BY-SA", "Attribution-ShareAlike")}

#: Each licence's texts, notices, titles and usual one-line forms.
TEMPLATES = {
    "Apache-2.0": [_APACHE_NOTICE, "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "Licensed under the Apache License, Version 2.0.", "Apache License Version 2.0"],
    "BSD-2-Clause": [_REDISTRIBUTION + _HOLDERS, "Released under the BSD 2-Clause License.", "BSD 2-Clause License"],
    "BSD-3-Clause": [_REDISTRIBUTION + _ENDORSE + _HOLDERS, "Released under the BSD 3-Clause License.", "BSD 3-Clause License"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0.", "Boost Software License - Version 1.0 - August 17th, 2003"],
    "CC0-1.0": ["Released under CC0 1.0 Universal.", "Creative Commons CC0 1.0 Universal Public Domain Dedication license"],
    "ISC": [_ISC, "Released under the ISC License.", "The ISC License"],
    "MIT": [_GRANT, "Released under the MIT License.", "The MIT License (MIT)", "Permission is hereby granted, free of charge, to any person obtaining a copy"],
    "MPL-2.0": [_MPL_NOTICE, "This work is subject to the terms of the Mozilla Public License, version 2.0.", "Mozilla Public License Version 2.0"],
    "Proprietary": ["All rights reserved.", "Proprietary and confidential. All rights reserved.", "This software is proprietary and confidential. Unauthorized copying is strictly prohibited."],
    "Unlicense": [_UNENCUMBERED, "Released into the public domain under the Unlicense."],
    "Zlib": [_ZLIB, "Released under the zlib License.", "zlib License"],
}
for _key, (_name, _version, _later, _date) in _GNU.items():
    TEMPLATES[_key] = [
        _gnu_notice("This library" if "Lesser" in _name else "This program", _name, _version, _later),
        f"This work is licensed under the GNU {_name}, version {_version}.",
        f"Licensed under the GNU {_name} version {_version} or later.",
        f"GNU {_name} Version {_version}",
        f"GNU {_name} Version {_version}, {_date}",
    ]
for _key, (_short, _long) in _CC.items():
    TEMPLATES[_key] = [f"Licensed under CC {_short} 4.0.", f"This work is licensed under a Creative Commons {_long} 4.0 International License."]
for _key in sorted(set(TEMPLATES) - {"Proprietary"}):
    TEMPLATES[_key].append(f"SPDX-License-Identifier: {_key}")

_OTHER_GNU = "affero lesser library lgpl agpl"
_OTHER_CC = "nc sa nd noncommercial sharealike noderivatives noderivs"
#: Words of which a window must have all (before the bar) and none (after it); one line of several is enough.
DECISIVE = {
    "AGPL-3.0": ["affero general public 3", "agpl 3", "agplv3"],
    "Apache-2.0": ["apache 2", "apache2"],
    "BSD-2-Clause": ["redistributions source binary reproduce disclaimer | neither endorse", "bsd 2 clause"],
    "BSD-3-Clause": ["redistributions source binary endorse", "bsd 3 clause"],
    "BSL-1.0": ["boost 1", "bsl 1"],
    "CC-BY-4.0": [f"cc by 4 | {_OTHER_CC}", f"commons attribution 4 | {_OTHER_CC}"],
    "CC-BY-NC-4.0": ["cc by nc 4 | sa nd", "commons noncommercial 4 | sharealike noderivatives noderivs"],
    "CC-BY-SA-4.0": ["cc by sa 4 | nc nd", "commons sharealike 4 | noncommercial noderivatives noderivs"],
    "CC0-1.0": ["cc0", "commons zero 1"],
    "GPL-2.0": [f"general public license 2 | {_OTHER_GNU}", f"gpl 2 | {_OTHER_GNU}", "gplv2"],
    "GPL-3.0": [f"general public license 3 | {_OTHER_GNU}", f"gpl 3 | {_OTHER_GNU}", "gplv3"],
    "ISC": ["isc license", "permission use copy modify distribute purpose fee | sublicense"],
    "LGPL-2.1": ["lesser general public 2 1 | affero", "lgpl 2 1"],
    "LGPL-3.0": ["lesser general public 3 | affero", "lgpl 3"],
    "MIT": ["mit", "permission hereby granted charge obtaining"],
    "MPL-2.0": ["mozilla public 2", "mpl 2"],
    "Proprietary": ["proprietary", "confidential", "all rights reserved | copyright c by"],
    "Unlicense": ["unlicense", "unencumbered public domain"],
    "Zlib": ["zlib", "altered misrepresented origin"],
}
#: What makes a line the beginning of a header, in small letters.
HEADER_WORDS = ("licence", "license", "copyright", "spdx", "rights reserved", "cc0", "redistribution", "permission", "unencumbered", "proprietary", "provided 'as-is'")
FILE_NAME = r"(?i)^(?:un)?(?:licen[cs]e|copying|notice)(?:[.-][\w.-]*)?$"


def headed(text: str) -> bool:
    """Whether a text has a licence word."""
    text = text.lower()
    return any(w in text for w in HEADER_WORDS)


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def decided(name: str, has: set[str]) -> bool:
    """Whether words that a window has decide for a licence. One without an entry needs none."""
    for line in DECISIVE.get(name, [""]):
        need, _, never = line.partition("|")
        if has.issuperset(need.split()) and has.isdisjoint(never.split()):
            return True
    return False


class Templates:
    """The templates' vectors, for given document frequencies over `n` files."""

    def __init__(self, n: int, frequency: dict[str, int], templates: dict[str, list[str]] = TEMPLATES):
        self.rare = math.log(1 + n) + 1
        self.idf = {w: math.log((1 + n) / (1 + frequency.get(w, 0))) + 1 for w in vocabulary(templates)}
        self.vectors = [(name, len(w), self.vector(w)) for name in sorted(templates) for w in map(words, templates[name])]

    def vector(self, ws: list[str]) -> dict[str, float]:
        out: dict[str, float] = {}
        for w in ws:
            out[w] = out.get(w, 0.0) + self.idf.get(w, self.rare)
        norm = math.sqrt(sum(x * x for x in out.values()))
        return {w: x / norm for w, x in out.items()} if norm else {}

    def best(self, ws: list[str], threshold: float = THRESHOLD, any_length: bool = False) -> tuple[float, str | None]:
        """The greatest cosine to a template of about this length (or of any) whose licence is decided, and that licence;
        else `unknown` and the greatest of the others, if that reaches the threshold."""
        v, has = self.vector(ws), set(ws)
        score, name, other = 0.0, None, 0.0
        for licence, n, t in self.vectors:
            if not (any_length or n <= 3 * len(ws) <= 9 * n):
                continue
            s = sum(x * v.get(w, 0.0) for w, x in t.items())
            if s > score + 1e-12 and decided(licence, has):
                score, name = s, licence
            elif s > other and licence != "Proprietary":
                other = s
        if score < threshold <= other:
            return round(other, 9), UNKNOWN
        return round(score, 9), name

    def header(self, text: str, threshold: float = THRESHOLD) -> tuple[float, str | None, str | None]:
        """The best header's cosine, licence and first line. A decided licence goes before an unknown one."""
        found: tuple[float, str | None, str | None] = (0.0, None, None)
        if not headed(text):
            return found
        lines = text.split("\n")
        of = [words(x) for x in lines]
        seen: dict[tuple[str, ...], tuple[float, str | None]] = {}
        for i, line in enumerate(lines):
            if not of[i] or not headed(line):
                continue
            windows, ahead, j = [of[i]], list(of[i]), i
            for size in WINDOWS:
                while len(ahead) < size and j + 1 < len(lines):
                    j += 1
                    ahead += of[j]
                if len(of[i]) < size <= len(ahead) or len(windows[-1]) < len(ahead) < size:
                    windows.append(ahead[:size])
            for w in windows:
                key = tuple(w)
                if key not in seen:
                    if len(seen) > 10_000:
                        seen.clear()
                    seen[key] = self.best(w, threshold)
                score, name = seen[key]
                if (name not in (None, UNKNOWN) and score >= threshold, score) > (found[1] not in (None, UNKNOWN) and found[0] >= threshold, found[0]):
                    found = (score, name, line)
        return found


def vocabulary(templates: dict[str, list[str]] = TEMPLATES) -> list[str]:
    return sorted({w for ts in templates.values() for t in ts for w in words(t)})


def frequencies(files: DataFrame, templates: dict[str, list[str]] = TEMPLATES) -> Templates:
    """Templates weighted by the document frequencies of their words over all files (a column text)."""
    terms = vocabulary(templates)

    def count(part: pa.RecordBatch) -> pa.RecordBatch:
        table = Words(pa.array(terms, pa.string()), LOWER, IN_WORD).hash
        order = np.argsort(table)
        w = Words(part.column("text"), LOWER, IN_WORD)
        at = np.minimum(np.searchsorted(table[order], w.hash), len(table) - 1)
        hit = table[order][at] == w.hash
        pairs = np.unique(w.row[hit] * len(table) + order[at[hit]])
        df = np.bincount(pairs % len(table), minlength=len(table))
        return pa.RecordBatch.from_arrays([pa.array([*terms, ""], pa.string()), pa.array([*df.tolist(), len(part)], pa.int64())], ["word", "n"])

    rows = map_chunks(files.select(F.coalesce("text", F.lit("")).alias("text")), count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df = {r["word"]: r["n"] for r in rows}
    return Templates(df.pop("", 0), df, templates)


def scan(files: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """path, license, score, origin (header, directory or null), evidence (the header, or the licence file's path), for
    every row of `files` (path, text), whatever its other columns."""
    ship(files.sparkSession)
    files = files.select(F.col("path").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    model = frequencies(files, templates)
    name = F.element_at(F.split(F.coalesce("path", F.lit("")), "/"), -1)
    files = files.withColumn("named", name.rlike(FILE_NAME))

    def judge(batches):
        for batch in batches:
            for part in chunks(batch):
                out = []
                for text, named in zip(part.column("text").to_pylist(), part.column("named").to_pylist(), strict=True):
                    score, lic, line = model.header(text, threshold)
                    all_words = words(text) if named or lic else []
                    whole, whole_lic = model.best(all_words, threshold, any_length=True)
                    good = score >= threshold
                    as_whole = whole_lic is not None and whole >= (threshold if named else FILE_THRESHOLD) and not (good and whole_lic == UNKNOWN)
                    is_file = as_whole or (named and bool(all_words))
                    file_lic, file_score = (whole_lic, whole) if as_whole else (lic, score) if good else (UNKNOWN, 0.0)
                    out.append((lic if good else None, score if good else None, line if good else None, file_lic if is_file else None, file_score if is_file else None))
                cols = list(zip(*out, strict=True)) or [[]] * 5
                kinds = [pa.string(), pa.float64(), pa.string(), pa.string(), pa.float64()]
                yield pa.RecordBatch.from_arrays([part.column("path"), *[pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)]], ["path", "license", "score", "line", "file_license", "file_score"])

    judged = cut(files.mapInArrow(judge, "path string, license string, score double, line string, file_license string, file_score double"))
    directory = F.when(F.col("path").isNotNull(), F.regexp_replace("path", "/?[^/]*$", ""))
    judged = judged.withColumn("dir", directory)
    order = F.struct((-F.col("file_score")).alias("s"), "path", "file_license")
    licensed = judged.where(F.col("file_license").isNotNull() & F.col("dir").isNotNull()).groupBy(F.col("dir").alias("above")).agg(F.min(order).alias("f"))
    # each directory once, with all its ancestors; the nearest that is licensed
    parts = F.split("dir", "/")
    dirs = cut(judged.where(F.col("dir").isNotNull()).groupBy("dir").agg(F.count("*").alias("n")))
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    every = dirs.select("dir", F.explode(F.array_distinct(above)).alias("above"))
    # a licence high up is met by all directories below it
    met = cut(every.groupBy("above").agg(F.count("*").alias("below")).join(licensed, "above"))
    near = join_skewed(every, met, ["above"], "below")
    nearest = near.groupBy("dir").agg(F.max_by("f", F.length("above")).alias("f"))
    placed = join_skewed(judged, cut(dirs.join(nearest, "dir", "left")), ["dir"], "n").drop("n")
    nowhere = judged.where(F.col("dir").isNull()).withColumn("f", F.lit(None).cast(placed.schema["f"].dataType))
    own = F.col("license").isNotNull()
    return placed.unionByName(nowhere).select(
        "path",
        F.coalesce("license", "f.file_license").alias("license"),
        F.coalesce("score", -F.col("f.s")).alias("score"),
        F.when(own, "header").when(F.col("f").isNotNull(), "directory").alias("origin"),
        F.when(own, F.col("line")).otherwise(F.col("f.path")).alias("evidence"),
    )
