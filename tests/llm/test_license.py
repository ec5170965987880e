import math
import re

import numpy as np
import pytest

from tidemill.llm import license
from tidemill.llm.queries import op9_license

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy"


@pytest.fixture(scope="module")
def files(spark):
    rows = [
        ("LICENSE", "Apache License Version 2.0"),
        ("src/a.py", "print('some code')"),
        ("src/b.py", "# This work is licensed under the GNU General Public License, version 3.\ncode = 1"),
        ("vendor/lib/COPYING.txt", MIT),
        ("vendor/lib/deep/er/x.c", "int x;"),
        ("vendor/x.c", "int y;"),
        ("vendor/lib/y.c", None),
        ("vendor/lib/y.c", None),
        ("other/readme.md", "my licence plate and the licensed driver of that car are from a far away country"),
        (None, "orphan"),
        ("docs/long.txt", "word " * 30_000 + "\nReleased under the MIT License.\n" + "word " * 30_000),
        ("both/LICENSE", "Released under the MIT License."),
        ("both/COPYING", "Licensed under the Apache License, Version 2.0."),
        ("both/f", ""),
    ]
    return spark.createDataFrame([(*r, "c") for r in rows], "path string, text string, dir string")


def test_scan(files):
    got = {r["path"]: (r["license"], r["origin"]) for r in license.scan(files).collect()}
    assert got["LICENSE"] == ("Apache-2.0", "header")
    assert got["src/a.py"] == ("Apache-2.0", "directory")
    assert got["src/b.py"] == ("GPL-3.0", "header")
    assert got["vendor/lib/COPYING.txt"] == ("MIT", "header")
    assert got["vendor/lib/deep/er/x.c"] == got["vendor/lib/y.c"] == ("MIT", "directory")
    assert got["vendor/x.c"] == got["other/readme.md"] == ("Apache-2.0", "directory")
    assert got[None] == (None, None)
    assert got["docs/long.txt"] == ("MIT", "header")
    assert got["both/f"][1] == "directory"
    assert license.scan(files).count() == files.count()


def dense(text, n, frequency, vocabulary):
    """A normalised TF-IDF vector over `vocabulary`, from the definition alone; words outside the templates have the greatest idf."""
    known = {w for ts in license.TEMPLATES.values() for t in ts for w in re.findall("[a-z0-9]+", t.lower())}
    said = re.findall("[a-z0-9]+", text.lower())
    v = np.array([said.count(w) * (math.log((1 + n) / (1 + (frequency.get(w, 0) if w in known else 0))) + 1) for w in vocabulary])
    return v / max(np.linalg.norm(v), 1e-300)


def test_cosine_against_dense_brute_force():
    n, frequency = 50, {"license": 3, "the": 40, "odd": 9, "software": 2}
    model = license.Templates(n, frequency)
    texts = ["Released under the MIT License.", "the the license of something odd", "GNU General Public License version 2 of 1991", license.TEMPLATES["ISC"][0].upper(), "Apache License version 2", "CC BY-SA 4.0"]
    for text in texts:
        said = re.findall("[a-z0-9]+", text.lower())
        cosines = []
        for name in sorted(license.TEMPLATES):
            for t in license.TEMPLATES[name]:
                other = re.findall("[a-z0-9]+", t.lower())
                if len(other) / 3 <= len(said) <= 3 * len(other):
                    both = sorted(set(said) | set(other))
                    cosines.append((float(dense(text, n, frequency, both) @ dense(t, n, frequency, both)), name))
        decided = [(c, name) for c, name in cosines if any(set(x.split("|")[0].split()) <= set(said) and not set(x.partition("|")[2].split()) & set(said) for x in license.DECISIVE[name])]
        score, name = model.best(license.words(text))
        top = max((c for c, _ in decided), default=0.0)
        if top >= license.THRESHOLD or max((c for c, x in cosines if x != "Proprietary"), default=0) < license.THRESHOLD:
            assert score == pytest.approx(top, abs=1e-8) and name in ([x for c, x in decided if c > top - 1e-9] or [None])
        else:
            assert name == license.UNKNOWN and score == pytest.approx(max(c for c, x in cosines if x != "Proprietary"), abs=1e-8)
    assert model.best([]) == (0.0, None)


GPL_NOTICE = """# This program is free software; you can redistribute it and/or
# modify it under the terms of the GNU General Public License
# as published by the Free Software Foundation; either version {}
# of the License, or (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.
import os
print(os.getcwd())
"""
MPL_NOTICE = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */
int main() { return 0; }"""
STANDARD = {
    GPL_NOTICE.format(2): "GPL-2.0",
    GPL_NOTICE.format(3): "GPL-3.0",
    GPL_NOTICE.format(2).replace("General Public", "Lesser General Public").replace("version 2", "version 2.1"): "LGPL-2.1",
    GPL_NOTICE.format(3).replace("General Public", "Affero General Public"): "AGPL-3.0",
    GPL_NOTICE.format(1): "unknown",
    MPL_NOTICE: "MPL-2.0",
    "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Copyright (C) 1989, 1991 Free Software Foundation, Inc.": "GPL-2.0",
    "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n": "GPL-3.0",
    "                  GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 2.1, February 1999": "LGPL-2.1",
    "                  GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007": "LGPL-3.0",
    "// SPDX-License-Identifier: BSD-2-Clause\nx = 1": "BSD-2-Clause",
    "// SPDX-License-Identifier: BSD-3-Clause\nx = 1": "BSD-3-Clause",
    "// SPDX-License-Identifier: ISC": "ISC",
    "// SPDX-License-Identifier: MIT": "MIT",
    "// SPDX-License-Identifier: GPL-1.0": "unknown",
    "Copyright 2020 Foo Inc. All rights reserved.": None,
    "All rights reserved.": "Proprietary",
    "ISC License\n\nCopyright (c) 2004-2010 by Some Body\n\n" + license._ISC: "ISC",
    "MIT License\n\nCopyright (c) 2020 Some Body\n\n" + license._GRANT: "MIT",
    "Copyright (c) 2020, Some Body\n\n" + license._REDISTRIBUTION + license._HOLDERS: "BSD-2-Clause",
    "Copyright (c) 2020, Some Body\n\n" + license._REDISTRIBUTION + license._ENDORSE + license._HOLDERS: "BSD-3-Clause",
    license._UNENCUMBERED: "Unlicense",
    "/* Licensed under the Apache License, Version 2.0 (the \"License\");\n * you may not use this file except in compliance with the License. */": "Apache-2.0",
    "my licence to drive was lost, and no copyright is claimed here": None,
}


def test_standard_notices(spark):
    """Each alone in a corpus of other files, which make common words common."""
    names = {f"d{i}/f": want for i, want in enumerate(STANDARD.values())}
    rows = [(f"d{i}/f", t) for i, t in enumerate(STANDARD)] + [(f"z/{i}", "the of and to in a is that this software with for you may use") for i in range(200)]
    got = {r["path"]: (r["license"], r["origin"]) for r in license.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert {p: got[p][0] for p in names} == names
    assert all(got[f"z/{i}"] == (None, None) for i in range(200))


def test_unknown_licence_file_stops_inheritance(spark):
    rows = [("LICENSE", "Released under the MIT License."), ("a/x", "code"), ("own/LICENSE.txt", "You may look but not touch."), ("own/deep/x", "code"), ("blank/COPYING", " \n"), ("blank/x", "code")]
    got = {r["path"]: (r["license"], r["evidence"]) for r in license.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got["a/x"] == got["blank/x"] == ("MIT", "LICENSE")
    assert got["own/deep/x"] == ("unknown", "own/LICENSE.txt")


def test_query_takes_rows_without_an_id(spark, tmp_path):
    docs = spark.createDataFrame([(None, "Released under the MIT License.", None), (1, "text", "s"), (1, None, "s"), (2000, "Licensed under CC BY 4.0.", "s")], "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((str(r["doc_id"]), r["license"]) for r in op9_license(spark, str(tmp_path)).collect())
    assert got == [("1", None), ("1", None), ("2000", "CC-BY-4.0"), ("None", "MIT")]


def test_counts_cover_all_files(files):
    model = license.frequencies(files)
    n = sum("license" in license.words(r["text"] or "") for r in files.collect())
    assert model.idf["license"] == pytest.approx(math.log((1 + files.count()) / (1 + n)) + 1)


def test_near_licences_are_told_apart(spark):
    rows = [(f"d{i}/f", t) for i, t in enumerate(["This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-SA 4.0.", "Licensed under CC BY 4.0.", "All rights reserved."])]
    got = {r["path"]: r["license"] for r in license.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert [got[f"d{i}/f"] for i in range(5)] == ["GPL-3.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC-BY-4.0", "Proprietary"]


def test_empty(files):
    assert license.scan(files.limit(0)).count() == 0
