from tidewater.llm import licenses, queries


def test_notices_and_inheritance(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."),
        (2, "a/x/one.txt", "some words only"),
        (3, "a/x/LICENSE.md", "Apache License\nVersion 2.0, January 2004\nLicensed under the Apache License, Version 2.0."),
        (4, "a/x/y/two.txt", "and\nLicensed under CC BY-NC 4.0."),
        (5, "a/x/y/three.txt", None),
        (6, "a/b/four.txt", ""),
        (7, "c/five.txt", "the permission of a public domain was copying nothing at all here"),
        (8, None, "words"),
        (None, "a/b/four.txt", ""),
    ]
    files = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, path string, text string, license string")
    got = {r.doc_id: (r.license, r.basis, r.from_directory) for r in licenses.licenses(files).collect()}
    assert got == {
        1: ("MIT", "notice", None),
        2: ("Apache-2.0", "directory", "a/x"),
        3: ("Apache-2.0", "notice", None),
        4: ("CC-BY-NC-4.0", "notice", None),
        5: ("Apache-2.0", "directory", "a/x"),
        6: ("MIT", "directory", "a"),
        7: (None, "none", None),
        8: (None, "none", None),
        None: ("MIT", "directory", "a"),
    }
    assert licenses.licenses(files.limit(0)).count() == 0
    assert licenses.licenses(files.unionAll(files)).count() == 18


def test_every_planted_notice_is_found(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = {r.doc_id: r.license for r in queries.op7_licenses(spark, folder).where("basis = 'notice'").collect()}
    for name, notice in (("MIT", "Released under the MIT License."), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.")):
        assert {i for i, t in texts.items() if notice in t} == {i for i, x in found.items() if x == name}


def test_notice_inside_a_long_line():
    matcher = licenses.Matcher(1000, {"the": 900, "of": 900})
    line = "word " * 60 + "end. Licensed under CC BY-SA 4.0. " + "more " * 60
    assert matcher.notice(line)[0] == "CC-BY-SA-4.0"
    assert matcher.notice("The license of the town was lost " * 30)[0] is None


HEADERS = {
    "MPL-2.0": "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */",
    "GPL-2.0": "# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation; either version 2 of the License, or\n# (at your option) any later version.",
    "GPL-3.0": "    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU General Public License as published by\n    the Free Software Foundation, either version 3 of the License, or\n    (at your option) any later version.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.",
    "MIT": "// SPDX-License-Identifier: MIT\nint main() { return 0; }",
    "Apache-2.0": "# SPDX-License-Identifier: Apache-2.0",
}
BSD = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice.\n2. Redistributions in binary form must reproduce the above copyright notice.\n"
THIRD = "3. Neither the name of the copyright holder nor the names of its\ncontributors may be used to endorse or promote products derived from\nthis software without specific prior written permission.\n"


def test_wrapped_headers_versions_and_tags():
    matcher = licenses.Matcher(1000, {"the": 900, "of": 900, "and": 850, "or": 700, "this": 600, "is": 800})
    for name, header in HEADERS.items():
        for text in (header, "some words before it\n\n" + header + "\n\n" + "and code after it " * 50):
            assert matcher.notice(text)[0] == name, (name, matcher.notice(text))
    assert matcher.notice(BSD)[0] == "BSD-2-Clause" and matcher.notice(BSD + THIRD)[0] == "BSD-3-Clause"
    assert matcher.notice("SPDX-License-Identifier: Zlib")[0] is None
    assert matcher.notice("SPDX-License-Identifier: GPL-2.0-or-later")[0] == "GPL-2.0"


def test_cosine_is_that_of_plain_vectors():
    import math

    matcher = licenses.Matcher(50, {"the": 40, "license": 9, "of": 45})
    words = licenses.tokens("the terms of the mit license and of other words here")
    weight = lambda t: math.log(51 / ({"the": 40, "license": 9, "of": 45}.get(t, 0) + 1)) + 1
    vector = lambda ws: {t: ws.count(t) * weight(t) for t in ws}
    a = vector(words)
    best = 0.0
    for _, notice in licenses.TEMPLATES[: licenses.NOTICES]:
        b = vector(licenses.tokens(notice))
        best = max(best, sum(a[t] * b.get(t, 0) for t in a) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values())))
    assert abs(matcher.best(words)[0] - best) < 1e-8


def test_nearest_ancestor_against_a_plain_walk(spark):
    import random

    rng = random.Random(4)
    rows = [(0, "LICENSE", "Released under the MIT License.")]
    for i in range(1, 200):
        folder = "/".join(rng.choice("abc") for _ in range(rng.randrange(5)))
        kind = rng.random()
        name, text = ("LICENSE", rng.choice(["Licensed under CC BY 4.0.", "Licensed under the Apache License, Version 2.0."])) if kind < 0.1 else (f"f{i}", "words")
        rows.append((i, f"{folder}/{name}" if folder else name, text))
    rows = [r for r in rows if r[0] == 0 or r[1] != "LICENSE"]
    seen, kept = set(), []
    for r in rows:
        if r[1].endswith("LICENSE"):
            if r[1] in seen:
                continue
            seen.add(r[1])
        kept.append(r)
    named = {"Licensed under CC BY 4.0.": "CC-BY-4.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT"}
    granted = {p.rpartition("/")[0]: named[t] for _, p, t in kept if p.endswith("LICENSE")}
    got = {r.doc_id: (r.license, r.from_directory) for r in licenses.licenses(spark.createDataFrame(kept, "doc_id long, path string, text string")).collect()}
    for i, path, text in kept:
        if text == "words":
            folder = path.rpartition("/")[0]
            while folder not in granted:
                folder = folder.rpartition("/")[0]
            assert got[i] == (granted[folder], folder)
