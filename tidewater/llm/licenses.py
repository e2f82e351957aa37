"""Licences of files: TF-IDF cosine of notices to templates, then inheritance from the nearest directory.

Every passage of a file that talks of licensing is compared with notice templates as a sparse TF-IDF vector; terms are weighted by how
few documents of the whole corpus have them. A file named like a licence file, or that is nothing but a notice, speaks for its
directory. A file without a notice of its own takes the licence of its nearest ancestor directory that has one. Paths are joined by
directory: distinct directories meet their ancestors, and files meet their directory's outcome.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import settle

# Licence identifiers with the customary notices and opening words of their texts.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    # the opening words that both texts share: the third clause, which stands above, wins where it is there
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("EPL-2.0", "This program is made available under the terms of the Eclipse Public License 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, all copyright and related rights are waived under CC0 1.0 Universal."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("Proprietary", "All rights reserved."),
)

# Identifiers of the one-line tag that name a licence otherwise than above.
TAG_NAMES = {f"{name}{end}": name for name in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for end in ("", "-only", "-or-later")}
_TAGS = {name: name for name, _ in TEMPLATES if name != "Proprietary"} | TAG_NAMES
NOTICES = len(TEMPLATES)
TEMPLATES += tuple((name, f"SPDX-License-Identifier: {tag}") for tag, name in _TAGS.items())

# What a passage must mention to be compared, and names of licence files.
MENTIONS = re.compile(r"licen[cs]e|copyright|copying|redistribut|rights reserved|public domain|permission|spdx|free software|\bcc0?[ -]", re.IGNORECASE)
LICENSE_FILE = "(?i)^(licen[cs]e|copying|notice|unlicense)([._-].*)?$"

#: Least cosine of a notice; of a one-line tag, whose identifier must be right; tokens of a passage, which overlap by half.
LEAST_COSINE = 0.6
LEAST_TAG = 0.95
PASSAGE = 40

_TOKEN = re.compile(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*")


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


VOCABULARY = sorted({t for _, notice in TEMPLATES for t in tokens(notice)})


def document_frequencies(docs: DataFrame) -> tuple[int, dict[str, int]]:
    """(documents, documents with each term of the templates), over all of ``docs``; one number for each term comes to the driver."""
    known = set(VOCABULARY)

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, rows = Counter(), 0
        for frame in batches:
            rows += len(frame)
            for text in frame["text"]:
                seen.update(known.intersection(w.strip(".,;:()\"'") for w in text.lower().split()))
        yield pd.DataFrame({"term": ["", *seen], "n": [rows, *seen.values()]})

    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    sums = {r.term: r.n for r in texts.mapInPandas(counts, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return sums.pop("", 0), sums


class Matcher:
    """Cosines of passages with the templates. Terms that no template has weigh as if no document had them."""

    def __init__(self, documents: int, frequencies: dict[str, int]):
        self.rare = math.log(documents + 1) + 1
        self.idf = {t: math.log((documents + 1) / (frequencies.get(t, 0) + 1)) + 1 for t in VOCABULARY}
        self.column = {t: i for i, t in enumerate(VOCABULARY)}
        self.table = np.zeros((len(TEMPLATES), len(VOCABULARY)))
        for row, (_, notice) in enumerate(TEMPLATES):
            for t, n in Counter(tokens(notice)).items():
                self.table[row, self.column[t]] = n * self.idf[t]
        self.table /= np.linalg.norm(self.table, axis=1, keepdims=True)
        self.openings: dict[tuple[str, str], set[int]] = {}
        for _, notice in TEMPLATES[:NOTICES]:
            words = tokens(notice)
            self.openings.setdefault((words[0], words[1]), set()).add(len(words))

    def best(self, words: list[str]) -> tuple[float, int]:
        """The greatest cosine of a passage and the template it is with, the first on ties; tags count from ``LEAST_TAG`` on."""
        counts = Counter(words)
        at = [(self.column[t], n * self.idf[t]) for t, n in counts.items() if t in self.column]
        if not at:
            return 0.0, 0
        norm = math.sqrt(sum(v * v for _, v in at) + sum((n * self.rare) ** 2 for t, n in counts.items() if t not in self.column))
        scores = np.round(self.table[:, [c for c, _ in at]] @ np.array([v for _, v in at]) / norm, 9)
        scores[NOTICES:][scores[NOTICES:] < LEAST_TAG] = 0.0
        row = int(np.argmax(scores))
        return min(1.0, float(scores[row])), row

    def passages(self, text: str) -> Iterator[list[str]]:
        """What is compared, by what mentions licensing: lines and sentences, passages of ``PASSAGE`` tokens across line breaks, and where a template's first two tokens stand, as many tokens as it has."""
        for line in text.split("\n"):
            if MENTIONS.search(line):
                words = tokens(line)
                if len(words) <= PASSAGE:
                    yield words
                if len(words) > PASSAGE // 2:
                    for part in re.split(r"(?<=[.!?])\s+", line):
                        if MENTIONS.search(part) and len(words := tokens(part)) <= 2 * PASSAGE:
                            yield words
        found = list(_TOKEN.finditer(text.lower()))
        words, starts = [m.group() for m in found], [m.start() for m in found]
        half = PASSAGE // 2
        blocks = {max(0, bisect_right(starts, m.start()) - 1) // half for m in MENTIONS.finditer(text)}
        for block in sorted(blocks | {b - 1 for b in blocks if b}):
            yield words[block * half : block * half + PASSAGE]
        for i, pair in enumerate(zip(words, words[1:])):
            for n in self.openings.get(pair, ()):
                yield words[i : i + n]

    def notice(self, text: str) -> tuple[str | None, float, bool]:
        """(licence, cosine, whether the text is nothing but the notice) of the best passage, the first template on ties; (None, 0.0, False) without one."""
        if not MENTIONS.search(text):
            return None, 0.0, False
        best, size = (0.0, 0), 0
        for words in self.passages(text):
            found = self.best(words)
            if (-found[0], found[1], -len(words)) < (-best[0], best[1], -size):
                best, size = found, len(words)
        if best[0] < LEAST_COSINE:
            return None, 0.0, False
        return TEMPLATES[best[1]][0], best[0], len(tokens(text)) <= size


def notices(files: DataFrame, matcher: Matcher) -> DataFrame:
    """(doc_id, path, own_license, cosine, whole) of each row of ``files`` (doc_id, path, text)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            found = [matcher.notice(text) for text in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "path": frame["path"], "own_license": [x[0] for x in found], "cosine": [x[1] for x in found], "whole": [x[2] for x in found]})

    texts = files.select(F.col("doc_id").cast("long").alias("doc_id"), "path", F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInPandas(rows, "doc_id long, path string, own_license string, cosine double, whole boolean")


def licenses(files: DataFrame) -> DataFrame:
    """(doc_id, path, license, cosine, basis, from_directory) of each row of ``files`` (doc_id, path, text; others are left out).

    basis: ``notice`` (its own), ``directory`` (inherited; from_directory tells from which, cosine is that of its licence file) or
    ``none``. Several licence files in a directory: the greatest cosine counts, then the least licence name. A missing path is in no
    directory and inherits nothing; a missing text is empty. Repeated rows come out repeatedly.
    """
    found = settle(notices(files, Matcher(*document_frequencies(files))), "license-notices")
    parts = F.split("path", "/")
    found = found.withColumns({"dir": F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/"), "name": F.element_at(parts, -1)})
    speaks = F.col("own_license").isNotNull() & (F.col("name").rlike(LICENSE_FILE) | F.col("whole"))
    granted = found.where(speaks & F.col("dir").isNotNull()).groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("minus"), "own_license")).alias("best"))
    granted = granted.select(F.col("dir").alias("ancestor"), F.col("best.own_license").alias("dir_license"), (-F.col("best.minus")).alias("dir_cosine"))
    dirs = found.where("dir is not null").select("dir").distinct()
    steps = F.split("dir", "/")
    up = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))).alias("ancestor"))
    nearest = up.join(granted, "ancestor").groupBy("dir").agg(F.max_by(F.struct("dir_license", "dir_cosine", "ancestor"), F.length("ancestor")).alias("near"))
    own = F.col("own_license").isNotNull()
    # one row at most: the licence of the topmost directory, for all that have no nearer one
    top = granted.where("ancestor = ''").agg(F.first(F.struct("dir_license", "dir_cosine", "ancestor")).alias("top"))
    out = found.join(nearest, "dir", "left").crossJoin(F.broadcast(top))
    out = out.withColumn("near", F.coalesce("near", F.when(F.col("dir").isNotNull(), F.col("top"))))
    basis = F.when(own, "notice").when(F.col("near").isNotNull(), "directory").otherwise("none")
    return out.select("doc_id", "path", F.coalesce("own_license", "near.dir_license").alias("license"), F.when(own, F.col("cosine")).otherwise(F.coalesce("near.dir_cosine", F.lit(0.0))).alias("cosine"), basis.alias("basis"), F.when(~own, F.col("near.ancestor")).alias("from_directory"))
