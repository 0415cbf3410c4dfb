"""License scan: TF-IDF cosine to templates, then nearest-ancestor inheritance.

Templates are short statements, standard file headers and full license texts. Every
window of a template's length (the whole text, if it is shorter) is compared by
sparse TF-IDF cosine, across line ends and comment marks; the document frequencies of the
templates' words are counted over the whole table. A template is looked for only in texts with
one of its anchors: its heaviest words, taken until the others alone cannot reach the
threshold (Cauchy-Schwarz). There, running sums bound the cosine of all windows at once
(a window's norm is at least that of its words counted once each time they occur), and only
windows whose bound reaches the threshold are scored, so no window that reaches it is missed.
Words outside the templates weigh like a word found in one file. An SPDX license line
names its license itself, with score 1.

A licence file (by its name, or because matched windows make up most of it) declares
the license of its directory. Files without a license of their own inherit from their
nearest ancestor directory with a declaration, by a join of directory paths.

Cases: a null or empty text has no license; a null path stands for a file in the root
directory. Repeated rows are scanned one by one. Ties between templates go to the
longer one, then to the smaller license id. Of several licence files in a directory the best score declares, ties to the smaller license
id. Very long texts are scanned whole, in time linear in their words but for windows that
reach the threshold. An empty table gives an empty result. Other columns pass through, whatever their
names; added columns replace columns of the same name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lookup_join, materialize, quoted, remaining, unpacked

#: The usual short statements, standard headers and short license texts.
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
    "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_GNU_HEADER = (
    "This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software "
    "Foundation, either version {version} of the License, or (at your option) any later version. This {what} is distributed in the hope that it will be "
    "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for "
    "more details."
)
TEMPLATES: dict[str, list[str]] = {
    "AGPL-3.0": [
        "Licensed under the GNU Affero General Public License, version 3.",
        _GNU_HEADER.format(what="program", name="Affero General Public License", version=3),
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a '
        "copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed "
        'under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for '
        "the specific language governing permissions and limitations under the License.",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work "
        "for additional information regarding copyright ownership. The ASF licenses this file to You under the Apache License, Version 2.0",
    ],
    "BSD-2-Clause": [_BSD_CONDITIONS],
    "BSD-3-Clause": [
        "Use of this source code is governed by a BSD-style license.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        _BSD_CONDITIONS + "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission.",
    ],
    "CC-BY-4.0": ["Licensed under a Creative Commons Attribution 4.0 International License, CC BY 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright to this work, CC0 1.0."],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        _GNU_HEADER.format(what="program", name="General Public License", version=2),
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        _GNU_HEADER.format(what="program", name="General Public License", version=3),
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies."
    ],
    "LGPL-2.1": [_GNU_HEADER.format(what="library", name="Lesser General Public License", version="2.1")],
    "LGPL-3.0": [
        "Licensed under the GNU Lesser General Public License, version 3.",
        _GNU_HEADER.format(what="library", name="Lesser General Public License", version=3),
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, '
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS,
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You "
        "can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "Proprietary": ["All rights reserved."],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
}
THRESHOLD = 0.7
#: Share of a file's words in matched passages from which it is a licence file.
FILE_SHARE = 0.5
_WORD = re.compile(r"[^\W_]+")
_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*\(?([A-Za-z0-9.+-]+)")
_ADDED = ("own_license", "own_score", "license", "license_via", "license_dir")


def _words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def vocabulary(templates: dict[str, list[str]]) -> set[str]:
    return {w for texts in templates.values() for t in texts for w in _words(t)}


class Matcher:
    """Templates as weighted vectors with their anchors."""

    def __init__(self, templates: dict[str, list[str]], frequency: dict[str, int], n_files: int, threshold: float):
        self.threshold = threshold
        self.rare = math.log((1 + n_files) / 2) + 1
        self.idf = {w: math.log((1 + n_files) / (1 + frequency.get(w, 0))) + 1 for w in vocabulary(templates)}
        #: (license, words, vector, anchors) of every template, by license.
        self.templates: list[tuple[str, int, dict[str, float], set[str]]] = []
        for name, texts in sorted(templates.items()):
            for text in texts:
                words = _words(text)
                vector = {w: n * self.idf[w] for w, n in Counter(words).items()}
                norm = math.sqrt(sum(v * v for v in vector.values()))
                vector = {w: v / norm for w, v in vector.items()}
                anchors, rest = set(), 1.0
                for w, v in sorted(vector.items(), key=lambda x: (-x[1], x[0])):
                    if rest < threshold * threshold - 1e-9:
                        break
                    anchors.add(w)
                    rest -= v * v
                self.templates.append((name, len(words), vector, anchors))
        self.anchors = set().union(*(t[3] for t in self.templates)) if self.templates else set()

    def cosine(self, words: list[str], vector: dict[str, float]) -> float:
        """TF-IDF cosine of a passage and a template."""
        weights = {w: n * self.idf.get(w, self.rare) for w, n in Counter(words).items()}
        norm = math.sqrt(sum(v * v for v in weights.values()))
        return sum(v * vector[w] for w, v in weights.items() if w in vector) / norm if norm else 0.0

    def windows(self, words: list[str], idf: np.ndarray, template: tuple) -> list[tuple[float, int, int]]:
        """(cosine, first, end) of the windows that reach the threshold."""
        _, length, vector, _ = template
        n = min(length, len(words))
        sums = np.concatenate(([0.0], np.cumsum(idf * np.array([vector.get(w, 0.0) for w in words]))))
        squares = np.concatenate(([0.0], np.cumsum(idf * idf)))
        bound = (sums[n:] - sums[:-n]) / np.sqrt(squares[n:] - squares[:-n])
        found = []
        for at in np.nonzero(bound >= self.threshold - 1e-9)[0].tolist():
            cosine = self.cosine(words[at : at + n], vector)
            if cosine >= self.threshold:
                found.append((cosine, at, at + n))
        return found

    def scan(self, text: str | None) -> tuple[str | None, float, float]:
        """(license, score, share of words in matched windows) of one whole text."""
        words = _words(text)
        if not words:
            return None, 0.0, 0.0
        known = self.anchors.intersection(words)
        spdx = _SPDX.search(text)
        # By cosine, then by length: a text within a longer one is the longer one.
        best: tuple[float, float, str | None] = (1.0, math.inf, spdx.group(1)) if spdx else (0.0, 0, None)
        if not known:
            return best[2], best[0], 0.0
        idf = np.array([self.idf.get(w, self.rare) for w in words])
        covered = np.zeros(len(words), dtype=bool)
        for template in self.templates:
            if known.isdisjoint(template[3]):
                continue
            taken = np.zeros(len(words), dtype=bool)
            # Of overlapping windows the best one matches, then the first.
            for cosine, first, end in sorted(self.windows(words, idf, template), key=lambda x: (-round(x[0], 9), x[1])):
                if taken[first] or taken[end - 1]:
                    continue
                taken[first:end] = True
                score = min(round(cosine, 9), 1.0)
                if (score, template[1]) > best[:2]:
                    best = (score, template[1], template[0])
            covered |= taken
        return best[2], best[0], float(covered.mean())


def document_frequencies(files: DataFrame, known: set[str], text: str = "text") -> tuple[dict[str, int], int]:
    """Over all files: how many hold each word of a (bounded) vocabulary, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                counts[""] += 1
                counts.update(known.intersection(_words(value)))
        yield pa.RecordBatch.from_pydict({"word": list(counts), "n": pa.array(counts.values(), pa.int64())})

    rows = files.select(F.col(text).alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"]: r["n"] for r in rows}
    return found, found.pop("", 0)


def scan_licenses(
    files: DataFrame,
    path: str = "path",
    text: str = "text",
    templates: dict[str, list[str]] = TEMPLATES,
    threshold: float = THRESHOLD,
    file_share: float = FILE_SHARE,
) -> DataFrame:
    """Every row of ``files`` without its text, with ``own_license``, ``own_score``,
    ``license``, ``license_via`` (header, file, inherited or null) and ``license_dir``."""
    frequency, n_files = document_frequencies(files, vocabulary(templates), text)
    matcher = Matcher(templates, frequency, n_files, threshold)
    names = remaining(files, [text, *_ADDED])
    added = [("own_license", pa.string()), ("own_score", pa.float64()), ("_share", pa.float64())]
    # The row travels as one column, so its names meet none of those below.
    rows = files.select(F.struct(*quoted(remaining(files, [text]))).alias("_row"), F.col(path).alias("_path"), F.col(text).alias("_text"))
    schema = T.StructType([*(rows.schema[c] for c in ("_row", "_path")), T.StructField("own_license", T.StringType()), T.StructField("own_score", T.DoubleType()), T.StructField("_share", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [matcher.scan(t) for t in batch.column(2).to_pylist()]
            columns = [pa.array([f[i] for f in found], kind) for i, (_, kind) in enumerate(added)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["_row", "_path", *(n for n, _ in added)])

    scanned = rows.mapInArrow(run, schema)
    where = F.coalesce(F.col("_path"), F.lit(""))
    by_name = F.regexp_replace(where, "^.*/", "").rlike(r"(?i)^(licen[cs]e|copying|notice|unlicense)([.-].*)?$")
    is_file = F.col("own_license").isNotNull() & (by_name | (F.col("_share") >= file_share))
    scanned = scanned.withColumns({"_dir": F.regexp_extract(where, "^(.*)/[^/]*$", 1), "_file": is_file})
    scanned = materialize(scanned, "scanned")

    order = F.struct(-F.col("own_score"), F.col("own_license"))
    declared = scanned.filter("_file").groupBy("_dir").agg(F.min(order)["own_license"].alias("_license"))
    declared = materialize(declared.withColumnRenamed("_dir", "_above"), "declared")
    # Each directory once: its ancestors with itself and the root, which is ''.
    parts = F.split("_dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    dirs = scanned.select("_dir").distinct().select("_dir", F.posexplode(above).alias("_depth", "_above"))
    near = lookup_join(dirs, declared, ["_above"], "inner").groupBy("_dir")
    near = near.agg(F.max(F.struct("_depth", "_above", "_license")).alias("_near"))
    near = materialize(near.select("_dir", F.col("_near._above").alias("license_dir"), F.col("_near._license").alias("_license")), "nearest")
    joined = lookup_join(scanned, near, ["_dir"])
    own = F.col("own_license").isNotNull()
    via = F.when(F.col("_file"), "file").when(own, "header").when(F.col("_license").isNotNull(), "inherited")
    return joined.select(
        *unpacked(names),
        "own_license",
        "own_score",
        F.coalesce("own_license", "_license").alias("license"),
        via.alias("license_via"),
        F.when(~own, F.col("license_dir")).alias("license_dir"),
    )
