"""License scans: sparse TF-IDF cosine of notices to templates, then inheritance from the nearest ancestor directory.

Units compared with the templates are the lines of a text, its paragraphs, and for licence files (by name) the whole
text, whose answer goes before those of its parts. Document frequencies of all words are counted over all files in a hashed table of fixed size. Units without any
*cue* are skipped without loss: a template's cues are its heaviest words, as many as needed for the others to stay below the
threshold even if a unit held all of them (Cauchy-Schwarz).

A licence found in a licence file holds for its directory. A file without a licence of its own gets that of the nearest
ancestor directory that has one: directories (not files) are expanded to their ancestors and joined by path; then files
join their directory's answer. That join's one side has a row for each directory, so a directory with very many files
is split by AQE.

Edge cases: null and empty texts have no licence of their own; null paths inherit nothing; of several licence files in a
directory the highest cosine holds, ties to the licence that sorts first; repeated rows are each answered; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored
from .neardup import Options, document_frequencies
from .shingles import shingles, words

#: Identifiers and names under which licences are referred to.
NAMES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache 2.0 License"),
    "MIT": ("MIT License",),
    "GPL-3.0": ("GNU General Public License, version 3", "GPLv3"),
    "GPL-2.0": ("GNU General Public License, version 2", "GPLv2"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPLv3"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPLv3"),
    "MPL-2.0": ("Mozilla Public License, version 2.0",),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "ISC": ("ISC License",),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC0-1.0": ("CC0 1.0", "Creative Commons Zero 1.0 Universal"),
    "Unlicense": ("The Unlicense",),
}
#: Customary notices around a name.
FRAMES = ("Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.", "Distributed under the terms of the {}.", "SPDX-License-Identifier: {}", "Licensed under {}.")
#: Opening passages of licence texts and customary headers.
TEXTS = {
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_CLAUSE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
#: Whole texts, clauses and headers that tell apart licences which share passages.
MORE = {
    "BSD-2-Clause": (_BSD + _BSD_END, _BSD),
    "BSD-3-Clause": (_BSD + "3. " + _BSD_CLAUSE + " " + _BSD_END, _BSD + "3. " + _BSD_CLAUSE, _BSD_CLAUSE),
    "AGPL-3.0": (_GNU.format("Affero", "3"),),
    "LGPL-3.0": (_GNU.format("Lesser", "3"), "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    "LGPL-2.1": (_GNU.format("Lesser", "2.1"),),
}
#: A licence whose text holds all of another's: where both are found in a file, it is the file's.
WIDER = {"BSD-2-Clause": "BSD-3-Clause"}
_LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense)[^/]*$"
_OPTIONS = Options(width=1)


def templates() -> list[tuple[str, str]]:
    out = [(k, f.format(k if "SPDX" in f else n)) for k, names in NAMES.items() for n in names for f in FRAMES]
    return sorted({*out, *TEXTS.items(), *((k, t) for k, texts in MORE.items() for t in texts)})


#: Runs of lines that begin as comments of common languages do, enclosed comments, and lines of comments without text.
_COMMENTS = re.compile(r"(?:^[ \t]*(?:#|//|\*|;|--|%|!|dnl\b|rem\b)[^\n]*(?:\n|\Z))+", re.M)
_ENCLOSED = re.compile(r"/\*.*?\*/|<!--.*?-->|\"\"\".*?\"\"\"", re.S)
_COMMENT_GAP = re.compile(r"^[ \t]*(?:#+|//+|\*+|;+|--+|%+|!+|dnl|rem)?[ \t]*\n", re.M)


class Matcher:
    """Template vectors over the hashed words of a corpus."""

    def __init__(self, cells: np.ndarray, n: int, threshold: float):
        self.threshold, self.o = threshold, _OPTIONS
        self.idf = np.log((1 + n) / (1 + np.minimum(cells, n))) + 1
        pairs = templates()
        self.names = [k for k, _ in pairs]
        who, h, w = self.vectors([t for _, t in pairs])
        self.terms = np.unique(h)
        self.matrix = np.zeros((len(self.terms), len(pairs)))
        self.matrix[np.searchsorted(self.terms, h), who] = w
        cues: set[str] = set()
        for k, (_, text) in enumerate(pairs):
            own = sorted({x for x in re.findall(r"[a-z0-9]+", text.lower())})
            _, oh, _ = self.vectors(own)
            weight = self.matrix[np.searchsorted(self.terms, oh), k]
            order = np.argsort(-weight, kind="stable")
            rest = np.sqrt(np.maximum(1 - np.cumsum(weight[order] ** 2), 0))
            cues.update(own[i] for i in order[: int(np.argmax(rest < threshold)) + 1])
        self.cue = re.compile(r"(?<![a-z0-9])(?:" + "|".join(sorted(cues)) + r")(?![a-z0-9])")

    def vectors(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit-length sparse rows."""
        who, h, tf = shingles(*words(pa.array(texts, pa.string())), 1)
        w = tf * self.idf[(h >> np.uint64(64 - self.o.bits)).astype(np.int64)]
        norm = np.sqrt(np.bincount(who, w * w, minlength=len(texts)))
        return who, h, w / norm[who]

    def units(self, text: str, whole: bool) -> list[str]:
        low = text.lower()
        if not self.cue.search(low):
            return []
        out = [p for p in low.split("\n") if self.cue.search(p)]
        out += [p for p in re.split(r"\n\s*\n", low) if "\n" in p.strip() and self.cue.search(p)]
        # comments that code follows without an empty line: whole, and their paragraphs
        for block in (*(m[0] for m in _COMMENTS.finditer(low)), *(m[0] for m in _ENCLOSED.finditer(low))):
            if "\n" in block.strip() and self.cue.search(block):
                out.append(block)
                out += [p for p in _COMMENT_GAP.split(block) if "\n" in p.strip() and p != block and self.cue.search(p)]
        return [*out, low] if whole else out

    def best(self, texts: list[str]) -> list[tuple[str, float]]:
        """The template's licence and cosine for each unit; ties go to the first in order."""
        who, h, w = self.vectors(texts)
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        known = self.terms[at] == h
        scores = np.zeros((len(texts), len(self.names)))
        np.add.at(scores, who[known], w[known, None] * self.matrix[at[known]])
        top = np.round(scores, 12).argmax(axis=1)
        return [(self.names[k], float(scores[i, k])) for i, k in enumerate(top)]


def _answer(found: dict[str, tuple[bool, float]]) -> tuple[str | None, float]:
    """The licence of the whole file, else of the best unit; ties to the one that sorts first."""
    if not found:
        return None, 0.0
    name = min(found, key=lambda k: (found[k][0], -round(found[k][1], 9), k))
    if WIDER.get(name) in found:
        name = WIDER[name]
    return name, found[name][1]


def _scanner(cells: np.ndarray, n: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(cells, n, threshold)
        for batch in slices(batches, "text", 2 << 20):
            # of each file and licence the best unit: whether it isn't the whole file, and the score
            found: list[dict[str, tuple[bool, float]]] = [{} for _ in range(batch.num_rows)]
            owner, units = [], []

            def flush() -> None:
                for (i, part), (name, score) in zip(owner, m.best(units), strict=True) if units else ():
                    if score >= threshold and (name not in found[i] or (part, -score) < (found[i][name][0], -found[i][name][1])):
                        found[i][name] = (part, score)
                owner.clear(), units.clear()

            for i, (text, whole) in enumerate(zip(batch.column("text").to_pylist(), batch.column("is_licence").to_pylist(), strict=True)):
                mine = m.units(text, bool(whole)) if text else []
                owner += [(i, not (whole and k == len(mine) - 1)) for k in range(len(mine))]
                units += mine
                if len(units) > 2000:
                    flush()
            flush()
            found = [_answer(f) for f in found]
            yield pa.RecordBatch.from_arrays([batch.column("file_id"), batch.column("path"), batch.column("is_licence"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["file_id", "path", "is_licence", "own", "score"])

    return run


def scan(files: DataFrame, threshold: float = 0.75) -> DataFrame:
    """file_id, path, is_licence, own (licence or null), score. ``files``: file_id, path, text."""
    rows = files.select(F.col("file_id").cast("long").alias("file_id"), F.col("path").alias("path"), F.col("text").alias("text"))
    cells, n = document_frequencies(rows, _OPTIONS)
    named = rows.withColumn("is_licence", F.coalesce(F.col("path").rlike(_LICENCE_FILE), F.lit(False)))
    return named.mapInArrow(_scanner(cells, n, threshold), "file_id long, path string, is_licence boolean, own string, score double")


def inherit(scanned: DataFrame) -> DataFrame:
    """Adds license and inherited_from: the file's own licence, else that of the nearest ancestor directory."""
    parent = F.when(F.locate("/", F.col("path")) > 0, F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).otherwise(F.when(F.col("path").isNotNull(), F.lit("")))
    scanned = stored(scanned.withColumn("dir", parent), "scanned")
    holders = scanned.where("is_licence AND own IS NOT NULL").groupBy(F.col("dir").alias("ancestor")).agg(F.min(F.struct((-F.col("score")).alias("s"), "own")).alias("best"))
    holders = holders.select("ancestor", F.col("best.own").alias("license"))
    dirs = scanned.where("dir IS NOT NULL").select("dir").distinct()
    parts = F.split("dir", "/")
    depth = F.when(F.col("dir") == "", F.lit(0)).otherwise(F.size(parts))
    chain = dirs.select("dir", F.explode(F.sequence(F.lit(0), depth)).alias("depth"))
    chain = chain.withColumn("ancestor", F.when(F.col("depth") == 0, F.lit("")).otherwise(F.array_join(F.slice(parts, F.lit(1), F.greatest(F.col("depth"), F.lit(1))), "/")))
    answers = chain.join(holders, "ancestor").groupBy("dir").agg(F.max(F.struct("depth", "ancestor", "license")).alias("near")).select("dir", "near.ancestor", F.col("near.license").alias("_license"))
    out = scanned.join(answers, "dir", "left")
    return out.select("file_id", "path", "own", "score", F.coalesce("own", "_license").alias("license"), F.when(F.col("own").isNull(), F.col("ancestor")).alias("inherited_from"))
