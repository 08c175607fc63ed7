"""Licence scan: Dice's coefficient over word bigrams between stretches of a text and licence templates.

Text is normalised to lower-case words and numbers without punctuation or line ends, so it does not
matter how a notice is wrapped or led in. A text's bigrams that a template has say where the template
would begin and end, if they were the same part of it; a stretch between is compared only if its size
allows the wanted coefficient, 2 min(a, b) / (a + b) >= least, and if enough of its bigrams are known.
Tags of SPDX are too short for coefficients: most of their words are the tag's own, so identifiers are compared.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.llm import textblocks
from ridgeline.llm.tuning import small_batches

# Notices by which texts state their licence, and short licences whole.
AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
HOLDERS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
BSD_2 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_3 = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        MIT,
        f"{MIT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {AS_IS}",
    ],
    "BSD-2-Clause": [f"{BSD_2} {HOLDERS}"],
    "BSD-3-Clause": [
        f"{BSD_2}{BSD_3} {HOLDERS}",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "ISC": [ISC],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
}

# How the files of whole licences begin.
FSF = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
HEADS = {
    "Apache-2.0": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "GPL-3.0": f"GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> {FSF}",
    "GPL-2.0": f"GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA {FSF}",
    "LGPL-3.0": f"GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> {FSF}",
    "AGPL-3.0": f"GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> {FSF}",
    "MPL-2.0": 'Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.',
}
for _name, _head in HEADS.items():
    TEMPLATES[_name].append(_head)

#: A tag states its licence by an identifier, which must be one of these as a whole.
TAG = b"spdx-license-identifier:"
IDENTIFIERS = {name.lower(): name for name in TEMPLATES} | {f"{name}{more}".lower(): name for name in ("GPL-2.0", "GPL-3.0", "LGPL-3.0", "AGPL-3.0") for more in ("-only", "-or-later", "+")}


def tagged(text: bytes) -> list[tuple[str, int]]:
    """Licence and line (from 1) of each identifier of a lower-cased text's tags that is known; an expression may hold several."""
    out, at = [], text.find(TAG)
    while at >= 0:
        end = text.find(b"\n", at)
        line = text.count(b"\n", 0, at) + 1
        stated = text[at + len(TAG) : end if end >= 0 else len(text)]
        out += [(IDENTIFIERS[x.decode()], line) for x in re.findall(rb"[a-z0-9.+-]+", stated) if x.decode() in IDENTIFIERS]
        at = text.find(TAG, at + 1)
    return out


#: What parts words: white space and ASCII punctuation.
PARTS = textblocks.SPACE.copy()
PARTS[[b for b in range(128) if not chr(b).isalnum()]] = True


class Templates:
    """Bigrams of templates, by hash: which templates have one, and at which place first."""

    def __init__(self, templates: dict[str, list[str]], least: float):
        self.least = least
        self.names = [name for name, texts in templates.items() for _ in texts]
        sequences: list[np.ndarray] = []
        for block in textblocks.blocks(pa.array([t for texts in templates.values() for t in texts], pa.string()), PARTS):
            found, bounds = textblocks.runs(block.hashes(), block.words, 2)
            sequences += [found[bounds[i] : bounds[i + 1]] for i in range(len(bounds) - 1)]
        firsts = [np.unique(x, return_index=True) for x in sequences]
        self.sets = [keys for keys, _ in firsts]
        self.sizes = np.array([len(keys) for keys in self.sets])
        self.lengths = np.array([len(x) for x in sequences])
        keys = np.concatenate([keys for keys, _ in firsts]) if firsts else np.zeros(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.of = np.concatenate([np.full(len(k), i) for i, (k, _) in enumerate(firsts)])[order] if firsts else np.zeros(0, int)
        self.place = np.concatenate([at for _, at in firsts])[order] if firsts else np.zeros(0, int)

    def dice(self, part: np.ndarray, i: int) -> float:
        own = np.unique(part)
        return 2.0 * len(np.intersect1d(own, self.sets[i], assume_unique=True)) / (len(own) + self.sizes[i])

    def notices(self, grams: np.ndarray) -> list[tuple[int, float, int, int]]:
        """template, coefficient, start, end of the notices in a text's bigrams, in order: of stretches that overlap the best one."""
        lo, hi = np.searchsorted(self.keys, grams, "left"), np.searchsorted(self.keys, grams, "right")
        hits = np.repeat(np.arange(len(grams)), hi - lo)
        if not len(hits):
            return []
        which = np.concatenate([np.arange(a, b) for a, b in zip(lo[hi > lo], hi[hi > lo], strict=True)])
        found = []
        order = np.argsort(self.of[which], kind="stable")  # by template, then by place in the text
        bounds = np.searchsorted(self.of[which][order], np.arange(len(self.names) + 1))
        for i in np.flatnonzero(2 * np.diff(bounds) >= self.least * self.sizes):
            some = order[bounds[i] : bounds[i + 1]]
            at, place = hits[some], self.place[which[some]]
            start = np.maximum(at - place, 0)
            end = np.minimum(start + self.lengths[i], len(grams))
            shared = np.searchsorted(at, end) - np.searchsorted(at, start)  # at least as many as distinct ones
            size = self.sizes[i]
            starts = np.unique(start[2 * shared >= self.least * (size + np.minimum(shared, size))])
            for s in starts.tolist():
                e = min(s + int(self.lengths[i]), len(grams))
                own = np.searchsorted(at, [s, e])
                a, b = int(at[own[0]]), int(at[own[1] - 1]) + 1  # without what stands around the known bigrams
                for x, y in {(s, e), (a, b)}:
                    if 2 * min(y - x, size) >= self.least * (min(y - x, size) + size):
                        d = self.dice(grams[x:y], i)
                        if d >= self.least:
                            found.append((-float(d), int(i), x, y))
        taken: list[tuple[int, float, int, int]] = []
        for d, i, x, y in sorted(found, key=lambda f: (f[0], f[2] - f[3], f[2], f[1])):
            if all(y <= t[2] or x >= t[3] for t in taken):
                taken.append((i, -d, x, y))
        return sorted(taken, key=lambda t: t[2])


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, licence, dice, line, notices, found for each row of docs.

    found: the licence, coefficient, first and last line (from 1) of every notice, in order; a
    notice is a stretch of words that reaches `least` with a template, and of stretches that overlap
    the best one, of equal ones the longest, then the first, then the first template. notices: how many. licence,
    dice and line are those of the best. A tag of SPDX is a notice if its identifier is that of a
    template's licence as a whole, with coefficient 1; other identifiers give nothing. Null without notices, as for null and empty texts. Lines
    are those between \\n. Rows that repeat get equal results; a null id is kept; an empty table
    gives no rows; other columns are not looked at.
    """
    small_batches(docs.sparkSession)
    known = Templates(templates or TEMPLATES, least)
    names = set(known.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in textblocks.blocks(batch.column(1), PARTS):
                grams, bounds = textblocks.runs(block.hashes(), block.words, 2)
                newline = np.flatnonzero(block.data == 10)
                whole = block.data.tobytes()
                tags, rows = TAG in whole, []
                for t in range(len(bounds) - 1):
                    own = []
                    for i, d, x, y in known.notices(grams[bounds[t] : bounds[t + 1]]):
                        first = int(block.starts[block.words[t] + x])
                        last = int(block.starts[min(block.words[t] + y, block.words[t + 1] - 1)])
                        before = int(np.searchsorted(newline, block.offsets[t]))
                        lines = np.searchsorted(newline, [first, last]) - before + 1
                        own.append({"licence": known.names[i], "dice": d, "line": int(lines[0]), "last": int(lines[1])})
                    if tags:
                        stated = [(n, x) for n, x in tagged(whole[block.offsets[t] : block.offsets[t + 1]]) if n in names]
                        own = sorted([*own, *({"licence": n, "dice": 1.0, "line": x, "last": x} for n, x in stated)], key=lambda r: r["line"])
                    rows.append(own)
                best = [max(r, key=lambda x: x["dice"]) if r else {} for r in rows]
                ids = batch.column(0).slice(block.first, len(rows))
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.array([b.get(c) for b in best], k) for c, k in (("licence", pa.string()), ("dice", pa.float64()), ("line", pa.int64()))), pa.array([len(r) for r in rows], pa.int64()), pa.array(rows, kind)],
                    names=[id_col, "licence", "dice", "line", "notices", "found"],
                )

    kind = pa.list_(pa.struct([("licence", pa.string()), ("dice", pa.float64()), ("line", pa.int64()), ("last", pa.int64())]))
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), *T.StructType.fromDDL("licence string, dice double, line long, notices long, found array<struct<licence:string,dice:double,line:long,last:long>>").fields]
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, T.StructType(fields))
