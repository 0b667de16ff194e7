"""License scans: a trained paragraph classifier.

A paragraph is a line, with the lines that a hard wrap continued: those after a
line of WRAPPED characters without an end of sentence. A logistic regression
over sparse word 1- and 2-grams tells licence families from each other, from
unknown licence wording and from ordinary text. It is trained on paragraphs of
the licences below, on short notices made by rule of their names, and on a
bounded sample of the corpus as ordinary text. Probabilities are calibrated by
a temperature fitted on notices held out whole: wordings, and licences without
a family, that training never sees. A family below LEAST_PROBABILITY is called
unknown. A prediction is confirmed where the paragraph and a template share
enough word 3-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import least_hashes, texts_of
from .tokens import text_batches
from .words import data_of, gram_hashes, lower_table, span_hashes, spans, word_table

#: Documents at most whose paragraphs stand for ordinary text, those with the least hashes of doc_id.
SAMPLE_DOCS, SAMPLE_PARAGRAPHS = 300, 1500
LEAST_PROBABILITY, LEAST_SHARED = 0.6, 0.5
#: Bytes of a line that a hard wrap may have ended.
WRAPPED = (40, 120)
NONE, UNKNOWN = "none", "unknown"
# Names of licence families, and paragraphs of their public texts.
NAMES = {
    "agpl": ["GNU Affero General Public License", "GNU AGPL v3", "AGPL-3.0"],
    "apache": ["Apache License, Version 2.0", "Apache 2.0 license", "Apache-2.0"],
    "boost": ["Boost Software License, Version 1.0", "Boost Software License", "BSL-1.0"],
    "bsd": ["BSD 3-Clause License", "BSD license", "BSD 2-Clause License", "BSD-3-Clause"],
    "cc": [
        "Creative Commons Attribution 4.0 International License", "Creative Commons CC BY license", "CC BY-NC 4.0", "CC BY-SA 3.0",
        "Creative Commons Attribution-ShareAlike License", "CC-BY-4.0",
    ],
    "epl": ["Eclipse Public License 2.0", "Eclipse Public License v1.0", "EPL-2.0"],
    "gpl": ["GNU General Public License, version 3", "GNU GPL v2 or later", "GNU General Public License", "GPL-3.0"],
    "isc": ["ISC License", "ISC license"],
    "lgpl": ["GNU Lesser General Public License", "GNU LGPL v2.1", "LGPL-3.0"],
    "mit": ["MIT License", "MIT license", "Expat license"],
    "mpl": ["Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL-2.0"],
    "publicdomain": ["Unlicense", "CC0 1.0 Universal Public Domain Dedication", "public domain"],
    "zlib": ["zlib License", "zlib/libpng license"],
}
PARAGRAPHS = {
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
    ],
    "boost": [
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ],
    "cc": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.",
    ],
    "epl": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "publicdomain": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "zlib": [
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    ],
    UNKNOWN: [
        "All rights reserved.", "Licensed under the terms of the accompanying agreement.", "Use of this work is subject to a separate license.",
        "This license applies to all copies of the work.", "Released under a proprietary license.", "See the license file for terms.",
        "No part of this publication may be reproduced without the prior written permission of the publisher.",
    ],
}
# Licences without a family of their own, for training and held out.
OTHERS = ["Artistic License 2.0", "Common Development and Distribution License", "European Union Public Licence 1.2", "Acme Public License", "Sample Vendor License", "Python Software Foundation License 2.0", "Open Data Commons License 1.0", "Academic Free License 3.0", "Vendor Source License 1.1"]
OTHERS_HELD = ["SIL Open Font License 1.1", "Microsoft Reciprocal License", "Example Source License 1.0"]
NOTICES = ["Released under the {}.", "Licensed under the {}.", "This project is available under the {}.", "This work is licensed under the {}.", "{}", "Distributed under the terms of the {}.", "License: {}", "Licensed under {}."]
NOTICES_HELD = ["Made available under the terms of the {}.", "The {} applies to this file.", "Published under the {}."]
# Ordinary sentences that use words of licences.
PROSE = [
    "She renewed her driving license last week.", "The bar lost its liquor license in May.", "Researchers at MIT released a new study under pressure.", "The Apache helicopter landed near the river.",
    "Permission to enter the building was denied.", "The mozilla crowd met in the public library.", "He wrote the software for the general public.", "Copies of the report were distributed free of charge.",
    "The eclipse was visible in public places.", "The gnu is a kind of antelope.", "Creative people in common rooms talk a lot.", "The terms of the agreement were read aloud.", "A license was granted to the MIT fishing club, which released the trout.",
]
PROSE_HELD = ["The version of the story that was released is free of errors.", "He has the right to use the boat without a license.", "Public domain names are sold by the author.", "You may not enter except with permission."]
AROUND = ["", "notice: ", "copyright 2020 the authors. ", "this file is part of the project. ", "note that it is ", "source code: "]
_WORDS = word_table("0123456789abcdefghijklmnopqrstuvwxyz")
_BITS = 20


def _heads(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where paragraphs begin, and where lines do."""
    lines = np.union1d(offsets[:-1], np.flatnonzero(low == 10) + 1)
    lines = lines[lines < max(len(low), 1)] if len(low) else lines
    if len(lines) < 2:
        return lines, lines
    # The last byte of the line before that is not blank, by its position.
    solid = np.flatnonzero((low != 10) & (low != 13) & (low != 32))
    at = np.searchsorted(solid, lines[1:]) - 1
    last = np.where(at >= 0, solid[np.maximum(at, 0)] if len(solid) else 0, 0)
    size = lines[1:] - 1 - lines[:-1]
    blank = np.diff(np.searchsorted(solid, np.append(lines, len(low)))) == 0
    wrapped = (last >= lines[:-1]) & (size >= WRAPPED[0]) & (size <= WRAPPED[1]) & ~np.isin(low[np.minimum(last, len(low) - 1)], np.frombuffer(b".!?:", np.uint8)) & ~blank[1:] & ~np.isin(lines[1:], offsets)
    return lines[np.concatenate([[True], ~wrapped])], lines


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words and pairs of words in one paragraph, with the paragraph of
    each; the text of each paragraph; its first byte there, its end, and its line number."""
    data, offsets = data_of(texts)
    low = lower_table()[data]
    heads, lines = _heads(low, offsets)
    starts, ends, _ = spans(_WORDS[low], offsets)
    words = span_hashes(low, starts, ends)
    paragraph = np.searchsorted(heads, starts, side="right") - 1
    pairs = gram_hashes(words, 2)
    same = paragraph[1:] == paragraph[:-1] if len(words) > 1 else np.zeros(0, bool)
    owner = np.clip(np.searchsorted(offsets, heads, side="right") - 1, 0, max(len(texts) - 1, 0))
    own = offsets[owner] if len(texts) else heads
    line = np.searchsorted(lines, heads) - np.searchsorted(lines, own)
    ends = np.minimum(np.append(heads[1:], len(data)), offsets[owner + 1]) if len(texts) else heads
    return np.concatenate([words, pairs[same]]), np.concatenate([paragraph, paragraph[:-1][same]]), owner, np.stack([heads - own, ends - own, line])


class Model(NamedTuple):
    """known: sorted hashes of n-grams; weights by n-gram and family; classes."""

    known: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    classes: list[str]

    def table(self) -> np.ndarray:
        out = np.zeros(1 << _BITS, dtype=bool)
        out[(self.known >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        return out


def _counts(known: np.ndarray, hashes: np.ndarray, owner: np.ndarray, n: int, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions in `known` and owners of the hashes that are known."""
    if table is not None:
        maybe = table[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)]
        hashes, owner = hashes[maybe], owner[maybe]
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    hit = known[at] == hashes
    return at[hit], owner[hit]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def examples(held: bool) -> list[tuple[str, str]]:
    """(text, class) of the notices that training sees, or of those held out."""
    names = {**NAMES, UNKNOWN: OTHERS_HELD if held else OTHERS}
    made = [(pattern.format(name), k) for k, each in names.items() for pattern in (NOTICES_HELD if held else NOTICES) for name in each]
    if held:
        return [*made, *[(p.format(n), UNKNOWN) for p in NOTICES for n in OTHERS_HELD], *[(t, NONE) for t in PROSE_HELD]]
    return [*made, *[(t, k) for k, ts in PARAGRAPHS.items() for t in ts for _ in range(3)], *[(t, NONE) for t in PROSE for _ in range(3)]]


def train(ordinary: list[str], rounds: int = 500) -> Model:
    """Fit on the notices in varying surroundings and the ordinary paragraphs; one of five
    of those, and the notices held out, fit the temperature."""
    classes = [NONE, *NAMES, UNKNOWN]
    seen, held = examples(False), examples(True)
    rows = [(AROUND[i % len(AROUND)] + t, k) for i, (t, k) in enumerate([*seen, *held])]
    rows += [(t.replace("\n", " "), NONE) for t in ordinary] + [(a or "text", NONE) for a in AROUND]
    out = np.zeros(len(rows), bool)
    out[len(seen) : len(seen) + len(held)] = True
    out[len(seen) + len(held) : len(seen) + len(held) + len(ordinary) : 5] = True
    hashes, owner, _, _ = _grams(pa.array([t for t, _ in rows]))
    known = np.unique(hashes[owner < len(seen)])
    x = np.zeros((len(rows), len(known)), np.float32)
    at, who = _counts(known, hashes, owner, len(rows))
    np.add.at(x, (who, at), 1.0)
    x /= np.sqrt(np.maximum((x**2).sum(axis=1, keepdims=True), 1)) / 2
    y = np.eye(len(classes), dtype=np.float32)[[classes.index(k) for _, k in rows]]
    weight = (1 / np.maximum((y * ~out[:, None]).sum(axis=0), 1))[y.argmax(axis=1)]
    w, b = np.zeros((len(known), len(classes)), np.float32), np.zeros(len(classes), np.float32)
    b[0] = 2.0  # without known n-grams a paragraph is ordinary
    fit, own, want, speed = weight[~out, None].astype(np.float32), x[~out], y[~out], np.zeros_like(w)
    for _ in range(rounds):
        speed = 0.9 * speed - 0.4 * (own.T @ (fit * (_softmax(own @ w + b) - want)) + 1e-4 * w)
        w += speed
    z = x[out] @ w + b
    grid = np.geomspace(0.25, 4, 33)
    share = 1 / np.maximum(y[out].sum(axis=0), 1)[y[out].argmax(axis=1)]
    loss = [-(share[:, None] * y[out] * np.log(_softmax(z / t) + 1e-12)).sum() for t in grid]
    return Model(known, w.astype(np.float64), b.astype(np.float64), float(grid[int(np.argmin(loss))]), classes)


def _shingles(text: str) -> set:
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))}


def templates(family: str) -> list[set]:
    names = [p.format(n) for n in NAMES.get(family, []) for p in (*NOTICES, *NOTICES_HELD)]
    return [_shingles(t) for t in (*PARAGRAPHS.get(family, []), *names)]


def compare(paragraph: str, family: str, known: dict[str, list[set]] | None = None) -> float:
    """The largest share of a template's word 3-grams, or of the paragraph's if those
    are fewer, that both have."""
    own = _shingles(paragraph)
    known = {} if known is None else known
    if family not in known:
        known[family] = templates(family)
    return max((len(own & t) / max(1, min(len(own), len(t))) for t in known[family]), default=0.0)


def probabilities(model: Model, at: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The paragraphs with known n-grams, and the probability of each class."""
    some, inverse = np.unique(who, return_inverse=True)
    # Counts of an n-gram in a paragraph, scaled as in training.
    pair, times = np.unique(inverse * len(model.known) + at, return_counts=True)
    row, gram = pair // len(model.known), pair % len(model.known)
    scale = 2 / np.sqrt(np.maximum(np.bincount(row, times.astype(float) ** 2, len(some)), 1))
    z = np.stack([np.bincount(row, model.weights[gram, c] * times, len(some)) for c in range(len(model.classes))], axis=1) * scale[:, None] + model.bias if len(some) else np.zeros((0, len(model.classes)))
    return some, _softmax(z / model.temperature) if len(some) else z


def _scan(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = model.table(), {}
        for batch in batches:
            for rows, texts in text_batches(batch):
                hashes, paragraph, owner, place = _grams(texts)
                at, who = _counts(model.known, hashes, paragraph, len(owner), table)
                some, p = probabilities(model, at, who)
                found: list[list[dict]] = [[] for _ in range(len(texts))]
                data: dict[int, bytes] = {}
                for k in np.flatnonzero(p.argmax(axis=1) != 0).tolist() if len(some) else []:
                    t, c = int(owner[some[k]]), int(p[k].argmax())
                    start, end, line = place[:, some[k]].tolist()
                    own = data.setdefault(t, texts[t].as_py().encode())[start:end].decode()
                    family = model.classes[c] if p[k, c] >= LEAST_PROBABILITY else UNKNOWN
                    shared = compare(own, family, known)
                    found[t].append({"line": line, "family": family, "probability": float(p[k, c]), "shared": shared, "confirmed": family != UNKNOWN and shared >= LEAST_SHARED})
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(found, _FOUND)], names=["doc_id", "found"])

    return run


_FOUND = pa.list_(pa.struct([("line", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("shared", pa.float64()), ("confirmed", pa.bool_())]))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """A row a document: doc_id, and found, an array of (line, family, probability,
    shared, confirmed) of the paragraphs that aren't ordinary text, by their first line.

    Null, empty and blank texts have none; repeated rows are scanned each.
    """
    sample = least_hashes(texts_of(docs).where("text is not null"), "doc_id", SAMPLE_DOCS, docs.count(), "text")
    lines = sample.select(F.explode(F.split("text", "\n")).alias("line")).where(~F.col("line").rlike("(?i)licen|copyright|rights|redistrib|permission|software|warrant|public domain"))
    ordinary = sorted(r.line for r in lines.distinct().orderBy(F.xxhash64("line"), "line").limit(SAMPLE_PARAGRAPHS).collect())
    return texts_of(docs).mapInArrow(_scan(train(ordinary)), "doc_id long, found array<struct<line:int,family:string,probability:double,shared:double,confirmed:boolean>>")
