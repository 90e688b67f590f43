"""Licence scan: Dice coefficient over word bigrams of normalised text.

A passage of a document and a template match if 2 * common / (sum of both sizes)
reaches a threshold. As the common part is at most the smaller size, that bounds the
passage's size by the template's and asks for a least number of common bigrams;
templates below it are pruned before any passage is scored.
"""

from __future__ import annotations

import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, extended

THRESHOLD = 0.8
WORD = re.compile(r"[^\W_]+")

#: The terms of short licences in full.
WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: '
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + WARRANTY
)
ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
)
BSD_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
)
UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + WARRANTY
)

#: The usual wording of licence notices. Others can be passed in.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        MIT[: MIT.index(" The above")],
        MIT,
    ],
    "ISC": [ISC],
    "BSD-2-Clause": [BSD_CONDITIONS + BSD_DISCLAIMER],
    "Zlib": [ZLIB],
    "Unlicense": [UNLICENSE],
    "BSD-3-Clause": [
        BSD_CONDITIONS[: BSD_CONDITIONS.index(" 1.")],
        BSD_CONDITIONS + BSD_NAMES + BSD_DISCLAIMER,
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
}


def normalise(text: str) -> list[str]:
    return WORD.findall(text.lower())


def bigrams(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:]))


def dice(a: set, b: set) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


class Matcher:
    def __init__(self, templates: dict[str, list[str]], threshold: float):
        self.threshold = threshold
        self.templates = [(name, bigrams(normalise(t)), len(normalise(t))) for name, ts in templates.items() for t in ts]
        self.index: dict[tuple[str, str], list[int]] = defaultdict(list)
        for i, (_, own, _) in enumerate(self.templates):
            for b in own:
                self.index[b].append(i)
        #: least common bigrams: common >= threshold / 2 * (common + size of the template)
        self.least = [threshold * len(own) / (2 - threshold) - 1e-9 for _, own, _ in self.templates]
        self.words = frozenset(b[0] for b in self.index)

    def matches(self, text: str | None) -> list[dict]:
        """Passages (code points) with their best template, left to right and disjoint."""
        low = (text or "").lower()
        words = WORD.findall(low)
        if self.words.isdisjoint(words):
            return []
        places = defaultdict(list)
        get = self.index.get
        for at, b in enumerate(zip(words, words[1:])):
            if hit := get(b):
                for i in hit:
                    places[i].append(at)
        found = []
        for i, hits in places.items():
            name, own, length = self.templates[i]
            if len(hits) < self.least[i]:
                continue
            longest = int(len(own) * (2 - self.threshold) / self.threshold + 1e-9)  # size bound, in bigrams
            ends = 0
            for k, a in enumerate(hits):  # a passage begins and ends with common bigrams
                ends = max(ends, k)
                while ends < len(hits) and hits[ends] - a < longest:
                    ends += 1
                if ends - k < self.least[i]:
                    continue
                seen, common = set(), set()
                at = a
                best = None
                for e in hits[k:ends]:
                    while at <= e:
                        b = (words[at], words[at + 1])
                        seen.add(b)
                        if b in own:
                            common.add(b)
                        at += 1
                    score = 2 * len(common) / (len(seen) + len(own))
                    if score >= self.threshold - 1e-12 and (best is None or score > best[0]):
                        best = (score, e)
                if best:
                    found.append((best[0], a, best[1] + 2, name))
        if not found:
            return []
        spans = [m.span() for m in WORD.finditer(low)]
        exact = len(low) == len(text)
        out, taken = [], bytearray(len(words))
        for score, a, e, name in sorted(found, key=lambda f: (-f[0], f[1] - f[2], f[1], f[3])):
            # best first, ties to the longer, then the earlier, then by name
            if not taken[a] and not taken[e - 1] and taken.find(1, a, e) < 0:
                taken[a:e] = b"\1" * (e - a)
                out.append({"license": name, "start": spans[a][0] if exact else None, "end": spans[e - 1][1] if exact else None, "word": a, "n_words": e - a, "dice": score})
        return sorted(out, key=lambda m: m["word"])


MATCH = "struct<license:string,start:int,end:int,word:int,n_words:int,dice:double>"


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Replaces `text` by `licenses`, an array of matches (empty for null, empty and
    unlicensed texts). Offsets are null in the rare text whose length changes in lower
    case; word numbers always hold. Of overlapping matches the one of the best score stays,
    ties by length, place and name. Repeated rows give equal arrays, a column called
    licenses is replaced, an empty table gives no rows. One pass over whole texts, no
    shuffle."""
    docs = docs.drop("licenses")
    schema = extended(docs, f"licenses array<{MATCH}>", ("text",))
    names = schema.names[:-1]
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("word", pa.int32()), ("n_words", pa.int32()), ("dice", pa.float64())]))
    templates = TEMPLATES if templates is None else templates

    def make():
        matcher = Matcher(templates, threshold)

        def handle(batch):
            found = [matcher.matches(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found, kind)], names=schema.names)

        return handle

    return arrow_map(docs, make, schema)
