"""License scans: winnowed fingerprints of templates pick candidates, banded alignment reports coverage and spans.

Templates are few and short; the inverted index of their winnowed word triples (the smallest checksum of each window of
`WINNOW` triples) goes to each task with the function. A document's triples are all looked up, hits vote for a template and a
diagonal, and around each diagonal a banded alignment of the template's words with the document's tells how many of the
template's words are matched, and where.

Defined results: a null or empty text, or one without a match, gives one row with no license; matches of one template that
overlap are reported once, by the better; a text of which fewer than one in 50 words begins a known triple near a diagonal is none; a match within one of more matched words (an opening in its text, GPL in LGPL) is
left out; a template of fewer than three words is looked up whole, one without words never matches; repeated rows have equal results; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

TOKEN = re.compile(r"\w+")
GRAM, WINNOW, BAND, LEAST = 3, 2, 8, 0.75
#: Words of a template for each of which a hit near the diagonal is needed. With a quarter of the words wrong, one in four is left if they are wrong at random.
FEW = 50
#: Notices and opening texts of common licenses.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0-notice": "This work is dedicated to the public domain under CC0 1.0 Universal.",
    "All-rights-reserved-notice": "All rights reserved.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
_BSD = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
    " IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)"
    " HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_2 = TEMPLATES["BSD"] + ": 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
#: Whole texts, reported instead of the openings above.
TEMPLATES |= {
    "MIT-text": TEMPLATES["MIT"] + ", and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY + " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Apache-2.0-header": TEMPLATES["Apache-2.0"] + " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause-text": _BSD_2 + _BSD,
    "BSD-3-Clause-text": _BSD_2 + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission." + _BSD,
    "ISC-text": TEMPLATES["ISC"] + " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
#: Whole texts, a file each.
TEMPLATES |= {f"{x.stem}-text": x.read_text() for x in sorted((Path(__file__).parent / "templates").glob("*.txt"))}
KIND = "doc_id {}, license string, coverage double, start long, end long"


def index_of(templates: dict[str, str]) -> tuple[dict[str, list[str]], dict[tuple[str, ...], list[tuple[str, int]]]]:
    tokens = {k: TOKEN.findall(v.lower()) for k, v in templates.items()}
    index: dict[tuple[str, ...], list[tuple[str, int]]] = defaultdict(list)
    for name, t in tokens.items():
        n = min(GRAM, len(t))  # a template of fewer words is a gram itself
        grams = list(zip(*(t[i:] for i in range(n))))
        if not grams:
            continue
        sums = [zlib.crc32(" ".join(g).encode()) for g in grams]
        picked = {min(range(i, min(i + WINNOW, len(sums))), key=lambda j: (sums[j], -j)) for i in range(max(1, len(sums) - WINNOW + 1))}
        for i in sorted(picked):
            index[grams[i]].append((name, i))
    return tokens, dict(index)


def aligned(a: list[str], b: list[str], shift: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched words, first and last matched position in b) of the longest common subsequence with |j - i - shift| <= band."""
    before: dict[int, tuple[int, int, int]] = {}
    for i, x in enumerate(a):
        now: dict[int, tuple[int, int, int]] = {}
        for j in range(max(0, i + shift - band), min(len(b), i + shift + band + 1)):
            best = max(before.get(j, (0, 0, 0)), now.get(j - 1, (0, 0, 0)), key=lambda v: (v[0], v[1]))
            if b[j] == x:
                n, first, _ = before.get(j - 1, (0, 0, 0))
                if n + 1 > best[0]:
                    best = (n + 1, first if n else j, j)
            now[j] = best
        before = now
    return max(before.values(), default=(0, 0, 0), key=lambda v: v[0])


def scan(text: str | None, tokens: dict, index: dict, sizes: tuple[int, ...] = ()) -> list[tuple[str, float, int, int]]:
    """(license, coverage, start, end) of each match; sizes are the lengths of the index's grams."""
    lower = (text or "").lower()
    words = TOKEN.findall(lower)
    sizes = sizes or tuple(sorted({len(g) for g in index}))
    hits = [(i, index[g]) for n in sizes for i, g in enumerate(zip(*(words[k:] for k in range(n)))) if g in index]
    if not hits:
        return []
    votes: dict[str, dict[int, int]] = defaultdict(dict)  # a template's diagonals: the last place of a hit
    each: dict[str, list[int]] = defaultdict(list)  # the diagonals of all hits
    for i, places in hits:
        for name, at in places:
            votes[name][i - at] = max(i, votes[name].get(i - at, 0))
            each[name].append(i - at)
    found, held = [], Counter(words)
    for name, last in votes.items():
        need = LEAST * len(tokens[name])
        if sum(min(n, held[w]) for w, n in Counter(tokens[name]).items()) < need:
            continue  # no alignment can match more
        each[name].sort()
        shifts, end, seen = sorted(last), -1, None  # seen: up to which diagonal hits were in the band of an alignment that failed
        for shift in shifts:
            if last[shift] <= end:
                continue  # its hits are in the last match
            highest = shifts[bisect_right(shifts, shift + 2 * BAND) - 1]
            if seen is not None and highest <= seen:
                continue
            skip = end + 1  # copies may follow closely: what is matched is not matched again
            for centre in (shift, shift + BAND) if highest > shift + BAND else (shift,):  # the second where a text drifts out of the first's band
                if (bisect_right(each[name], centre + BAND) - bisect_left(each[name], centre - BAND)) * FEW < len(tokens[name]):
                    continue
                n, first, stop = aligned(tokens[name], words[skip:], centre - skip)
                if n >= need and stop - first < len(tokens[name]) + 2 * BAND:
                    end, seen = max(end, stop + skip), None
                    found.append((n / len(tokens[name]), name, first + skip, stop + skip))
                    break
            else:
                seen = highest
    if not found:
        return []
    spans = [m.span() for m in TOKEN.finditer(text if len(text) == len(lower) else lower)]
    out: list[tuple[str, float, int, int]] = []
    size = lambda x: (round(x[0] * len(tokens[x[1]])), x[0])
    found = [x for x in found if not any(y[2] <= x[2] and x[3] <= y[3] and size(y) > size(x) for y in found)]
    for coverage, name, first, stop in sorted(found, key=lambda x: (-x[0], x[2], x[1])):
        start, end = spans[first][0], spans[stop][1]
        if not any(o[0] == name and o[2] < end and start < o[3] for o in out):
            out.append((name, coverage, start, end))
    return sorted(out, key=lambda x: (x[2], x[0]))


def scanned(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    tokens, index = index_of(templates or TEMPLATES)
    sizes = tuple(sorted({len(g) for g in index}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(key.as_py(), *x) for key, text in zip(batch.column(0), batch.column(1)) for x in scan(text.as_py(), tokens, index, sizes) or [(None, None, None, None)]]
            kinds = [batch.column(0).type, pa.string(), pa.float64(), pa.int64(), pa.int64()]
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=["doc_id", "license", "coverage", "start", "end"])

    return docs.select("doc_id", "text").mapInArrow(run, KIND.format(docs.schema["doc_id"].dataType.simpleString()))


def op6_licenses(spark, sf_dir: str) -> DataFrame:
    return scanned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
