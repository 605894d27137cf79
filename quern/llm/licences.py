"""Licence scan: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

A text's words (letters and digits, lower case) give 5-word shingles. A template of m shingles belongs to the class of
windows of w shingles, the power of two with w / 4 < m <= w / 2; windows start at every w / 2 shingles, so that one holds
each occurrence whole. A window that holds 80 % of a template has a Jaccard similarity with it of J or more, and each
band of one minimum hash agrees with probability J; there are as many bands as make the chance that none agrees
less than one in a thousand. Windows whose minima agree with a template's are read exactly: the share of the
template's shingles in them must be 80 %.

Null and empty texts match nothing. Repeated rows match each; a null doc_id stays null. A template that occurs twice in a text is
reported once, with its best containment and the first place of that. A share of exactly 80 % matches. Texts of any length
are read whole, one at a time. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common
from quern.llm.jaccard import WIDTH, windows

#: Share of a template that must be there; chance of missing it by its bands.
PERCENT, MISS = 80, 0.001
#: Bytes of texts that a worker reads at a time; a longer text is read alone.
SLICE = 1_000_000

_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."


def _gnu(kind: str, version: str) -> str:
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
        f"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for more details. "
        f"You should have received a copy of the GNU {kind} along with this program. If not, see <https://www.gnu.org/licenses/>."
    )


#: Short licences whole (BSL-1.0 and Unlicense by their first paragraphs), and for long ones (Apache, MPL, the GNU family, CC) the notices by
#: which files name them, as their publishers word them; whole long texts can be given to scan() beside them. A text that holds one licence whole may hold 80 % of a like one.
TEMPLATES = {
    "MIT": f"{_GRANT} {_AS_IS}",
    "MIT-notice": "Released under the MIT License.",
    "BSD-2-Clause": f"{_BSD} {_BSD_END}",
    "BSD-3-Clause": f"{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_END}",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "GPL-2.0-or-later": _gnu("General Public License", "2"),
    "GPL-3.0-or-later": _gnu("General Public License", "3"),
    "LGPL-3.0-or-later": _gnu("Lesser General Public License", "3"),
    "AGPL-3.0-or-later": _gnu("Affero General Public License", "3"),
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}

#: ASCII letters and digits stay (lower case), other ASCII ends a word, bytes of other characters stay.
_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words(text: str | None) -> bytes:
    return b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_KEEP).split())


def bands(w: int, m: int, percent: int = PERCENT, miss: float = MISS) -> int:
    """Bands with which a window of w shingles that holds `percent` of m is missed with less chance than `miss`."""
    shared = -(-percent * m // 100)
    return math.ceil(math.log(miss) / math.log(1 - shared / (w + m - shared)))


class Index:
    def __init__(self, templates: dict[str, str], width: int = WIDTH, percent: int = PERCENT):
        self.names = sorted(templates)
        self.sets = [np.unique(windows(words(templates[n]), width)) for n in self.names]
        self.percent, self.width = percent, width
        classes: dict[int, list[int]] = {}
        for k, s in enumerate(self.sets):
            classes.setdefault(2 * 2 ** math.ceil(math.log2(max(1, len(s)))), []).append(k)
        random = np.random.default_rng(11)
        self.classes = []
        for w, members in sorted(classes.items()):
            n = max(bands(w, len(self.sets[k]), percent) for k in members)
            odd = random.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1)
            minima = {k: (self.sets[k][:, None] * odd).min(axis=0) for k in members}
            seen = np.zeros(1 << 16, bool)
            for m in minima.values():
                seen[m >> np.uint64(48)] = True
            self.classes.append((w, odd, minima, seen))

    def scan(self, text: str | None) -> list[tuple[str, float, int]]:
        """(template, containment, first shingle of the window) of each template in the text."""
        h = windows(words(text), self.width)
        found: dict[int, tuple[float, int]] = {}
        for w, odd, minima, seen in self.classes:
            if not len(h):
                break
            step = w // 2
            starts = np.arange(0, len(h), step)
            low = np.empty((len(odd), len(starts)), np.uint64)
            for b, factor in enumerate(odd):
                low[b] = np.minimum.reduceat(h * factor, starts) if step > 1 else h * factor
            low[:, :-1] = np.minimum(low[:, :-1], low[:, 1:])
            maybe = np.flatnonzero(seen[low >> np.uint64(48)].any(axis=0))
            for at in maybe:
                here = None
                for k, m in minima.items():
                    if (low[:, at] == m).any():
                        here = h[starts[at] : starts[at] + w] if here is None else here
                        share = np.isin(self.sets[k], here).mean()
                        if 100 * share >= self.percent and (k not in found or share > found[k][0]):
                            found[k] = (float(share), int(starts[at]))
        return [(self.names[k], *v) for k, v in sorted(found.items())]


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, licence, containment and word (place of the window) of every template that a text holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        for batch in batches:
            for at, texts in common.slices(batch.column(1), SLICE):
                rows = [(one, *hit) for one, text in zip(batch.column(0).slice(at, len(texts)).to_pylist(), texts, strict=True) for hit in index.scan(text)]
                columns = [[r[k] for r in rows] for k in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.float64(), pa.int64()), strict=True)], names=["doc_id", "licence", "containment", "word"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(common.lean(run), "doc_id long, licence string, containment double, word long")


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))
