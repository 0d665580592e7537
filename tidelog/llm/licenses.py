"""License scans by conditional compression.

Candidate blocks are the surroundings of words that licenses use. A block is compressed alone and once with
each license's template as zstandard raw dictionary; templates are ranked by how many bytes they save, and all
are held against the block word by word. A license is found where one of its wordings lies in the
block with at most DIFFERENCES of its words missing, changed or added (so a wording of fewer than 20 words
has to be there exactly); the differing words are given. What was found is taken out and the rest ranked anew.

Only texts with such a word leave the JVM. Blocks are at most BLOCK characters and overlap by half, more than
the longest wording, so memory does not follow the text and every wording lies whole in some block; of finds
that overlap, the one with the most words of its wording stays. Defined results: null
and empty texts, and texts without a candidate, give no rows; several notices give a row each; repeated rows
give repeated results; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a block, and those kept around a word.
BLOCK, AROUND = 6000, 1200

#: The share of a wording's words that may differ.
DIFFERENCES = 0.05

LEVEL = 9

# Verbs and names of short notices, first lines of license files, and published texts and headers.
VERBS = ["licensed under", "released under", "distributed under", "published under", "available under", "provided under", "subject to the terms of"]
NAMES = {
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0", "Apache-2.0", "Apache 2.0"],
    "Apache-1.1": ["the Apache Software License, Version 1.1", "Apache-1.1"],
    "MIT": ["the MIT License", "the terms of the MIT license", "MIT License"],
    "MIT-0": ["the MIT No Attribution License", "MIT-0"],
    "GPL-2.0": ["the GNU General Public License, version 2", "the GNU GPL v2", "GPLv2", "GPL-2.0"],
    "GPL-3.0": ["the GNU General Public License, version 3", "the GNU GPL v3", "GPLv3", "GPL-3.0"],
    "LGPL-2.1": ["the GNU Lesser General Public License, version 2.1", "LGPLv2.1", "LGPL-2.1"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3", "LGPLv3", "LGPL-3.0"],
    "AGPL-3.0": ["the GNU Affero General Public License, version 3", "AGPLv3", "AGPL-3.0"],
    "MPL-1.1": ["the Mozilla Public License, version 1.1", "MPL-1.1"],
    "MPL-2.0": ["the Mozilla Public License, version 2.0", "the Mozilla Public License, v. 2.0", "MPL-2.0"],
    "EPL-1.0": ["the Eclipse Public License 1.0", "the Eclipse Public License v1.0", "EPL-1.0"],
    "EPL-2.0": ["the Eclipse Public License 2.0", "the Eclipse Public License v2.0", "the Eclipse Public License v. 2.0", "EPL-2.0"],
    "CDDL-1.0": ["the Common Development and Distribution License 1.0", "the Common Development and Distribution License, Version 1.0", "CDDL-1.0"],
    "EUPL-1.2": ["the European Union Public Licence v1.2", "the EUPL, Version 1.2", "EUPL-1.2"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "the Simplified BSD License", "BSD-2-Clause"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "the New BSD License", "BSD-3-Clause"],
    "BSD-4-Clause": ["the BSD 4-Clause License", "the Original BSD License", "BSD-4-Clause"],
    "0BSD": ["the Zero-Clause BSD License", "the BSD Zero Clause License", "0BSD"],
    "ISC": ["the ISC License", "ISC License"],
    "Zlib": ["the zlib License", "the zlib/libpng License"],
    "BSL-1.0": ["the Boost Software License, Version 1.0", "the Boost Software License 1.0", "BSL-1.0"],
    "BUSL-1.1": ["the Business Source License 1.1", "BUSL-1.1"],
    "Artistic-2.0": ["the Artistic License 2.0", "Artistic-2.0"],
    "NCSA": ["the University of Illinois/NCSA Open Source License", "the NCSA Open Source License"],
    "PostgreSQL": ["the PostgreSQL License", "the PostgreSQL Licence"],
    "PSF-2.0": ["the Python Software Foundation License Version 2", "PSF-2.0"],
    "OFL-1.1": ["the SIL Open Font License, Version 1.1", "the SIL Open Font License 1.1", "OFL-1.1"],
    "WTFPL": ["the Do What The Fuck You Want To Public License", "the WTFPL"],
    "AFL-3.0": ["the Academic Free License version 3.0", "AFL-3.0"],
    "MS-PL": ["the Microsoft Public License", "MS-PL"],
    "ODbL-1.0": ["the Open Data Commons Open Database License", "the Open Database License 1.0", "ODbL-1.0"],
    "CC-BY-4.0": ["CC BY 4.0", "a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0", "a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC0-1.0": ["CC0 1.0", "the CC0 1.0 Universal Public Domain Dedication"],
    "Unlicense": ["the Unlicense"],
}
HEADS = {
    "Apache-2.0": ["Apache License Version 2.0, January 2004"],
    "GPL-2.0": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "GPL-3.0": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "LGPL-2.1": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "LGPL-3.0": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "AGPL-3.0": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "MPL-1.1": ["MOZILLA PUBLIC LICENSE Version 1.1"],
    "MPL-2.0": ["Mozilla Public License Version 2.0"],
    "EPL-1.0": ["Eclipse Public License - v 1.0"],
    "EPL-2.0": ["Eclipse Public License - v 2.0"],
    "CDDL-1.0": ["COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 1.0"],
    "EUPL-1.2": ["EUROPEAN UNION PUBLIC LICENCE v. 1.2"],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003"],
    "BUSL-1.1": ["Business Source License 1.1"],
    "Artistic-2.0": ["The Artistic License 2.0"],
    "PSF-2.0": ["PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2"],
    "OFL-1.1": ["SIL OPEN FONT LICENSE Version 1.1 - 26 February 2007"],
    "WTFPL": ["DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004"],
    "AFL-3.0": ["Licensed under the Academic Free License version 3.0"],
    "MS-PL": ["Microsoft Public License (Ms-PL)"],
    "CC0-1.0": ["Creative Commons Legal Code CC0 1.0 Universal"],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International Public License"],
    "CC-BY-SA-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International Public License"],
}
DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
LIABILITY = "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
NO_ENDORSEMENT = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
NO_WARRANTY = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
ISC_TERMS = "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE"
ISC_REST = " INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
GNU = "you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
TEXTS = {
    "MIT": [f"{GRANT}, subject to the following conditions: {NOTICE}", f"{GRANT}, subject to the following conditions: {NOTICE} {NO_WARRANTY}"],
    "MIT-0": [f"{GRANT}. {NO_WARRANTY}"],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ],
    "BSD-2-Clause": [BSD + DISCLAIMER, f"{BSD}{DISCLAIMER} {LIABILITY}"],
    "BSD-3-Clause": [
        BSD[BSD.index("Redistributions in binary") :] + "3. " + NO_ENDORSEMENT + DISCLAIMER,
        f"{BSD}3. {NO_ENDORSEMENT}{DISCLAIMER} {LIABILITY}",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: * Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. * Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. * " + NO_ENDORSEMENT + DISCLAIMER,
    ],
    "BSD-4-Clause": [BSD + "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the copyright holder. 4. " + NO_ENDORSEMENT],
    "0BSD": [f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {ISC_TERMS}{ISC_REST}"],
    "ISC": [
        f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {ISC_TERMS}",
        f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {ISC_TERMS}{ISC_REST}",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ],
    "BSL-1.0": [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    ],
    "NCSA": [
        f"{GRANT.replace('deal in', 'deal with')}, subject to the following conditions: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimers. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimers in the documentation and/or other materials provided with the distribution."
    ],
    "PostgreSQL": ["Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."],
    "WTFPL": ["Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO."],
    "GPL-2.0": ["This program is free software; " + GNU.format("General Public License", ";", 2), "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"],
    "GPL-3.0": ["This program is free software: " + GNU.format("General Public License", ",", 3)],
    "LGPL-2.1": ["This library is free software; " + GNU.format("Lesser General Public License", ";", 2.1)],
    "LGPL-3.0": ["This library is free software: " + GNU.format("Lesser General Public License", ",", 3)],
    "AGPL-3.0": ["This program is free software: " + GNU.format("Affero General Public License", ",", 3)],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "EPL-1.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "CDDL-1.0": ["The contents of this file are subject to the terms of the Common Development and Distribution License (the License). You may not use this file except in compliance with the License."],
    "OFL-1.1": ["This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also available with a FAQ at: http://scripts.sil.org/OFL"],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
}
HINT = r"(?i)licen[sc]|copyright|permission|redistribut|free software|public domain|creative commons|spdx|source code form|(?:released|distributed|published|available|provided) under|subject to the terms|everyone is permitted"

WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")

FOUND = "doc_id long, start long, stop long, license string, saved double, differences int, differing array<string>"


def templates() -> dict[str, list[str]]:
    """The wordings of each license: its texts, its first lines, every verb before every name, and the machine-readable tag."""
    return {k: [*TEXTS.get(k, []), *HEADS.get(k, []), *(f"{v} {n}" for n in names for v in VERBS), f"SPDX-License-Identifier: {k}"] for k, names in NAMES.items()}


def differing(wording: list[str], words: list[str]) -> tuple[int, int, list[str]]:
    """(first word, last word + 1, differences: -missing, +added or was>is) of the place in `words` that is nearest to the wording by words missing, changed or added."""
    n, m = len(words), len(wording)
    ids = {w: i for i, w in enumerate(dict.fromkeys(wording))}
    a, b = np.array([ids[w] for w in wording]), np.array([ids.get(w, -1) for w in words], np.int64)
    steps = np.arange(n + 1)
    d = np.zeros((m + 1, n + 1), np.int32)
    for i in range(1, m + 1):
        row = np.empty(n + 1, np.int64)
        row[0] = i
        row[1:] = np.minimum(d[i - 1, :-1] + (b != a[i - 1]), d[i - 1, 1:] + 1)
        d[i] = np.minimum.accumulate(row - steps) + steps
    j = stop = int(np.argmin(d[m]))
    i, odd = m, []
    while i:
        if j and d[i, j] == d[i - 1, j - 1] + (b[j - 1] != a[i - 1]):
            if b[j - 1] != a[i - 1]:
                odd.append(f"{wording[i - 1]}>{words[j - 1]}")
            i, j = i - 1, j - 1
        elif d[i, j] == d[i - 1, j] + 1:
            odd.append(f"-{wording[i - 1]}")
            i -= 1
        else:
            odd.append(f"+{words[j - 1]}")
            j -= 1
    return j, stop, odd[::-1]


class Scanner:
    """Finds licenses in texts."""

    def __init__(self):
        self.hint = re.compile(HINT)
        self.plain = zstandard.ZstdCompressor(level=LEVEL)
        self.given, self.wordings = {}, {}
        for name, wordings in templates().items():
            known = zstandard.ZstdCompressionDict("\n".join(wordings).lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.given[name] = zstandard.ZstdCompressor(level=LEVEL, dict_data=known)
            self.wordings[name] = [WORD.findall(w.lower()) for w in wordings]

    def blocks(self, text: str) -> Iterator[tuple[int, int]]:
        spans: list[list[int]] = []
        for m in self.hint.finditer(text):
            a, z = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
            if spans and a <= spans[-1][1]:
                spans[-1][1] = z
            else:
                spans.append([a, z])
        for a, z in spans:
            while z - a > BLOCK:
                yield a, a + BLOCK
                a += BLOCK // 2
            yield a, z

    def ranked(self, text: str) -> list[tuple[float, str]]:
        """(share of bytes saved, license), best first."""
        raw = text.encode()
        alone = len(self.plain.compress(raw))
        saved = [((alone - len(c.compress(raw))) / alone, name) for name, c in self.given.items()]
        return sorted(saved, key=lambda x: (-x[0], x[1]))

    def _best(self, words: list[re.Match], text: str) -> tuple | None:
        if not words:
            return None
        plain = [w[0] for w in words]
        have, best = set(plain), None
        for saved, name in self.ranked(text):
            for wording in self.wordings[name]:
                may = int(DIFFERENCES * len(wording))
                if len(wording) > len(plain) + may or sum(w not in have for w in wording) > may:
                    continue
                a, z, odd = differing(wording, plain)
                count = len(odd)
                if a < z and count <= may and (best is None or (len(wording) - count, saved) > best[0]):
                    best = ((len(wording) - count, saved), a, z, name, saved, count, odd)
        return best

    def __call__(self, text: str) -> list[tuple]:
        """(start, stop, license, share saved, differences, differing words), by place."""
        found: dict[tuple[int, int], tuple[int, tuple]] = {}
        for a, z in self.blocks(text):
            parts = [(a, z)]
            while parts:
                p, q = parts.pop()
                piece = text[p:q].lower()
                piece = piece if len(piece) == q - p else "".join(c.lower()[:1] for c in text[p:q])
                words = list(WORD.finditer(piece))
                best = self._best(words, piece)
                if best:
                    (same, _), i, k, name, saved, count, odd = best
                    s, e = p + words[i].start(), p + words[k - 1].end()
                    if (s, e) not in found or (same, saved) > (found[s, e][0], found[s, e][1][3]):
                        found[s, e] = same, (s, e, name, saved, count, odd)
                    parts += [(p, s), (e, q)]
        # A block's end may cut a wording and leave a shorter one in it; the whole one of the next block is the longer.
        kept: list[tuple] = []
        starts: list[int] = []
        for _, row in sorted(found.values(), key=lambda x: (-x[0], x[1][:2])):
            i = bisect_left(starts, row[1])
            if not i or kept[i - 1][1] <= row[0]:
                starts.insert(i, row[0])
                kept.insert(i, row)
        return kept


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


def scan(docs: DataFrame) -> DataFrame:
    """One row per license notice: doc_id, start, stop (characters), license, saved, differences, differing words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = scanner()
        for batch in batches:
            rows = [(d, *f) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for f in find(t)]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in FOUND.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").where(F.col("text").rlike(HINT)).mapInArrow(run, FOUND)
