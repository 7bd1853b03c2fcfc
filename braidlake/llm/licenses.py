"""Licence scans: normalised text against licence templates by Dice's coefficient over word bigrams.

Words are runs of letters and digits, in lower case. A window of a text can only reach the threshold t
against a template of n bigrams if it has between n t / (2 - t) and n (2 - t) / t bigrams, and shares
n t / (2 - t) of them at least; so a text is a candidate for the few templates that it has so many
bigrams of, and only windows between such bigrams, of sizes within the bounds, are compared.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from braidlake.llm.common import fresh, schema_of, table
from braidlake.llm.toxicity import _letters
from braidlake.llm.words import LOWER, blocks, mix64, text_bytes, word_hashes

THRESHOLD = 0.8
#: Of windows that overlap, one that is LONGER times as long as the best goes before it if it scores less by NEAR at most.
NEAR, LONGER = 0.1, 1.2
#: Windows that are looked at together.
WINDOWS = 1 << 20

_WARRANTY = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {} for more details."
_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD3 = _BSD + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."

_VERBATIM = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_ECLIPSE = "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT."


def _commons(kind: str) -> str:
    """How the legal code of a Creative Commons licence begins."""
    return f"By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons {kind} 4.0 International Public License (\"Public License\"). To the extent this Public License may be interpreted as a contract, You are granted the Licensed Rights in consideration of Your acceptance of these terms and conditions"


def _gnu(kind: str, version: str, later: bool) -> str:
    """The notice of a GNU licence, as its publisher words it for files."""
    license, mark = f"GNU {kind}General Public License", ";" if version.startswith("2") else ","
    terms = f"either version {version} of the License, or (at your option) any later version." if later else f"version {version} of the License."
    return f"This program is free software{':' if mark == ',' else ';'} you can redistribute it and/or modify it under the terms of the {license} as published by the Free Software Foundation{mark} {terms} " + _WARRANTY.format(license)


# Notices, short texts and beginnings of long texts of public licences, as their publishers word them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("BSD-2-Clause", f"{_BSD} {_DISCLAIMER}"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", _BSD3),
    ("BSD-3-Clause", f"{_BSD3} {_DISCLAIMER}"),
    ("GPL-2.0", _gnu("", "2", False)),
    ("GPL-2.0-or-later", _gnu("", "2", True)),
    ("GPL-3.0", _gnu("", "3", False)),
    ("LGPL-2.1", _gnu("Lesser ", "2.1", False)),
    ("LGPL-2.1-or-later", _gnu("Lesser ", "2.1", True)),
    ("LGPL-3.0", _gnu("Lesser ", "3", False)),
    ("LGPL-3.0-or-later", _gnu("Lesser ", "3", True)),
    ("AGPL-3.0", _gnu("Affero ", "3", False)),
    ("AGPL-3.0-or-later", _gnu("Affero ", "3", True)),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    # How long texts begin.
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. \"Licensor\" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License."),
    ("GPL-2.0", f"GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. {_VERBATIM} Preamble The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users."),
    ("GPL-3.0", f"GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> {_VERBATIM} Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works."),
    ("LGPL-2.1", f"GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. {_VERBATIM} [This is the first released version of the Lesser GPL. It also counts as the successor of the GNU Library Public License, version 2, hence the version number 2.1.]"),
    ("LGPL-3.0", f"GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> {_VERBATIM} This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("AGPL-3.0", f"GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> {_VERBATIM} Preamble The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software. 1.2. \"Contributor Version\" means the combination of the Contributions of others (if any) used by a Contributor and that particular Contributor's Contribution."),
    ("EPL-1.0", f"Eclipse Public License - v 1.0 {_ECLIPSE}"),
    ("EPL-2.0", f"Eclipse Public License - v 2.0 {_ECLIPSE}"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE LEGAL SERVICES. DISTRIBUTION OF THIS DOCUMENT DOES NOT CREATE AN ATTORNEY-CLIENT RELATIONSHIP. CREATIVE COMMONS PROVIDES THIS INFORMATION ON AN \"AS-IS\" BASIS."),
    ("CC-BY-4.0", _commons("Attribution")),
    ("CC-BY-SA-4.0", _commons("Attribution-ShareAlike")),
    ("CC-BY-NC-4.0", _commons("Attribution-NonCommercial")),
    ("CC-BY-ND-4.0", _commons("Attribution-NoDerivatives")),
    ("CC-BY-NC-SA-4.0", _commons("Attribution-NonCommercial-ShareAlike")),
    ("CC-BY-NC-ND-4.0", _commons("Attribution-NonCommercial-NoDerivatives")),
]


def templates_in(folder: str) -> list[tuple[str, str]]:
    """A template for each file in a folder of whole licence texts, named as the file without .txt; for scan_licenses beside TEMPLATES or instead."""
    files = sorted(f for f in Path(folder).iterdir() if f.is_file())
    return [(f.name.removesuffix(".txt"), f.read_text(encoding="utf-8", errors="replace")) for f in files]


def bigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each pair of neighbouring words, first one of each text and one more)."""
    words, bounds, _ = word_hashes(_letters(LOWER[data]), offsets)
    count = np.maximum(np.diff(bounds) - 1, 0)
    first = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(bounds[:-1] - first[:-1], count) + np.arange(first[-1])
    if not len(at):
        return np.zeros(0, np.uint64), first
    return mix64(words[at] * np.uint64(0x9E3779B97F4A7C15) ^ mix64(words[at + 1])), first


def dice(a: Counter, b: Counter) -> float:
    """Dice's coefficient of two multisets."""
    total = a.total() + b.total()
    return 2 * (a & b).total() / total if total else 0.0


class Scanner:
    """Finds the windows of a text that are like a template.

    The bigrams of a text that a template has are its hits. In a window from hit i to hit j, hit t counts
    if the window holds fewer than the template's own number of the same bigram before t: if the hit that
    many places before, among its equals, stands before i. So all windows from a start are one running sum.
    """

    def __init__(self, templates=TEMPLATES, threshold: float = THRESHOLD):
        self.names, self.threshold = [name for name, _ in templates], threshold
        grams, first = bigrams(*text_bytes(pa.array([t for _, t in templates])))
        self.grams = [Counter(grams[a:b].tolist()) for a, b in zip(first, first[1:], strict=False)]
        self.own = [np.unique(grams[a:b], return_counts=True) for a, b in zip(first, first[1:], strict=False)]
        self.total = [int(n.sum()) for _, n in self.own]
        self.keys = np.unique(grams)
        self.least = [int(np.ceil(threshold * n / (2 - threshold) - 1e-9)) for n in self.total]
        self.most = [int((2 - threshold) * n / threshold + 1e-9) for n in self.total]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self.keys >> np.uint64(48)] = True

    def scan(self, grams: np.ndarray) -> list[tuple[str, float, int]]:
        """(licence, best coefficient, word it starts at) of a text's bigrams, best first, those at the threshold at least."""
        out = []
        for t in self._tables(grams):
            i = int(np.argmax(t.dice))
            if t.dice[i] > 0:
                out.append((t.name, float(t.dice[i]), int(t.at[i]), int(t.size[i])))
        return _best_of(sorted(out, key=_order))

    def apart(self, grams: np.ndarray) -> list[tuple[str, float, int]]:
        """As scan, but of windows that overlap only the best counts, or a longer one on near ties; what is left beside it is looked at anew."""
        tables = self._tables(grams)
        if not any(t.dice.any() for t in tables):
            return []
        # Best first; windows that a chosen one has cut come back with what is left of them.
        firsts = [np.flatnonzero(t.dice > 0) for t in tables]
        which = np.repeat(np.arange(len(tables)), [len(f) for f in firsts])
        start = np.concatenate(firsts)
        dice_, at, size = (np.concatenate([x[f] for x, f in zip(col, firsts, strict=True)]) for col in ([t.dice for t in tables], [t.at for t in tables], [t.size for t in tables]))
        order = np.lexsort((which, -size, at, -dice_))
        queue = list(zip((-dice_[order]).tolist(), at[order].tolist(), (-size[order]).tolist(), which[order].tolist(), start[order].tolist(), strict=True))
        queue.reverse()
        again: list = []
        found = []
        while queue or again:
            take = heapq.heappop(again) if again and (not queue or again[0] < queue[-1]) else queue.pop()
            minus, p, minus_size, k, i = take
            t = tables[k]
            if t.dice[i] != -minus or t.size[i] != -minus_size:
                continue  # it has been cut, or dropped
            name, d, size_ = t.name, -minus, -minus_size
            rivals = []
            for other in tables:
                lo, hi = np.searchsorted(other.at, [p - other.most, p + size_])
                ok = np.flatnonzero((other.dice[lo:hi] >= max(d - NEAR, 1e-12)) & (other.size[lo:hi] >= LONGER * size_) & (other.at[lo:hi] + other.size[lo:hi] > p)) + lo
                if len(ok):
                    j = ok[np.lexsort((-other.size[ok], other.at[ok], -other.dice[ok]))[0]]
                    rivals.append((other.name, float(other.dice[j]), int(other.at[j]), int(other.size[j])))
            if rivals:
                name, d, p, size_ = min(rivals, key=_order)
            found.append((name, d, p, size_))
            for n, other in enumerate(tables):
                lo, hi = np.searchsorted(other.at, [p - other.most, p + size_])
                inside = other.at[lo:hi] >= p
                other.dice[lo:hi][inside] = 0
                cut = lo + np.flatnonzero(~inside & (other.dice[lo:hi] > 0) & (other.at[lo:hi] + other.size[lo:hi] > p))
                if len(cut):
                    self._fill(other, cut, p)
                    for c in cut[other.dice[cut] > 0].tolist():
                        heapq.heappush(again, (-float(other.dice[c]), int(other.at[c]), -int(other.size[c]), n, c))
        return _best_of(sorted(found, key=_order))

    def _tables(self, grams: np.ndarray) -> list[_Starts]:
        """For each template that a text has enough bigrams of, the best window from each of its hits."""
        hit = np.flatnonzero(self.maybe[grams >> np.uint64(48)])
        hit = hit[np.isin(grams[hit], self.keys)]
        values, out = grams[hit], []
        for k, (keys, counts) in enumerate(self.own):
            if len(hit) < self.least[k]:
                continue
            place = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
            mine = keys[place] == values
            at, kind = hit[mine], place[mine]
            if np.minimum(np.bincount(kind, minlength=len(keys)), counts * np.maximum(1, len(at))).sum() < self.least[k]:
                continue
            # The hit with as many equals between as the template has of that bigram.
            order = np.argsort(kind, kind="stable")
            before = np.full(len(at), -1)
            rank = np.arange(len(at)) - np.searchsorted(kind[order], kind[order])
            old = rank >= counts[kind[order]]
            before[order[old]] = order[np.flatnonzero(old) - counts[kind[order]][old]]
            table_ = _Starts(self.names[k], at, before, self.total[k], self.least[k], self.most[k])
            self._fill(table_, np.arange(len(at)), len(grams))
            out.append(table_)
        return out

    def _fill(self, t: _Starts, starts: np.ndarray, end: int) -> None:
        """The best windows from these hits that end before `end`."""
        t.dice[starts], t.size[starts] = 0, 0
        # Only starts with enough hits within reach can be the start of one.
        reach = np.searchsorted(t.at, np.minimum(t.at[starts] + t.most, end))
        starts, reach = (x[reach - starts >= t.least] for x in (starts, reach))
        step = max(1, WINDOWS // max(t.most, 1))
        for a in range(0, len(starts), step):
            i, last = starts[a : a + step], reach[a : a + step]
            width = int((last - i).max())
            j = i[:, None] + np.arange(width)
            there = j < last[:, None]
            j = np.minimum(j, len(t.at) - 1)
            shared = np.cumsum((t.before[j] < i[:, None]) & there, axis=1)
            size = t.at[j] - t.at[i][:, None] + 1
            d = np.where(there & (size >= t.least) & (shared >= t.least), 2 * shared / (size + t.total), 0)
            best = np.argmax(d, axis=1)
            row = np.arange(len(i))
            ok = d[row, best] >= self.threshold - 1e-12
            t.dice[i[ok]], t.size[i[ok]] = d[row, best][ok], size[row, best][ok]


class _Starts:
    """The hits of one template in a text, and the best window from each: its coefficient (0: none) and bigrams."""

    def __init__(self, name: str, at: np.ndarray, before: np.ndarray, total: int, least: int, most: int):
        self.name, self.at, self.before, self.total, self.least, self.most = name, at, before, total, least, most
        self.dice, self.size = np.zeros(len(at)), np.zeros(len(at), np.int64)


def _order(window: tuple[str, float, int, int]):
    return -window[1], window[2], -window[3], window[0]


def _best_of(windows: list[tuple[str, float, int, int]]) -> list[tuple[str, float, int]]:
    best: dict[str, tuple[float, int]] = {}
    for name, d, p, _ in windows:
        best.setdefault(name, (d, p))
    return [(n, d, p) for n, (d, p) in best.items()]


def scan_licenses(docs: DataFrame, text: str, columns: list[str], templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """The columns with license (the best match, null for none), dice, start_word and licenses (all, in order of code points, by commas).

    Matches do not overlap: of templates that match the same words the best counts, a longer one before it on near ties.
    Where one of the columns has the name of a new one, the new one takes _ before its name.

    Null and empty texts, and such of one word, match nothing; whole texts are scanned, however long;
    of equal coefficients the earlier in the text comes first, then the lesser name; equal texts get equal
    values, repeated rows a row each; an empty table gives no rows.
    """
    names = fresh(columns, "license", "dice", "start_word", "licenses")
    made_schema = ", ".join(f"`{n}` {kind}" for n, kind in zip(names, ("string", "double", "long", "string"), strict=True))
    schema = schema_of(docs, columns) + made_schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, threshold)
        for whole in batches:
            for start, part in blocks(whole.column(text)):
                b = whole.slice(start, len(part))
                grams, first = bigrams(*text_bytes(part))
                hot = np.cumsum(np.concatenate([[0], scanner.maybe[grams >> np.uint64(48)]]))[first]
                found = [scanner.apart(grams[x:y]) if h else [] for x, y, h in zip(first, first[1:], np.diff(hot), strict=False)]
                top = [f[0] if f else (None, None, None) for f in found]
                every = [",".join(sorted(n for n, *_ in f)) if f else None for f in found]
                made = [pa.array([t[0] for t in top], pa.string()), pa.array([t[1] for t in top], pa.float64()), pa.array([t[2] for t in top], pa.int64()), pa.array(every, pa.string())]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), *made], names=[*columns, *names])

    return docs.select(*columns, *([text] if text not in columns else [])).mapInArrow(run, schema)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", ["doc_id"])
