"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams.

A text is scanned in units: the whole text, each line, and each run of two or more lines that ends at an empty line. A unit
and a template are multisets of word bigrams; their Dice coefficient is twice the bigrams they share over all they have.
Sizes bound it: 2 * min / (a + b) is the most it can be, so for each unit only templates whose size lies in a window around
its own are candidates, and those that share no bigram with it are never compared.

Licences also stand in no unit: in paragraphs inside a longer text, inside a line, or right above code. So each template is
slid over the words of the whole text too: of all runs of bigrams that start and end with one of the template's, those that
reach the threshold are 'span's. Of spans that overlap, the one with the largest 2 * shared - threshold * (a + b) stays; a
span inside a unit that matches isn't repeated.

Relatives differ by a word or a number that hardly moves the coefficient: versions, and variants such as Affero, Lesser or
NonCommercial. These telling words are counted in the unit and in the template. A template may not name a unit that has more of
one than it has itself, and a short one (SHORT bigrams at most) needs all of its own to be there; the next best template is
tried, and if none may, the unit is of an 'unknown version' and the name says what it is like.

Defined results for odd input: a null or empty text, and one with fewer than two words, has no bigram and matches nothing;
equal coefficients go to the template that comes first by name; copies and repeated rows are scanned alike; texts may be of
any length; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from pkgutil import get_data

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: Bigrams of a template in which any small number is a version.
SHORT = 120
#: Words that tell variants of a licence apart, with their short forms, and those that stand before a version.
VARIANTS = {"affero": "affero", "agpl": "affero", "lesser": "lesser", "lgpl": "lesser", "library": "library", "noncommercial": "nc", "nc": "nc", "sharealike": "sa", "sa": "sa", "noderivatives": "nd", "noderivs": "nd", "nd": "nd"}
BEFORE_VERSION = ("version", "versions", "v", "ver")
UNKNOWN = "unknown version, like "
_NUMBER = re.compile(r"v?([0-9](?:\.[0-9]+)*)")
_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")

# Public licence texts, headers and the usual one-line notices, by name. Complete texts stand in license_texts.
COMPLETE = ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-SA-4.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense")
TEMPLATES = {name: get_data("tesserae.llm", f"license_texts/{name}.txt").decode() for name in COMPLETE} | {
    "AGPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "GPL-2.0 header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MIT notice": "Released under the MIT License.",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}


def bigrams(text: str) -> Counter:
    """The multiset of word bigrams of the normalised text."""
    words = _WORD.findall(text.lower())
    return Counter(zip(words, words[1:], strict=False))


def dice(a: Counter, b: Counter) -> float:
    """Twice the shared bigrams over all; 0 if both are empty."""
    total = a.total() + b.total()
    return 2 * (a & b).total() / total if total else 0.0


def telling(words: list[str]) -> list[tuple[int, str, bool]]:
    """(place, what it tells, whether it tells that in long texts too) of the words that tell relatives apart."""
    out = []
    for k, word in enumerate(words):
        for part in word.split("-"):
            if part in VARIANTS:
                out.append((k, VARIANTS[part], True))
            elif number := _NUMBER.fullmatch(part):
                named = part[0] == "v" or bool(k and words[k - 1].strip(".") in BEFORE_VERSION)
                out.append((k, "version " + re.sub(r"(\.0)+$", "", number[1]), named))
    return out


class Scanner:
    """Templates ordered by size, and the bigrams that any of them has."""

    def __init__(self, templates: dict[str, str], threshold: float):
        found = sorted((bigrams(t).total(), name) for name, t in templates.items())
        self.threshold = threshold
        self.sizes, self.names = [n for n, _ in found], [name for _, name in found]
        self.grams = [bigrams(templates[name]) for name in self.names]
        self.told = [Counter(what for _, what, plain in telling(_WORD.findall(templates[name].lower())) if plain or n <= SHORT) for n, name in zip(self.sizes, self.names, strict=True)]
        self.known = {g for t in self.grams for g in t}
        self.words = {w for g in self.known for w in g}
        self.places: dict[tuple[str, str], list[tuple[int, int]]] = {}
        for i, grams in enumerate(self.grams):
            for g, n in grams.items():
                self.places.setdefault(g, []).append((i, n))

    def may_name(self, i: int, told: list[tuple[int, str, bool]], first: int, last: int) -> bool:
        """Whether template i may name the words from ``first`` to ``last``, by what they tell."""
        short, own = self.sizes[i] <= SHORT, self.told[i]
        found = Counter(what for k, what, plain in told if first <= k <= last and (plain or short))
        if any(n - own[what] > int(0.2 * max(n, own[what])) for what, n in found.items()):
            return False
        return not short or all(found[what] for what in own)

    def best(self, unit: str) -> tuple[str, float, int] | None:
        """(template, coefficient, bigrams) of the best match that reaches the threshold."""
        words = _WORD.findall(unit.lower())
        n = len(words) - 1
        # 2 * min(n, m) / (n + m) >= t bounds the sizes m that can reach t
        low = bisect_left(self.sizes, n * self.threshold / (2 - self.threshold) - 1e-9)
        high = bisect_left(self.sizes, n * (2 - self.threshold) / self.threshold + 1e-9)
        if n < 1 or low == high:
            return None
        grams = Counter(g for g in zip(words, words[1:], strict=False) if g in self.known)
        if 2 * grams.total() < self.threshold * n:
            return None
        found = [(-2 * (grams & self.grams[i]).total() / (n + self.sizes[i]), self.names[i]) for i in range(low, high)]
        enough = sorted((score, name) for score, name in found if -score >= self.threshold)
        if not enough:
            return None
        told = telling(words)
        for score, name in enough:
            if self.may_name(self.names.index(name), told, 0, n):
                return name, -score, n
        return UNKNOWN + enough[0][1], -enough[0][0], n

    def scan(self, text: str) -> list[tuple[str, str, float, int, int]]:
        """(unit, template, coefficient, start, end) of the units that match; start and end are places in the text."""
        out, at, block = [], 0, None
        units = [("text", 0, len(text))]
        for line in text.split("\n"):
            end = at + len(line)
            if line.strip():
                units.append(("line", at, end))
                block = (block[0] if block else at, end, block[2] + 1 if block else 1)
            elif block:
                if block[2] > 1:
                    units.append(("block", block[0], block[1]))
                block = None
            at = end + 1
        if block and block[2] > 1 and (block[0], block[1]) != (0, len(text)):
            units.append(("block", block[0], block[1]))
        for unit, a, b in units:
            if (found := self.best(text[a:b])) is not None:
                out.append((unit, found[0], found[1], a, b))
        whole = [(a, b) for _, _, score, a, b in out if score >= self.threshold]
        out += [("span", *s) for s in self.spans(text) if not any(a <= s[2] and s[3] <= b for a, b in whole)]
        return out

    def windows(self, hits: list[tuple[int, tuple[str, str]]], i: int) -> Iterator[tuple[float, float, int, int]]:
        """(surplus, coefficient, first bigram, last bigram): the best run from each of template i's bigrams that reaches the threshold."""
        grams, m, t = self.grams[i], self.sizes[i], self.threshold
        hits = [(at, g) for at, g in hits if g in grams]
        at = np.array([x for x, _ in hits])
        # the hit that counts again once this one is left out: of the same bigram, as many further on as the template has
        places: dict[tuple[str, str], list[int]] = {}
        counts = np.zeros(len(hits), bool)
        again = np.full(len(hits), len(hits))
        for k, (_, g) in enumerate(hits):
            seen = places.setdefault(g, [])
            if len(seen) >= grams[g]:
                again[seen[-grams[g]]] = k
            else:
                counts[k] = True
            seen.append(k)
        # shared[b]: bigrams shared by the run from the present start to hit b
        shared = np.cumsum(counts)
        last = np.searchsorted(at, at + m * (2 - t) / t + 1, "right")
        for a, b in enumerate(last.tolist()):
            size = at[a:b] - at[a] + 1 + m
            surplus = 2 * shared[a:b] - t * size
            k = int(surplus.argmax())
            if surplus[k] >= -1e-9:
                yield float(surplus[k]), float(2 * shared[a + k] / size[k]), int(at[a]), int(at[a + k])
            shared[a : again[a]] -= 1

    def spans(self, text: str) -> list[tuple[str, float, int, int]]:
        """(template, coefficient, start, end) of the runs of words that match, wherever they stand; none overlap."""
        low = text.lower()
        words = _WORD.findall(low)
        hits = [(k, g) for k, g in enumerate(zip(words, words[1:], strict=False)) if g in self.known]
        total = [0] * len(self.sizes)
        for g, n in Counter(g for _, g in hits).items():
            for i, most in self.places[g]:
                total[i] += min(n, most)
        # a run that reaches t shares t / (2 - t) of the template's bigrams at least
        least = self.threshold / (2 - self.threshold)
        told = telling(words)
        runs = [(i, w) for i, n in enumerate(total) if n and n >= self.sizes[i] * least - 1e-9 for w in self.windows(hits, i)]
        # runs that a template may name come first; a version that differs stands right behind the shared words
        fine = [self.may_name(i, told, w[2], w[3] + 2) for i, w in runs]
        found = [(not f, -w[0], self.names[i] if f else UNKNOWN + self.names[i], *w[1:]) for f, (i, w) in zip(fine, runs, strict=True)]
        taken: list[tuple[str, float, int, int]] = []
        for _, _, name, score, a, b in sorted(found):
            # a bigram reaches into the next word, so runs that end and start side by side share a word
            if all(b < x or y < a for _, _, x, y in taken):
                taken.append((name, score, a, b))
        if not taken:
            return []
        at = [m.span() for m in _WORD.finditer(low)]
        # lower case can be longer than the text it is of
        origin = None if len(low) == len(text) else [k for k, c in enumerate(text) for _ in c.lower()]
        place = lambda x: x if origin is None else origin[x]
        return sorted(((name, score, place(at[a][0]), place(at[b + 1][1] - 1) + 1) for name, score, a, b in taken), key=lambda s: s[2:])


@lru_cache(maxsize=4)
def _scanner(templates: tuple[tuple[str, str], ...], threshold: float) -> Scanner:
    return Scanner(dict(templates), threshold)


_MATCH = "_id long, unit string, license string, dice double, start int, end int"


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per unit of a text that matches: id, unit, license, dice, start, end."""
    key = tuple(sorted((templates or TEMPLATES).items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(key, threshold)
        for batch in batches:
            rows = [(i, *m) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for m in scanner.scan(t or "")]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["_id", "unit", "license", "dice", "start", "end"])

    narrow = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return narrow.mapInArrow(run, _MATCH).withColumnRenamed("_id", id_col)
