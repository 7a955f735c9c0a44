"""License notices in documents, by conditional compression and exact wording.

* **Candidate blocks.** Where ``most`` words of a template may differ, a notice holds one
  of any ``most + 1`` of its words; the longest are the template's anchors. The words
  around an anchor's place, as many before and after as a notice can have, are a block;
  blocks that meet are one, and a long one is cut into pieces that overlap by a notice.
* **Ranking.** A block is compressed alone and with every template as a zstandard raw
  dictionary. Templates are ranked by the bytes that they save.
* **Confirming.** In that order a template is aligned with the block's words, and what
  differs is counted exactly (words missing, words put in between). The first template
  that is there is confirmed with its closest place, its words are masked, and what is
  left of the block is compressed and ranked again until nothing is confirmed. A place that
  differs never takes words of another template's exact notice, unless that wording is part
  of its own: the exact one goes first. Every template is tried: neither a saving nor a rank
  rules one out. The only test before the alignment is that the block has enough of the
  template's words.

So of notices that hold one another (a license's first sentence and its whole text) the one
that explains most bytes is reported. A notice is found if at most ``most_different`` of its
words differ (of a template with words that must be there, one may differ in any case).

Templates are public notices, fixed values below; a caller may pass its own. Their number
bounds the work per block; a text is read as a stream, one block in memory at a time.

Defined results: null and empty texts have no notice; a template without words is never
found, an empty set of templates finds nothing; a notice that occurs several times is
reported once per place; equal rows are reported alike; an empty table gives an empty
result; other columns are carried inside ``row``.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from convoscope.llm.common import annotate

#: Notices as their licenses' publishers word them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-header": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction'
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation"
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details. You should have received a copy of the GNU General Public License along with this "
        "program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
        "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE."
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE "
        'IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER "
        "IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-Clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        'with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS '
        "OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
        "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
        "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
        "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
        "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
}

#: Words of one-line notices that name the license and may not differ.
MUST = {
    "Apache-2.0": "apache 2.0",
    "MIT": "mit",
    "GPL-3.0": "gnu general public 3",
    "CC-BY-NC-4.0": "cc by nc 4.0",
    "CC-BY-4.0": "creative commons attribution 4.0",
    "MPL-2.0": "mozilla 2.0",
}

_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)?")


def wording(text: str) -> list[str]:
    return [_spelt(w) for w in _WORD.findall(text)]


def _spelt(word: str) -> str:
    """A word in lower case, and in the one spelling of those that have two."""
    return word.lower().replace("licence", "license")


@dataclass(frozen=True)
class LicenseParams:
    """The share of a notice's words that may differ, and the compression level."""

    most_different: float = 0.1
    level: int = 3


Word = tuple[int, int, str]


class Matcher:
    """Templates with their dictionaries and words."""

    def __init__(self, templates: dict[str, str], params: LicenseParams, must: dict[str, str] = MUST):
        self.templates = {k: w for k, v in templates.items() if (w := wording(v))}
        self.must = {k: [x in must.get(k, "").split() for x in w] for k, w in self.templates.items()}
        self.most = {
            k: max(int(params.most_different * len(w)), int(any(self.must[k]))) for k, w in self.templates.items()
        }
        self.counts = {k: Counter(w) for k, w in self.templates.items()}
        self.plain = zstandard.ZstdCompressor(level=params.level, write_checksum=False)
        self.given = {
            k: zstandard.ZstdCompressor(
                level=params.level, write_checksum=False,
                dict_data=zstandard.ZstdCompressionDict(" ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT),
            )
            for k, w in self.templates.items()
        }
        #: Templates whose wording is part of a template's own.
        self.holds = {
            k: {o for o, part in self.templates.items() if any(w[i : i + len(part)] == part for i in range(len(w) - len(part) + 1))}
            for k, w in self.templates.items()
        }
        #: What a template saves of its own words, the most it can save.
        self.ceiling = {k: max(1, self._saved(k, " ".join(w).encode())) for k, w in self.templates.items()}
        # Anchors; None if every word of a text may be the only one in common.
        self.anchors: dict[str, set[str] | None] = {}
        for k, words in self.templates.items():
            if any(self.must[k]):
                self.anchors[k] = {max((w for w, own in zip(words, self.must[k]) if own), key=lambda w: (len(w), w))}
                continue
            longest = sorted(set(words), key=lambda w: (-len(w), w))[: self.most[k] + 1]
            self.anchors[k] = set(longest) if len(longest) > self.most[k] else None

    def _saved(self, name: str, body: bytes) -> int:
        return len(self.plain.compress(body)) - len(self.given[name].compress(body))

    def matches(self, text: str | None) -> list[dict]:
        if not text or not self.templates:
            return []
        # A text without any anchor isn't read word by word; beyond ASCII case may add letters.
        low = _spelt(text)
        near = [k for k, own in self.anchors.items() if own is None or any(a in low or not a.isascii() for a in own)]
        del low
        out: list[dict] = []
        # Words of confirmed notices, as far as the next block may hold them again.
        masked: set[int] = set()
        for block, own in self._blocks(text, near) if near else ():
            masked &= {start for start, _, _ in block}
            out += self._confirmed(block, own, masked)
        return sorted(out, key=lambda m: (m["start"], m["license"], m["end"]))

    def _blocks(self, text: str, near: list[str]) -> Iterator[tuple[list[Word], int]]:
        """Words ``(start, end, word)`` of each candidate block, and how many of them may
        begin a notice: what begins later is whole in the next piece."""
        # The most words of a notice, those put in between included.
        span = max(len(self.templates[k]) + self.most[k] for k in near)
        everywhere = any(self.anchors[k] is None for k in near)
        anchors = set().union(*(self.anchors[k] or () for k in near))
        before: deque[Word] = deque(maxlen=span)
        block: list[Word] | None = None
        left = 0
        for m in _WORD.finditer(text):
            word = (m.start(), m.end(), _spelt(m.group()))
            left -= 1
            if everywhere or word[2] in anchors:
                block = list(before) if block is None else block
                left = span
            if block is None:
                before.append(word)
                continue
            block.append(word)
            if not left:
                yield block, len(block)
                before = deque(block, maxlen=span)
                block = None
            elif len(block) >= 4 * span:
                yield block, len(block) - span
                block = block[-span:]
        if block:
            yield block, len(block)

    def _confirmed(self, block: list[Word], own: int, masked: set[int]) -> Iterator[dict]:
        words: list[str | None] = [None if start in masked else word for start, _, word in block]
        while True:
            order = self.ranked(words)
            rank_of = {name: (rank, saved) for rank, (saved, name) in enumerate(order, 1)}
            exact = [(at, name) for name in rank_of for at in self._exact(name, words, own)]
            for _, name in order:
                place = self._closest(name, words, own, self.most[name])
                if place is not None:
                    break
            else:
                return
            different, first, last = place
            # Words that differ may not be those of another exact notice.
            for at, other in exact if different else ():
                if other not in self.holds[name] and at < last and first < at + len(self.templates[other]):
                    name, different, first, last = other, 0, at, at + len(self.templates[other])
                    break
            rank, saved = rank_of[name]
            yield {
                "license": name, "start": block[first][0], "end": block[last - 1][1], "different": different,
                "saved": saved, "share": saved / self.ceiling[name], "rank": rank,
            }
            masked.update(start for start, _, _ in block[first:last])
            words[first:last] = [None] * (last - first)

    def _exact(self, name: str, words: list[str | None], own: int) -> list[int]:
        template = self.templates[name]
        size = len(template)
        return [
            i for i in range(min(own, len(words) - size + 1)) if words[i] == template[0] and words[i : i + size] == template
        ]

    def ranked(self, words: list[str | None]) -> list[tuple[int, str]]:
        """All templates by the bytes that each saves of the words, the most first."""
        body = " ".join(w for w in words if w is not None).encode()
        return sorted(((self._saved(k, body), k) for k in self.templates), key=lambda x: (-x[0], x[1])) if body else []

    def _closest(self, name: str, words: list[str | None], own: int, most: int) -> tuple[int, int, int] | None:
        """The run of unmasked words that differs least from the template, in at most
        ``most`` words, as ``(different, first, one past the last)``; of equals the shortest,
        then the first."""
        # Each word of the template that the block lacks is one that differs.
        there = Counter(words)
        if sum(max(0, n - there[w]) for w, n in self.counts[name].items()) > most:
            return None
        best = None
        # By number of the template's words read: (words that differ, first).
        cells: dict[int, tuple[int, int]] = {}
        for at, word in enumerate(words):
            if word is None:
                cells = {}
                continue
            cells, ending = self._step(name, most, word, at if at < own else None, cells)
            if ending is not None:
                key = (ending[0], at + 1 - ending[1], ending[1])
                best = min(best, key) if best else key
        return (best[0], best[2], best[2] + best[1]) if best else None

    def _step(self, name: str, most: int, word: str, start: int | None, cells: dict[int, tuple[int, int]]):
        """The cells after one more word, and the best run that is a notice and ends with it.
        Of runs that differ in as many words the one that starts last is kept."""
        template, must = self.templates[name], self.must[name]
        size = len(template)
        # In a cell of i words, word i - 1 was the last in common. This word is put in
        # between, or it is the next in common after leaving some of the template out.
        after = {i: (n + 1, s) for i, (n, s) in cells.items() if n < most}
        ending = None

        def take(at: int, n: int, s: int) -> None:
            nonlocal ending
            if at < size and (at not in after or (n, -s) < (after[at][0], -after[at][1])):
                after[at] = (n, s)
            whole = n + size - at
            if whole <= most and not any(must[at:]) and (ending is None or (whole, -s) < (ending[0], -ending[1])):
                ending = (whole, s)

        def skip(i: int, n: int, s: int) -> None:
            for left_out in range(min(most - n + 1, size - i)):
                if template[i + left_out] == word:
                    take(i + left_out + 1, n + left_out, s)
                if must[i + left_out]:
                    break

        if start is not None:
            skip(0, 0, start)
        for i, (n, s) in cells.items():
            skip(i, n, s)
        return after, ending


def scan_licenses(
    docs: DataFrame, templates: dict[str, str] | None = None, params: LicenseParams = LicenseParams(),
    must: dict[str, str] = MUST, text: str = "text",
) -> DataFrame:
    """``row`` (the input's columns) with ``notices``: license, start and end of its words
    in characters, words that differ; bytes that its template saved of the block when it
    was confirmed, their share of what the template can save, and its rank by them."""
    chosen = dict(TEMPLATES if templates is None else templates)
    made: list[Matcher] = []

    def work(column: pa.Array) -> list[pa.Array]:
        if not made:
            made.append(Matcher(chosen, params, must))
        kind = pa.list_(pa.struct([
            ("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("different", pa.int64()),
            ("saved", pa.int64()), ("share", pa.float64()), ("rank", pa.int64()),
        ]))
        return [pa.array([made[0].matches(t) for t in column.to_pylist()], kind)]

    return annotate(
        docs, text, work,
        "notices array<struct<license:string,start:bigint,end:bigint,different:bigint,saved:bigint,share:double,rank:bigint>>",
    )
