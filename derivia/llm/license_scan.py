"""License scans by conditional compression: a block that a template describes shrinks when the template is known."""

from __future__ import annotations

import difflib
import re
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from derivia.llm._common import arrow_setup, chunks

# The wording of common license texts and notices.
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
_MIT_OFF = "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_OFF = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GNU = "This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."

#: The wordings of each license, each as a whole; a longer one holds more of the license.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (_MIT, f"{_MIT} {_MIT_OFF}",),
    "MIT-notice": ("Released under the MIT License.",),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",),
    "Apache-2.0-notice": ("Licensed under the Apache License, Version 2.0.",),
    "Apache-1.1": ("The end-user documentation included with the redistribution, if any, must include the following acknowledgment: \"This product includes software developed by the Apache Software Foundation (http://www.apache.org/).\" Alternately, this acknowledgment may appear in the software itself, if and wherever such third-party acknowledgments normally appear.",),
    "BSD-2-Clause": (_BSD, f"{_BSD} {_BSD_OFF}",),
    "BSD-3-Clause": (f"{_BSD} {_BSD_NAMES}", f"{_BSD} {_BSD_NAMES} {_BSD_OFF}",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "GPL-3.0-or-later": (_GNU.format(what="program", name="General Public License", version="3"),),
    "GPL-3.0-notice": ("This work is licensed under the GNU General Public License, version 3.",),
    "GPL-2.0-or-later": (_GNU.format(what="program", name="General Public License", version="2"),),
    "GPL-2.0-notice": ("This work is licensed under the GNU General Public License, version 2.",),
    "AGPL-3.0-or-later": (_GNU.format(what="program", name="Affero General Public License", version="3"),),
    "LGPL-3.0-or-later": (_GNU.format(what="library", name="Lesser General Public License", version="3"),),
    "LGPL-2.1-or-later": (_GNU.format(what="library", name="Lesser General Public License", version="2.1"),),
    "LGPL-2.0-or-later": (_GNU.format(what="library", name="Library General Public License", version="2"),),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "CC-BY-4.0-notice": ("Licensed under CC BY 4.0.",),
    "CC-BY-NC-4.0-notice": ("Licensed under CC BY-NC 4.0.",),
    "CC-BY-SA-4.0-notice": ("Licensed under CC BY-SA 4.0.",),
    "CC-BY-ND-4.0-notice": ("Licensed under CC BY-ND 4.0.",),
    "CC-BY-NC-SA-4.0-notice": ("Licensed under CC BY-NC-SA 4.0.",),
    "CC-BY-NC-ND-4.0-notice": ("Licensed under CC BY-NC-ND 4.0.",),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal.",),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",),
}
#: Words of which licenses' names are made. Those of the first set belong to no text of another license.
OWN_WORDS = frozenset("affero agpl apache boost bsd by-nc by-nc-nd by-nc-sa by-nd by-sa cc cc0 eclipse gnu gpl isc lesser lgpl mit mozilla mpl unlicense x11 zlib".split())
NAME_WORDS = OWN_WORDS | frozenset("by general later license only public version".split())
_TOKEN = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")


_NUMBER = re.compile(r"v?\d[\d.]*")


def naming(word: str) -> bool:
    """Whether a word is part of licenses' names or versions."""
    return word in NAME_WORDS or bool(_NUMBER.fullmatch(word))


def name_places(words: Sequence[str]) -> list[tuple[int, bool]]:
    """Places of words of names, single ones inside of a name included, and whether the next word is one too."""
    mine = [naming(w) for w in words]
    mine = [x or (0 < i < len(words) - 1 and mine[i - 1] and mine[i + 1]) for i, x in enumerate(mine)]
    return [(i, i + 1 < len(words) and mine[i + 1]) for i, x in enumerate(mine) if x]


def wording(text: str) -> list[str]:
    """Words in lower case without punctuation; versions and hyphenated names stay whole."""
    return _TOKEN.findall(text.lower())


class Scanner:
    """Templates (a wording, or several, for each license) as raw dictionaries for the compressor."""

    def __init__(self, templates: Mapping[str, str | Sequence[str]], *, least_reduction: float = 0.25, most_missing: float = 0.1, most_added: float = 0.2, level: int = 9):
        import zstandard

        wordings = {(k, i): text for k, v in templates.items() for i, text in enumerate([v] if isinstance(v, str) else v) if wording(text)}
        self.plain = zstandard.ZstdCompressor(level=level, write_content_size=False)
        self.known = {k: zstandard.ZstdCompressor(level=level, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(v.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for k, v in wordings.items()}
        self.words = {k: wording(v) for k, v in wordings.items()}
        self.least, self.missing, self.added = least_reduction, most_missing, most_added
        self.code = {w: i for i, w in enumerate(sorted({w for x in self.words.values() for w in x}), 1)}  # 0: in no template
        self.counts = np.array([np.bincount([self.code[w] for w in x], minlength=len(self.code) + 1) for x in self.words.values()]).reshape(len(self.words), -1)
        self.named = {k: name_places(x) for k, x in self.words.items()}
        self.need = np.array([len(x) - int(most_missing * len(x)) for x in self.words.values()])

    def saved(self, name: tuple[str, int], part: bytes) -> tuple[int, float]:
        """By how many bytes, and what share of its compressed size, the part shrinks when the template is known."""
        alone = len(self.plain.compress(part))
        less = alone - len(self.known[name].compress(part))
        return less, less / alone

    def pad(self, name: tuple[str, int]) -> int:
        """Words that a license in the text may have more than its template."""
        return max(4, len(self.words[name]) // 2)

    def aligned(self, name: tuple[str, int], words: list[str], a: int, b: int) -> tuple[int, int, int] | None:
        """First word, end and words held of the template in words a to b, None where its wording differs by too much.

        Of ordinary words a share may be missing or put in between. Those of names and versions must be there, each run
        of them together; and no word that belongs to another license's name may have been put in between.
        """
        template = self.words[name]
        most = self.missing * len(template)
        if len(template) - (Counter(words[a:b]) & Counter(template)).total() > most:
            return None
        same = [m for m in difflib.SequenceMatcher(None, words[a:b], template, autojunk=False).get_matching_blocks() if m.size]
        held = sum(m.size for m in same)
        if not held or len(template) - held > most:
            return None
        lo, hi = a + same[0].a, a + same[-1].a + same[-1].size
        at = {m.b + k: a + m.a + k for m in same for k in range(m.size)}
        if any(i not in at or (joined and at.get(i + 1) != at[i] + 1) for i, joined in self.named[name]):
            return None
        put = set(range(lo, hi)) - set(at.values())
        if len(put) > max(4, self.added * len(template)) or any(words[i] in OWN_WORDS for i in put):
            return None
        return lo, hi, held

    def stretches(self, k: int, name: tuple[str, int], words: list[str], codes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Stretches of the words, apart from each other, that hold the template's words in order, and how many.

        Every window that has enough words of the template is tried, or lies in one that was; those with most of its
        word pairs come first.
        """
        template, pad, need, words = self.words[name], self.pad(name), self.need[k], list(words)
        width, n = len(template) + pad, len(words)
        starts = np.arange(max(1, n - width + 1))
        ends = np.minimum(starts + width, n)
        inside = (self.counts[k] > 0)[codes]
        sums = np.r_[0, np.cumsum(inside)]
        held = sums[ends] - sums[starts]
        size = len(self.code) + 1
        own = np.array([self.code[w] for w in template])
        pairs = np.r_[0, np.cumsum(np.isin(codes[:-1] * size + codes[1:], own[:-1] * size + own[1:]))]
        tried = np.flatnonzero(held >= need)
        tried = tried[np.argsort(pairs[starts[tried]] - pairs[np.maximum(ends[tried] - 1, starts[tried])], kind="stable")]
        for at in tried.tolist():
            if held[at] < need:
                continue
            a, b = at, int(ends[at])
            found = self.aligned(name, words, a, b)
            if found is None or found[2] < len(template):
                wide = self.aligned(name, words, max(0, a - pad), min(n, b + pad))
                if wide and (found is None or (wide[2] > found[2] and wide[1] - wide[0] <= width)):
                    found = wide
            if found is None:
                held[max(0, at - pad) : at + pad + 1] = 0
                continue
            lo, hi, _ = found
            yield found
            words[lo:hi] = [""] * (hi - lo)
            inside[lo:hi] = False
            first, last = max(0, lo - width + 1), min(len(starts), hi)
            sums = np.r_[0, np.cumsum(inside[first : min(n, last + width)])]
            left = sums[ends[first:last] - first] - sums[starts[first:last] - first]
            held[first:last] = np.minimum(held[first:last], left)

    def scan(self, text: str) -> list[tuple[int, int, str, float, int, int]]:
        """First line, last line, license, reduction, template words missing, words put in between, of each finding."""
        words = [w.lower() for w in _TOKEN.findall(text)]
        get = self.code.get
        codes = np.array([get(w, 0) for w in words], np.int64)
        has = np.bincount(codes, minlength=len(self.code) + 1)
        likely = np.flatnonzero(np.minimum(self.counts, has).sum(1) >= self.need)
        if not len(likely):
            return []
        names, spans = list(self.words), [m.span() for m in _TOKEN.finditer(text)]
        ranked = []
        for k in likely.tolist():
            name = names[k]
            for lo, hi, held in self.stretches(k, name, words, codes):
                less, share = self.saved(name, text[spans[lo][0] : spans[hi - 1][1]].encode())
                if share >= self.least:
                    ranked.append((-less, -share, name, lo, hi, held))
        out = []
        taken = np.zeros(len(words), bool)
        for _, share, name, lo, hi, held in sorted(ranked):
            if taken[lo:hi].any():
                continue
            taken[lo:hi] = True
            begin = text.count("\n", 0, spans[lo][0])
            out.append((begin, begin + text.count("\n", spans[lo][0], spans[hi - 1][1]), name[0], round(-share, 4), len(self.words[name]) - held, hi - lo - held))
        return sorted(out)


def scanned(docs: DataFrame, templates: Mapping[str, str | Sequence[str]] = TEMPLATES, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per confirmed finding: id, first_line, last_line, license, reduction, n_missing, n_added.

    Line breaks and other marks between words do not matter. Every stretch of a text with enough of a template's words
    is aligned with it, and held if at most a tenth of its words is missing, in order, at most a fifth (or four) put in
    between, every word of names and versions is there with nothing inside of a name, and no word of another license's
    name was put in. Each is compressed with the template as raw dictionary; of those that shrink by a quarter the ones
    that save most bytes come first, and one counts if no better one holds its words.

    A license has one wording or several; they are constants of the program, so licenses that are not among them are not
    found. Documents without a finding have no row; null and empty texts have none; repeated rows are reported each; an
    empty table gives an empty one. A text is searched whole, in one task, in memory of some fifty times its size. Ids
    may be of any type, other columns of any name.
    """
    arrow_setup(docs.sparkSession)
    templates = dict(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, **options)
        for batch in chunks(batches):
            found = [(i, *x) for i, text in enumerate(batch.column("text").to_pylist()) for x in scanner.scan(text or "")]
            if found:
                row, first, last, name, reduction, missing, added = zip(*found, strict=True)
                ints = [pa.array(x, pa.int64()) for x in (first, last, missing, added)]
                yield pa.RecordBatch.from_arrays([batch.column(id_col).take(pa.array(row)), ints[0], ints[1], pa.array(name), pa.array(reduction), ints[2], ints[3]], [id_col, "first_line", "last_line", "license", "reduction", "n_missing", "n_added"])

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, first_line long, last_line long, license string, reduction double, n_missing long, n_added long"
    return docs.select(F.col(id_col), F.col(text_col).alias("text")).filter("text <> ''").mapInArrow(run, schema)
