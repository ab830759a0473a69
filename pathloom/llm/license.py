"""License scans by patience alignment of texts with license templates.

Texts and templates are folded to words. A region is a run of words in which a template's telling words (not function
words) are at most ``GAP`` words apart. From each place of a region that holds one of the template's first words, windows of
``REACHES`` times the template's words are aligned with it, whatever the region's length; a window whose words cannot cover
``COVERAGE`` of the template, counted as multisets, is passed over, which loses no match. The window with the best coverage
counts, of equal ones the shortest, and the search goes on behind it. In an alignment words that are unique on both sides are
anchors, the longest increasing subsequence of them is kept, gaps between anchors are aligned the same way, and equal words
at the ends of a gap are matched. Coverage is the share of the template's words that are matched.

Templates are whole public license texts (``licenses/``), shorter ones and usual notices below. Null and empty texts have no
license; several licenses, and several places of one, are all reported; of equal coverage the longer place comes first, then
the earlier; null ids and repeated rows give rows like others; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from bisect import bisect_left
from functools import cache
from importlib import resources

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .decontam import offsets, words_of

COVERAGE = 0.8
GAP = 12
#: Lengths of the windows that are aligned, in template lengths.
REACHES = (4 / 3, 8 / 3, 16 / 3)
#: Words that templates share with any English text.
FUNCTION_WORDS = frozenset(b"a an and any are as at be by for from has have if in into is it its may no not of on or other shall so such that the their this to was were which will with you your".split())
#: Public license notices, by SPDX name.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-or-later-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
}


@cache
def templates() -> dict[str, str]:
    """Name to text: the notices and short texts above, and the whole texts in the package's folder."""
    whole = {f.name.removesuffix(".txt"): f.read_text() for f in sorted(resources.files(__package__).joinpath("licenses").iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}
    return TEMPLATES | whole


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs (sorted by the first) whose second numbers increase, by patience piles."""
    tops: list[int] = []
    last: list[int] = []
    back: list[int] = []
    for k, (_, y) in enumerate(pairs):
        pile = bisect_left(tops, y)
        back.append(last[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(y)
            last.append(k)
        else:
            tops[pile], last[pile] = y, k
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(text: list[bytes], template: list[bytes]) -> list[tuple[int, int]]:
    """Matched places (in the text, in the template), both increasing."""
    out, todo = [], [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            out.append((b - 1, d - 1))
            b, d = b - 1, d - 1
        if a == b or c == d:
            continue
        left, right = Counter(text[a:b]), Counter(template[c:d])
        where = {w: k for k, w in enumerate(template[c:d], c) if right[w] == 1 and left[w] == 1}
        chain = increasing([(k, where[w]) for k, w in enumerate(text[a:b], a) if w in where])
        if not chain:
            continue
        out += chain
        ends = [(a - 1, c - 1), *chain, (b, d)]
        todo += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(ends, ends[1:], strict=False) if p + 1 < q and r + 1 < s]
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE):
        self.coverage = coverage
        found = [(name, words_of(text.encode())) for name, text in templates.items()]
        self.templates = [(name, w, Counter(w), frozenset(w) - FUNCTION_WORDS, frozenset(w), len(set(w)) - (1 - coverage) * len(w) - 1e-9, coverage * len(w)) for name, w in found if w]
        self.telling = frozenset().union(*[t[3] for t in self.templates]) if self.templates else frozenset()

    def scan(self, words: list[bytes]) -> list[tuple[str, float, int, int]]:
        """(license, coverage, first word, last word), the best first."""
        there, out = set(words), []
        # a text that is too short, or lacks too many of a template's distinct words, cannot cover it
        able = [t[:4] for t in self.templates if len(words) >= t[6] and len(t[4] & there) >= t[5]]
        places = [k for k, w in enumerate(words) if w in self.telling] if able else []
        for name, template, counts, telling in able if places else ():
            own = [k for k in places if words[k] in telling]
            cuts = [0, *(k for k in range(1, len(own)) if own[k] - own[k - 1] > GAP), len(own)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b:
                    out += self.region(words, max(0, own[a] - GAP), min(len(words), own[b - 1] + GAP + 1), name, template, counts)
        return sorted(out, key=lambda x: (-x[1], x[2] - x[3], x[2], x[0]))

    def region(self, words, start, end, name, template, counts) -> list[tuple[str, float, int, int]]:
        """Matches between two places, none within another."""
        need = self.coverage * len(template)
        if end - start < need:
            return []
        heads = {*template[: max(1, len(template) - int(need) + 1)]}
        reaches = [int(r * len(template)) + 2 for r in REACHES]
        out, past, left, right, can, have = [], start, start, start, 0, Counter()
        for begin in range(start, end):
            # what the largest window from here can match at most
            while right < min(end, begin + reaches[-1]):
                w, right = words[right], right + 1
                if w in counts:
                    have[w] += 1
                    can += have[w] <= counts[w]
            while left < begin:
                w, left = words[left], left + 1
                if w in counts:
                    can -= have[w] <= counts[w]
                    have[w] -= 1
            if begin < past or can < need or words[begin] not in heads:
                continue
            best = None
            for reach in reaches:
                found = self.match(words, begin, min(end, begin + reach), template)
                best = found if found and (best is None or found[0] > best[0]) else best
                if begin + reach >= end:
                    break
            if best:
                out.append((name, *best))
                past = best[2] + 1
        return out

    def match(self, words, start, end, template) -> tuple[float, int, int] | None:
        """(coverage, first word, last word) of the template between two places, if it is there."""
        pairs = align(words[start:end], template)
        if len(pairs) < self.coverage * len(template):
            return None
        return len(pairs) / len(template), start + pairs[0][0], start + pairs[-1][0]


SCAN = "doc_id long, licenses array<struct<license:string,coverage:double,start:int,end:int>>"


def scan(docs: DataFrame, given: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """The licenses of every document, with coverage and code-point offsets in the original text."""
    given = templates() if given is None else dict(given)
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(given, coverage)
        for whole in batches:
            for part in common.slices(whole):
                rows = []
                for text in common.utf8(part):
                    found = scanner.scan(words_of(text))
                    at = offsets(text.decode(), [(a, b) for *_, a, b in found]) if found else []
                    rows.append([{"license": name, "coverage": share, "start": a, "end": b} for (name, share, *_), (a, b) in zip(found, at, strict=True)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, kind)], names=["doc_id", "licenses"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCAN)


def report(docs: DataFrame) -> DataFrame:
    """The digest of :func:`scan`, one row for each document."""
    found = scan(docs)
    each = F.transform("licenses", lambda x: F.concat_ws(":", x["license"], F.round(x["coverage"], 6).cast("string"), x["start"].cast("string"), x["end"].cast("string")))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.get("licenses", F.lit(0))["license"].alias("best_license"), F.round(F.coalesce(F.get("licenses", F.lit(0))["coverage"], F.lit(0.0)), 6).alias("best_coverage"), F.array_join(each, ",").alias("found"))
