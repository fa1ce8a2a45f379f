"""License texts in documents by patience alignment.

A license template and a text are aligned on the words that are unique to both: the longest run of them that is
in the same order in both holds as anchors, and the gaps between anchors are aligned in the same way, until a gap
has no unique words left. Coverage is the share of the template's words that found a partner.

A template that is covered must have most of its words in the text, so of any more words than may be missing one is there, and the words
that both have, each as often as in the one that has it less often, are enough. These tests
pass over texts and parts of texts, and lose none. In what is left, places are cut out where words that only the template has stand
close together, so that a license that occurs several times is found each time.

Coverage does not tell a license from its neighbours, which differ in a word or two. So each template has the words that must be there
(``must``): the name with its version and clauses, right behind what introduces it, so that no other word can stand in
between ("Lesser", "Educational Community"). A place without them is no match.

Templates are notices, SPDX lines and, under names that end in ``-whole``, complete license texts (``license_texts``).

Defined results: null and empty texts have no matches. Of matches that overlap in a text the one that covers more words counts, then the better
covered one, then the first by name. Rows that repeat are scanned each.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from importlib.resources import files

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COVERAGE = 0.8
#: Words of the text per aligned word, at most, between the first and the last one.
SPREAD = 1.6
#: Up to this many pairs of words a gap without unique words is aligned in one table; a larger one is halved first.
TABLE = 2500

WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")

# The templates, public texts and usual one-line notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above "
        "copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
        "appear in all copies."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}

TEMPLATES["BSD-2-Clause-name"] = "Released under the BSD 2-Clause License."
TEMPLATES["BSD-3-Clause-name"] = "Released under the BSD 3-Clause License."
#: Ids that an SPDX line names.
SPDX = (
    "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "GPL-2.0-only",
    "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense",
)
TEMPLATES |= {f"SPDX-{name}": f"SPDX-License-Identifier: {name}" for name in SPDX}
TEMPLATES |= {x.name.removesuffix(".txt"): x.read_text("utf-8") for x in files(__package__).joinpath("license_texts").iterdir() if x.name.endswith(".txt")}

#: Words between "under" and a name that belong to no name.
FILL = r"(?:(?:the|a|an|terms|conditions|provisions|of|and|same|standard|permissive) )*"
UNDER = rf"\b(?:under|to) {FILL}"
LICENSE = r"licen[cs]e"
VERSION = r"(?:version |v )?v?"
# Patterns over a template's words joined by blanks. The first begins the name at "under" (or "to"), or is
# empty where the text itself is the license; the others must be among the aligned words.
GPL = rf"{UNDER}gnu general public {LICENSE}\b"
APACHE = rf"{UNDER}apache (?:software )?{LICENSE} {VERSION}2(?:\.0)?(?!\S)"
MUST = {
    "Apache-2.0": (APACHE,),
    "Apache-2.0-header": (APACHE,),
    "BSD-2-Clause": ("", r"\bsource code\b", r"\bbinary form\b"),
    "CC-BY-4.0": (rf"{UNDER}creative commons attribution (?:cc[ -]by )?(?:international )?{VERSION}4\.0(?!\S)",),
    "CC-BY-NC-4.0": (rf"{UNDER}cc[ -]by[ -]nc[ -]{VERSION}4\.0(?!\S)",),
    "CC-BY-SA-4.0": (rf"{UNDER}creative commons attribution[ -]share[ -]?alike (?:cc[ -]by[ -]sa )?(?:international )?{VERSION}4\.0(?!\S)",),
    "GPL-3.0": (rf"{GPL} (?:gpl )?{VERSION}3(?:\.0)?(?!\S)",),
    "GPL-3.0-header": (GPL, rf"\b(?:version |v )v?3(?:\.0)?(?!\S)|\bv3(?:\.0)?(?!\S)"),
    "ISC": ("", r"\bwithout fee\b", r"\bcopyright notice\b"),
    "MIT": (rf"{UNDER}mit {LICENSE}\b",),
    "MIT-text": ("", r"\bfree of charge\b", r"\bcopyright notice\b"),
    "MPL-2.0": (rf"{UNDER}mozilla public {LICENSE} {VERSION}2(?:\.0)?(?!\S)",),
}
MUST |= {f"SPDX-{name}": ("", rf"\bspdx-license-identifier {re.escape(name.lower())}(?!\S)") for name in SPDX}
MUST |= {f"BSD-{n}-Clause-name": (rf"{UNDER}bsd {n}-clause {LICENSE}\b",) for n in (2, 3)}
MUST |= {
    "Apache-2.0-whole": ("", r"\bapache license version 2\.0(?!\S)"),
    "BSD-2-Clause-whole": ("", r"\bsource code\b", r"\bbinary form\b"),
    "BSD-3-Clause-whole": ("", r"\bsource code\b", r"\bbinary form\b", r"\bendorse or promote\b"),
    "CC0-1.0-whole": ("", r"\bcc0 1\.0 universal\b"),
    "GPL-2.0-whole": ("", r"\bgnu general public license version 2 june 1991\b"),
    "GPL-3.0-whole": ("", r"\bgnu general public license version 3 29 june 2007\b"),
    "ISC-whole": ("", r"\bwithout fee\b", r"\bcopyright notice\b"),
    "LGPL-2.1-whole": ("", r"\bgnu lesser general public license version 2\.1(?!\S)"),
    "LGPL-3.0-whole": ("", r"\bgnu lesser general public license version 3 29 june 2007\b"),
    "MIT-whole": ("", r"\bfree of charge\b", r"\bcopyright notice\b"),
    "MPL-2.0-whole": ("", r"\bmozilla public license version 2\.0(?!\S)"),
}
#: Words in a match or shortly behind it that make it another license: the third clause of BSD-3-Clause, the fourth of the old one.
NOT_BEHIND = {name: frozenset(("endorse", "advertising")) for name in ("BSD-2-Clause", "BSD-2-Clause-whole")} | {"BSD-3-Clause-whole": frozenset(("advertising",))}
BEHIND = 60


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def longest_rising(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing run in ``values``, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    below: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        below.append(piles[k - 1] if k else -1)
        if k == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[k], piles[k] = v, i
    found, i = [], piles[-1] if piles else -1
    while i >= 0:
        found.append(i)
        i = below[i]
    return found[::-1]


def common_lengths(a: Sequence[str], b: Sequence[str]) -> list[int]:
    """The length of a longest common subsequence of ``a`` and each beginning of ``b``."""
    row = [0] * (len(b) + 1)
    for word in a:
        corner = 0
        for j, other in enumerate(b, 1):
            above = row[j]
            row[j] = corner + 1 if word == other else max(above, row[j - 1])
            corner = above
    return row


def common_words(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence, in space that grows with the lists only (Hirschberg 1975): half of ``a`` goes with
    the beginning of ``b``, and half with the rest, where the two have most in common."""
    if len(a) * len(b) <= TABLE or len(a) == 1:
        return common_in_table(a, b)
    half = len(a) // 2
    ahead, behind = common_lengths(a[:half], b), common_lengths(a[half:][::-1], b[::-1])[::-1]
    cut = max(range(len(b) + 1), key=lambda j: ahead[j] + behind[j])
    return common_words(a[:half], b[:cut]) + [(half + p, cut + q) for p, q in common_words(a[half:], b[cut:])]


def common_in_table(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence of short lists."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    found, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return found


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of equal words, rising in both lists."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, x, j, y = todo.pop()
        while i < x and j < y and a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < x and j < y and a[x - 1] == b[y - 1]:
            x, y = x - 1, y - 1
            found.append((x, y))
        if i >= x or j >= y:
            continue
        here, there = Counter(a[i:x]), Counter(b[j:y])
        place = {w: k for k, w in enumerate(b[j:y], j) if there[w] == 1}
        unique = [(k, place[w]) for k, w in enumerate(a[i:x], i) if here[w] == 1 and w in place]
        anchors = [unique[k] for k in longest_rising([p for _, p in unique])]
        if not anchors:
            found += [(i + p, j + q) for p, q in common_words(a[i:x], b[j:y])]
            continue
        found += anchors
        edges = [(i - 1, j - 1), *anchors, (x, y)]
        todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:], strict=False)]
    return sorted(found)


class Template:
    """A template's words, the words that occur in it once, and enough of them to tell texts without it."""

    def __init__(self, name: str, text: str, coverage: float):
        self.name, self.words = name, words_of(text)
        count = Counter(self.words)
        self.once = {w for w, n in count.items() if n == 1}
        missing = len(self.words) - self.needed(coverage)
        own = TEMPLATES.get(name) == text
        first, *others = MUST.get(name, ("",)) if own else ("",)
        self.title = re.compile(first) if first else None
        self.must = [re.compile(x) for x in others]
        self.not_behind = NOT_BEHIND.get(name, frozenset()) if own else frozenset()
        # The longest words are the rarest ones, as a rule; any words would do.
        order = sorted(count, key=lambda w: (-len(w), w))
        self.signs, covered = set(), 0
        for w in order:
            if covered > missing:
                break
            self.signs.add(w)
            covered += count[w]

        self.place = {w: i for i, w in enumerate(self.words) if w in self.once}
        self.count, self.least = count, self.needed(coverage)

    def reachable(self, count: Counter[str], size: int) -> bool:
        """Whether words with these counts could cover the template, in whatever order they stand."""
        if size < self.least:
            return False
        few, many = sorted((self.count, count), key=len)
        return sum(min(n, many.get(w, 0)) for w, n in few.items()) >= self.least

    def needed(self, coverage: float) -> int:
        return max(1, int(-(-len(self.words) * coverage // 1)))

    def places(self, words: list[str]) -> Iterator[tuple[int, int]]:
        """Ranges of words where the template could be: its signs stand close together, each range around one
        occurrence of the sign that is there most often. The text around a long license may repeat some of its words, so
        ranges are also laid where most signs agree on the begin."""
        reach = int(len(self.words) * SPREAD) + 1
        at = [i for i, w in enumerate(words) if w in self.signs]
        group: list[int] = []
        for i in [*at, None]:
            if group and (i is None or i - group[-1] > reach):
                seen = Counter(words[k] for k in group if words[k] in self.once)
                word = max(seen, key=lambda w: (seen[w], w)) if seen else None
                hubs = [k for k in group if words[k] == word] or [group[0]]
                before = self.words.index(word) if word else 0
                after = len(self.words) - before
                # Between two occurrences the border is half way from where one should end to where the other should begin.
                borders = [min(max((a + after + b - before) // 2, a + 1), b) for a, b in zip(hubs, hubs[1:], strict=False)]
                for hub, low, high in zip(hubs, [0, *borders], [*borders, len(words)], strict=True):
                    yield max(low, hub - reach), min(high, hub + reach)
                yield from self.agreed(words, group)
                group = []
            if i is not None:
                group.append(i)

    def agreed(self, words: list[str], group: list[int]) -> Iterator[tuple[int, int]]:
        """Ranges that begin where more signs put the begin than anywhere else within half a template."""
        size = len(self.words)
        step = max(2, size // 16)
        votes = Counter((k - self.place[words[k]]) // step for k in group if words[k] in self.place)
        votes = {c: votes[c - 1] + votes[c] + votes[c + 1] for c in list(votes)}
        cells, near = sorted(votes), size // (2 * step)
        best: list[int] = []
        for c in cells:
            if best and c - best[-1] <= near:
                if votes[c] > votes[best[-1]]:
                    best[-1] = c
            else:
                best.append(c)
        for c in best:
            yield max(0, (c - 1) * step), min(len(words), (c + 2) * step + size)

    def titled(self, words: list[str], first: int, last: int) -> Iterator[tuple[int, int, int, int]]:
        """The parts of a range around each occurrence of the template's name, and the place of the name; all of it without one."""
        if self.title is None:
            yield first, last, last, first
            return
        text = " ".join(words[first:last])
        names = [(first + text.count(" ", 0, m.start()), first + text.count(" ", 0, m.end())) for m in self.title.finditer(text)]
        lead = next(i for i, w in enumerate(self.words) if w in ("under", "to"))
        lead += int(lead * (SPREAD - 1)) + 1
        ends = [begin for begin, _ in names[1:]] + [last + lead]
        for (begin, end), then in zip(names, ends, strict=False):
            yield max(first, begin - lead), max(min(last, then - lead), end + 1), begin, end

    def holds(self, words: list[str], begin: int, end: int) -> bool:
        """Whether what must be among the words is there, and nothing behind them makes them another license."""
        text = " ".join(words[begin : end + 1])
        return all(x.search(text) for x in self.must) and self.not_behind.isdisjoint(words[begin : end + 1 + BEHIND])


def find_licenses(text: str, templates: list[Template], coverage: float) -> list[tuple[str, int, int, float]]:
    """(name, begin, end, coverage) of the licenses in a text; offsets count code points."""
    if not text:
        return []
    low = text.lower()
    present = Counter(WORD.findall(low))
    size = present.total()
    possible = [t for t in templates if not t.signs.isdisjoint(present) and t.reachable(present, size)]
    if not possible:
        return []
    spans = [(m.start(), m.end()) for m in WORD.finditer(low)]
    words = [low[b:e] for b, e in spans]
    found = []
    for t in possible:
        for first, last, named, name_end in (x for place in t.places(words) for x in t.titled(words, *place)):
            if not t.reachable(Counter(words[first:last]), last - first):
                continue
            pairs = align(t.words, words[first:last])
            if len(pairs) < t.needed(coverage):
                continue
            begin, end = min(first + pairs[0][1], named), max(first + pairs[-1][1], name_end)
            if end - begin + 1 <= SPREAD * len(pairs) + 2 and t.holds(words, begin, end):
                found.append((len(pairs), len(pairs) / len(t.words), t.name, begin, end))
    kept: list[tuple] = []
    for m in sorted(found, key=lambda m: (-m[0], -m[1], m[2], m[3])):
        if all(m[4] < k[3] or k[4] < m[3] for k in kept):
            kept.append(m)
    same = len(low) == len(text)
    offsets = spans if same else [(m.start(), m.end()) for m in WORD.finditer(text)]
    return [(name, offsets[b][0], offsets[e][1], c) for _, c, name, b, e in sorted(kept, key=lambda m: m[3])]


def scan_licenses(rows: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """(id, text) -> (id, license, begin, end, coverage), one row per license found."""
    texts = dict(TEMPLATES if templates is None else templates)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready = [t for t in (Template(n, x, coverage) for n, x in sorted(texts.items())) if t.words]
        for batch in batches:
            out = [(i, *m) for i, text in zip(batch["id"], batch["text"], strict=True) if isinstance(text, str) for m in find_licenses(text, ready, coverage)]
            frame = pd.DataFrame(out, columns=["id", "license", "begin", "end", "coverage"])
            frame["id"] = frame["id"].astype(batch["id"].dtype)
            yield frame

    return rows.select("id", "text").mapInPandas(run, f"id {kind}, license string, begin int, end int, coverage double")


def document_licenses(documents: DataFrame) -> DataFrame:
    """(doc_id, license, begin, end, coverage) of all licenses in ``documents``."""
    return scan_licenses(documents.select(F.col("doc_id").alias("id"), "text")).withColumnRenamed("id", "doc_id")
