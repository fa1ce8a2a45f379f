from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from ballast.llm.licenses import COVERAGE, TEMPLATES, Template, align, document_licenses, find_licenses, longest_rising, scan_licenses, words_of
from ballast.sources.tables import table
from tests.llm.cases import documents, no_documents

READY = [Template(n, t, COVERAGE) for n, t in sorted(TEMPLATES.items())]


def found(text):
    return [(name, text[b:e], round(c, 3)) for name, b, e, c in find_licenses(text, READY, COVERAGE)]


def test_longest_rising_runs():
    rng = random.Random(2)
    for _ in range(300):
        v = rng.sample(range(8), rng.randrange(8))
        best = max((len(c) for n in range(len(v) + 1) for c in combinations(v, n) if list(c) == sorted(c)), default=0)
        got = [v[i] for i in longest_rising(v)]
        assert got == sorted(got) and len(got) == best


def test_alignment_rises_and_matches():
    rng = random.Random(3)
    for _ in range(300):
        a, b = (rng.choices("abcdefghij", k=rng.randrange(25)) for _ in range(2))
        pairs = align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    same = rng.choices("abc", k=40)
    assert len(align(same, same)) == 40


@pytest.mark.parametrize("name", sorted(TEMPLATES))
def test_each_template_is_found_in_a_text(name):
    text = f"Some words of a document. {TEMPLATES[name]} And more words, under the hood."
    ((got, span, coverage),) = found(text)
    assert got == name and coverage == 1.0 and words_of(span) == words_of(TEMPLATES[name])


def test_changed_copies():
    text = TEMPLATES["MIT-text"].replace("hereby granted", "given").replace("copy of", "copy  of\n#").upper()
    ((name, _, coverage),) = found("x " * 500 + text + " y" * 500)
    assert name == "MIT-text" and 0.9 < coverage < 1
    assert found(" ".join(words_of(TEMPLATES["MIT-text"])[:40])) == []


def test_every_occurrence_counts():
    text = f"{TEMPLATES['MIT']} a b c d e f {TEMPLATES['MIT']}\n{TEMPLATES['MIT']} x {TEMPLATES['GPL-3.0']}"
    assert [n for n, _, _ in found(text)] == ["MIT", "MIT", "MIT", "GPL-3.0"]


def test_clean_texts_have_none():
    assert found("The license of the version is released to the public under general terms, and this work is a copy.") == []


def test_signs_lose_no_covered_text():
    rng = random.Random(5)
    for t in READY:
        for _ in range(50):
            words = [w for w in t.words if rng.random() < 0.85]
            if len(align(t.words, words)) >= t.needed(COVERAGE):
                assert not t.signs.isdisjoint(words)


def test_lines_of_the_test_documents(spark, data):
    df = table(spark, data.replace("0.001", "0.01"), "documents")
    got = {(r.doc_id, r.license) for r in document_licenses(df).collect()}
    want = {(r.doc_id, n) for r in df.collect() for n in ("MIT", "GPL-3.0", "CC-BY-NC-4.0", "Apache-2.0") if TEMPLATES[n] in (r.text or "")}
    assert want and want <= got and len(got - want) <= 0.02 * len(want)


def test_defined_results(spark):
    assert document_licenses(documents(spark)).collect() == [] and document_licenses(no_documents(spark)).collect() == []
    rows = [(None, TEMPLATES["MIT"]), (1, TEMPLATES["MIT"]), (1, TEMPLATES["MIT"]), (2, "word " * 200_000 + TEMPLATES["GPL-3.0"])]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("license", F.lit("mine"))
    got = sorted(((r.id, r.license, r.begin) for r in scan_licenses(df).collect()), key=repr)
    assert got == sorted([(None, "MIT", 0), (1, "MIT", 0), (1, "MIT", 0), (2, "GPL-3.0", 1_000_000)], key=repr)


@pytest.mark.parametrize(
    "text",
    [
        "Released under the BSD License.",
        "Released under the MIT-0 License.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-NC-SA 4.0.",
        "Licensed under CC BY-NC 3.0.",
        "Licensed under the Educational Community License, Version 2.0.",
        "Licensed under the Apache License, Version 1.1.",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This work is licensed under the GNU General Public License, version 2.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution NoDerivatives 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.",
        TEMPLATES["Apache-2.0-header"].replace("Apache License", "Educational Community License"),
        TEMPLATES["GPL-3.0-header"].replace("GNU General", "GNU Lesser General"),
        TEMPLATES["GPL-3.0-header"].replace("version 3", "version 2"),
        TEMPLATES["MPL-2.0"].replace("Mozilla Public License, v. 2.0", "Common Public License, v. 2.0"),
        TEMPLATES["BSD-2-Clause"] + " Neither the name of the holder nor the names of its contributors may be used to endorse or promote products.",
    ],
)
def test_neighbours_of_a_license_are_not_it(text):
    assert found(text) == [] and found(f"One two. {text} Three four.") == []


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Released under the terms of the MIT License", ["MIT"]),
        ("Licensed under the Apache License 2.0", ["Apache-2.0"]),
        ("This work is licensed under the GNU General Public License v3.", ["GPL-3.0"]),
        ("This work is licensed under the GNU General Public License, version 3.0.", ["GPL-3.0"]),
        ("Licensed under CC BY NC 4.0", ["CC-BY-NC-4.0"]),
        ("This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License.", ["CC-BY-SA-4.0"]),
        ("Released under the BSD License. Released under the MIT License.", ["MIT"]),
        ("Released under the BSD License. Here are more words. Released under the MIT License.", ["MIT"]),
    ],
)
def test_usual_forms_of_a_name(text, want):
    assert [n for n, _, _ in found(text)] == want
    assert all(words_of(span)[0] in ("released", "licensed", "this") and span.lower().count("released") <= 1 for _, span, _ in found(text))


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        after = [0]
        for j, y in enumerate(b):
            after.append(row[j] + 1 if x == y else max(row[j + 1], after[-1]))
        row = after
    return row[-1]


def test_gaps_of_any_size_are_aligned_as_far_as_possible():
    """Without unique words nothing anchors: the alignment is a longest common subsequence, however long the lists."""
    import random

    from ballast.llm.licenses import align, common_words

    cycle = [f"w{i % 7}" for i in range(62)]
    assert len(align(cycle[:60], cycle[2:62])) == 58
    draw = random.Random(4)
    for n, m in ((3, 900), (70, 80), (200, 150), (400, 30)):
        a, b = [draw.choice("abcde") for _ in range(n)], [draw.choice("abcde") for _ in range(m)]
        pairs = common_words(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p < q and r < s for (p, r), (q, s) in zip(pairs, pairs[1:]))
        assert len(pairs) == longest_common(a, b)


def plain_align(a, b):
    """Patience alignment written down as it is defined, by recursion, with a longest common subsequence where nothing is unique."""
    if not a or not b:
        return 0
    if a[0] == b[0]:
        return 1 + plain_align(a[1:], b[1:])
    if a[-1] == b[-1]:
        return 1 + plain_align(a[:-1], b[:-1])
    unique = [(a.index(w), b.index(w)) for w in a if a.count(w) == b.count(w) == 1]
    if not unique:
        return longest_common(a, b)
    best = max((c for n in range(1, len(unique) + 1) for c in combinations(unique, n) if all(p[1] < q[1] for p, q in zip(c, c[1:], strict=False))), key=len)
    edges = [(-1, -1), *best, (len(a), len(b))]
    return len(best) + sum(plain_align(a[p + 1 : r], b[q + 1 : s]) for (p, q), (r, s) in zip(edges, edges[1:], strict=False))


def test_coverage_is_at_least_what_anchors_in_order_leave():
    """With one possible run of anchors the alignment is the plain one; of several longest runs either may be taken."""
    rng = random.Random(11)
    for _ in range(400):
        a = [rng.choice("abcdefgh") for _ in range(rng.randrange(14))]
        b = [w for w in a if rng.random() < 0.8]
        for _ in range(rng.randrange(4)):
            b.insert(rng.randrange(len(b) + 1), rng.choice("abcxyz"))
        unique = [b.index(w) for w in a if a.count(w) == b.count(w) == 1]
        if unique == sorted(unique):
            assert len(align(a, b)) == plain_align(a, b)
        assert len(align(a, b)) <= longest_common(a, b)


WHOLE = sorted(n for n in TEMPLATES if n.endswith("-whole"))


def test_whole_texts_are_there():
    assert len(WHOLE) == 12 and all(len(words_of(TEMPLATES[n])) > 100 for n in WHOLE)


@pytest.mark.parametrize("name", WHOLE)
def test_whole_licenses_in_long_texts(name):
    """Beside text that repeats words of the license, with words left out but those that name it, and twice in a row."""
    rng = random.Random(name)
    names = set("endorse or promote source code binary form free of charge without fee copyright notice".split())
    own = words_of(TEMPLATES[name])
    prose = " ".join(rng.choice([*rng.sample(own, 20), "prose", "words"]) for _ in range(3000))
    changed = " ".join(w for w in TEMPLATES[name].split() if rng.random() > 0.03 or w[0].isupper() or w[-1].isdigit() or w in names)
    got = [(n, c) for n, _, c in found(f"{prose}\n{changed}\n{prose}") if n == name]
    assert len(got) == 1 and got[0][1] > 0.9
    assert [n for n, _, _ in found(f"{TEMPLATES[name]}\n\n{TEMPLATES[name]}")].count(name) == 2


def test_whole_licenses_and_their_neighbours():
    four = TEMPLATES["BSD-3-Clause-whole"].replace("3. Neither", "3. All advertising materials mentioning features must display this. 4. Neither")
    assert not [n for n, _, _ in found(four) if n.startswith("BSD")]
    assert [n for n, _, _ in found(TEMPLATES["BSD-3-Clause-whole"])] == ["BSD-3-Clause-whole"]
    affero = TEMPLATES["GPL-3.0-whole"].replace("GNU GENERAL PUBLIC LICENSE", "GNU AFFERO GENERAL PUBLIC LICENSE").replace("29 June", "19 November")
    assert "GPL-3.0-whole" not in [n for n, _, _ in found(affero)]
    for text in ("SPDX-License-Identifier: MIT-0", "SPDX-License-Identifier: LicenseRef-x of MIT", "Released under the BSD 4-Clause License."):
        assert found(text) == []


def test_counts_lose_no_covered_text():
    rng = random.Random(6)
    for t in READY:
        words = [w for w in t.words if rng.random() < 0.9]
        if len(align(t.words, words)) >= t.least:
            assert t.reachable(Counter(words), len(words))
        assert not t.reachable(Counter(t.words[: t.least - 1]), t.least - 1)
