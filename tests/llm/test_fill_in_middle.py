from __future__ import annotations

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ballast.llm.fill_in_middle import (
    FrameWriter,
    document_rewrites,
    draws,
    fill_in_middle,
    find_marks,
    restore,
    rewrite,
    sha256,
)
from tests.llm import cases

UNITS = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def framed(text: str, size: int = 7):
    return FrameWriter(size).write(text.encode()).close()


def plainly(name: str, text: str):
    """(n, form, prefix chars, middle chars, output) by the rule, without frames."""
    units = UNITS.findall(text)
    h = hashlib.sha256(f"42:{name}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


texts = st.text(alphabet=st.sampled_from("ab <>PSM\t\n\x0b\xa0é日\U0001f600."), max_size=60)


@settings(max_examples=300, deadline=None)
@given(texts, st.integers(1, 9), st.integers(0, 200))
def test_frames_cut_and_restore_like_whole_texts(text, size, name):
    f = framed(text, size)
    assert f.n == len(UNITS.findall(text))
    assert b"".join(f.stream()).decode() == text
    place = 0
    for k, unit in enumerate(UNITS.findall(text), 1):
        place += len(unit)
        assert f.unit_end(k) == (len(text[:place].encode()), place)
    n, form, prefix, middle, output = plainly(str(name), text)
    new = rewrite(f, str(name))
    assert (f.n, new.form, new.prefix_chars, new.middle_chars) == (n, form, prefix, middle)
    assert b"".join(new.output.stream()).decode() == output
    assert b"".join(restore(new.output, new.form)).decode() == text


def test_every_form_occurs_and_ranges_are_streamed():
    forms = {rewrite(framed("a b c d e f"), str(i)).form for i in range(60)}
    assert forms == {"plain", "psm", "spm"}
    f = framed("0123456789abcdef", 5)
    for a in range(17):
        for b in range(a, 17):
            assert b"".join(f.stream(a, b)) == b"0123456789abcdef"[a:b]
    assert f.unit_end(0) == (0, 0) and framed("").size() == 0


def test_only_frames_with_a_cut_are_opened(monkeypatch):
    draw = random.Random(1)
    f = framed(" ".join("w" * draw.randint(1, 9) for _ in range(5000)), 100)
    opened = []
    monkeypatch.setattr(type(f), "frame", lambda self, i, frame=type(f).frame: opened.append(i) or frame(self, i))
    f.unit_end(2500)
    assert len(opened) == 1


def test_marks_are_found_across_chunks():
    assert find_marks([b"ab<", b"P", b">c<S", b">", b"<M"]) == {b"<P>": 2, b"<S>": 6}
    assert find_marks([b"<", b"", b"M>"]) == {b"<M>": 0}
    assert find_marks([]) == {}


def test_draws_are_those_of_the_hex_digest():
    h = hashlib.sha256(b"42:17").hexdigest()
    assert draws("17") == [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]
    assert sha256([b"a", b"b"]) == hashlib.sha256(b"ab").hexdigest()


def test_documents_of_all_kinds(spark):
    rows = [*cases.DOCUMENTS, *[(100 + i, f"x{i} <P> y", None, None, 0) for i in range(6)], *[(200 + i, "ein  Text mit\tWörtern ", "de", "s", 1) for i in range(40)]]
    got = sorted(map(repr, map(tuple, document_rewrites(cases.documents(spark, rows)).collect())))
    expected = []
    for doc_id, text, *_ in rows:
        n, form, prefix, middle, output = plainly("" if doc_id is None else str(doc_id), text or "")
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (output, text or "")]
        expected.append(repr((doc_id, n, form, prefix, middle, *digests)))
    assert got == sorted(expected)


def test_texts_are_rewritten_and_all_columns_stay(spark):
    docs = cases.documents(spark)
    out = fill_in_middle(docs)
    assert out.columns == docs.columns
    assert sorted(repr(r.text) for r in out.collect()) == sorted(repr(plainly("" if d is None else str(d), t or "")[4]) for d, t, *_ in cases.DOCUMENTS)
    assert {r["_row"] for r in out.collect()} == {"mine _row"}


@pytest.mark.parametrize("operator", [document_rewrites, fill_in_middle])
def test_no_documents(spark, operator):
    assert operator(cases.no_documents(spark)).count() == 0
