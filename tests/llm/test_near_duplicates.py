from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ballast.llm.graph import components
from ballast.llm.near_duplicates import BANDS, ROWS, Shingler, bands_of, document_duplicates, drop_near_duplicates, scatter, signature
from ballast.sources.tables import table
from tests.llm.cases import documents, find_components, no_documents, shingles


def expected(rows, n):
    sets = [shingles(t, n) for _, t in rows]
    groups = {}
    for (i, _), c in zip(rows, find_components(sets), strict=True):
        groups.setdefault(c, []).append(i)
    least = {c: min((i for i in ids if i is not None), default=None) for c, ids in groups.items()}
    out = []
    for (i, _), c, s in zip(rows, find_components(sets), sets, strict=True):
        component = least[c] if s else i
        out.append((i, len(s), component, i == component))
    return sorted(out, key=repr)


def result(df):
    rows = document_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()
    return sorted([tuple(r) for r in rows], key=repr)


def test_second_step_is_a_permutation():
    x = np.arange(1 << 16, dtype=np.uint32)
    assert len(np.unique(scatter(x.copy(), 0x85EBCA6B, 0xC2B2AE35))) == len(x)


def test_coordinates_agree_as_often_as_sets_overlap():
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 1 << 63, 900).astype(np.uint64))
    b = np.concatenate([a[:800], np.unique(rng.integers(0, 1 << 63, 100).astype(np.uint64))])
    share = (signature(a, 2000) == signature(b, 2000)).mean()
    assert abs(share - 0.8) < 0.04
    assert (bands_of(signature(a)) == bands_of(signature(b))).any()
    assert len(bands_of(signature(a))) == BANDS and len(signature(a)) == BANDS * ROWS


def test_shingles_of_short_texts():
    s = Shingler(2)
    assert len(s("")) == 0 and len(s(None)) == 0 and len(s("One")) == 1 and len(s("a b c a b")) == 3
    assert (s("A  b\n") == s("a b")).all() and (s("a b") != s("b a")).all()


def test_same_classes_as_brute_force(spark, data):
    df = table(spark, data, "documents")
    assert result(df) == expected([(r.doc_id, r.text) for r in df.collect()], 2)


def test_defined_results(spark):
    df = documents(spark)
    assert result(df) == expected([(r.doc_id, r.text) for r in df.collect()], 2)
    assert result(no_documents(spark)) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_large_groups_chains_and_loose_copies(spark, seed):
    """One text with hundreds of edited copies that are linked with it but not with each other, and chains of edits."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(100_000)}"
    base = [word() for _ in range(200)]
    texts = [base]
    for _ in range(150):
        t = list(base)
        for i in rng.sample(range(200), 9):
            t[i] = word()
        texts.append(t)
    for _ in range(5):
        chain = [word() for _ in range(120)]
        for _ in range(12):
            texts.append(chain)
            chain = list(chain)
            for i in rng.sample(range(120), 5):
                chain[i] = word()
    texts += [list(base)] * 20 + [[word() for _ in range(50)] for _ in range(50)]
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df) == expected(rows, 2)


def test_one_row_of_each_group_stays(spark):
    df = documents(spark)
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    # 2 (twice) is a copy of 1, 9 one of 7; texts without words all stay.
    gone = [(2, df.where("doc_id = 2").first().text)] * 2 + [(9, "word")]
    rest = [(r.doc_id, r.text) for r in df.collect()]
    for x in gone:
        rest.remove(x)
    assert got == sorted(rest, key=repr)


def test_identical_rows_leave_one(spark):
    df = spark.createDataFrame([(1, "a b c d e f")] * 3 + [(1, "A b c d e  f"), (None, "x y")] + [(None, "x y")], "doc_id long, text string")
    assert drop_near_duplicates(df).count() == 2


def test_components_of_long_paths(spark):
    n = 300
    edges = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    edges = edges.unionByName(spark.createDataFrame([(1000, 1001), (1001, 1000), (1000, 1000)], "a long, b long"))
    got = {r.node: r.label for r in components(edges).collect()}
    assert got == {i: 0 for i in range(n)} | {1000: 1000, 1001: 1000}
