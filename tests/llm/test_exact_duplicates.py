from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ballast.llm.exact_duplicates import bucket_low, build_directory, build_index, document_copies, drop_exact_duplicates, equal_texts
from tests.llm import cases


def grouped(rows):
    """Normalised text -> ids, by the rule."""
    groups: dict[str, list] = {}
    for doc_id, text, *_ in rows:
        groups.setdefault((text or "").translate(cases.FOLD), []).append(doc_id)
    return groups


def check(found, rows):
    groups, kept = grouped(rows), {}
    assert len(found) == len(rows)
    for r in found:
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        ids = groups[text]
        best = max((i for i in ids if i is not None), default=None)
        assert (r["keep_id"], r["group_size"]) == (best, len(ids))
        if r["kept"]:
            assert r["id"] == best
            kept[text] = kept.get(text, 0) + 1
    assert kept == dict.fromkeys(groups, 1)


def many(n: int = 1500):
    """A third of all rows are one text, in different case; groups of all sizes; single texts."""
    draw = random.Random(5)
    rows = [(i, draw.choice(("Hot text", "hot TEXT", "HOT tExt"))) for i in range(n // 3)]
    rows += [(n + i, f"group {draw.randint(0, 60)} " + "ü" * 50) for i in range(n // 3)]
    rows += [(2 * n + i, f"alone {i} " + "x" * draw.randint(0, 400)) for i in range(n // 3)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize(
    "options",
    [
        {},
        {"bucket_bytes": 2_000, "run_rows": 50},
        {"bucket_bytes": 500, "run_rows": 3},
        {"bucket_bytes": 4_000, "hash_bits": 3, "run_rows": 40},
        {"bucket_bytes": 300, "hash_bits": 1, "run_bytes": 1},
        {"hash_bits": 0},
    ],
    ids=str,
)
def test_groups_are_those_of_equal_texts(spark, options):
    """Few bits of hash make different texts collide; small buckets make the directory double and chains overflow."""
    rows = many(600 if "hash_bits" in options else 1500)
    docs = spark.createDataFrame(rows, "id long, text string").repartition(5)
    check(equal_texts(build_index(docs, **options)).collect(), rows)


def test_directory_covers_all_hashes_once_and_no_bucket_is_too_full(spark):
    draw = random.Random(2)
    entries = [(draw.randint(-(2**63), 2**63 - 1), draw.randint(0, 100)) for _ in range(3000)]
    entries += [((draw.randint(0, 2**20) | 5 << 58) - 2**63, 50) for _ in range(300)]  # a crowded corner
    df = spark.createDataFrame(entries, "hash long, size long")
    directory, chained = build_directory(df, 4_000)
    buckets = [(r.depth, r.low) for r in directory.collect()]
    assert chained.count() == 0
    assert len({d for d, _ in buckets}) > 3
    fill = dict.fromkeys(buckets, 0)
    for h, size in entries:
        holding = [(d, low) for d, low in buckets if low <= h < low + 2 ** (64 - d)]
        assert len(holding) == 1
        fill[holding[0]] += size + 64
    assert max(fill.values()) <= 4_000


def test_buckets_begin_at_their_first_bits(spark):
    rows = spark.createDataFrame([(-1,), (0,), (2**62 + 5,)], "hash long")
    found = rows.select(bucket_low(0).alias("a"), bucket_low(1).alias("b"), bucket_low(2).alias("c"), bucket_low(64).alias("d")).collect()
    assert [tuple(r) for r in found] == [(-(2**63), -(2**63), -(2**62), -1), (-(2**63), 0, 0, 0), (-(2**63), 0, 2**62, 2**62 + 5)]


def test_index_holds_each_text_once_in_key_order(spark):
    import zstandard

    rows = many(300)
    index = build_index(spark.createDataFrame(rows, "id long, text string"), bucket_bytes=2_000)
    held = index.buckets.where("body is not null").collect()
    assert sorted(zstandard.decompress(r.body).decode() for r in held) == sorted(grouped(rows))
    assert index.directory.agg(F.max("depth")).first()[0] > 2


def test_documents_of_all_kinds(spark):
    docs = cases.documents(spark)
    found = document_copies(docs)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    check([{**r.asDict(), "id": r.doc_id} for r in found.collect()], cases.DOCUMENTS)


def test_one_row_of_each_group_stays_with_all_columns(spark):
    docs = cases.documents(spark)
    left = drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    groups = grouped(cases.DOCUMENTS)
    assert sorted(repr((r.text or "").translate(cases.FOLD)) for r in left.collect()) == sorted(map(repr, groups))
    for r in left.collect():
        assert r.doc_id == max((i for i in groups[(r.text or "").translate(cases.FOLD)] if i is not None), default=None)


@pytest.mark.parametrize("operator", [document_copies, drop_exact_duplicates])
def test_no_documents(spark, operator):
    assert operator(cases.no_documents(spark)).count() == 0
