from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ballast.llm.nearest import build_index, nearest_embeddings, random_rotation, search
from ballast.sources.tables import table


def plain(rows, k=20, every=20):
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)]
    out = {}
    for q, x in fine:
        if q % every == 0:
            scored = sorted((-float(x @ v), i) for i, v in fine if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def found(df, **more):
    out = {}
    for r in sorted(nearest_embeddings(df, **more).collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def recall(got, want):
    hits = sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in near}) for q, near in want.items())
    return hits / sum(map(len, want.values()))


def test_rotation_keeps_inner_products():
    r = random_rotation(30)
    assert np.allclose(r @ r.T, np.eye(30))


def test_recall_against_brute_force(spark, data):
    df = table(spark, data.replace("0.001", "0.01"), "embeddings")
    want = plain([(r.vec_id, r.embedding) for r in df.collect()])
    got = found(df)
    assert {q: len(n) for q, n in got.items()} == {q: len(n) for q, n in want.items()}
    assert recall(got, want) >= 0.98
    for q, near in got.items():
        exact = dict(want[q])
        assert all(abs(s - exact[i]) < 1e-12 for i, s in near if i in exact)
        assert near == sorted(near, key=lambda x: (-x[1], x[0]))


@pytest.mark.parametrize("scale", [1, 1000])
def test_lengths_and_centres_of_all_kinds(spark, scale):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(900, 24)) * rng.exponential(scale, (900, 1)) + 3 * scale
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    index = build_index(df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")))
    asked = df.where("vec_id % 20 = 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    got = {}
    for r in search(index, asked, 20, block=7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert recall(got, plain(rows)) >= 0.98


def test_defined_results(spark):
    rows = [
        (0, [1.0, 0.0]), (20, [0.0, 0.0]), (40, None), (60, [1.0, None]), (80, [float("nan"), 1.0]), (100, [float("inf"), 1.0]),
        (None, [5.0, 5.0]), (1, [1.0, 2.0, 3.0]), (3, [2.0, 1.0]), (2, [2.0, 1.0]), (4, [2.0, 1.0]), (5, [-1.0, 0.5]), (120, [0.5, 0.5]), (6, []),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("mine"))
    got = found(df, k=3)
    assert set(got) == {0, 120}
    assert [i for i, _ in got[0]] == [2, 3, 4] and [i for i, _ in got[120]] == [2, 3, 4]
    assert found(df.limit(0)) == {}
    assert [len(n) for n in found(df, k=50).values()] == [5, 5]


def test_repeated_ids_and_vectors(spark):
    rows = [(0, [1.0, 1.0, 0.5])] * 2 + [(i, [1.0, 1.0, 0.5]) for i in range(1, 9)]
    got = found(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3)
    assert all(i != 0 for i, _ in got[0]) and {i for i, _ in got[0]} <= {1, 2, 3}


def test_each_length_is_searched_by_itself(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=(6, 9, 9)[i % 3]).tolist()) for i in range(0, 600, 4)]
    rows.append((1000, [1.0]))
    got = found(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5), k=5)
    for d in (6, 9, 1):
        same = [r for r in rows if len(r[1]) == d]
        want = plain(same, 5)
        assert recall({q: got.get(q, []) for q in want}, want) >= 0.98 if any(want.values()) else not any(got.get(q) for q in want)


def test_blocks_are_bounded_by_bytes_and_slices(spark, monkeypatch):
    from ballast.llm import nearest

    monkeypatch.setattr(nearest, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(nearest, "SLICE", 3)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=12).tolist()) for i in range(0, 1200, 5)]
    got = found(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), k=4)
    assert recall(got, plain(rows, 4)) >= 0.98
