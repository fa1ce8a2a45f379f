from __future__ import annotations

import math
import random

import pytest

from ballast import apportion_budget

TREES = "group_id BIGINT, seq INT, n_easy BIGINT, n_hard BIGINT"


def in_order(trees, total, easy=6, hard=60):
    left, to_come, shares = float(total), sum(easy * e + hard * h for e, h in trees), []
    for e, h in trees:
        need, whole, share = easy * e + hard * h, math.floor(left), 0.0
        if whole > 0 and need > 0:
            share = whole - to_come + need if whole > to_come else max(easy, whole * need / to_come)
        shares.append(share)
        left -= share
        to_come -= need
    return shares


def shares(spark, groups, total, **seconds):
    rows = [(g, i, e, h) for g, trees in groups.items() for i, (e, h) in enumerate(trees)]
    found = apportion_budget(spark.createDataFrame(rows, TREES), total, **seconds).collect()
    assert len(found) == len(rows)
    return {g: [r.share for r in sorted((r for r in found if r.group_id == g), key=lambda r: r.seq)] for g in groups}


def test_known_cases(spark):
    assert shares(spark, {1: [(2, 1), (3, 0), (0, 2)]}, 600)[1] == [462, 18, 120]
    short = shares(spark, {1: [(1, 3), (5, 1), (1, 0), (1, 0)]}, 100)[1]
    assert [round(s, 2) for s in short] == [64.58, 30.88, 6, 0]


@pytest.mark.parametrize(("total", "seconds"), [(600, {}), (61.7, {}), (0, {}), (40, {"easy": 2.5, "hard": 1.5})])
def test_follows_the_trees_in_order(spark, total, seconds):
    draw = random.Random(11)
    groups = {g: [(draw.randint(0, 3), draw.randint(0, 2)) for _ in range(draw.randint(1, 25))] for g in range(40)}
    groups[99] = [(draw.randint(0, 2), draw.randint(0, 1)) for _ in range(600)]
    found = shares(spark, groups, total, **seconds)
    for g, trees in groups.items():
        assert found[g] == pytest.approx(in_order(trees, total, **seconds)), g


def test_large_budget_over_many_trees(spark):
    groups = {1: [(1, 0)] * 1500 + [(0, 1)] * 500}
    assert shares(spark, groups, 7000)[1] == pytest.approx(in_order(groups[1], 7000))


@pytest.mark.parametrize("total", [200_000, 1_000_000])
def test_tens_of_thousands_of_funded_trees_in_one_group(spark, total):
    """Short by a lot and ample; both take seconds."""
    groups = {1: [(1, i % 2) for i in range(20_000)], 2: [(1, 0)] * 30_000, 3: [(0, 0), (2, 0)]}
    found = shares(spark, groups, total)
    for g, trees in groups.items():
        assert found[g] == pytest.approx(in_order(trees, total)), g


def test_a_hot_group_is_spread_over_its_blocks(spark, many_blocks):
    """One group with nine tenths of the trees: no task reads more than its range, and the shares are those of the fold."""
    rows = [(0, n, n % 5, n % 3) for n in range(9_000)] + [(1 + n % 50, n, 1, 1) for n in range(1_000)]
    trees = spark.createDataFrame(rows, "group_id long, seq long, n_easy long, n_hard long")
    for total in (10_000, 10_000_000):
        shares = {(r.group_id, r.seq): r.share for r in apportion_budget(trees, total).collect()}
        for group in (0, 7):
            mine = sorted((n, 6.0 * e + 60.0 * h) for g, n, e, h in rows if g == group)
            left, to_come = float(total), sum(x for _, x in mine)
            for n, need in mine:
                offer = float(int(left))
                share = 0.0
                if need and offer > 0:
                    share = offer - to_come + need if offer > to_come else max(6.0, offer * need / to_come)
                assert abs(shares[group, n] - share) < 1e-6
                left, to_come = left - share, to_come - need
