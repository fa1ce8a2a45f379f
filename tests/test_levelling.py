from __future__ import annotations

import random
from collections import Counter

import pytest

from ballast import (
    changed_counts,
    count_changes,
    rebalance_counted,
    assign_destinations,
    levelling_plan,
    levelling_threshold,
    pending_by_slot,
    pending_pages,
    pick_to_move,
    rebalance,
    slot_results,
    split_moved,
)
from ballast.plans.scratch import materialize

NODES = "slot BIGINT, tree_id STRING, node_id STRING, is_easy BOOLEAN"
COUNTS = "slot BIGINT, n BIGINT"


def one_at_a_time(counts, cap):
    """The rule itself: one unit from the richest to the poorest until one side is done."""
    have = dict(counts)
    threshold = min(cap, -(-sum(have.values()) // len(have)) - 1)
    while True:
        poor = min(have, key=lambda s: (have[s], s))
        rich = min(have, key=lambda s: (-have[s], s))
        if not (have[poor] < threshold < have[rich]):
            return {s: have[s] - n for s, n in counts.items()}
        have[poor] += 1
        have[rich] -= 1


def work(spark, counts):
    rows = [(s, f"T{s}", f"n{k}", k % 3 == 0) for s, n in counts.items() for k in range(n)]
    return spark.createDataFrame(rows, NODES), spark.createDataFrame([(s,) for s in counts], "slot BIGINT")


CASES = {
    "one giver": ({0: 12, 1: 0, 2: 0}, 10, {0: -6, 1: 3, 2: 3}),
    "tie": ({0: 5, 1: 5, 2: 0, 3: 2}, 10, {0: -1, 1: -1, 2: 2, 3: 0}),
    "cap binds": ({0: 100, 1: 0}, 10, {0: -10, 1: 10}),
    "all empty": ({0: 0, 1: 0, 2: 0}, 10, {0: 0, 1: 0, 2: 0}),
    "level already": ({0: 3, 1: 3}, 10, {0: 0, 1: 0}),
}


@pytest.mark.parametrize("case", CASES, ids=str)
def test_plan_of_known_cases(spark, case):
    counts, cap, expected = CASES[case]
    plan = levelling_plan(spark.createDataFrame(list(counts.items()), COUNTS), cap)
    assert {r.slot: r.delta for r in plan.collect()} == expected


def test_threshold_of_nothing(spark):
    counts = spark.createDataFrame([(0, 0), (1, 0), (2, 0)], COUNTS)
    assert levelling_threshold(counts).first().asDict() == {"n_slots": 3, "n_open": 0, "threshold": -1}
    none = spark.createDataFrame([], COUNTS)
    assert levelling_plan(none).count() == 0


def test_plan_follows_the_rule(spark, many_blocks):
    draw = random.Random(3)
    for _ in range(12):
        counts = {s: draw.choice([0, 0, 1, 2, 5, draw.randint(0, 40)]) for s in range(draw.randint(1, 30))}
        cap = draw.choice([2, 5, 10, 100])
        plan = levelling_plan(spark.createDataFrame(list(counts.items()), COUNTS), cap)
        assert {r.slot: r.delta for r in plan.collect()} == one_at_a_time(counts, cap), (counts, cap)


HOT = {0: 400, 1: 3, 2: 0, 3: 25, 4: 0, 5: 1, **{s: s % 4 for s in range(6, 120)}}


def test_rebalance_moves_each_node_once(spark, many_blocks):
    nodes, slots = work(spark, HOT)
    rows = rebalance(nodes, slots).collect()
    delta = one_at_a_time(HOT, 10)
    assert Counter(r.slot for r in rows) == Counter({s: n + delta[s] for s, n in HOT.items()})
    assert Counter((r.old_slot, r.node_id) for r in rows) == Counter((s, f"n{k}") for s, n in HOT.items() for k in range(n))
    for r in rows:
        moved = r.slot != r.old_slot
        assert r.tree_id == (f"T{r.old_slot}/{r.node_id}" if moved else f"T{r.old_slot}")


def test_steps_agree_and_lose_nothing(spark, many_blocks):
    nodes, slots = work(spark, HOT)
    plan = levelling_plan(pending_by_slot(nodes, slots))
    picked = pick_to_move(nodes, plan, seed=5)
    assert sum(r.delta for r in plan.collect()) == 0
    taken = Counter(r.slot for r in picked.collect())
    assert taken == Counter({r.slot: -r.delta for r in plan.collect() if r.delta < 0})
    for slot in taken:
        assert sorted(r["rank"] for r in picked.collect() if r.slot == slot) == list(range(1, taken[slot] + 1))

    moved, kept = split_moved(nodes, picked)
    everything = sorted(map(tuple, nodes.collect()))
    assert sorted(map(tuple, moved.unionByName(kept).collect())) == everything
    assert moved.count() == sum(taken.values())

    usual = sorted(map(tuple, assign_destinations(picked, plan).collect()))
    hot = sorted(map(tuple, assign_destinations(picked, plan, hot_rows=5).collect()))
    assert usual == hot and len(usual) == sum(taken.values())
    gets = Counter(row[-1] for row in usual)
    assert gets == Counter({r.slot: r.delta for r in plan.collect() if r.delta > 0})


def test_nodes_match_letter_for_letter(spark):
    nodes = spark.createDataFrame([(1, "Ab", "x", True), (1, "aB", "x", True), (2, "aB", "x", True)], NODES)
    picked = spark.createDataFrame([(1, "aB", "x", 1)], "slot BIGINT, tree_id STRING, node_id STRING, rank BIGINT")
    moved, kept = split_moved(nodes, picked)
    assert [tuple(r) for r in moved.collect()] == [(1, "aB", "x", True)]
    assert kept.count() == 2


def test_trees_that_differ_in_case_stay_apart(spark):
    nodes = spark.createDataFrame([(0, tree, f"n{k}", True) for tree in "aA" for k in range(6)], NODES)
    slots = spark.createDataFrame([(0,), (1,), (2,)], "slot BIGINT")
    rows = rebalance(nodes, slots).collect()
    assert len(rows) == 12 and Counter(r.slot for r in rows) == {0: 6, 1: 3, 2: 3}
    plan = levelling_plan(pending_by_slot(nodes, slots))
    moved, kept = split_moved(nodes, pick_to_move(nodes, plan))
    assert (moved.count(), kept.count()) == (6, 6)


def test_slots_beyond_an_integer(spark):
    nodes = spark.createDataFrame([(3_000_000_000, "t", f"n{k}", True) for k in range(9)], NODES)
    slots = spark.createDataFrame([(3_000_000_000,), (3_000_000_001,)], "slot BIGINT")
    assert Counter(r.slot for r in rebalance(nodes, slots).collect()) == {3_000_000_000: 5, 3_000_000_001: 4}


def test_slots_report_solution_counts_and_pages(spark):
    nodes, slots = work(spark, {0: 0, 1: 5})
    solutions = spark.createDataFrame(
        [(1, 7, "feasible", 3), (1, 8, "optimal", 9), (1, 9, "infeasible", 99)], "slot BIGINT, tie_id BIGINT, status STRING, objective BIGINT"
    )
    rows = slot_results(solutions, nodes, slots, page_size=3).orderBy("slot", "page").collect()
    assert [(r.slot, r.page, len(r.pending), r.n, r.objective) for r in rows] == [(0, 0, 0, 0, None), (1, 0, 3, 5, 9), (1, 1, 2, 5, 9)]


def test_nothing_to_give_keeps_everything(spark):
    nodes, slots = work(spark, {0: 2, 1: 2, 2: 1})
    rows = rebalance(nodes, slots).collect()
    assert all(r.slot == r.old_slot for r in rows) and len(rows) == 5


def test_another_seed_picks_other_nodes(spark):
    nodes, slots = work(spark, {0: 40, 1: 0, 2: 0, 3: 0})
    plan = levelling_plan(pending_by_slot(nodes, slots))
    first, again, other = (sorted(r.node_id for r in pick_to_move(nodes, plan, seed).collect()) for seed in (1, 1, 2))
    assert first == again != other


def test_pending_counts_and_pages_show_empty_slots(spark, many_blocks):
    counts = {0: 0, 1: 11, 2: 1}
    nodes, slots = work(spark, counts)
    assert {r.slot: (r.n, r.n_easy, r.n_hard) for r in pending_by_slot(nodes, slots).collect()} == {
        0: (0, 0, 0),
        1: (11, 4, 7),
        2: (1, 1, 0),
    }
    pages = pending_pages(nodes, slots, page_size=4).orderBy("slot", "page").collect()
    assert [(r.slot, r.page, len(r.pending)) for r in pages] == [(0, 0, 0), (1, 0, 4), (1, 1, 4), (1, 2, 3), (2, 0, 1)]
    ids = [p.node_id for r in pages if r.slot == 1 for p in r.pending]
    assert ids == sorted(f"n{k}" for k in range(11))


def test_counts_follow_the_moves_without_the_nodes(spark):
    rows = [(i % 4 if i % 7 else 9, f"t{i}", str(i), i % 3 == 0) for i in range(300)]
    nodes = spark.createDataFrame(rows, "slot long, tree_id string, node_id string, is_easy boolean")
    slots = spark.createDataFrame([(i,) for i in range(20)], "slot long")
    counts = pending_by_slot(nodes, slots)
    for seed in range(3):
        nodes, counts = rebalance_counted(nodes.select("slot", "tree_id", "node_id", "is_easy"), counts, cap=15, seed=seed)
        nodes = materialize(nodes, "nodes")
        recount = sorted(map(tuple, pending_by_slot(nodes, slots).collect()))
        assert sorted(map(tuple, counts.select("slot", "n", "n_easy", "n_hard").collect())) == recount
    assert "tree_id" not in counts._jdf.queryExecution().toString()
    assert sum(r[1] for r in recount) == 300


def test_new_and_finished_nodes_change_the_counts(spark):
    moves = spark.createDataFrame(
        [(None, 1, True), (None, 1, False), (2, None, False), (1, 2, True), (None, None, True)], "slot long, new_slot long, is_easy boolean"
    )
    counts = spark.createDataFrame([(1, 3, 2, 1), (2, 4, 0, 4), (3, 0, 0, 0)], "slot long, n long, n_easy long, n_hard long")
    after = {r.slot: (r.n, r.n_easy, r.n_hard) for r in changed_counts(counts, count_changes(moves)).collect()}
    assert after == {1: (4, 2, 2), 2: (4, 1, 3), 3: (0, 0, 0)}
