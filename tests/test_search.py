from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ballast import select_best_subset
from ballast.operators.frontier import expand_frontier, seed_frontier
from ballast.operators.paths import flipped_items
from ballast.operators.ranking import greedy_solutions, rank_items, search_space

ITEMS = "instance_id BIGINT, item_id BIGINT, weight BIGINT, value BIGINT"
INSTANCES = "instance_id BIGINT, capacity BIGINT"


def most_value(items, capacity):
    best = {0: 0}
    for weight, value in items:
        for w, v in sorted(best.items(), reverse=True):
            if w + weight <= capacity:
                best[w + weight] = max(best.get(w + weight, -1), v + value)
    return max(best.values()) if capacity >= 0 else None


def least_value(items, demand):
    total_w, total_v = (sum(x) for x in zip(*items)) if items else (0, 0)
    left = most_value(items, total_w - demand)
    return None if left is None else total_v - left


def problems():
    """instance -> (capacity, [(weight, value)]): random, edge and one very large case."""
    draw = random.Random(7)
    made = {}
    for i in range(40):
        items = [(draw.randint(1, 20), draw.randint(0, 60)) for _ in range(draw.randint(1, 12))]
        made[i] = (draw.randint(0, sum(w for w, _ in items) + 3), items)
    for i in range(40, 60):  # value close to weight: bounds are tight, many ties
        items = [(w, w + draw.randint(0, 1)) for w in (draw.randint(1, 9) for _ in range(12))]
        made[i] = (sum(w for w, _ in items) // 2, items)
    made[100] = (10, [])
    made[101] = (0, [(1, 5), (2, 3)])
    made[102] = (3, [(4, 100), (3, 1)])
    made[103] = (12, [(4, 8)] * 6)
    made[104] = (5, [(1, 0), (2, 0), (9, 0)])
    # A third of all rows and more in one instance.
    made[200] = (1500, [(draw.randint(1, 30), draw.randint(1, 1000)) for _ in range(400)])
    return made


def tables(spark, made):
    items = [(i, n, w, v) for i, (_, rows) in made.items() for n, (w, v) in enumerate(rows)]
    heads = [(i, c) for i, (c, _) in made.items()]
    return spark.createDataFrame(items, ITEMS), spark.createDataFrame(heads, INSTANCES)


def check(result, made, sense):
    expected = {
        i: (most_value if sense == "max" else least_value)(rows, capacity) for i, (capacity, rows) in made.items()
    }
    report = {r.instance_id: r for r in result.report.collect()}
    assert {i: r.objective for i, r in report.items()} == expected
    for i, row in report.items():
        assert row.status == ("infeasible" if expected[i] is None else "optimal")
    chosen: dict[int, list[int]] = {}
    for row in result.choices.collect():
        chosen.setdefault(row.instance_id, []).append(row.item_id)
    for i, (capacity, rows) in made.items():
        if expected[i] is None:
            continue
        picked = [rows[n] for n in chosen.get(i, [])]
        assert len(set(chosen.get(i, []))) == len(picked)
        assert sum(v for _, v in picked) == expected[i]
        weight = sum(w for w, _ in picked)
        assert weight <= capacity if sense == "max" else weight >= capacity


@pytest.mark.parametrize("sense", ["max", "min"])
def test_equals_dynamic_programme(spark, many_blocks, sense):
    made = problems()
    check(select_best_subset(*tables(spark, made), sense), made, sense)


@pytest.mark.parametrize(
    "options",
    [
        {"levels_per_round": 1, "max_rounds": 1000},
        {"dominance": False, "levels_per_round": 3},
        {"reduce": False},
        {"hot_nodes": 1, "small_frontier": 0},
        {"small_frontier": 0},
    ],
    ids=str,
)
def test_options_do_not_change_the_outcome(spark, many_blocks, options):
    made = {i: p for i, p in problems().items() if i < 20 or 48 < i < 110}
    check(select_best_subset(*tables(spark, made), "max", **options), made, "max")


def test_bad_items_are_errors_of_their_instance_only(spark):
    made = {1: (5, [(2, 3), (3, 4)]), 2: (5, [(2, 3)]), 3: (5, [(2, 3)]), 4: (5, [(2, 3)]), 5: (-1, [(1, 1)])}
    items, instances = tables(spark, made)
    broken = [(2, 90, None, 1), (3, 91, 0, 1), (4, 92, 1, None)]
    items = items.unionByName(spark.createDataFrame(broken, ITEMS))
    instances = instances.unionByName(spark.createDataFrame([(6, None)], INSTANCES))
    result = select_best_subset(items, instances)
    found = {r.instance_id: (r.status, r.objective, r.halted) for r in result.report.collect()}
    assert found == {
        1: ("optimal", 7, False),
        2: ("error", None, False),
        3: ("error", None, False),
        4: ("error", None, False),
        5: ("infeasible", None, False),
        6: ("error", None, False),
    }
    assert {r.instance_id for r in result.choices.collect()} == {1}

    halted = select_best_subset(items, instances, halt_all=True)
    assert halted.stop_reason == "halted" and halted.rounds == 0
    assert {r.halted for r in halted.report.collect()} == {True}


def test_round_size_is_limited(spark):
    with pytest.raises(ValueError):
        select_best_subset(*tables(spark, {1: (1, [(1, 1)])}), levels_per_round=17)


def test_too_much_demand_is_infeasible(spark):
    made = {1: (5, [(1, 1), (3, 2)]), 2: (4, [(1, 1), (3, 2)])}
    found = {r.instance_id: (r.status, r.objective) for r in select_best_subset(*tables(spark, made), "min").report.collect()}
    assert found == {1: ("infeasible", None), 2: ("optimal", 3)}


def test_round_limit_reports_the_best_so_far(spark):
    made = {i: p for i, p in problems().items() if 40 <= i < 60}
    result = select_best_subset(*tables(spark, made), max_rounds=1, levels_per_round=1)
    assert result.stop_reason == "max_rounds"
    items = {(i, n): wv for i, (_, rows) in made.items() for n, wv in enumerate(rows)}
    picked: dict[int, list] = {}
    for row in result.choices.collect():
        picked.setdefault(row.instance_id, []).append(items[row.instance_id, row.item_id])
    for row in result.report.collect():
        capacity, rows = made[row.instance_id]
        chosen = picked.get(row.instance_id, [])
        assert row.objective == sum(v for _, v in chosen) <= most_value(rows, capacity)
        assert sum(w for w, _ in chosen) <= capacity


def test_reduction_leaves_little_to_search(spark, many_blocks):
    made = {200: problems()[200]}
    ranked = rank_items(*tables(spark, made))
    assert ranked.items.select("block").distinct().count() > 1
    core = search_space(ranked, 4).pages.select(F.sum(F.size("items"))).first()[0]
    assert core < 100


def test_large_numbers_stay_exact(spark):
    big = 10**15
    made = {1: (10**9 + 5, [(10**9, 7 * big), (10**9 - 1, 7 * big - 7), (6, 6), (5, 42), (1, 1)])}
    rows = made[1][1]
    expected = max(
        sum(v for k, (_, v) in enumerate(rows) if mask >> k & 1)
        for mask in range(32)
        if sum(w for k, (w, _) in enumerate(rows) if mask >> k & 1) <= made[1][0]
    )
    assert select_best_subset(*tables(spark, made)).report.first().objective == expected


def test_order_of_items_is_exact_for_any_bigint(spark):
    """Ratios that agree as DOUBLE: the better item is found, and chosen."""
    big = 2**53
    made = {
        1: (10, [(10, big), (10, big + 1)]),
        2: (10, [(10, big + 1), (10, big)]),
        3: (2**60, [(2**59 + 1, 2**60 + 1), (2**59 - 1, 2**60 - 3), (2, 4)]),
        4: (7, [(3, 9 * 10**17 // 3), (7, 7 * 10**17 + 1), (4, 4 * 10**17)]),
    }
    check(select_best_subset(*tables(spark, made)), made, "max")


@pytest.mark.parametrize("kind", ["double", "float", "decimal(10, 2)", "string"])
def test_fractions_are_refused(spark, kind):
    items, instances = tables(spark, {1: (5, [(2, 10), (2, 10)])})
    for column in ("weight", "value"):
        with pytest.raises(TypeError):
            select_best_subset(items.withColumn(column, F.col(column).cast(kind)), instances)
    with pytest.raises(TypeError):
        select_best_subset(items, instances.withColumn("capacity", F.col("capacity").cast(kind)))


def test_whole_decimals_are_fine(spark):
    items, instances = tables(spark, {1: (5, [(2, 10), (2, 10), (3, 11)])})
    items = items.withColumn("weight", F.col("weight").cast("decimal(12, 0)"))
    assert select_best_subset(items, instances).report.first().objective == 21


def test_bounds_are_never_below_the_best_completion(spark):
    from itertools import combinations

    draw = random.Random(19)
    made = {i: (draw.randint(1, 25), [(draw.randint(1, 9), draw.randint(0, 30)) for _ in range(draw.randint(1, 8))]) for i in range(60)}
    items, instances = tables(spark, made)
    space = search_space(rank_items(items, instances), page_size=2, reduce=False)
    roots = space.roots().withColumnsRenamed({"base_weight": "weight", "base_value": "value"})
    roots = seed_frontier(roots, 1, carry=["weight", "value"])
    first = expand_frontier(roots, space.page(0)).drop("best", "complete")
    seen = 0
    nodes = first.unionByName(expand_frontier(first, space.page(1)).drop("best", "complete"))
    key = ("instance_id", "depth", "mask")
    flips: dict[tuple, set[int]] = {}
    for row in flipped_items(nodes.select(*key, "from_page"), space.pages, key).collect():
        flips.setdefault(tuple(row[c] for c in key), set()).add(row.item_id)
    for node in nodes.collect():
        capacity, rows = made[node.instance_id]
        order = sorted(range(len(rows)), key=lambda n: (-rows[n][1] / rows[n][0], n))
        greedy, room = set(), capacity
        for n in order:
            if rows[n][0] > room:
                break
            greedy.add(n)
            room -= rows[n][0]
        decided, flipped = set(order[: node.depth]), flips.get(tuple(node[c] for c in key), set())
        fixed = {n for n in decided if (n in greedy) != (n in flipped)}
        free = order[node.depth :]
        best = max(
            (
                sum(rows[n][1] for n in fixed.union(more))
                for k in range(len(free) + 1)
                for more in combinations(free, k)
                if sum(rows[n][0] for n in fixed.union(more)) <= capacity
            ),
            default=None,
        )
        if best is not None:
            seen += 1
            assert node.bound >= best, (node, best)
    assert seen > 100


def test_a_search_of_many_rounds_needs_no_limit(spark):
    made = {1: (60, [(w, w) for w in (7, 11, 13, 17, 19, 23, 29, 31)])}
    result = select_best_subset(*tables(spark, made), levels_per_round=1, reduce=False, dominance=False)
    assert result.stop_reason == "empty"
    check(result, made, "max")


def test_release_deletes_what_the_search_wrote(spark):
    from pathlib import Path

    from ballast.plans.scratch import scratch_root

    made = {1: (10, [(3, 4), (5, 6), (7, 8), (2, 3)])}
    before = set(Path(scratch_root(spark).removeprefix("file:")).iterdir())
    result = select_best_subset(*tables(spark, made))
    check(result, made, "max")
    assert set(Path(scratch_root(spark).removeprefix("file:")).iterdir()) > before
    result.release()
    assert set(Path(scratch_root(spark).removeprefix("file:")).iterdir()) == before


def test_pages_have_folders_of_their_own_kind(spark):
    from ballast.operators.ranking import page_folder

    rows = spark.range(400).selectExpr("cast(id as int) as page").selectExpr("page", f"{page_folder('page')} as f").collect()
    assert [r.f for r in rows[:64]] == list(range(64))
    assert all(r.f == 63 + r.page // 64 for r in rows[64:])


def equal_space(spark, weights, capacity):
    """Search space of one instance whose items are worth their weight, and its root."""
    items = spark.createDataFrame([(1, i, w, w) for i, w in enumerate(weights)], ITEMS)
    space = search_space(rank_items(items, spark.createDataFrame([(1, capacity)], INSTANCES)), page_size=8, reduce=False)
    roots = space.roots().withColumnsRenamed({"base_weight": "weight", "base_value": "value"})
    return space, seed_frontier(roots, 1, carry=["weight", "value"])


@pytest.mark.parametrize("weights, capacity", [([7, 11, 13, 17, 19, 23, 29, 31], 75), ([10**12 + i * i for i in range(8)], 4 * 10**12 + 50)])
def test_most_valuable_descendant_leads_the_others(spark, weights, capacity):
    space, root = equal_space(spark, weights, capacity)
    best = space.page(0).select("instance_id", F.expr("best - 1").alias("best"))
    every = expand_frontier(root, space.page(0), best).agg(F.count("*").alias("n"), F.max("value").alias("most")).first()
    led = expand_frontier(root, space.page(0), best, lead=True).collect()
    assert every.n > 1 and [r.value for r in led] == [every.most]
    assert every.most == most_value([(w, w) for w in weights], capacity)


def test_round_expands_its_nodes_once(spark, monkeypatch):
    from ballast.operators import search

    written = []
    plain = search.materialize
    monkeypatch.setattr(search, "materialize", lambda df, label: written.append(label) or plain(df, label))
    draw = random.Random(3)
    items = [(i, k, w, w) for i in range(6) for k, w in enumerate(draw.randint(20, 200) for _ in range(14))]
    caps = {i: sum(r[2] for r in items if r[0] == i) // 2 for i in range(6)}
    result = select_best_subset(spark.createDataFrame(items, ITEMS), spark.createDataFrame(list(caps.items()), INSTANCES))
    assert {r.instance_id: r.objective for r in result.report.collect()} == {
        i: most_value([(r[2], r[3]) for r in items if r[0] == i], c) for i, c in caps.items()
    }
    assert written.count("children") == result.rounds


def test_first_solution_tries_all_choices_around_the_cut(spark, many_blocks):
    draw = random.Random(31)
    made = {}
    for i in range(30):
        weights = [draw.randint(20, 400) for _ in range(draw.randint(2, 8))]
        values = weights if i % 2 else [w + draw.randint(0, 9) for w in weights]
        made[i] = (sum(weights) // 2, list(zip(weights, values)))
    made[100] = (5, [(2, 3)])  # everything fits
    made[101] = (0, [(2, 3), (1, 1)])  # nothing does
    items, instances = tables(spark, made)
    ranked = rank_items(items, instances)
    core = ranked.lines(ranked.heads).selectExpr("*", "crit_item is null or ratio > crit_ratio or (ratio = crit_ratio and item_id < crit_item) as greedy")
    found = {r.instance_id: r for r in greedy_solutions(ranked, core).collect()}
    greedy = {r.instance_id: set() for r in found.values()}
    for r in core.where("greedy").collect():
        greedy[r.instance_id].add(r.item_id)
    for i, (capacity, rows) in made.items():
        assert found[i].objective == most_value(rows, capacity)
        chosen = greedy[i].symmetric_difference(found[i].flips)
        assert sum(rows[n][1] for n in chosen) == found[i].objective
        assert sum(rows[n][0] for n in chosen) <= capacity


def test_equal_values_that_fill_the_capacity_open_no_node(spark):
    draw = random.Random(32)
    made = {i: (0, [(w, w) for w in (draw.randint(20, 200) for _ in range(40))]) for i in range(5)}
    made = {i: (sum(w for w, _ in rows) // 2, rows) for i, (_, rows) in made.items()}
    result = select_best_subset(*tables(spark, made))
    assert result.rounds == 0 and result.stop_reason == "empty"
    check(result, made, "max")


@pytest.mark.parametrize("small_frontier", [0, 1_000_000])
def test_round_counts_its_nodes_once(spark, monkeypatch, small_frontier):
    from ballast.operators import search

    written = []
    plain = search.materialize
    monkeypatch.setattr(search, "materialize", lambda df, label: written.append(label) or plain(df, label))
    # No choice of even weights fills an odd capacity, so bounds prune little.
    made = {i: (1001 + 2 * i, [(2 * w, 2 * w) for w in range(50 + i, 62 + i)]) for i in range(6)}
    result = select_best_subset(*tables(spark, made), small_frontier=small_frontier)
    assert result.rounds > 0
    assert written.count("known") == result.rounds
    check(result, made, "max")
