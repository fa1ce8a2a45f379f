"""Registered queries: every operator over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.operators import budget, frontier, incumbent, iterate, levelling, paths, ranking, search
from ballast.plans.scratch import materialize, new_folder
from ballast.sources import views
from ballast.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

# Fixed value: the cluster that the levelling rule was made for has this many work slots.
N_SLOTS = 39
BRAND_CAPACITY = 100
# Suppliers have hundreds of lines each; a cap above the mean lets them level.
NO_CAP = 1_000_000_000


def _customers(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    items = materialize(views.customer_items(spark, folder), "orders")
    return items, views.half_capacity(spark, folder, items)


def _brands(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    items = views.brand_items(spark, folder)
    return items, views.fixed_capacity(items, BRAND_CAPACITY)


def _equal(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Orders that are worth their weight: no order is better than another, so bounds tell little."""
    items, instances = _customers(spark, folder)
    return items.withColumn("value", F.col("weight")), instances


def seed_frontier(spark: SparkSession, folder: str) -> DataFrame:
    instances = table(spark, folder, "customer").select(F.col("c_custkey").alias("instance_id"))
    return frontier.seed_frontier(instances, N_SLOTS).selectExpr(
        "instance_id", "tree_id", "node_id", "slot", "depth", "weight", "value", "bit_count(mask) as n_flips"
    )


def _two_levels(spark: SparkSession, folder: str) -> tuple[DataFrame, ranking.Ranked]:
    """Nodes of depth 1 and 2 under the greedy choice of every customer, nothing reduced, with their flips as text."""
    ranked = ranking.rank_items(*_customers(spark, folder))
    space = ranking.search_space(ranked, page_size=1, reduce=False)
    roots = space.roots().withColumnsRenamed({"base_weight": "weight", "base_value": "value"})
    roots = frontier.seed_frontier(roots, 1, carry=["weight", "value"])
    first = materialize(frontier.expand_frontier(roots, space.page(0)), "first")
    second = frontier.expand_frontier(first.drop("best", "complete"), space.page(1))
    nodes = materialize(first.unionByName(second), "levels")
    key = ("instance_id", "depth", "mask")
    flips = paths.flipped_items(nodes.select(*key, "from_page"), space.pages, key).groupBy(*key)
    flips = flips.agg(F.expr("array_join(transform(array_sort(collect_list(struct(position, item_id))), x -> cast(x.item_id as string)), ',') as flips"))
    return nodes.join(flips, list(key), "left").withColumn("flips", F.coalesce("flips", F.lit(""))), ranked


def expand_frontier(spark: SparkSession, folder: str) -> DataFrame:
    nodes, _ = _two_levels(spark, folder)
    return nodes.selectExpr("instance_id", "depth", "weight", "value", "bound", "flips")


def prune_frontier(spark: SparkSession, folder: str) -> DataFrame:
    nodes, ranked = _two_levels(spark, folder)
    sizes = ranked.heads.select("instance_id", "n_items")
    best = ranked.heads.selectExpr("instance_id", "base_value as objective")
    kept = frontier.prune_frontier(nodes.join(sizes, "instance_id"), best)
    return kept.selectExpr("instance_id", "depth", "weight", "value", "bound", "flips")


def _merge(sense: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return incumbent.merge_incumbent(views.order_solutions(spark, folder), "key", sense)

    return query


def merge_incumbent_errors(spark: SparkSession, folder: str) -> DataFrame:
    """With partial orders as errors, which halt their customer's search."""
    return incumbent.merge_incumbent(views.order_solutions(spark, folder, "error"), "key", "max")


def merge_incumbent_all(spark: SparkSession, folder: str) -> DataFrame:
    """The best of all solutions, without a key."""
    return incumbent.merge_incumbent(views.order_solutions(spark, folder).drop("key"), [], "max")


def merge_incumbent_all_errors(spark: SparkSession, folder: str) -> DataFrame:
    return incumbent.merge_incumbent(views.order_solutions(spark, folder, "unbounded").drop("key"), [], "min")


def is_halted(spark: SparkSession, folder: str) -> DataFrame:
    return incumbent.is_halted(views.order_solutions(spark, folder, "error"))


def _best_subset(instances: Callable, sense: str, **options) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        result = search.select_best_subset(*instances(spark, folder), sense, **options)
        return result.report.select("instance_id", "status", "objective")

    return query


def best_subset_resumed(spark: SparkSession, folder: str) -> DataFrame:
    """A search that ends after its first round, taken up again from its folder."""
    first = search.select_best_subset(*_customers(spark, folder), max_rounds=1, levels_per_round=4, steps_per_round=1)
    return search.resume_search(first).report.select("instance_id", "status", "objective")


def report_written(spark: SparkSession, folder: str) -> DataFrame:
    """The report, written and read back."""
    path = new_folder(spark, "report")
    incumbent.write_report(search.select_best_subset(*_brands(spark, folder)).report, path)
    return spark.read.parquet(path)


def best_subset_choices(spark: SparkSession, folder: str) -> DataFrame:
    """What the chosen items of every customer add up to."""
    items, instances = _customers(spark, folder)
    choices = search.select_best_subset(items, instances).choices
    totals = (
        choices.join(items, ["instance_id", "item_id"])
        .groupBy("instance_id")
        .agg(F.sum("value").alias("value"), F.sum("weight").alias("weight"))
    )
    return instances.join(totals, "instance_id", "left").selectExpr(
        "instance_id", "coalesce(value, 0L) as value", "coalesce(weight, 0L) <= capacity as fits"
    )


def _limited(spark: SparkSession, folder: str) -> search.SearchResult:
    return search.select_best_subset(
        *_customers(spark, folder), max_rounds=1, levels_per_round=1, dominance=False, reduce=False
    )


def solution_report(spark: SparkSession, folder: str) -> DataFrame:
    return search.select_best_subset(*_customers(spark, folder)).report


def solution_report_after_one_round(spark: SparkSession, folder: str) -> DataFrame:
    return _limited(spark, folder).report


def search_history(spark: SparkSession, folder: str) -> DataFrame:
    return _limited(spark, folder).history


def best_subset_halted(spark: SparkSession, folder: str) -> DataFrame:
    """A capacity that is missing is an error and ends the whole search."""
    items, instances = _customers(spark, folder)
    instances = instances.selectExpr("instance_id", "if(instance_id = 7, null, capacity) as capacity")
    return search.select_best_subset(items, instances, halt_all=True, reduce=False).report


def slot_results_customer(spark: SparkSession, folder: str) -> DataFrame:
    """What every customer's slot reports: best order, counts and pages of open orders."""
    solutions = views.order_solutions(spark, folder).withColumnRenamed("key", "slot")
    rows = levelling.slot_results(solutions, *views.customer_work(spark, folder), page_size=4)
    entry = "concat_ws(':', x.tree_id, x.node_id, cast(x.is_easy as int))"
    return rows.selectExpr(
        "slot", "page", f"array_join(transform(pending, x -> {entry}), ',') as pending",
        "n", "n_easy", "n_hard", "tie_id", "status", "objective", "halted",
    )


def _work(view: Callable, cap: int) -> dict[str, Query]:
    def pending(spark: SparkSession, folder: str) -> DataFrame:
        return levelling.pending_by_slot(*view(spark, folder))

    def by_tree(spark: SparkSession, folder: str) -> DataFrame:
        return levelling.pending_by_slot(*view(spark, folder), by_tree=True)

    def pages(spark: SparkSession, folder: str) -> DataFrame:
        lists = levelling.pending_pages(*view(spark, folder), page_size=4)
        entry = "concat_ws(':', x.tree_id, x.node_id, cast(x.is_easy as int))"
        return lists.selectExpr("slot", "page", f"array_join(transform(pending, x -> {entry}), ',') as pending")

    def threshold(spark: SparkSession, folder: str) -> DataFrame:
        return levelling.levelling_threshold(pending(spark, folder), cap)

    def plan(spark: SparkSession, folder: str) -> DataFrame:
        return levelling.levelling_plan(pending(spark, folder), cap)

    def planned(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        nodes, slots = view(spark, folder)
        made = materialize(levelling.levelling_plan(levelling.pending_by_slot(nodes, slots), cap), "plan")
        return nodes, made, levelling.pick_to_move(nodes, made)

    def picked(spark: SparkSession, folder: str) -> DataFrame:
        return planned(spark, folder)[2]

    def split(spark: SparkSession, folder: str) -> DataFrame:
        nodes, _, chosen = planned(spark, folder)
        moved, kept = levelling.split_moved(nodes, materialize(chosen, "picked"))
        return moved.withColumn("moved", F.lit(True)).unionByName(kept.withColumn("moved", F.lit(False)))

    def assigned(spark: SparkSession, folder: str) -> DataFrame:
        _, made, chosen = planned(spark, folder)
        return levelling.assign_destinations(chosen, made)

    def balanced(spark: SparkSession, folder: str) -> DataFrame:
        return levelling.rebalance(*view(spark, folder), cap)

    def counted(spark: SparkSession, folder: str) -> DataFrame:
        nodes, slots = view(spark, folder)
        counts = materialize(levelling.pending_by_slot(nodes, slots), "counts")
        return levelling.rebalance_counted(nodes, counts, cap)[1]

    return {
        "pending_by_slot": pending,
        "pending_by_tree": by_tree,
        "pending_pages": pages,
        "levelling_threshold": threshold,
        "levelling_plan": plan,
        "pick_to_move": picked,
        "split_moved": split,
        "assign_destinations": assigned,
        "rebalance": balanced,
        "pending_after_rebalance": counted,
    }


def _budget(total: int) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        trees = materialize(views.customer_trees(spark, folder), "trees")
        shares = budget.apportion_budget(trees, total)
        return shares.select("group_id", "seq", F.round("share", 4).alias("share"))

    return query


def _halving(spark: SparkSession, folder: str) -> iterate.Iteration:
    """Halve the quantity of every order until no part exceeds 10."""
    seed = views.order_weights(spark, folder).withColumnRenamed("weight", "quantity")

    def step(rows: DataFrame, number: int, n_open: int) -> DataFrame:
        parts = F.expr("if(quantity > 10, array(quantity div 2, quantity - quantity div 2), array(quantity))")
        split = rows.select("o_orderkey", F.explode(parts).alias("quantity"))
        return split.withColumn("open", F.col("quantity") > 10)

    return iterate.iterate_until_empty(seed, step)


def iterate_halving(spark: SparkSession, folder: str) -> DataFrame:
    leaves = _halving(spark, folder).emitted
    return leaves.groupBy("o_orderkey").agg(F.count("*").alias("leaves"), F.sum("quantity").alias("quantity"))


def iterate_history(spark: SparkSession, folder: str) -> DataFrame:
    return _halving(spark, folder).history


def iterate_halted(spark: SparkSession, folder: str) -> DataFrame:
    """Halving that halts when a part is still larger than 40 after two rounds or more: its history."""
    seed = views.order_weights(spark, folder).selectExpr("o_orderkey", "weight as quantity", "0 as level")

    def step(rows: DataFrame, number: int, n_open: int) -> DataFrame:
        parts = F.expr("if(quantity > 10, array(quantity div 2, quantity - quantity div 2), array(quantity))")
        split = rows.select("o_orderkey", F.explode(parts).alias("quantity"), (F.col("level") + 1).alias("level"))
        return split.withColumn("open", F.col("quantity") > 10)

    halt = (F.col("level") >= 2) & (F.col("quantity") > 40)
    return iterate.iterate_until_empty(seed, step, halt=halt).history


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {
        "seed_frontier": seed_frontier,
        "expand_frontier": expand_frontier,
        "prune_frontier": prune_frontier,
        "merge_incumbent_max": _merge("max"),
        "merge_incumbent_min": _merge("min"),
        "best_subset_max": _best_subset(_customers, "max"),
        "best_subset_min": _best_subset(_customers, "min"),
        "best_subset_brand_max": _best_subset(_brands, "max"),
        "best_subset_brand_min": _best_subset(_brands, "min"),
        "best_subset_no_dominance": _best_subset(_customers, "max", dominance=False, levels_per_round=4),
        "best_subset_choices": best_subset_choices,
        "best_subset_equal": _best_subset(_equal, "max"),
        "best_subset_budgeted": _best_subset(_brands, "max", round_seconds=600_000),
        "best_subset_resumed": best_subset_resumed,
        "report_written": report_written,
        "solution_report": solution_report,
        "solution_report_after_one_round": solution_report_after_one_round,
        "search_history": search_history,
        "merge_incumbent_errors": merge_incumbent_errors,
        "merge_incumbent_all": merge_incumbent_all,
        "merge_incumbent_all_errors": merge_incumbent_all_errors,
        "is_halted": is_halted,
        "best_subset_halted": best_subset_halted,
        "slot_results_customer": slot_results_customer,
        "apportion_budget_600": _budget(600),
        "apportion_budget_60": _budget(60),
        "apportion_budget_5000": _budget(5000),
        "iterate_halving": iterate_halving,
        "iterate_history": iterate_history,
        "iterate_halted": iterate_halted,
    }
    work = {
        "supplier": (views.supplier_work, NO_CAP),
        "customer": (views.customer_work, levelling.CAP),
        "cased": (views.customer_cased_work, levelling.CAP),
    }
    for owner, (view, cap) in work.items():
        found.update({f"{name}_{owner}": query for name, query in _work(view, cap).items()})
    return found
