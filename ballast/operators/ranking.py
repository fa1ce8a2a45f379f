"""From items and budgets to a search space.

1. *Rank*: order each instance by value per weight and run totals along it. The longest
   prefix that fits is the greedy choice, the item after it is the critical one.
2. *Reduce*: drop the items whose decision cannot differ from the greedy one in any better
   choice. What remains, the *core*, is what the search has to branch on.
3. *Page*: cut the core into pages of a fixed number of items, one row each, so that one
   join brings a round's items to the open nodes.

Instances may have any number of items: no step holds a whole instance in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballast.functions.bounds import check_whole, exact_ratio, flip_can_win
from ballast.functions.status import check_sense
from ballast.plans.blocks import BLOCK, block_totals, range_blocks, running_totals, shuffle_tasks
from ballast.plans.scratch import materialize, new_folder, release

INSTANCE = "instance_id"

# So many items at the end of an instance, in whole pages, have their choices listed as a whole (``completion.py``).
TAIL_ITEMS = 16

# So many items on either side of the cut of the greedy choice have all their choices tried for the first solution.
NEAR_ITEMS = 6

# The first pages, which most instances have, are stored in a folder each; later ones share folders of as many.
PAGE_FOLDERS = 64


def page_folder_of(page: int) -> int:
    return page if page < PAGE_FOLDERS else PAGE_FOLDERS - 1 + page // PAGE_FOLDERS


def page_folder(page: str) -> str:
    """The folder of a page, as an SQL expression."""
    return f"cast(if({page} < {PAGE_FOLDERS}, {page}, {PAGE_FOLDERS - 1} + {page} div {PAGE_FOLDERS}) as int)"


def _order() -> list[Column]:
    return [F.col("ratio").desc(), F.col("item_id")]


# Does the greedy choice of its instance take an item? Those ahead of the critical item.
GREEDY = "crit_item is null or ratio > crit_ratio or (ratio = crit_ratio and item_id < crit_item)"


@dataclass
class Ranked:
    """``items``: (instance, block, item, weight, value, ratio); ``heads``: one row per
    instance with totals, budget, status, greedy choice and critical item; ``blocks``: one
    row per (instance, block)."""

    items: DataFrame
    heads: DataFrame
    blocks: DataFrame

    def lines(self, heads: DataFrame) -> DataFrame:
        """Items with the columns of ``heads``, which has one row per instance."""
        items = self.items.select(INSTANCE, BLOCK, "item_id", "weight", "value", "ratio")
        return items.join(self.blocks.join(heads, INSTANCE), [INSTANCE, BLOCK])


def rank_items(items: DataFrame, instances: DataFrame, sense: str = "max") -> Ranked:
    """Order the items of every instance and find the greedy choice.

    Weights, values and capacities are whole numbers, and (instance, item) is unique; other types
    are refused. For ``max`` the budget is the capacity. For ``min`` the search chooses what to leave
    out, so the budget is what the total weight exceeds the demand by.
    """
    check_sense(sense)
    check_whole(items, "weight", "value")
    check_whole(instances, "capacity")
    usable = items.selectExpr(INSTANCE, "item_id", "cast(weight as bigint) as weight", "cast(value as bigint) as value")
    usable = usable.selectExpr("*", "coalesce(weight > 0 and value >= 0, false) as good")
    usable = usable.selectExpr("*", f"if(good, {exact_ratio()}, null) as ratio")
    ordered = range_blocks(usable, [INSTANCE], _order(), "items")
    totals = {
        "n_items": F.expr("1L"),
        "weight": F.expr("if(good, weight, 0L)"),
        "value": F.expr("if(good, value, 0L)"),
        "n_bad": F.expr("if(good, 0L, 1L)"),
    }
    blocks = materialize(block_totals(ordered, [INSTANCE], totals), "blocks")

    whole = blocks.groupBy(INSTANCE).agg(
        *[F.expr(f"sum({c}) as {n}") for c, n in zip(totals, ("n_items", "total_weight", "total_value", "n_bad"))]
    )
    budget = "capacity" if sense == "max" else "total_weight - capacity"
    heads = (
        instances.selectExpr(INSTANCE, "cast(capacity as bigint) as capacity")
        .join(whole, INSTANCE, "left")
        .selectExpr(
            INSTANCE,
            "capacity",
            *[f"coalesce({c}, 0L) as {c}" for c in ("n_items", "total_weight", "total_value", "n_bad")],
        )
        .selectExpr("*", f"{budget} as budget")
        .selectExpr("*", "case when n_bad > 0 or capacity is null then 'error' when budget < 0 then 'infeasible' end as status")
    )
    context = blocks.select(INSTANCE, BLOCK, "weight_before", "value_before").join(
        heads.where("status is null").select(INSTANCE, "budget"), INSTANCE
    )
    placed = running_totals(
        ordered.drop("good"), [INSTANCE], _order(), {"weight": F.col("weight"), "value": F.col("value")}, context
    )
    critical = placed.where("weight_before <= budget and weight_before + weight > budget").selectExpr(
        INSTANCE,
        "weight_before as base_weight",
        "value_before as base_value",
        "weight as crit_weight",
        "value as crit_value",
        "ratio as crit_ratio",
        "item_id as crit_item",
    )
    # Without a critical item everything fits: weight has no price.
    heads = heads.join(critical, INSTANCE, "left").selectExpr(
        *heads.columns,
        "coalesce(base_weight, total_weight) as base_weight",
        "coalesce(base_value, total_value) as base_value",
        "coalesce(crit_weight, 1L) as crit_weight",
        "coalesce(crit_value, 0L) as crit_value",
        "crit_ratio",
        "crit_item",
    )
    return Ranked(ordered, materialize(heads, "heads"), blocks.select(INSTANCE, BLOCK))


def greedy_solutions(ranked: Ranked, core: DataFrame | None = None) -> DataFrame:
    """One solution per searchable instance: (instance, objective, flips).

    The greedy choice, or, with ``core`` given, the best one that differs from it by
    putting in one item that still fits, by changing one item for the critical one, or by any change of the items
    around the critical one. ``flips`` are the items decided against the greedy order.
    """
    heads = ranked.heads.where("status is null")
    plain = heads.selectExpr(INSTANCE, "base_value as objective", "cast(array() as array<bigint>) as flips")
    if core is None:
        return plain
    variants = core.selectExpr(
        INSTANCE,
        """case when not greedy and weight <= budget - base_weight then base_value + value
                when greedy and crit_item is not null and crit_weight - weight <= budget - base_weight
                then base_value - value + crit_value end as objective""",
        "if(greedy, array(item_id, crit_item), array(item_id)) as flips",
    ).where("objective is not null")
    best = plain.unionByName(variants).unionByName(near_solutions(core)).groupBy(INSTANCE).agg(F.expr("max(struct(objective, flips)) as best"))
    return best.selectExpr(INSTANCE, "best.objective", "best.flips")


def near_solutions(core: DataFrame) -> DataFrame:
    """The best choice that differs from the greedy one only in its last ``NEAR_ITEMS`` items and in the first as many behind
    them, for instances where it is better: (instance, objective, flips).

    Choices are listed as two numbers, ``less`` and ``more``, whose bits are the items taken out and put in. With plain columns
    for the items Spark makes one loop of it, without arrays; a row has no more than these items, whatever the instance.
    """
    outward = Window.partitionBy(INSTANCE, "greedy").orderBy(
        F.expr("if(greedy, ratio, null)").asc(), F.expr("if(greedy, item_id, null)").desc(), *_order()
    )
    usable = core.where("not greedy or crit_item is not null")
    placed = usable.withColumn("place", F.row_number().over(outward) - 1).where(F.col("place") < NEAR_ITEMS)
    columns = []
    for side, test in (("less", "greedy"), ("more", "not greedy")):
        columns.append(F.expr(f"cast(count_if({test}) as int) as n_{side}"))
        for k in range(NEAR_ITEMS):
            columns += [F.expr(f"coalesce(max(if({test} and place = {k}, {c}, null)), 0L) as {side}_{c}{k}") for c in ("weight", "value")]
            columns.append(F.expr(f"max(if({test} and place = {k}, item_id, null)) as {side}_item{k}"))
    near = placed.groupBy(INSTANCE, "budget", "base_weight", "base_value").agg(*columns)
    # To all tasks of a shuffle: there are few rows, but many choices of each.
    near = materialize(near.repartition(shuffle_tasks(core), INSTANCE), "near")

    def total(side: str, column: str) -> str:
        return " + ".join(f"if({side} & {1 << k} <> 0, {side}_{column}{k}, 0L)" for k in range(NEAR_ITEMS))

    rows = near.selectExpr("*", "explode(sequence(0, shiftleft(1, n_less) - 1)) as less")
    rows = rows.selectExpr("*", f"base_weight - ({total('less', 'weight')}) as weight", f"base_value - ({total('less', 'value')}) as value")
    rows = rows.selectExpr("*", "explode(sequence(0, shiftleft(1, n_more) - 1)) as more")
    rows = rows.where(f"weight + {total('more', 'weight')} <= budget").selectExpr(
        INSTANCE, f"value + {total('more', 'value')} as objective", "base_value", f"less | shiftleft(more, {NEAR_ITEMS}) as flipped"
    )
    top = rows.where("objective > base_value").groupBy(INSTANCE).agg(F.max("objective").alias("objective"), F.max_by("flipped", "objective").alias("flipped"))
    items = [f"if(flipped & {1 << j} <> 0, {side}_item{j % NEAR_ITEMS}, null)" for j, side in enumerate(["less"] * NEAR_ITEMS + ["more"] * NEAR_ITEMS)]
    return top.join(near, INSTANCE).selectExpr(INSTANCE, "objective", f"filter(array({', '.join(items)}), i -> i is not null) as flips")


@dataclass
class SearchSpace:
    """``pages``: core items by (instance, page), ``last`` marking the final page;
    ``start``: first solution of every searchable instance, whose objective is ``best`` on
    the pages."""

    pages: DataFrame
    start: DataFrame

    def roots(self) -> DataFrame:
        """Instances with a core: (instance, base_weight, base_value, best)."""
        return self.page(0).select(INSTANCE, "base_weight", "base_value", "best")

    def page(self, *numbers: int, piece: tuple[int, int] | None = None) -> DataFrame:
        """The given pages of all instances, or of each the items from ``piece[0]`` up to ``piece[1]``; reads only the
        folders that hold them. ``advance`` tells whether the page is decided with these items."""
        folders = F.col("page_folder").isin([page_folder_of(n) for n in numbers])
        rows = self.pages.where(folders & F.col("page").isin(list(numbers))).drop("page_folder").withColumn("advance", F.lit(1))
        if piece is None:
            return rows
        begin, end = piece
        done = F.size("items") <= end
        rows = rows.withColumns({"last": F.col("last") & done, "advance": F.when(F.col("page_size") <= end, 1).otherwise(0)})
        return rows.withColumn("items", F.slice("items", begin + 1, end - begin))

    def tails(self) -> DataFrame:
        """(instance, tail): the page from which on few enough items are left to list all their choices."""
        return self.page(0).select(INSTANCE, "tail")


def search_space(ranked: Ranked, page_size: int, reduce: bool = True) -> SearchSpace:
    """Core items in pages, and the instances that have any.

    With ``reduce=False`` every item is in the core.
    """
    heads = ranked.heads.where("status is null").select(
        INSTANCE, "budget", "base_weight", "base_value", "crit_weight", "crit_value", "crit_ratio", "crit_item"
    )
    core = ranked.lines(heads).selectExpr("*", f"{GREEDY} as greedy")
    if reduce:
        # Any item whose flip improves on the greedy choice passes this first test.
        candidates = materialize(core.where(flip_can_win("base_value")), "candidates")
        start = materialize(greedy_solutions(ranked, candidates), "start")
        best = ranked.blocks.join(start.selectExpr(INSTANCE, "objective as best"), INSTANCE)
        core = candidates.join(best, [INSTANCE, BLOCK]).where(flip_can_win("best"))
    else:
        start = greedy_solutions(ranked)
        core = core.selectExpr("*", "base_value as best")

    tail_pages = max(1, TAIL_ITEMS // page_size)
    totals = {"position": F.expr("1L"), "addable": F.expr("if(greedy, 0L, value)")}
    context = block_totals(core, [INSTANCE], totals, whole=list(totals)).drop(*totals)
    rows = running_totals(core, [INSTANCE], _order(), totals, context)
    item = """struct(position_before as position, item_id, weight, value, greedy,
                     addable_whole - addable_before - if(greedy, 0L, value) as addable_after)"""
    shared = ["budget", "crit_weight", "crit_value", "base_weight", "base_value", "best"]
    pages = (
        rows.selectExpr("*", f"cast(position_before div {page_size} as int) as page", f"{item} as item")
        .groupBy(INSTANCE, "page", *shared)
        .agg(
            F.expr("sort_array(collect_list(item)) as items"),
            F.expr("max(position_before + 1 = position_whole) as last"),
            F.expr(f"cast(max(greatest(0, (position_whole + {page_size - 1}) div {page_size} - {tail_pages})) as int) as tail"),
        )
        .selectExpr("*", f"{page_size} as page_size", f"{page_folder('page')} as page_folder")
    )
    spark = pages.sparkSession
    path = new_folder(spark, "pages")
    pages.write.partitionBy("page_folder").parquet(path)
    if reduce:
        release(candidates)
    return SearchSpace(spark.read.schema(pages.schema).parquet(path), start)
