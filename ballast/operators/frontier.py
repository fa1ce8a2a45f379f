"""Open nodes of the search: seed, expand, prune.

A node is a choice that keeps to the greedy order except for some items, the *flips*, that
are decided the other way; ``page`` tells which page of core items it has to decide next and ``depth`` how many items
are decided for good. Greedy items come first in the order, so a node is always a choice that fits the budget, and
``weight`` and ``value`` are those of that choice.

A node does not carry its flips. It knows the node it comes from, ``parent`` of round ``parent_round``, and in the bits of
``mask`` what has been flipped since: bit i stands for the i-th item from page ``from_page`` on. The way back to the root is
walked for the winners only (:mod:`ballast.operators.paths`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ballast.functions.bounds import node_bound
from ballast.plans.blocks import range_blocks, running_best, shuffle_tasks
from ballast.plans.skew import join_by_key

INSTANCE = "instance_id"
PAGE_KEY = [INSTANCE, "page"]

PATH_COLUMNS = ("from_page", "parent_round", "parent", "mask")
# ``tail``: the page at which a node of a large search is completed (``completion.py``), else null.
NODE_COLUMNS = (INSTANCE, "page", "depth", "weight", "value", "bound", "tail", *PATH_COLUMNS)


def seed_frontier(instances: DataFrame, n_slots: int, slot: int = 1, carry: Sequence[str] = ()) -> DataFrame:
    """One root node per instance, on one slot; weight and value are 0 unless carried over."""
    zero = {c: F.lit(0).cast("bigint").alias(c) for c in ("weight", "value") if c not in carry}
    return instances.select(
        INSTANCE,
        F.col(INSTANCE).cast("string").alias("tree_id"),
        F.lit("").alias("node_id"),
        F.lit(slot % n_slots).alias("slot"),
        F.lit(0).alias("page"),
        F.lit(0).alias("depth"),
        *zero.values(),
        F.lit(None).cast("bigint").alias("bound"),
        F.lit(None).cast("int").alias("tail"),
        F.lit(0).alias("from_page"),
        F.lit(None).cast("int").alias("parent_round"),
        F.lit(None).cast("bigint").alias("parent"),
        F.lit(0).cast("bigint").alias("mask"),
        *carry,
    )


# The two children of a node n for one item: as the greedy order has it, and against it.
_CHILDREN = """array(
    struct(n.weight as weight, n.value as value, n.mask as mask),
    if(item.greedy or n.weight + item.weight <= budget,
       struct(if(item.greedy, n.weight - item.weight, n.weight + item.weight) as weight,
              if(item.greedy, n.value - item.value, n.value + item.value) as value,
              n.mask | shiftleft(1L, cast(item.position - from_page * page_size as int)) as mask),
       null))"""

# The children of all nodes ``open`` for one item that can still beat ``best``.
_SURVIVORS = f"""filter(
        transform(
            filter(flatten(transform(open, n -> {_CHILDREN})), c -> c is not null),
            c -> struct(c.weight as weight, c.value as value, c.mask as mask, {node_bound("c", "item")} as bound)),
        c -> c.bound > best)"""

# All descendants of a node that survive the items of one page, level by level.
_DESCENDANTS = f"""aggregate(
    items,
    array(struct(weight, value, mask, bound)),
    (open, item) -> {_SURVIVORS})"""

# The same, but every node is a choice of its own, so the most valuable one is the cutoff of its level: it stays, and
# others only if they can still lead to more. After the last item only that one is left.
_LED = f"""aggregate(
    items,
    array(struct(weight, value, mask, bound)),
    (open, item) -> element_at(
        transform(transform(array({_SURVIVORS}), kept -> struct(kept, transform(kept, c -> c.value) as worth)),
            x -> element_at(transform(array(struct(array_max(x.worth) as most, array_position(x.worth, array_max(x.worth)) - 1 as place)),
                top -> filter(x.kept, (c, i) -> c.bound > top.most or i = top.place)), 1)), 1))"""


def expand_frontier(
    nodes: DataFrame,
    pages: DataFrame,
    best: DataFrame | None = None,
    hot: DataFrame | None = None,
    small: bool = False,
    lead: bool = False,
) -> DataFrame:
    """Decide the next few items of every node.

    ``pages`` holds one row per instance and page with a short list of items. Each item gives two
    children, one with the greedy decision and one against it (an item is only put in if
    it fits); they are bounded, and those that can still beat ``best`` (instance, best) go
    on to the next item. Nodes that have decided the last item are ``complete``; nodes
    without a page leave the frontier. ``hot`` names (instance, page) with very many nodes, see
    :func:`ballast.plans.skew.hot_keys`. With ``small`` the caller vouches that
    ``best`` has few rows: the nodes stay where they are and meet their pages by broadcast. With ``lead`` the most valuable
    descendant of a node is the cutoff for its others, level by level, so that not all of them are returned.

    One join; the levels are a fold inside the joined row, whose size the page bounds.
    """
    page = pages.select(*PAGE_KEY, "budget", "crit_weight", "crit_value", "last", "items", "page_size", "advance")
    page = page.withColumn("best", F.lit(-1).cast("bigint")) if best is None else page.join(best, INSTANCE)
    if small:
        rows = nodes.join(F.broadcast(page), PAGE_KEY)
    else:
        rows = join_by_key(nodes, page, PAGE_KEY, hot, shuffle_tasks(nodes))
    rows = rows.where("bound is null or bound > best")
    path = ["tail", *[c for c in PATH_COLUMNS if c != "mask"]]
    descendants = _LED if lead else _DESCENDANTS
    return rows.selectExpr(
        INSTANCE, "page + advance as page", "cast(depth + size(items) as int) as depth", *path, "best", "last as complete", f"inline({descendants})"
    ).select(*NODE_COLUMNS, "best", "complete")


def prune_frontier(nodes: DataFrame, incumbent: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Keep the open nodes that can still beat the incumbent.

    ``nodes`` needs ``bound``, ``depth`` and ``n_items``; ``incumbent`` holds (instance,
    objective), null where nothing has been found yet.
    """
    rows = join_by_key(nodes, incumbent.select(INSTANCE, "objective"), INSTANCE, hot)
    wins = F.col("objective").isNull() | (F.col("bound") > F.col("objective"))
    return rows.where(wins & (F.col("depth") < F.col("n_items"))).drop("objective")


def keep_best_of_weight(nodes: DataFrame, spread: bool = False) -> DataFrame:
    """Of nodes with the same instance, depth and weight, keep the one with most value.

    They face the same remaining items and the same room, so no other can lead to more.
    The shuffle key includes the weight, so a single instance spreads over all tasks. All columns are numbers, so
    this is a hash aggregation; ties are resolved by the order of the rows, alike for all columns of a row.
    With ``spread`` the rows go to all tasks of a shuffle, as what follows takes long for each of them.
    """
    if spread:
        nodes = nodes.repartition(shuffle_tasks(nodes), INSTANCE, "depth", "weight")
    told = [F.max_by(c, "value").alias(c) for c in ("page", "tail", *PATH_COLUMNS)]
    kept = nodes.groupBy(INSTANCE, "depth", "weight").agg(
        F.max("value").alias("value"), F.max("bound").alias("bound"), *told, F.max("best").alias("best"), F.max("complete").alias("complete")
    )
    return kept.select(*NODE_COLUMNS, "best", "complete")


def keep_dominant(nodes: DataFrame, few: bool = False) -> DataFrame:
    """Drop nodes that a lighter or equally heavy one of the same instance and depth matches in value.

    Whatever a heavier node can still put in, the lighter one can too, so no dropped node leads to more than the
    one that drops it. A sweep over rising weight finds them by the most value so far. ``few`` tells that
    there are so few nodes that one task can sweep all of an instance; else it is swept in range blocks.
    """
    by, order = [INSTANCE, "depth"], [F.col("weight"), F.col("value").desc()]
    if few:
        lighter = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        swept = nodes.withColumn("_most", F.max("value").over(lighter))
    else:
        blocked = range_blocks(keep_best_of_weight(nodes), by, order, "swept", spread=True)
        swept = running_best(blocked, by, order, F.col("value"), "_most").drop("block")
    return swept.where("_most is null or value > _most").drop("_most")
