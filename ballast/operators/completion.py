"""Closing nodes near the end of a large search at once.

All choices of the last items of an instance, its *tail*, are listed once by weight (Horowitz and Sahni 1974). The best
completion of a node is the one of most value among those that fit into its room: the most value so far in a sweep over
rising weight, in which nodes stand at their room. No node is expanded over the tail.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.operators.frontier import INSTANCE
from ballast.operators.ranking import TAIL_ITEMS
from ballast.plans.blocks import range_blocks, running_best

# A tail has ``TAIL_ITEMS`` items (``ranking.py``): 65,536 choices per instance, in one row before they are listed.
_CHOICES = """aggregate(items, array(struct(0L as weight, 0L as value, 0L as mask)), (open, item) -> flatten(transform(open, n -> array(n,
    struct(n.weight + if(item.greedy, -item.weight, item.weight) as weight,
           n.value + if(item.greedy, -item.value, item.value) as value,
           n.mask | shiftleft(1L, cast(item.position - tail * page_size as int)) as mask)))))"""


def tail_choices(pages: DataFrame, tails: DataFrame) -> DataFrame:
    """(instance, tail, weight, value, mask) of all ways to flip the next ``TAIL_ITEMS`` items from page ``tail`` on, for rows (instance, tail)."""
    near = f"page >= tail and page < tail + greatest(1, {TAIL_ITEMS} div page_size)"
    whole = pages.drop("tail").join(tails, INSTANCE).where(near).groupBy(INSTANCE, "tail", "page_size")
    items = whole.agg(F.expr("flatten(transform(array_sort(collect_list(struct(page, items))), p -> p.items)) as items"))
    return items.selectExpr(INSTANCE, "tail", f"inline({_CHOICES})")


def complete_tails(nodes: DataFrame, pages: DataFrame, best: DataFrame) -> DataFrame:
    """The best completion of all ``nodes`` of each instance, if it beats ``best``: one closed row per instance.

    ``nodes`` (instance, tail, weight, value, round, node) have decided everything ahead of page ``tail``. With no more than
    ``TAIL_ITEMS`` items behind it the result is the best of all completions, else a good one. Columns of the result: (instance, from_page, value, best, parent_round, parent, mask).
    """
    by = [INSTANCE, "tail"]
    tails = nodes.select(*by).distinct()
    budgets = pages.where("page = 0").select(INSTANCE, "budget")
    choices = tail_choices(pages, tails).selectExpr(
        *by, "weight as at", "0 as kind", "value", "mask", "cast(null as int) as round", "cast(null as bigint) as node"
    )
    probes = nodes.select(*by, "weight", "value", "round", "node").join(budgets, INSTANCE)
    probes = probes.selectExpr(*by, "budget - weight as at", "1 as kind", "value", "cast(null as bigint) as mask", "round", "node")
    order = [F.col("at"), F.col("kind")]
    blocked = range_blocks(choices.unionByName(probes), by, order, "tails", spread=True)
    listed = F.expr("if(kind = 0, struct(value, mask), null)")
    reached = running_best(blocked, by, order, listed, "most").where("kind = 1")
    reached = reached.selectExpr(*by, "value + most.value as value", "most.mask as mask", "round", "node")
    top = reached.groupBy(INSTANCE).agg(
        F.max("value").alias("value"), *[F.max_by(c, "value").alias(c) for c in ("tail", "mask", "round", "node")]
    )
    return top.join(best, INSTANCE).where("value > best").selectExpr(
        INSTANCE, "tail as from_page", "value", "best", "round as parent_round", "node as parent", "mask"
    )
