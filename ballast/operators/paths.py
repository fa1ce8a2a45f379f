"""From winning nodes back to the root: which items they flip."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.operators.frontier import INSTANCE
from ballast.plans.scratch import materialize

MASKS = (INSTANCE, "from_page", "mask")


def walk_back(winners: DataFrame, nodes: DataFrame) -> DataFrame:
    """The masks on the way from the root to each winner: (instance, from_page, mask), those that flip anything.

    ``winners``: (instance, parent_round, parent, from_page, mask), at most one per instance; ``nodes``: all nodes of the search
    with ``round`` and ``node``, by which their children know them. One join for each node on the longest way.
    """
    at, found = materialize(winners.select(INSTANCE, "parent_round", "parent", "from_page", "mask"), "way"), []
    while True:
        found.append(at.select(*MASKS).where("mask <> 0"))
        onward = at.where("parent is not null")
        rounds = [r.parent_round for r in onward.select("parent_round").distinct().collect()]
        if not rounds:
            break
        # Few rows: one per instance. The rounds that hold them are read, no others.
        wanted = onward.select(INSTANCE, F.col("parent_round").alias("round"), F.col("parent").alias("node"))
        step = nodes.where(F.col("round").isin(rounds)).join(wanted, [INSTANCE, "round", "node"])
        at = materialize(step.select(INSTANCE, "parent_round", "parent", "from_page", "mask"), "way")
    masks = found[0]
    for more in found[1:]:
        masks = masks.unionByName(more)
    return masks


def flipped_items(masks: DataFrame, pages: DataFrame, keys: tuple[str, ...] = (INSTANCE,)) -> DataFrame:
    """(keys, position, item_id) of the flipped items of ``masks`` (keys, from_page, mask); the keys include the instance.

    The bits of a mask run on from page to page.
    """
    sizes = pages.select(INSTANCE, F.col("page").alias("from_page"), "page_size")
    bits = masks.join(sizes, [INSTANCE, "from_page"]).select(
        *keys, "from_page", "page_size", F.posexplode(F.split(F.reverse(F.bin("mask")), "")).alias("bit", "set")
    )
    flips = bits.where("set = '1'").selectExpr(*keys, "cast(from_page + bit div page_size as int) as page", "cast(bit % page_size as int) as place")
    items = pages.select(INSTANCE, "page", F.posexplode("items").alias("place", "item"))
    joined = flips.join(items, [INSTANCE, "page", "place"])
    return joined.select(*keys, F.col("item.position").alias("position"), F.col("item.item_id").alias("item_id"))
