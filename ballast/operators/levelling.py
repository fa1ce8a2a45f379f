"""Levelling of open nodes between slots.

A *slot* owns open nodes, each a row (slot, tree_id, node_id, is_easy, ...). Slots with
few open nodes are filled up from those with most. ``slots`` lists all slots, empty ones
too; neither slots nor nodes of one slot are assumed to fit into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ballast.operators.incumbent import merge_incumbent
from ballast.plans.blocks import BLOCK, block_totals, range_blocks, running_totals
from ballast.plans.scratch import materialize
from ballast.plans.skew import HOT_ROWS, MAX_HOT_KEYS, join_by_key

# Fixed value: no slot is filled up beyond this many open nodes.
CAP = 10
SEED = 1
CHUNK = 1000
# Letters of the MD5 that tell the parts of a slot: 4,096 parts, so that a slot of any size is cut up.
PREFIX = 3

NODE = ("slot", "tree_id", "node_id")


def pending_by_slot(nodes: DataFrame, slots: DataFrame, by_tree: bool = False) -> DataFrame:
    """Open nodes per slot, or per slot and tree: (slot, [tree_id,] n, n_easy, n_hard)."""
    keys = ["slot", "tree_id"] if by_tree else ["slot"]
    counts = nodes.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("is_easy")).alias("n_easy"),
        F.count_if(~F.col("is_easy")).alias("n_hard"),
    )
    if by_tree:
        return counts
    zero = F.lit(0).cast("bigint")
    return slots.join(counts, "slot", "left").select(
        "slot", *[F.coalesce(F.col(c), zero).alias(c) for c in ("n", "n_easy", "n_hard")]
    )


def pending_pages(nodes: DataFrame, slots: DataFrame, page_size: int = CHUNK) -> DataFrame:
    """Lists of the open nodes of each slot in key order: (slot, page, pending).

    A list holds at most ``page_size`` nodes; a slot has as many pages as it needs, and an
    empty slot has one empty list.
    """
    order = [F.col("tree_id"), F.col("node_id")]
    blocked = range_blocks(nodes.select(*NODE, "is_easy"), ["slot"], order, "pending")
    ranked = running_totals(blocked, ["slot"], order, {"rank": F.lit(1).cast("bigint")})
    page = F.floor(F.col("rank_before") / page_size).cast("bigint").alias("page")
    entry = F.struct("tree_id", "node_id", "is_easy")
    pages = ranked.groupBy("slot", page).agg(F.sort_array(F.collect_list(entry)).alias("pending"))
    owners = blocked.groupBy("slot").agg(F.count("*").alias("n"))
    empty = slots.join(owners, "slot", "left_anti").select(
        "slot", F.lit(0).cast("bigint").alias("page"), F.array().cast(pages.schema["pending"].dataType).alias("pending")
    )
    return pages.unionByName(empty)


def slot_results(
    solutions: DataFrame, nodes: DataFrame, slots: DataFrame, sense: str = "max", tie: str = "tie_id", page_size: int = CHUNK
) -> DataFrame:
    """What each slot reports: its best solution with the counts and the pages of its open nodes.

    ``solutions`` has slot, status, objective and the tie column. One row per slot and page;
    a slot without a solution has nulls in its columns.
    """
    best = merge_incumbent(solutions, "slot", sense, tie)
    heads = pending_by_slot(nodes, slots).join(best, "slot", "left")
    pages = pending_pages(nodes, slots, page_size)
    hot = _hot_slots(heads, "n", HOT_ROWS * page_size)
    return join_by_key(pages, heads, "slot", hot)


def levelling_threshold(counts: DataFrame, cap: int = CAP) -> DataFrame:
    """One row: (n_slots, n_open, threshold)."""
    n_open = F.coalesce(F.sum("n"), F.lit(0).cast("bigint"))
    mean = F.ceil(n_open / F.count("*")).cast("bigint")
    return counts.agg(
        F.count("*").alias("n_slots"),
        n_open.alias("n_open"),
        F.when(F.count("*") > 0, F.least(F.lit(cap).cast("bigint"), mean - 1)).alias("threshold"),
    )


def levelling_plan(counts: DataFrame, cap: int = CAP) -> DataFrame:
    """How many nodes each slot gives (delta < 0) or gets (delta > 0): (slot, n, delta).

    Every slot below the threshold is filled up to it. The same number is taken one by one
    from whichever slot has most at that moment, ties by the lowest slot. The outcome of
    that process is a cut: all slots give what they have above some level, and the lowest
    slots among those that reach it give one more. Level and last such slot are found by
    aggregation, and the plan is then a projection of the counts.
    """
    counts = materialize(counts.select("slot", F.col("n").cast("bigint").alias("n")), "counts")
    cut = _cut(counts, cap)
    if cut is None:
        return counts.withColumn("delta", F.lit(0).cast("bigint"))
    threshold, missing, step = cut["threshold"], cut["missing"], cut["step"]
    level = (step["nodes"] - missing) // step["slots"] + 1
    one_more = missing - (step["nodes"] - step["slots"] * level)

    reaches = F.col("n") >= level
    extra = F.lit(1)
    if one_more < step["slots"]:
        extra = F.when(F.col("slot") <= _kth_slot(counts.where(reaches), one_more), 1).otherwise(0)
    delta = F.when(F.col("n") < threshold, threshold - F.col("n")).when(reaches, level - F.col("n") - extra).otherwise(0)
    return counts.withColumn("delta", delta.cast("bigint"))


def _cut(counts: DataFrame, cap: int):
    """Where the moves end: (threshold, missing, step), or None if nothing moves.

    ``missing`` nodes have to be found above the threshold; ``step`` has the number of slots
    at or above the height where there are enough, and of their nodes.

    Works on one row per height. k different heights need at least k * (k - 1) / 2 open
    nodes, so even a million heights, a small sort, take half a trillion nodes.
    """
    heights = counts.groupBy("n").agg(F.count("*").alias("slots"))
    everything, down = Window.partitionBy(), Window.orderBy(F.col("n").desc())
    so_far = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mean = F.ceil(F.sum(F.col("n") * F.col("slots")).over(everything) / F.sum("slots").over(everything))
    steps = heights.select(
        "n",
        (F.least(F.lit(cap).cast("bigint"), mean.cast("bigint") - 1)).alias("threshold"),
        F.sum("slots").over(so_far).alias("slots"),
        F.sum(F.col("n") * F.col("slots")).over(so_far).alias("nodes"),
        F.lead("n").over(down).alias("next"),
        F.col("slots").alias("here"),
    )
    lacking = F.expr("if(n < threshold, (threshold - n) * here, 0L)")
    steps = steps.withColumn("missing", F.sum(lacking).over(everything))
    enough = "n > threshold and nodes - slots * greatest(next, threshold) >= missing"
    cut = steps.agg(
        F.max("threshold").alias("threshold"),
        F.max("missing").alias("missing"),
        F.expr(f"max_by(struct(slots, nodes), n) filter (where {enough})").alias("step"),
    ).first()
    return cut if cut["missing"] else None


def _kth_slot(counts: DataFrame, k: int):
    """The k-th lowest slot, sorting only the range block that holds it."""
    blocked = range_blocks(counts.select("slot"), [], [F.col("slot")], "slots")
    totals = block_totals(blocked, [], {"rank": F.lit(1).cast("bigint")})
    holds = (F.col("rank_before") < k) & (F.col("rank_before") + F.col("rank") >= k)
    block = totals.where(holds).first()
    inside = blocked.where(F.col(BLOCK) == block[BLOCK])
    place = F.row_number().over(Window.partitionBy(BLOCK).orderBy("slot"))
    return inside.withColumn("place", place).where(F.col("place") == k - block["rank_before"]).first()["slot"]


def _hot_slots(plan: DataFrame, size: str, hot_rows: int) -> DataFrame | None:
    """Slots whose ``size`` calls for a broadcast join; never more than MAX_HOT_KEYS."""
    total = plan.agg(F.expr(f"sum({size}) as total")).first()["total"] or 0
    limit = max(hot_rows, total // MAX_HOT_KEYS)
    return plan.where(f"{size} > {limit}").select("slot") if total > limit else None


def pick_to_move(nodes: DataFrame, plan: DataFrame, seed: int = SEED, carry: Sequence[str] = ()) -> DataFrame:
    """Exactly ``-delta`` nodes of every giving slot: (slot, tree_id, node_id, rank), and the columns to carry.

    The order is pseudo-random but fixed by the seed: by MD5 of seed, tree and node. Counts
    per slot and MD5 prefix tell which prefixes lie before the last node to give; only nodes with
    these are read again, and each prefix of a slot is put in order by itself.
    """
    lot = F.md5(F.concat_ws("|", F.lit(str(seed)), "tree_id", "node_id"))
    lots = nodes.select(*NODE, *carry, lot.alias("lot")).withColumn("prefix", F.substring("lot", 1, PREFIX))
    givers = plan.where("delta < 0").selectExpr("slot", "-delta as gives")
    counts = lots.groupBy("slot", "prefix").agg(F.count("*").alias("c")).join(givers, "slot")
    earlier = Window.partitionBy("slot").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    context = counts.select("slot", "prefix", "gives", F.coalesce(F.sum("c").over(earlier), F.lit(0).cast("bigint")).alias("before"))
    inside = Window.partitionBy("slot", "prefix").orderBy("lot", "tree_id", "node_id")
    ranked = lots.join(context.where("before < gives"), ["slot", "prefix"])
    ranked = ranked.withColumn("rank", (F.col("before") + F.row_number().over(inside)).cast("bigint"))
    return ranked.where("rank <= gives").select(*NODE, *carry, "rank")


def split_moved(nodes: DataFrame, picked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(moved, kept): the nodes that are among the picked ones, and the others.

    Here as everywhere a node is told by its slot, tree and node id, letter for letter.
    """
    picked = picked.select(*NODE)
    return nodes.join(picked, list(NODE), "left_semi"), nodes.join(picked, list(NODE), "left_anti")


def assign_destinations(picked: DataFrame, plan: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Where each picked node goes: the columns of ``picked`` without rank, and new_slot.

    The picked nodes are numbered by slot and rank, the open places by slot, and node i
    goes to place i. ``plan`` must be the one the nodes were picked by.
    """
    moves = range_blocks(plan.where("delta <> 0").select("slot", "delta"), [], [F.col("slot")], "moves")
    sides = {"given": F.greatest(-F.col("delta"), F.lit(0)), "taken": F.greatest(F.col("delta"), F.lit(0))}
    numbered = running_totals(moves, [], [F.col("slot")], sides)

    # One slot may give nearly everything that moves.
    hot = _hot_slots(plan.where("delta < 0"), "-delta", hot_rows)
    givers = numbered.where("delta < 0").select("slot", "given_before")
    moving = join_by_key(picked, givers, "slot", hot)
    moving = moving.withColumn("place", F.col("given_before") + F.col("rank") - 1).drop("given_before", "rank")

    # One row per place. A slot gets no more than the cap; in chunks, so that no array is long.
    start, end = F.col("taken_before"), F.col("taken_before") + F.col("delta") - 1
    chunks = numbered.where("delta > 0").select(
        F.col("slot").alias("new_slot"), end.alias("end"), F.explode(F.sequence(start, end, F.lit(CHUNK))).alias("first")
    )
    last = F.least(F.col("end"), F.col("first") + (CHUNK - 1))
    places = chunks.select("new_slot", F.explode(F.sequence("first", last)).alias("place"))
    return moving.join(places, "place").drop("place")


def rebalance(nodes: DataFrame, slots: DataFrame, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """The nodes after one levelling: their columns, and ``old_slot``.

    A moved node is the root of a new tree named after its old tree and its own id. Kept
    and moved nodes come from one join of all nodes with the moves. (slot, tree_id, node_id)
    must be unique.
    """
    plan = materialize(levelling_plan(pending_by_slot(nodes, slots), cap), "plan")
    return move_nodes(nodes, assign_destinations(pick_to_move(nodes, plan, seed), plan))


def move_nodes(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    """All nodes, those of ``moves`` (slot, tree_id, node_id, new_slot) at their new slots: their columns, and ``old_slot``."""
    moves = moves.select(*NODE, "new_slot").alias("moves")
    same = [F.col(f"nodes.{c}") == F.col(f"moves.{c}") for c in NODE]
    rows = nodes.alias("nodes").join(moves, same, "left")
    new_slot = F.col("moves.new_slot")
    changed = {
        "slot": F.coalesce(new_slot, F.col("nodes.slot")),
        "tree_id": F.when(new_slot.isNull(), F.col("nodes.tree_id")).otherwise(
            F.concat_ws("/", "nodes.tree_id", "nodes.node_id")
        ),
    }
    return rows.select(
        *[changed.get(c, F.col(f"nodes.{c}")).alias(c) for c in nodes.columns], F.col("nodes.slot").alias("old_slot")
    )


def rebalance_counted(nodes: DataFrame, counts: DataFrame, cap: int = CAP, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(nodes, counts) after one levelling of nodes whose counts per slot are known.

    ``counts`` is that of :func:`pending_by_slot` or of an earlier call. The new counts are the old ones and what the moves
    change in them: their plan reads the moves, never the nodes.
    """
    plan = materialize(levelling_plan(counts, cap), "plan")
    moves = materialize(assign_destinations(pick_to_move(nodes, plan, seed, carry=["is_easy"]), plan), "moves")
    return move_nodes(nodes, moves), changed_counts(counts, count_changes(moves))


def count_changes(moves: DataFrame) -> DataFrame:
    """What ``moves`` (slot, new_slot, is_easy) add to the counts of slots: (slot, n, n_easy, n_hard), negative for givers.

    A null ``slot`` stands for a node that is new, a null ``new_slot`` for one that is done.
    """
    ends = moves.select(
        F.explode(F.array(F.struct(F.col("slot"), F.lit(-1).alias("by")), F.struct(F.col("new_slot").alias("slot"), F.lit(1).alias("by")))).alias("end"),
        "is_easy",
    ).select("end.*", "is_easy")
    by = F.col("by").cast("bigint")
    return (
        ends.where(F.col("slot").isNotNull())
        .groupBy("slot")
        .agg(
            F.sum(by).alias("n"),
            F.sum(F.when(F.col("is_easy"), by).otherwise(0)).alias("n_easy"),
            F.sum(F.when(~F.col("is_easy"), by).otherwise(0)).alias("n_hard"),
        )
    )


def changed_counts(counts: DataFrame, changes: DataFrame) -> DataFrame:
    """Counts per slot with changes (slot, n, n_easy, n_hard) added; written out, so that the next changes start from a table."""
    names = ("n", "n_easy", "n_hard")
    added = changes.select("slot", *[F.col(c).alias(f"_{c}") for c in names])
    rows = counts.join(added, "slot", "left")
    return materialize(rows.select("slot", *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).cast("bigint").alias(c) for c in names]), "counts")
