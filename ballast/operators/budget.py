"""Sharing a time budget among the trees of a group, in order."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.operators.iterate import iterate_until_empty
from ballast.plans.blocks import BLOCK, block_totals, range_blocks, running_totals
from ballast.plans.scratch import materialize

# Seconds for an easy and for a hard open node.
EASY_SECONDS = 6
HARD_SECONDS = 60

# Trees of a group that are served in one row; the list of their shares is never longer.
CHUNK = 1000


def apportion_budget(trees: DataFrame, total: float, easy: float = EASY_SECONDS, hard: float = HARD_SECONDS) -> DataFrame:
    """Share of every tree, as (group_id, seq, share).

    ``trees``: (group_id, seq, n_easy, n_hard); ``seq`` orders the trees of a group and is
    unique in it. Each tree with open nodes is offered whole seconds of what is left. If
    that exceeds the need of all trees still to come, the tree gets its need and the whole
    surplus, otherwise its proportional part, but never less than ``easy``. When nothing
    is left, and for trees without open nodes, the share is 0.

    Where the budget exceeds the need of the whole group, what is left after the first tree is the need
    of the others, so each gets its own: that case is a projection. Else what one tree gets depends
    on all before it. The trees of such groups are served in chunks, all groups at once, and
    what is left and still to come goes from chunk to chunk. Trees learn of their group by (group, block), so
    a group of any size is spread over as many tasks as it has blocks.
    """
    if easy <= 0 or hard <= 0:
        raise ValueError("seconds per node must be positive")
    need = (F.col("n_easy") * F.lit(float(easy)) + F.col("n_hard") * F.lit(float(hard))).alias("need")
    order = [F.col("seq")]
    blocked = range_blocks(trees.select("group_id", "seq", need).where(F.col("need") > 0), ["group_id"], order, "trees")
    totals = {"need": F.col("need"), "place": F.expr("1L")}
    blocks = materialize(block_totals(blocked, ["group_id"], totals, whole=["need"]), "budget-blocks")
    offer = math.floor(total)
    # With whole needs, none below the least share, the offer is exactly what is still to come from the second tree on.
    plain = float(easy).is_integer() and float(hard).is_integer() and easy <= hard
    rich = F.col("need_whole") < offer if plain else F.lit(False)

    # A tree that gets anything gets at least min(easy, hard): those behind the last one that can be funded are left out.
    funded_at_most = max(0, math.ceil(total / min(easy, hard)))
    context = blocks.where(rich | (F.col("place_before") < funded_at_most)).select("group_id", BLOCK, "place_before", F.col("need_whole").alias("whole"))
    ranked = running_totals(blocked, ["group_id"], order, {"place": F.expr("1L")}, context)
    is_rich = F.col("whole") < offer if plain else F.lit(False)
    surplus = F.when(F.col("place_before") == 0, offer - F.col("whole")).otherwise(0)
    amply = ranked.where(is_rich).select("group_id", "seq", (F.col("need") + surplus).alias("share"))
    short = ranked.where(~is_rich & (F.col("place_before") < funded_at_most))
    groups = blocks.where(~rich).groupBy("group_id").agg(F.max("need_whole").alias("whole"))
    served = amply.unionByName(_in_chunks(short, groups, float(total), float(easy)))
    return trees.select("group_id", "seq").join(served, ["group_id", "seq"], "left").select(
        "group_id", "seq", F.coalesce("share", F.lit(0.0)).alias("share")
    )


def _in_chunks(ranked: DataFrame, groups: DataFrame, total: float, easy: float) -> DataFrame:
    """(group_id, seq, share) of the trees of ``groups`` (group_id, whole) that get anything, given by place in ``ranked``."""
    spark = ranked.sparkSession
    seq_type = ranked.schema["seq"].dataType.simpleString()
    shares = f"array<struct<seq:{seq_type},share:double>>"
    if total < 1 or groups.isEmpty():
        return spark.createDataFrame([], f"group_id {ranked.schema['group_id'].dataType.simpleString()}, seq {seq_type}, share double")

    chunk = F.floor(F.col("place_before") / CHUNK).cast("int").alias("chunk")
    lists = materialize(
        ranked.groupBy("group_id", chunk).agg(F.sort_array(F.collect_list(F.struct("seq", "need"))).alias("list")), "chunks"
    )
    seed = groups.select("group_id", F.lit(total).alias("left"), F.col("whole").alias("to_come"), F.array().cast(shares).alias("shares"))

    def serve(state: Column, tree: Column) -> Column:
        offer = F.floor(state["left"]).cast("double")
        surplus = offer - state["to_come"]
        share = (
            F.when(offer <= 0, F.lit(0.0))
            .when(surplus > 0, surplus + tree["need"])
            .otherwise(F.greatest(F.lit(easy), offer * tree["need"] / state["to_come"]))
        )
        return F.struct(
            (state["left"] - share).alias("left"),
            (state["to_come"] - tree["need"]).alias("to_come"),
            F.array_append(state["shares"], F.struct(tree["seq"].alias("seq"), share.alias("share"))).alias("shares"),
        )

    def step(rows: DataFrame, number: int, n_open: int) -> DataFrame:
        state = F.struct("left", "to_come", "shares")
        rows = rows.join(lists.where(F.col("chunk") == number), "group_id")
        after = rows.select("group_id", F.aggregate("list", state, serve).alias("s"), (F.size("list") == CHUNK).alias("more"))
        done = after.select("group_id", "s.left", "s.to_come", "s.shares", F.lit(False).alias("open"))
        rest = after.where(F.col("more") & (F.col("s.left") >= 1)).select(
            "group_id", "s.left", "s.to_come", F.array().cast(shares).alias("shares"), F.lit(True).alias("open")
        )
        return done.unionByName(rest)

    emitted = iterate_until_empty(seed, step, max_rounds=None, label="budget").emitted
    return emitted.select("group_id", F.inline("shares"))
