"""Exact choice of the best subset per instance by branch and bound over DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.operators.budget import EASY_SECONDS, HARD_SECONDS, apportion_budget
from ballast.operators.completion import complete_tails
from ballast.operators.frontier import (
    INSTANCE,
    NODE_COLUMNS,
    PAGE_KEY,
    expand_frontier,
    keep_best_of_weight,
    keep_dominant,
    seed_frontier,
)
from ballast.operators.incumbent import is_halted, merge_incumbent, solution_report
from ballast.operators.iterate import Iteration, iterate_until_empty, resume
from ballast.operators.paths import flipped_items, walk_back
from ballast.operators.ranking import GREEDY, Ranked, SearchSpace, rank_items, search_space
from ballast.plans.blocks import block_totals, range_blocks, running_totals, shuffle_tasks
from ballast.plans.scratch import Scratch, materialize, scratch_scope
from ballast.plans.skew import hot_limit

LEVELS_PER_ROUND = 8

# Pages that a round decides while there are few nodes, with dominance and a new cutoff after each.
STEPS_PER_ROUND = 2

# Nodes of one instance that one task may expand; with more, the instance is hot.
HOT_NODES = 20_000

# A node may have 2 ** levels descendants in one row before they are pruned.
MOST_LEVELS = 16
# A mask has a bit for every item that a round decides.
MOST_BITS = 62

# A frontier counts as small up to this many items on the pages of its nodes, some 50 MB.
SMALL_FRONTIER = 1_000_000

# An instance with more nodes than this waits for the next round before it decides another page.
FEW_NODES = 16

# Open nodes of one instance that enter a round; the best do, the others wait.
SLAB = 1_024


@dataclass
class SearchResult:
    """``report``: (instance_id, status, objective, n_open, halted) for every instance;
    ``choices``: (instance_id, item_id) of the chosen items, one row each, found when first asked for;
    ``history``: (round, n_open, n_closed, stop_reason); ``stop_reason`` as in the loop;
    ``folder``: where the rounds are, for :func:`resume_search`."""

    report: DataFrame
    history: DataFrame
    stop_reason: str
    rounds: int
    folder: str
    scratch: Scratch
    search: Search
    best: DataFrame
    nodes: DataFrame

    @cached_property
    def choices(self) -> DataFrame:
        with scratch_scope() as scratch:
            found = self.search.choices(self.best, self.nodes)
        self.scratch.folders += scratch.folders
        return found

    def release(self) -> None:
        """Delete the tables behind the results, once they have been used."""
        self.scratch.release()


def select_best_subset(
    items: DataFrame,
    instances: DataFrame,
    sense: str = "max",
    max_rounds: int | None = None,
    levels_per_round: int = LEVELS_PER_ROUND,
    dominance: bool = True,
    halt_all: bool = False,
    reduce: bool = True,
    hot_nodes: int = HOT_NODES,
    small_frontier: int = SMALL_FRONTIER,
    steps_per_round: int = STEPS_PER_ROUND,
    slab: int = SLAB,
    round_seconds: float | None = None,
) -> SearchResult:
    """Best 0/1 choice of items for every instance.

    ``items``: (instance_id, item_id, weight, value); ``instances``: (instance_id, capacity).
    ``max`` takes most value within the capacity. ``min`` takes least value whose weight
    reaches the capacity. Weights must be positive and values not negative; an instance with
    other items gets status error and is not searched. With ``halt_all`` one such instance
    stops the whole search.

    The search goes on until every instance is solved. When ``max_rounds`` ends it early, instances
    with open nodes are reported as feasible with the best choice found so far.

    Of an instance with more than ``slab`` open nodes the best by bound enter a round, ties by depth. The others wait in a written
    table, and come up again when nothing else is open; those that the incumbent has reached by then are gone. What a
    round costs is so bounded by the slab, whatever the instance. Nodes of such instances are completed over their last
    16 items by one sweep instead of being expanded there; the first time, nodes further up are completed over the next 16 items
    too, for a good incumbent.

    ``round_seconds`` is shared among the instances in every round, by their open nodes and in the order of their ids (see
    :func:`ballast.operators.budget.apportion_budget`). What an instance gets is its quota in place of the slab: it is charged
    6 seconds for a node with one page to go and 60 for others, and what it leaves is added to its next share.
    """
    if not 1 <= levels_per_round <= MOST_LEVELS:
        raise ValueError(f"levels_per_round must be between 1 and {MOST_LEVELS}")
    if steps_per_round < 1 or steps_per_round * levels_per_round > MOST_BITS:
        raise ValueError(f"a round decides between 1 and {MOST_BITS} items")
    with scratch_scope() as scratch:
        ranked = rank_items(items, instances, sense)
        space = search_space(ranked, levels_per_round, reduce)
        search = Search(
            ranked, space, sense, levels_per_round, steps_per_round, dominance, hot_nodes, small_frontier, slab, round_seconds
        )
        halted = bool(halt_all and is_halted(ranked.heads).first()["halted"])
        loop = iterate_until_empty(
            search.seed(), search.step, 0 if halted else max_rounds, label="nodes", park=search.park, revive=search.revive, keep=True,
            deal_up_to=search.few_open,
        )
        return search.result(loop, halted, scratch)


def resume_search(result: SearchResult, max_rounds: int | None = None) -> SearchResult:
    """Go on with a search that has ended at its round limit, or whose rounds were cut off, behind its last finished round."""
    with scratch_scope() as scratch:
        search = result.search
        spark = search.ranked.heads.sparkSession
        search.large = True
        loop = resume(
            spark, result.folder, search.step, max_rounds, park=search.park, revive=search.revive, keep=True, deal_up_to=search.few_open
        )
        scratch.folders += result.scratch.folders
        return search.result(loop, False, scratch)


@dataclass
class Search:
    """One search: its tables, and the functions that the loop calls."""

    ranked: Ranked
    space: SearchSpace
    sense: str
    levels: int
    steps: int
    dominance: bool
    hot_nodes: int
    small_frontier: int
    slab: int
    round_seconds: float | None
    #: Has any instance had more open nodes than enter a round?
    large: bool = False
    #: Have its nodes been completed over the next items once?
    dived: bool = False
    #: The pages that open nodes may have to decide next.
    pages: set[int] = field(default_factory=lambda: {0})
    #: What instances have left of their shares: (instance, unspent).
    ledger: DataFrame | None = None

    @property
    def few_open(self) -> int:
        """So many open nodes are a small frontier: they meet their pages where they are, more are spread by their instance and page."""
        return self.small_frontier // self.levels

    def seed(self) -> DataFrame:
        roots = self.space.roots().withColumnsRenamed({"base_weight": "weight", "base_value": "value"})
        seed = seed_frontier(roots, 1, carry=["weight", "value", "best"]).select(*NODE_COLUMNS, "best")
        return self.numbered(seed, 0)

    @staticmethod
    def numbered(rows: DataFrame, number: int) -> DataFrame:
        """With the round and a number of their own; written before anything refers to them."""
        return rows.withColumns({"round": F.lit(number), "node": F.monotonically_increasing_id()})

    def step(self, nodes: DataFrame, number: int, n_open: int) -> DataFrame:
        """One round: improvements found so far as closed rows, and the children of all nodes."""
        small = n_open <= self.few_open
        # Every node is a choice of its own. Written, as are the few rows below, since each of their readers would go through all nodes again.
        counted = nodes.groupBy(PAGE_KEY).agg(
            F.max("best").alias("before"), F.max("value").alias("value"),
            F.max_by("round", "value").alias("parent_round"), F.max_by("node", "value").alias("parent"), F.count("*").alias("n"),
        )
        counted = materialize(counted, "known")
        known = counted.groupBy(INSTANCE).agg(
            F.max("before").alias("before"), F.max("value").alias("value"),
            F.max_by("parent_round", "value").alias("parent_round"), F.max_by("parent", "value").alias("parent"),
        )
        known = known.withColumn("best", F.greatest("before", "value"))
        most = 0 if small else counted.agg(F.max("n")).first()[0]
        best = known.select(INSTANCE, "best")
        closed = self.closed(known.where("value > before").selectExpr("*", "0 as from_page", "0L as mask"))

        if self.large:
            # The first time all nodes look how far the next items take them: a good incumbent spares most of the rest.
            ends = nodes.where("page = tail") if self.dived else nodes.withColumn("tail", F.col("page"))
            self.dived = True
            if not ends.isEmpty():
                found = materialize(complete_tails(ends, self.space.pages, best), "completed")
                closed = closed.unionByName(self.closed(found))
                better = found.select(INSTANCE, F.col("value").alias("_found"))
                best = best.join(better, INSTANCE, "left").select(INSTANCE, F.greatest("best", "_found").alias("best"))
            nodes = nodes.where("tail is null or page <> tail")
            self.pages = {r.page for r in nodes.select("page").distinct().collect()} or {0}
        open_nodes = nodes.selectExpr(
            *PAGE_KEY, "depth", "weight", "value", "bound", "tail", "page as from_page", "round as parent_round", "node as parent", "0L as mask"
        )
        few = small and not self.large
        parts = self.parts(few)
        for k, (ahead, piece) in enumerate(parts):
            limit = hot_limit(n_open, max(1, self.hot_nodes >> (self.levels // 2 * k)))
            hot = None
            if most > limit:
                hot = counted.where(F.col("n") > limit).select(INSTANCE, (F.col("page") + ahead).alias("page"))
                # Nodes of hot instances are expanded where they are: dealt out to all tasks, as the children below already are.
                open_nodes = open_nodes.repartition(shuffle_tasks(open_nodes)) if k == 0 else open_nodes
            page = self.space.page(*sorted(p + ahead for p in self.pages), piece=piece)
            children = expand_frontier(open_nodes, page, best, hot, small, lead=self.dominance)
            # A complete node has beaten the best known choice: it is emitted as one.
            if k + 1 == len(parts):
                children = keep_dominant(children, few) if self.dominance else children
                closed = closed.unionByName(children.withColumn("open", ~F.col("complete")).drop("complete"))
                break
            # Written, as the rows below are read in several ways, each of which would expand all nodes anew.
            children = materialize(keep_best_of_weight(children, spread=True), "children")
            closed = closed.unionByName(children.where("complete").drop("complete").withColumn("open", F.lit(False)))
            open_nodes = children.where("not complete").drop("complete")
            # What this part has found is the cutoff in the next one.
            way = ["from_page", "parent_round", "parent", "mask"]
            within = children.groupBy(INSTANCE).agg(
                F.max("value").alias("value"), F.count("*").alias("n"), *[F.max_by(c, "value").alias(c) for c in way]
            )
            within = materialize(best.withColumnRenamed("best", "before").join(within, INSTANCE), "within")
            within = within.withColumn("best", F.greatest("before", "value"))
            closed = closed.unionByName(self.closed(within.where("value > before")))
            if few:
                # Another page in the same round only for instances that have few nodes.
                many = F.broadcast(within.where(F.col("n") > FEW_NODES).select(INSTANCE))
                closed = closed.unionByName(open_nodes.join(many, INSTANCE, "left_semi").withColumn("open", F.lit(True)))
                within = within.where(F.col("n") <= FEW_NODES)
            best = within.select(INSTANCE, "best")
            open_nodes = open_nodes.drop("best")
        self.pages = {p + ahead + 1 for p in self.pages for ahead, _ in parts}
        return self.numbered(closed, number + 1)

    def parts(self, few: bool) -> list[tuple[int, tuple[int, int] | None]]:
        """What a round decides, as (pages ahead, piece of the page): with dominance and a new cutoff between the parts.

        Several pages, if there are few nodes; else the two halves of one page.
        """
        half = self.levels // 2
        if not self.dominance or not few and not half:
            return [(0, None)]
        if few:
            return [(k, None) for k in range(self.steps)]
        return [(0, (0, half)), (0, (half, self.levels))]

    @staticmethod
    def closed(rows: DataFrame) -> DataFrame:
        """Solutions (instance, value, best and the way to them) as closed rows."""
        return rows.selectExpr(
            INSTANCE, "from_page as page", "0 as depth", "0L as weight", "value", "cast(null as bigint) as bound", "cast(null as int) as tail",
            "from_page", "parent_round", "parent", "mask", "best", "false as open",
        )

    def park(self, nodes: DataFrame, n_open: int) -> DataFrame | None:
        """Which nodes enter the next round, and which the later ones: by bound, then depth, then by lot.

        By lot, as the fullest of equally promising nodes have little room for anything better. Nodes at their tail, or in it,
        always enter: they are not expanded.
        """
        budgeted = self.round_seconds is not None
        if not budgeted:
            if n_open <= self.slab:
                return None
            if nodes.groupBy(INSTANCE).count().agg(F.max("count")).first()[0] <= self.slab:
                return None
        self.large = True
        order = [F.col("bound").desc_nulls_first(), F.col("depth").desc(), F.xxhash64("weight", "value"), F.col("round"), F.col("node")]
        tails = self.space.tails().withColumnRenamed("tail", "_tail")
        blocked = range_blocks(nodes.join(tails, INSTANCE), [INSTANCE], order, "slab", spread=True)
        cost = {"cost": F.expr(f"if(page > _tail, {EASY_SECONDS}L, {HARD_SECONDS}L)" if budgeted else "if(page >= _tail, 0L, 1L)")}
        context = block_totals(blocked, [INSTANCE], {**cost, "n": F.expr("1L")}, whole=["n"]).select(INSTANCE, "block", "cost_before", "n_whole")
        if budgeted:
            context = context.join(self.quotas(blocked), INSTANCE).withColumn("later", F.greatest(F.col("quota"), F.lit(float(self.round_seconds))))
        else:
            context = context.withColumns({"quota": F.lit(float(self.slab)), "later": F.lit(float(self.slab))})
        placed = running_totals(blocked, [INSTANCE], order, cost, context)
        if not budgeted:
            placed = placed.withColumn("tail", F.expr("if(n_whole > quota, greatest(page, _tail), tail)"))
            placed = placed.withColumn("cost_before", F.expr("if(page >= _tail, 0L, cost_before)"))
        wave = "if(cost_before < quota, 0, cast(1 + floor((cost_before - quota) / later) as int))"
        return placed.withColumn("wave", F.expr(wave))

    def revive(self, waiting: DataFrame, emitted: DataFrame) -> DataFrame:
        """Of nodes that have waited, those that can still beat the incumbent, which they learn."""
        found = emitted.groupBy(INSTANCE).agg(F.max("value").alias("_found"))
        nodes = waiting.join(found, INSTANCE, "left").withColumn("best", F.greatest("best", "_found")).drop("_found")
        return nodes.where("bound is null or bound > best")

    def quotas(self, nodes: DataFrame) -> DataFrame:
        """(instance, quota): the share of each instance in this round and what it has left from earlier ones."""
        counts = nodes.groupBy(INSTANCE).agg(F.count_if(F.expr("page > _tail")).alias("n_easy"), F.count_if(F.expr("page <= _tail")).alias("n_hard"))
        trees = materialize(counts.select(F.lit(0).cast("bigint").alias("group_id"), F.col(INSTANCE).alias("seq"), "n_easy", "n_hard"), "trees")
        shares = apportion_budget(trees, self.round_seconds).withColumnRenamed("seq", INSTANCE)
        wants = trees.selectExpr(f"seq as {INSTANCE}", f"n_easy * {EASY_SECONDS} + n_hard * {HARD_SECONDS} as wants")
        given = shares.join(wants, INSTANCE).select(INSTANCE, "share", "wants")
        if self.ledger is not None:
            given = given.join(self.ledger, INSTANCE, "left").withColumn("share", F.col("share") + F.coalesce("unspent", F.lit(0.0)))
        given = materialize(given.select(INSTANCE, F.col("share").alias("quota"), "wants"), "ledger")
        left = given.select(INSTANCE, F.greatest(F.col("quota") - F.col("wants"), F.lit(0.0)).alias("unspent"))
        if self.ledger is not None:
            left = left.unionByName(self.ledger.join(given, INSTANCE, "left_anti"))
        self.ledger = materialize(left, "ledger")
        return given.select(INSTANCE, "quota")

    def result(self, loop: Iteration, halted: bool, scratch: Scratch) -> SearchResult:
        way = ["parent_round", "parent", "from_page", "mask"]
        found = loop.emitted.select(INSTANCE, F.col("value").alias("objective"), *way)
        # A node that is open at the end may already be a better choice than any emitted one.
        late = loop.open.where(F.col("value") > F.col("best")).select(INSTANCE, F.col("value").alias("objective"), *way)
        nothing = [F.lit(None).cast(found.schema[c].dataType).alias(c) for c in way]
        none = F.lit(None).cast("array<bigint>").alias("flips")
        start = self.space.start.select(INSTANCE, "objective", *nothing, "flips", F.lit(0).alias("tie"))
        later = found.unionByName(late).select("*", none, F.lit(1).alias("tie"))
        solutions = start.unionByName(later).withColumn("status", F.lit("feasible"))
        best = materialize(merge_incumbent(solutions, INSTANCE, "max", "tie").drop("halted", "status"), "best")

        objective = F.col("objective") if self.sense == "max" else F.col("total_value") - F.col("objective")
        incumbent = self.ranked.heads.join(best.select(INSTANCE, "objective"), INSTANCE, "left").select(
            INSTANCE, F.coalesce(F.col("status"), F.lit("feasible")).alias("status"), objective.alias("objective")
        )
        open_counts = loop.open.groupBy(INSTANCE).agg(F.count("*").alias("n_open"))
        report = solution_report(incumbent, open_counts, halted)
        reason = "halted" if halted else loop.stop_reason
        return SearchResult(report, loop.history, reason, loop.rounds, loop.folder, scratch, self, best, loop.rows)

    def choices(self, best: DataFrame, nodes: DataFrame) -> DataFrame:
        """(instance_id, item_id) of the chosen items: the greedy ones, but for the flips of the best choice."""
        masks = walk_back(best.where("tie = 1"), nodes)
        flips = flipped_items(masks, self.space.pages).select(INSTANCE, "item_id")
        flips = flips.unionByName(best.where("tie = 0").select(INSTANCE, F.explode("flips").alias("item_id")))
        flips = materialize(flips.withColumn("flipped", F.lit(True)), "flips")
        solved = self.ranked.heads.join(best.select(INSTANCE), INSTANCE).select(INSTANCE, "crit_ratio", "crit_item")
        lines = self.ranked.lines(solved).join(flips, [INSTANCE, "item_id"], "left")
        taken = f"({GREEDY}) <> (flipped is not null)"
        return lines.where(taken if self.sense == "max" else f"not ({taken})").select(INSTANCE, "item_id")
