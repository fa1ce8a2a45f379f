"""Exact budgeted choice and work levelling as Spark DataFrame jobs."""

from ballast.functions.status import STATUSES, status_rank
from ballast.operators.budget import apportion_budget
from ballast.operators.frontier import expand_frontier, prune_frontier, seed_frontier
from ballast.operators.incumbent import merge_incumbent, solution_report, write_report
from ballast.operators.iterate import Iteration, iterate_until_empty, resume
from ballast.operators.levelling import (
    assign_destinations,
    changed_counts,
    count_changes,
    levelling_plan,
    levelling_threshold,
    pending_by_slot,
    pending_pages,
    pick_to_move,
    rebalance,
    rebalance_counted,
    slot_results,
    split_moved,
)
from ballast.operators.search import SearchResult, resume_search, select_best_subset

__all__ = [
    "STATUSES",
    "Iteration",
    "SearchResult",
    "apportion_budget",
    "assign_destinations",
    "changed_counts",
    "count_changes",
    "expand_frontier",
    "iterate_until_empty",
    "levelling_plan",
    "levelling_threshold",
    "merge_incumbent",
    "pending_by_slot",
    "pending_pages",
    "pick_to_move",
    "prune_frontier",
    "rebalance",
    "rebalance_counted",
    "resume",
    "resume_search",
    "seed_frontier",
    "select_best_subset",
    "slot_results",
    "solution_report",
    "split_moved",
    "status_rank",
    "write_report",
]
