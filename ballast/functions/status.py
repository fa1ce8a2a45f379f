"""Solution status: fixed values and their precedence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
STATUSES = ("infeasible", "feasible", "optimal", "error", "unbounded")
SOLVED = ("feasible", "optimal")
HALTING = ("error", "unbounded")

SENSES = ("max", "min")


def status_rank(status: Column) -> Column:
    """2 for error and unbounded, 1 for feasible and optimal, else 0."""
    return F.when(status.isin(*HALTING), 2).when(status.isin(*SOLVED), 1).otherwise(0)


def check_sense(sense: str) -> None:
    if sense not in SENSES:
        raise ValueError(f"sense must be one of {SENSES}, not {sense!r}")


def final_status(rank: Column, found: Column, open_nodes: Column, worst: Column) -> Column:
    """Status of one instance when the search has ended.

    ``worst`` is kept where the rank says error or unbounded. Otherwise a solution is
    optimal once no open node is left, and feasible before that.
    """
    return (
        F.when(rank == 2, worst)
        .when(found & (open_nodes == 0), "optimal")
        .when(found, "feasible")
        .otherwise("infeasible")
    )
