"""Best known solutions and the final report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.functions.status import check_sense, final_status, status_rank


def merge_incumbent(solutions: DataFrame, by: str | list[str], sense: str = "max", tie: str = "tie_id") -> DataFrame:
    """Best solution per key.

    ``solutions`` needs ``status``, ``objective`` and the tie column; every further column
    is carried along. Error and unbounded outrank everything, then solved ones by
    objective, then the rest; equal ones go to the lowest tie value. The outcome does not
    depend on the order of the rows. ``halted`` tells that the winner ends the search.

    One aggregation with map-side combining, so a key of any size is fine.
    """
    check_sense(sense)
    keys = [by] if isinstance(by, str) else list(by)
    rank = status_rank(F.col("status"))
    better_first = -F.col("objective") if sense == "max" else F.col("objective")
    carried = [c for c in solutions.columns if c not in keys and c != tie]
    entry = F.struct(
        (-rank).alias("_rank"),
        F.when(rank == 1, better_first).alias("_objective"),
        F.col(tie).alias(tie),
        *[F.col(c) for c in carried],
    )
    best = solutions.groupBy(*keys).agg(F.min(entry).alias("_best"))
    return best.select(
        *keys,
        *[F.col(f"_best.{c}").alias(c) for c in solutions.columns if c not in keys],
        (F.col("_best._rank") == -2).alias("halted"),
    )


def is_halted(solutions: DataFrame) -> DataFrame:
    """One row: does any solution end the whole search?"""
    return solutions.agg(F.coalesce(F.bool_or(status_rank(F.col("status")) == 2), F.lit(False)).alias("halted"))


def solution_report(incumbent: DataFrame, open_counts: DataFrame, halted: bool = False, key: str = "instance_id") -> DataFrame:
    """Final status per instance.

    ``incumbent`` has one row per instance (key, status, objective); ``open_counts`` holds
    (key, n_open) and may leave out instances without open nodes.
    """
    rank = status_rank(F.col("status"))
    n_open = F.coalesce(F.col("n_open"), F.lit(0).cast("bigint"))
    found = (rank == 1) & F.col("objective").isNotNull()
    return incumbent.join(open_counts, key, "left").select(
        key,
        final_status(rank, found, n_open, F.col("status")).alias("status"),
        F.when(found, F.col("objective")).alias("objective"),
        n_open.alias("n_open"),
        F.lit(halted).alias("halted"),
    )


def write_report(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a report or a history as Parquet."""
    report.write.mode(mode).parquet(path)
