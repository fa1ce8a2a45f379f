"""Joining one row per key to a table where few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot above this many rows; fewer rows are fine in one task.
HOT_ROWS = 1_000_000
# Never more hot keys than this, whatever the size of the table.
MAX_HOT_KEYS = 10_000


def hot_keys(rows: DataFrame, key: str, n_rows: int, hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """Keys of ``rows`` that deserve a broadcast join, or None when there can be none.

    ``n_rows`` is the measured row count. At most ``n_rows / limit`` keys can exceed the
    limit, so the result never has more than ``MAX_HOT_KEYS`` rows.
    """
    limit = hot_limit(n_rows, hot_rows)
    if n_rows <= limit:
        return None
    return rows.groupBy(key).count().where(F.col("count") > limit).select(key)


def hot_limit(n_rows: int, hot_rows: int = HOT_ROWS) -> int:
    """A key of a table of ``n_rows`` is hot above so many rows."""
    return max(hot_rows, n_rows // MAX_HOT_KEYS)


def join_by_key(
    rows: DataFrame, one_per_key: DataFrame, key: str | list[str], hot: DataFrame | None, tasks: int | None = None
) -> DataFrame:
    """Inner join; the rows of hot keys stay where they are and meet a broadcast.

    With ``tasks`` the others go to so many tasks and are not joined into fewer: small rows that take long stay apart.
    The hint keeps Spark from broadcasting ``rows`` to the few tasks of the other side.
    """

    def met(df: DataFrame) -> DataFrame:
        if tasks is None:
            return df.join(one_per_key, key)
        return df.repartition(tasks, *([key] if isinstance(key, str) else key)).join(one_per_key.hint("merge"), key)

    if hot is None:
        return met(rows)
    hot = F.broadcast(hot)
    of_hot = F.broadcast(one_per_key.join(hot, key, "left_semi"))
    usual = met(rows.join(hot, key, "left_anti"))
    return rows.join(of_hot, key).unionByName(usual)
