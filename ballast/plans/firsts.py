"""The first k rows of every group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Up to this k Spark trims groups before the shuffle by itself
# (spark.sql.optimizer.windowGroupLimitThreshold).
TRIM_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"
SALTS = 256


def first_k(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """Rows that are among the first ``k`` of their group in the given order.

    For a small ``k`` every task sends at most ``k`` rows of a group to the shuffle. For a
    larger one the groups are trimmed in salted parts first, so that no task sorts a whole
    large group.
    """
    by = [F.col(c) for c in order]

    def trim(rows: DataFrame, parts: Sequence[str | Column]) -> DataFrame:
        window = Window.partitionBy(*parts).orderBy(*by)
        return rows.withColumn("_place", F.row_number().over(window)).where(F.col("_place") <= k).drop("_place")

    if k >= int(df.sparkSession.conf.get(TRIM_LIMIT, "1000")):
        df = trim(df.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(SALTS))), [*keys, "_salt"]).drop("_salt")
    return trim(df, keys)
