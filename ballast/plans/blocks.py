"""Ordered work inside groups of any size.

A plain ``Window.partitionBy(key)`` puts a whole key into one task. Here rows are
range-partitioned by (key, order) instead and stamped with the number of their range,
the *block*. A large key spans many blocks and a block holds many small keys, so

* totals per (key, block) are a small table: at most one row per key plus one per block,
* running totals over that table give each block its offset,
* the remaining work inside one (key, block) never exceeds one range partition.

(key, block) also serves as join key whenever one row per key has to be brought to all
rows of that key: the small side is repeated per block, the large side is never skewed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballast.plans.scratch import materialize

BLOCK = "block"


def range_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[Column], label: str, spread: bool = False) -> DataFrame:
    """Stamp every row with its block. Written out, so that block numbers stay fixed.

    The number of ranges is left to ``spark.sql.shuffle.partitions`` and to adaptive
    coalescing, which joins neighbouring ranges and so keeps the order. With ``spread`` they are
    not joined: rows that take long stay apart however little room they take.
    """
    by = [F.col(k) for k in keys] + list(order)
    rows = df.repartitionByRange(shuffle_tasks(df), *by) if spread else df.repartitionByRange(*by)
    return materialize(rows.withColumn(BLOCK, F.spark_partition_id()), label)


def shuffle_tasks(df: DataFrame) -> int:
    """The tasks that a shuffle has."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def block_totals(
    blocked: DataFrame, keys: Sequence[str], totals: Mapping[str, Column], whole: Sequence[str] = ()
) -> DataFrame:
    """One row per (keys, block): each total, and ``<name>_before`` over the earlier blocks.

    For the names in ``whole`` also ``<name>_whole``, the total of the key. The windows see
    at most one row per block for each key.
    """
    per_block = blocked.groupBy(*keys, BLOCK).agg(*[F.sum(c).alias(n) for n, c in totals.items()])
    key = Window.partitionBy(*keys)
    earlier = key.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    types = {n: per_block.schema[n].dataType for n in totals}
    return per_block.select(
        "*",
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0).cast(t)).alias(f"{n}_before") for n, t in types.items()],
        *[F.sum(n).over(key).alias(f"{n}_whole") for n in whole],
    )


def running_totals(
    blocked: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    totals: Mapping[str, Column],
    context: DataFrame | None = None,
) -> DataFrame:
    """Add ``<name>_before`` to every row: the total over the rows ahead of it in its key.

    ``context`` may hold the result of :func:`block_totals` with further columns per
    (keys, block); they are added to the rows by the same join, and rows of blocks that
    are missing from it are left out.
    """
    if context is None:
        context = block_totals(blocked, keys, totals)
        context = context.select(*keys, BLOCK, *[f"{n}_before" for n in totals])
    ahead = Window.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = blocked.select("*", *[F.sum(c).over(ahead).alias(f"_{n}_ahead") for n, c in totals.items()])
    joined = local.join(context, [*keys, BLOCK])
    for n in totals:
        before = F.when(F.col(f"_{n}_ahead").isNull(), F.col(f"{n}_before")).otherwise(
            F.col(f"{n}_before") + F.col(f"_{n}_ahead")
        )
        joined = joined.withColumn(f"{n}_before", before.cast(joined.schema[f"{n}_before"].dataType))
    return joined.drop(*[f"_{n}_ahead" for n in totals])


def running_best(blocked: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """Add ``name`` to every row: the largest ``value`` over the rows ahead of it in its key, null if there is none.

    ``value`` may be a struct; nulls are left out.
    """
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    tops = blocked.groupBy(*keys, BLOCK).agg(F.max(value).alias("_top"))
    tops = tops.select(*keys, BLOCK, F.max("_top").over(earlier).alias("_earlier"))
    ahead = Window.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = blocked.withColumn("_ahead", F.max(value).over(ahead)).join(tops, [*keys, BLOCK])
    return rows.withColumn(name, F.greatest("_ahead", "_earlier")).drop("_ahead", "_earlier")
