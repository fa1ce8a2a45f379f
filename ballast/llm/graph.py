"""Connected components by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.plans.scratch import materialize, release


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); label is the smallest node of its component.

    Rounds of large-star and small-star (Kiveris et al. 2014): every edge is turned towards the
    smallest neighbour, until nothing changes. The number of rounds grows with the logarithm of the size.
    Each round's edges are written to the shared folder, so that a lost executor repeats its tasks only.
    Self loops and repeated edges do no harm; nodes can be of any type that has an order.
    """
    links = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(most_rounds):
        moved = star(star(links, True), False)
        after = materialize(moved, "links")
        if same_rows(after, links):
            release(links)
            return after.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
                after.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
            )
        release(links)
        links = after
    raise RuntimeError(f"components are not settled after {most_rounds} rounds")


def star(links: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each node to the smallest of them and the node: the larger ones (large star,
    over edges in both directions), or the smaller ones and the node itself (small star)."""
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
        found = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("_m").alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("_m"))
        found = links.join(least, "a").select(F.col("b").alias("a"), F.col("_m").alias("b")).unionByName(least.select("a", F.col("_m").alias("b")))
    return found.where("a <> b").distinct()


def same_rows(x: DataFrame, y: DataFrame) -> bool:
    """Tables without repeated rows are equal if their counts and sums of row hashes are."""
    digest = lambda t: t.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return digest(x) == digest(y)
