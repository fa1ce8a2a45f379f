"""The tables as the operators want them: items, instances, nodes, slots, trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.sources.tables import table


def cents(amount: str) -> Column:
    return F.round(F.col(amount) * 100).cast("bigint")


def order_weights(spark: SparkSession, folder: str) -> DataFrame:
    """(o_orderkey, weight): total quantity of every order, 0 for those without lines."""
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("bigint").alias("weight"))
    orders = table(spark, folder, "orders").select("o_orderkey")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").selectExpr("o_orderkey", "coalesce(weight, 0L) as weight")


def customer_items(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as items of their customer: weight is the quantity, at least 1, value the price."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", cents("o_totalprice").alias("value"))
    return orders.join(order_weights(spark, folder), "o_orderkey").select(
        F.col("o_custkey").alias("instance_id"),
        F.col("o_orderkey").alias("item_id"),
        F.greatest("weight", F.lit(1).cast("bigint")).alias("weight"),
        "value",
    )


def half_capacity(spark: SparkSession, folder: str, items: DataFrame) -> DataFrame:
    """Half of the total weight of each customer's items, 0 for customers without any."""
    half = items.groupBy("instance_id").agg(F.expr("sum(weight) div 2").alias("capacity"))
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("instance_id"))
    return customers.join(half, "instance_id", "left").selectExpr("instance_id", "coalesce(capacity, 0L) as capacity")


def brand_items(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as items of their brand: weight is the size, value the retail price."""
    return table(spark, folder, "part").select(
        F.regexp_extract("p_brand", r"(\d+)", 1).cast("bigint").alias("instance_id"),
        F.col("p_partkey").alias("item_id"),
        F.col("p_size").cast("bigint").alias("weight"),
        cents("p_retailprice").alias("value"),
    )


def fixed_capacity(items: DataFrame, capacity: int) -> DataFrame:
    return items.select("instance_id").distinct().withColumn("capacity", F.lit(capacity).cast("bigint"))


def order_solutions(spark: SparkSession, folder: str, otherwise: str = "infeasible") -> DataFrame:
    """Orders read as solutions of their customer; ``otherwise`` is the status of partial orders."""
    status = F.col("o_orderstatus")
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("key"),
        F.col("o_orderkey").alias("tie_id"),
        F.when(status == "F", "optimal").when(status == "O", "feasible").otherwise(otherwise).alias("status"),
        cents("o_totalprice").alias("objective"),
    )


def supplier_work(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, slots): all lines as open work of their supplier."""
    lines = table(spark, folder, "lineitem")
    nodes = lines.select(
        F.col("l_suppkey").alias("slot"),
        F.col("l_orderkey").cast("string").alias("tree_id"),
        F.concat_ws("-", "l_linenumber", "l_partkey", cents("l_extendedprice")).alias("node_id"),
        (F.col("l_discount") < 0.05).alias("is_easy"),
    )
    return nodes, table(spark, folder, "supplier").select(F.col("s_suppkey").alias("slot"))


def customer_work(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, slots): all orders as open work of their customer."""
    nodes = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("slot"),
        F.col("o_orderkey").cast("string").alias("tree_id"),
        F.col("o_orderkey").cast("string").alias("node_id"),
        (F.col("o_totalprice") < 100000).alias("is_easy"),
    )
    return nodes, table(spark, folder, "customer").select(F.col("c_custkey").alias("slot"))


def customer_trees(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as trees of their customer, small lines as easy nodes and large ones as hard.

    Orders without lines are trees without open nodes.
    """
    lines = (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(
            F.count_if(F.col("l_quantity") < 25).alias("n_easy"),
            F.count_if(F.col("l_quantity") >= 25).alias("n_hard"),
        )
    )
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return orders.join(lines, "o_orderkey", "left").selectExpr(
        "o_custkey as group_id", "o_orderkey as seq", "coalesce(n_easy, 0L) as n_easy", "coalesce(n_hard, 0L) as n_hard"
    )


def customer_cased_work(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, slots) as for customers, with tree ids of which two each differ in case only."""
    nodes, slots = customer_work(spark, folder)
    letter = F.when(F.col("tree_id").cast("bigint") % 2 == 0, "t").otherwise("T")
    tree = F.concat(letter, F.expr("cast(tree_id as bigint) div 2"))
    return nodes.select("slot", tree.alias("tree_id"), F.lit("0").alias("node_id"), "is_easy"), slots
