"""The star-schema tables seen as interaction logs.

Log ``events``: the event stream, one item per event's ``k`` property, no ties within a user.
Log ``orders``: order lines by customer; dates tie and items repeat. Log ``priorities``: orders by customer, five items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nextrail.functions.text import json_text
from nextrail.operators.encode import embed_text
from nextrail.operators.skew import join_lookup


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def event_log(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("user_id"),
        F.get_json_object("props", "$.k").alias("item_id"),
        F.col("value").alias("event_value"),
        F.col("ts").alias("datetime"),
        F.col("event_type").alias("event_name"),
        (F.col("event_type") != "error").alias("label"),
    )


def order_log(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_quantity"
    )
    joined = join_lookup(lines, orders, "o_orderkey", "inner")
    return joined.select(
        F.col("o_custkey").cast("string").alias("user_id"),
        F.col("l_partkey").cast("string").alias("item_id"),
        F.col("l_quantity").alias("event_value"),
        F.col("o_orderdate").alias("datetime"),
        F.lit("purchase").alias("event_name"),
        F.lit(True).alias("label"),
    )


def priority_log(spark: SparkSession, folder: str) -> DataFrame:
    """Orders by customer, the priority as the item."""
    return table(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias("user_id"),
        F.col("o_orderpriority").alias("item_id"),
        F.col("o_totalprice").alias("event_value"),
        F.col("o_orderdate").alias("datetime"),
        F.lit("order").alias("event_name"),
        F.lit(True).alias("label"),
    )


def priority_items(spark: SparkSession, folder: str) -> DataFrame:
    seen = priority_log(spark, folder).select("item_id").distinct()
    return seen.withColumn("item_text", F.col("item_id"))


def part_items(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("item_id"),
        json_text(
            F.col("p_name").alias("title"), F.split("p_type", " ").alias("genres")
        ).alias("item_text"),
    )


def event_items(spark: SparkSession, folder: str) -> DataFrame:
    """The items that occur in the event log, with the text of the part of that number."""
    seen = event_log(spark, folder).select("item_id").distinct()
    return seen.join(part_items(spark, folder), "item_id", "left")


def customer_users(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("user_id"),
        json_text(F.col("c_mktsegment"), F.col("c_nationkey")).alias("user_text"),
    )


def event_users(spark: SparkSession, folder: str) -> DataFrame:
    seen = event_log(spark, folder).select("user_id").distinct()
    return seen.join(customer_users(spark, folder), "user_id", "left")


def item_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("string").alias("item_id"), "embedding"
    )


def event_item_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of the items that occur in the event log."""
    return event_items(spark, folder).join(item_vectors(spark, folder), "item_id")


def part_item_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of all parts, from their texts."""
    return embed_text(part_items(spark, folder), num_features=64)
