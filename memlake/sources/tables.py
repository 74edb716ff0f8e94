"""Readers of the stored tables, and their views as the model's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def messages(spark: SparkSession, root: str) -> DataFrame:
    """Conversations as messages of threads: thread_id, position, role, text."""
    return load(spark, root, "conversations").select(F.col("conv_id").alias("thread_id"), F.col("turn").alias("position"), "role", "text")


def actions(spark: SparkSession, root: str) -> DataFrame:
    """Orders as actions: id, owner, status (O open, F done, P waiting), deadline, priority, amount."""
    return load(spark, root, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("owner"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").cast("date").alias("deadline"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_totalprice").alias("amount"),
    )


def relations(spark: SparkSession, root: str) -> DataFrame:
    """Line items as dated edges from a supplier to a part."""
    return load(spark, root, "lineitem").select(
        F.concat(F.lit("s"), "l_suppkey").alias("entity_a"),
        F.concat(F.lit("p"), "l_partkey").alias("entity_b"),
        F.col("l_shipdate").cast("date").alias("valid_from"),
        F.col("l_quantity").alias("strength"),
        F.col("l_returnflag").alias("flag"),
    )


def feedback(spark: SparkSession, root: str) -> DataFrame:
    """Events as recall feedback: doc_id (the user), event_type used or exposure, ts."""
    kind = F.when(F.col("event_type").isin("purchase", "signup"), "used").when(F.col("event_type") == "view", "exposure")
    return load(spark, root, "events").select(F.col("user_id").alias("doc_id"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("ts"), "value").where("kind is not null")
