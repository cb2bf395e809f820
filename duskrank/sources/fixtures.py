"""Maps the benchmark tables onto the pipeline's logical tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskrank.schemas import INTERACTIONS, ITEMS, USERS, conform


@dataclass(frozen=True)
class Tables:
    interactions: DataFrame
    items: DataFrame
    users: DataFrame


# fixed values: which event type stands for which reaction ("view" is no reaction)
REACTION_OF = {"like": "purchase", "dislike": "error", "share": "signup", "bookmarks": "click"}


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return conform(
        events.select(
            "user_id",
            F.get_json_object("props", "$.k").cast("long").alias("item_id"),
            F.col("event_id").alias("pos"),
            F.col("value").alias("timespent"),
            *[(F.col("event_type") == kind).cast("int").alias(name) for name, kind in REACTION_OF.items()],
        ),
        INTERACTIONS,
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return conform(
        vectors.select(
            F.col("vec_id").alias("item_id"),
            (F.col("vec_id") % 10).alias("source_id"),
            (F.lit(10.0) + F.col("vec_id") % 50).alias("duration"),
            F.col("embedding").alias("embeddings"),
        ),
        ITEMS,
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return conform(
        customers.select(
            F.col("c_custkey").alias("user_id"),
            (1 + F.col("c_nationkey") % 2).alias("gender"),
            (18 + F.col("c_custkey") % 60).alias("age"),
        ),
        USERS,
    )


def load(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(interactions(spark, sf_dir), items(spark, sf_dir), users(spark, sf_dir))
