"""Readers and writers of the pipeline's tables."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskrank.operators.split import FACTOR, RANKER, TEST, append_holdout, part_of
from duskrank.schemas import INTERACTIONS, ITEMS, PAIRS, USERS, conform, fixed_length


def read_interactions(spark: SparkSession, path: str) -> DataFrame:
    return conform(spark.read.parquet(path), INTERACTIONS)


def read_items(spark: SparkSession, path: str, vector_size: int | None = None) -> DataFrame:
    """With ``vector_size``, a vector of another length stops the job that reads it."""
    items = conform(spark.read.parquet(path), ITEMS)
    if vector_size is None:
        return items
    return items.withColumn("embeddings", fixed_length(F.col("embeddings"), vector_size, "embeddings"))


def read_users(spark: SparkSession, path: str) -> DataFrame:
    return conform(spark.read.parquet(path), USERS)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header and the columns user_id, item_id."""
    return spark.read.schema(PAIRS).csv(path, header=True, enforceSchema=False)


def write_split(split: DataFrame, path: str) -> None:
    """One pass over the log: the three parts become partitions of one table."""
    split.write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, with_holdout: bool = False) -> dict[str, DataFrame]:
    """Parts by name. ``with_holdout`` appends the test rows to the ranker's training rows."""
    table = spark.read.parquet(path)
    parts = {name: part_of(table, name) for name in (FACTOR, RANKER, TEST)}
    if with_holdout:
        parts[RANKER] = append_holdout(parts[RANKER], parts[TEST])
    return parts


def write_features(df: DataFrame, folder: str, name: str) -> str:
    path = f"{folder}/ranker_dataset_{name}.parquet"
    df.write.mode("overwrite").parquet(path)
    return path


def write_submission(df: DataFrame, folder: str, score: str = "predict", now: float | None = None) -> str:
    """CSV parts with user_id, item_id, predict in a folder named after the time."""
    stamp = int(time.time() if now is None else now)
    path = f"{folder}/{stamp}_submission.csv"
    df.select("user_id", "item_id", F.col(score).alias("predict")).write.csv(path, header=True)
    return path
