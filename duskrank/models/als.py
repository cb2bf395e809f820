"""Implicit-feedback alternating least squares on Spark MLlib."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskrank.functions.ordered import dense_index
from duskrank.session import cut, use_checkpoints


class Indexed(NamedTuple):
    entries: DataFrame  # u, i, weight
    users: DataFrame  # user_id, u
    items: DataFrame  # item_id, i
    n_entries: int


def indexed(train: DataFrame) -> Indexed:
    """Sparse matrix of the set: duplicate (user, item) weights summed, ids numbered densely.

    Both indexes are written once: they are used again after the fit to restore the ids.
    """
    sums = (
        train.dropna(subset=["user_id", "item_id"])
        .groupBy("user_id", "item_id")
        .agg(F.sum("weight").alias("weight"))
    )
    sums = cut(sums, "weights")
    users = cut(dense_index(sums, "user_id", "u"), "users")
    items = cut(dense_index(sums, "item_id", "i"), "items")
    entries = sums.join(users, "user_id").join(items, "item_id").select("u", "i", "weight")
    return Indexed(entries, users, items, sums.count())


def fit_als(
    train: DataFrame,
    iterations: int = 10,
    alpha: float = 10.0,
    regularization: float = 0.01,
    n_factors: int = 64,
    seed: int = 42,
    blocks: int | None = None,
) -> dict[str, DataFrame]:
    """Factor tables ``users`` and ``items`` (id, features). A negative weight is a sure dislike."""
    use_checkpoints(train.sparkSession)
    entries, users, items, _ = indexed(train)
    als = ALS(
        rank=n_factors,
        maxIter=iterations,
        regParam=regularization,
        alpha=alpha,
        implicitPrefs=True,
        userCol="u",
        itemCol="i",
        ratingCol="weight",
        seed=seed,
        checkpointInterval=10,
    )
    if blocks is not None:
        als = als.setNumBlocks(blocks)
    model = als.fit(entries)
    return {
        "users": model.userFactors.join(users, F.col("id") == F.col("u")).select(F.col("user_id").alias("id"), "features"),
        "items": model.itemFactors.join(items, F.col("id") == F.col("i")).select(F.col("item_id").alias("id"), "features"),
    }
