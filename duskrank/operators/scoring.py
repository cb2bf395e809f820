"""Scoring (user, item) pairs against fitted factor tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskrank.functions.exprs import dot

# fixed values: suffixes of the four outputs of a biased model
BIASED_SUFFIXES = ("", "_with_user_and_item_bias", "_only_user_bias", "_only_item_bias")


def _with_factors(pairs: DataFrame, user_factors: DataFrame, item_factors: DataFrame) -> DataFrame:
    def side(factors: DataFrame, key: str, tag: str) -> DataFrame:
        bias = F.col("bias") if "bias" in factors.columns else F.lit(None).cast("double")
        return factors.select(
            F.col("id").alias(key), F.col("features").alias(f"_{tag}"), bias.alias(f"_{tag}_bias")
        )

    return (
        pairs.select("user_id", "item_id")
        .join(side(user_factors, "user_id", "u"), "user_id", "left")
        .join(side(item_factors, "item_id", "i"), "item_id", "left")
        .withColumn("is_cold", F.col("_u").isNull() | F.col("_i").isNull())
    )


def _cold_value(cold: float | None) -> Column:
    return F.lit(cold).cast("double")


def score_pairs(
    pairs: DataFrame,
    user_factors: DataFrame,
    item_factors: DataFrame,
    name: str = "predict",
    cold: float | None = -1.0,
) -> DataFrame:
    """Dot product where both ids are known, else ``cold``; keeps every pair and adds ``is_cold``."""
    value = F.when(~F.col("is_cold"), dot(F.col("_u"), F.col("_i"))).otherwise(_cold_value(cold))
    return _with_factors(pairs, user_factors, item_factors).select(
        "user_id", "item_id", value.alias(name), "is_cold"
    )


def score_pairs_biased(
    pairs: DataFrame,
    user_factors: DataFrame,
    item_factors: DataFrame,
    name: str = "predict",
    cold: float | None = -1.0,
) -> DataFrame:
    """Four outputs: dot, dot + both biases, user bias, item bias."""
    product = dot(F.col("_u"), F.col("_i"))
    values = (product, product + F.col("_u_bias") + F.col("_i_bias"), F.col("_u_bias"), F.col("_i_bias"))
    hot = ~F.col("is_cold")
    return _with_factors(pairs, user_factors, item_factors).select(
        "user_id",
        "item_id",
        *[
            F.when(hot, v).otherwise(_cold_value(cold)).alias(name + suffix)
            for v, suffix in zip(values, BIASED_SUFFIXES)
        ],
        "is_cold",
    )


def score_by_source(
    pairs: DataFrame,
    items: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    cold: float | None = -1.0,
) -> DataFrame:
    """Score distinct (user, source) pairs with ``score`` and hand the values down to the items.

    Pairs whose item has no source stay, as cold.
    """
    sourced = pairs.select("user_id", "item_id").join(
        items.select("item_id", "source_id"), "item_id", "left"
    )
    distinct = (
        sourced.select("user_id", F.col("source_id").alias("item_id"))
        .dropna(subset=["user_id", "item_id"])
        .dropDuplicates(["user_id", "item_id"])
    )
    scored = score(distinct).withColumnRenamed("item_id", "source_id")
    names = [c for c in scored.columns if c not in ("user_id", "source_id", "is_cold")]
    out = sourced.join(scored, ["user_id", "source_id"], "left")
    missing = F.col("is_cold").isNull()
    return out.select(
        "user_id",
        "item_id",
        *[F.when(missing, _cold_value(cold)).otherwise(F.col(c)).alias(c) for c in names],
        F.coalesce("is_cold", F.lit(True)).alias("is_cold"),
    )


def to_long(scored: DataFrame, name: str) -> DataFrame:
    """(user_id, item_id, model, score) rows of one model's output column."""
    return scored.select(
        "user_id", "item_id", F.lit(name).alias("model"), F.col(name).cast("double").alias("score")
    )


def pivot_scores(long_scores: Sequence[DataFrame] | DataFrame, models: Sequence[str]) -> DataFrame:
    """One row per pair with a column per model: a single aggregation for the whole fleet."""
    if not isinstance(long_scores, DataFrame):
        long_scores = reduce(DataFrame.unionByName, long_scores)
    return long_scores.groupBy("user_id", "item_id").agg(
        *[F.max(F.when(F.col("model") == m, F.col("score"))).alias(m) for m in models]
    )


def mean_ensemble(columns: Sequence[str], weights: Sequence[float] | None = None) -> Column:
    """Sum of w_k * score_k over the number of models (not over the sum of the weights)."""
    weights = [1.0] * len(columns) if weights is None else list(weights)
    if len(weights) != len(columns):
        raise ValueError("one weight per model is needed")
    total = reduce(lambda a, b: a + b, [F.col(c) * F.lit(float(w)) for c, w in zip(columns, weights)])
    return total / F.lit(float(len(columns)))
