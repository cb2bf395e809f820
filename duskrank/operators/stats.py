"""Item, source, user and user-by-source statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duskrank.functions.exprs import mean_where, positive_feedback, sum_where, target, watch_ratio
from duskrank.functions.ordered import HOT_ROWS, Hot, nearest_quantiles, positions, tied_modes
from duskrank.schemas import SIGNALS

ODD_DECILES = (10, 30, 50, 70, 90)
DECILES = tuple(range(10, 100, 10))


def item_stats(
    interactions: DataFrame,
    items: DataFrame,
    users: DataFrame,
    column: str = "item_id",
    positive_threshold: int = 10,
    ratio_default: float = 1.0,
    min_users: int = 20,
    max_ratio: float = 5.0,
    exact: bool = True,
    hot: Hot = True,
    limit: int = HOT_ROWS,
) -> DataFrame:
    """Reaction, watch-ratio and audience statistics per item (or per source).

    ``n_users`` counts rows, not distinct users. With few positives the like/dislike ratio falls back
    to ``ratio_default`` and the positive gender mean and negative age mean are hidden.
    """
    rows = (
        interactions.select("user_id", "item_id", "timespent", *SIGNALS)
        .join(items.select("item_id", "source_id", "duration"), "item_id", "left")
        .join(users.select("user_id", "gender", "age"), "user_id", "left")
        .withColumn("timespent_ratio", watch_ratio(F.col("timespent"), F.col("duration"), max_ratio))
        .withColumn("positive_feedback", positive_feedback())
    )
    liked, disliked = F.col("positive_feedback") >= 1, F.col("dislike") >= 1
    reactions = []
    for s in SIGNALS:
        reactions += [F.avg(s).alias(f"mean_{s}"), F.sum(s).alias(f"sum_{s}")]
    split_means = []
    for c in ("timespent_ratio", "gender", "age"):
        split_means += [
            F.avg(c).alias(f"mean_{c}"),
            mean_where(liked, F.col(c)).alias(f"mean_{c}_positive"),
            mean_where(disliked, F.col(c)).alias(f"mean_{c}_negative"),
        ]
    means = (
        rows.groupBy(column)
        .agg(
            F.count("user_id").alias("n_users"),
            *reactions,
            *split_means,
            F.sum("positive_feedback").alias("sum_positive"),
        )
        .filter(F.col("n_users") >= min_users)
    )
    quantiles = nearest_quantiles(
        rows, [column], {"timespent_ratio": ODD_DECILES, "age": ODD_DECILES}, exact, hot, limit
    ).withColumnRenamed(column, "_key")
    enough = F.col("sum_positive") >= positive_threshold
    balance = F.try_divide(
        F.col("sum_positive") - F.col("sum_dislike"), F.col("sum_positive") + F.col("sum_dislike")
    )
    return (
        means.join(quantiles, F.col(column).eqNullSafe(F.col("_key")), "left")
        .drop("_key")
        .withColumn("like_dislike_ratio", F.coalesce(F.when(enough, balance), F.lit(ratio_default)))
        .withColumn("mean_gender_positive", F.when(enough, F.col("mean_gender_positive")))
        .withColumn("mean_age_negative", F.when(enough, F.col("mean_age_negative")))
    )


def source_duration_stats(items: DataFrame, exact: bool = True, hot: Hot = True, limit: int = HOT_ROWS) -> DataFrame:
    """Mean, deciles and number of items of every source's durations."""
    means = items.groupBy("source_id").agg(
        F.avg("duration").alias("duration_mean"), F.count("item_id").alias("n_items")
    )
    quantiles = nearest_quantiles(items, ["source_id"], {"duration": DECILES}, exact, hot, limit)
    quantiles = quantiles.withColumnRenamed("source_id", "_key")
    return means.join(quantiles, F.col("source_id").eqNullSafe(F.col("_key")), "left").drop("_key")


def combine_source_stats(stats: DataFrame, durations: DataFrame) -> DataFrame:
    """Full join with one ``source_id``: sources known only to one side are kept."""
    return stats.join(durations, "source_id", "full")


def user_source_stats(interactions: DataFrame, items: DataFrame, min_interactions: int = 10) -> DataFrame:
    """Per (user, source) reaction rates and the source's share of the user's interactions."""
    prefix = "user2source_"
    catalogue = items.select("item_id", "source_id", "duration", F.lit(True).alias("_known"))
    rows = (
        interactions.select("user_id", "item_id", "timespent", *SIGNALS)
        .join(catalogue, "item_id", "left")
        .withColumn("_ratio", watch_ratio(F.col("timespent"), F.col("duration")))
        .withColumn("target", target())
    )
    signals = (*SIGNALS, "target")
    grouped = rows.groupBy("user_id", "source_id", "_known").agg(
        F.count(F.lit(1)).alias("n_interactions"),
        F.avg((positive_feedback() > 0).cast("double")).alias("source_acceptance"),
        F.avg(F.col("dislike").cast("double")).alias("source_disacceptance"),
        F.avg("_ratio").alias("mean_source_timespent_ratio"),
        F.avg("timespent").alias(f"{prefix}avg_timespent"),
        F.avg("_ratio").alias(f"{prefix}avg_timespent_ratio"),
        *[F.avg(s).alias(f"{prefix}avg_{s}") for s in signals],
        *[F.sum(s).alias(f"{prefix}sum_{s}") for s in signals],
        F.count("source_id").alias(f"{prefix}source_interactions"),
    )
    # already one row per (user, source): the window sees at most as many rows as there are sources
    total = F.sum("n_interactions").over(Window.partitionBy("user_id"))
    return (
        grouped.withColumn("n_total_interactions", total)
        .filter(F.col("_known") & (F.col("n_interactions") >= min_interactions))
        .withColumn("source_perc", F.col("n_interactions") / F.col("n_total_interactions"))
        .drop("n_interactions", "_known")
    )


def user_stats(
    interactions: DataFrame,
    items: DataFrame,
    min_items: int = 10,
    max_ratio: float = 5.0,
    exact: bool = True,
    hot: Hot = True,
    limit: int = HOT_ROWS,
) -> DataFrame:
    """Totals, watch times, recent reactions and favourite sources per user, prefixed ``user_``."""
    rows = (
        positions(interactions.select("user_id", "item_id", "pos", "timespent", *SIGNALS), hot=hot, limit=limit)
        .join(items.select("item_id", "source_id", "duration"), "item_id", "left")
        .withColumn("timespent_ratio", watch_ratio(F.col("timespent"), F.col("duration"), max_ratio))
    )
    liked, disliked = F.col("like") == 1, F.col("dislike") == 1
    # fixed values: output names of the totals and of the trailing-window counts
    total_names = {"like": "total_likes", "dislike": "total_dislikes", "share": "total_share", "bookmarks": "total_bookmarks"}
    recent_names = {"like": "n_likes", "dislike": "n_dislikes", "share": "n_shares", "bookmarks": "n_bookmarks"}
    share_names = {"like": "like_perc", "dislike": "dislike_perc", "share": "share_perc", "bookmarks": "bookmarks_perc"}
    watch = []
    for c in ("timespent", "timespent_ratio"):
        watch += [
            F.avg(c).alias(f"avg_{c}"),
            mean_where(liked, F.col(c)).alias(f"avg_{c}_like"),
            mean_where(disliked, F.col(c)).alias(f"avg_{c}_dislike"),
        ]
    means = (
        rows.groupBy("user_id")
        .agg(
            *[F.sum(s).alias(name) for s, name in total_names.items()],
            F.sum("timespent").alias("total_timespent"),
            *watch,
            F.count(F.lit(1)).alias("total_interactions"),
            *[
                sum_where(F.col("rn") <= k, F.col(s)).alias(f"{name}_last_{k}")
                for s, name in recent_names.items()
                for k in (10, 20, 100)
            ],
        )
        .filter(F.col("total_interactions") >= min_items)
    )
    for s, name in share_names.items():
        means = means.withColumn(name, F.col(total_names[s]) / F.col("total_interactions"))
    sourced = interactions.select("user_id", "item_id", "like").join(
        items.select("item_id", "source_id"), "item_id", "left"
    )
    out = (
        means.join(nearest_quantiles(interactions, ["user_id"], {"timespent": ODD_DECILES}, exact, hot, limit), "user_id", "left")
        .join(
            tied_modes(sourced, "user_id", "source_id", {"source_id_mode": None, "liked_source_id_mode": liked}),
            "user_id",
            "left",
        )
    )
    return out.withColumnsRenamed({c: f"user_{c}" for c in out.columns if c != "user_id"})
