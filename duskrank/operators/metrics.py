"""Graded per-user AUC and the reports built on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskrank.functions.ordered import HOT_ROWS, Hot, running_totals


def user_auc(
    df: DataFrame,
    score: str = "predictions",
    target: str = "target",
    by: Sequence[str] = (),
    hot: Hot = True,
    limit: int = HOT_ROWS,
) -> DataFrame:
    """AUC per user over the grade pairs (1 vs 0) and (0 vs -1): a win counts 1, a tie 0.5.

    Computed from ranks instead of pairs. Rows with a null score win nothing but their pairs stay in
    the denominator; users without any pair are absent; NaN ranks highest and ties with itself.
    """
    keys = [*by, "user_id"]
    grade = {name: F.col(target) == value for name, value in (("_up", 1), ("_mid", 0), ("_down", -1))}
    per_score = df.groupBy(*keys, score).agg(
        *[F.count(F.when(cond, F.lit(1))).alias(name) for name, cond in grade.items()]
    )
    scored = F.col(score).isNotNull()
    per_score = per_score.withColumn("_smid", F.when(scored, F.col("_mid")).otherwise(0)).withColumn(
        "_sdown", F.when(scored, F.col("_down")).otherwise(0)
    )
    ranked = running_totals(per_score, keys, score, ["_smid", "_sdown"], hot, limit)
    wins = F.col("_up") * (F.col("_smid_before") + F.col("_smid") / 2) + F.col("_mid") * (
        F.col("_sdown_before") + F.col("_sdown") / 2
    )
    up, mid, down = F.sum("_up"), F.sum("_mid"), F.sum("_down")
    return (
        ranked.groupBy(*keys)
        .agg(
            F.coalesce(F.sum(F.when(scored, wins)), F.lit(0.0)).alias("num"),
            (up * mid + mid * down).alias("den"),
        )
        .filter(F.col("den") > 0)
        .withColumn("rocauc", F.col("num") / F.col("den"))
    )


def mean_auc(df: DataFrame, score: str = "predictions", target: str = "target", hot: Hot = True, limit: int = HOT_ROWS) -> DataFrame:
    """One row: mean of the users' AUCs and the number of users that have one."""
    return user_auc(df, score, target, hot=hot, limit=limit).agg(
        F.avg("rocauc").alias("mean_auc"), F.count(F.lit(1)).alias("n_users")
    )


def auc_report(
    df: DataFrame, scores: Sequence[str], target: str = "target", hot: Hot = True, limit: int = HOT_ROWS
) -> DataFrame:
    """Mean AUC of every score column, computed in one grouped run over the unpivoted scores."""
    long = df.select("user_id", target, *[F.col(c).cast("double").alias(c) for c in scores]).unpivot(
        ["user_id", target], list(scores), "model", "score"
    )
    return (
        user_auc(long, "score", target, by=["model"], hot=hot, limit=limit)
        .groupBy("model")
        .agg(F.avg("rocauc").alias("mean_auc"), F.count(F.lit(1)).alias("n_users"))
    )


def cold_share(scored: DataFrame, by: Sequence[str] = (), cold: str = "is_cold") -> DataFrame:
    """Share of pairs that no model vector covered."""
    return scored.groupBy(*by).agg(F.avg(F.col(cold).cast("double")).alias("cold_share"))
