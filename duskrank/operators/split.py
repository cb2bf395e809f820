"""Time-ordered splitting of the interaction log and user sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskrank.functions.exprs import any_reaction
from duskrank.functions.ordered import HOT_ROWS, Hot, positions

TEST, RANKER, FACTOR = "test", "cb", "als"
_SEQ = ("seq", "n_rows")


def with_reverse_position(interactions: DataFrame, hot: Hot = True, limit: int = HOT_ROWS) -> DataFrame:
    """``rn``: 1 for the user's last row, counting back in ``pos`` order."""
    return positions(interactions, hot=hot, limit=limit).drop(*_SEQ)


def last_n_holdout(interactions: DataFrame, n: int = 20, hot: Hot = True, limit: int = HOT_ROWS) -> DataFrame:
    """The last ``n`` rows of every user that has more than ``n``."""
    return (
        positions(interactions, hot=hot, limit=limit)
        .filter((F.col("n_rows") > n) & (F.col("rn") <= n))
        .drop(*_SEQ)
    )


def without_pairs(df: DataFrame, held_out: DataFrame) -> DataFrame:
    """Rows whose (user, item) never occurs in ``held_out``, earlier repeats included."""
    return df.join(held_out.select("user_id", "item_id").distinct(), ["user_id", "item_id"], "left_anti")


def tail_ratio(train: DataFrame, hot: Hot = True, limit: int = HOT_ROWS) -> DataFrame:
    """``rn_ratio``: reverse position within the remaining history over its length."""
    place = positions(train.drop("rn"), hot=hot, limit=limit)
    kept = train.select("user_id", "pos", "rn") if "rn" in train.columns else None
    place = place.withColumn("rn_ratio", F.col("rn") / F.col("n_rows")).drop(*_SEQ, "rn")
    return place if kept is None else place.join(kept, ["user_id", "pos"])


def split_log(
    interactions: DataFrame, n: int = 20, ranker_fraction: float = 0.2, hot: Hot = True, limit: int = HOT_ROWS
) -> DataFrame:
    """All three parts in one frame, told apart by the column ``split``.

    ``test`` is the holdout; of the remaining rows the last ``ranker_fraction`` per user train the
    ranker (``cb``) and the rest the first-stage models (``als``).
    """
    ranked = positions(interactions, hot=hot, limit=limit)
    held = (F.col("n_rows") > n) & (F.col("rn") <= n)
    test = ranked.filter(held).drop(*_SEQ)
    train = without_pairs(ranked.drop(*_SEQ), test)
    again = positions(train.withColumnRenamed("rn", "_rn"), hot=hot, limit=limit)
    part = F.when(F.col("rn") / F.col("n_rows") < ranker_fraction, RANKER).otherwise(FACTOR)
    rest = again.withColumn("split", part).drop("rn", *_SEQ).withColumnRenamed("_rn", "rn")
    return rest.unionByName(test.withColumn("split", F.lit(TEST)))


def part_of(split: DataFrame, name: str) -> DataFrame:
    return split.filter(F.col("split") == name).drop("split")


def append_holdout(ranker: DataFrame, test: DataFrame) -> DataFrame:
    """Ranker training rows plus the holdout with ``rn`` = 1 (for the final submission fit only)."""
    return ranker.unionByName(test.withColumn("rn", F.lit(1).cast(ranker.schema["rn"].dataType)))


def users_with_target(df: DataFrame) -> DataFrame:
    """Rows of the users that reacted at least once in ``df``."""
    active = df.groupBy("user_id").agg(F.sum(any_reaction()).alias("_n")).filter("_n > 0")
    return df.join(active.select("user_id"), "user_id", "left_semi")


def user_fold(seed: int, column: str = "user_id"):
    """Pseudo-random value in [0, 10000) that depends only on the user and the seed."""
    named = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(column).cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(named, 1, 8), 16, 10).cast("long") % 10000


def split_users(df: DataFrame, held_fraction: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """User-disjoint random split: (kept rows, held rows); every user falls on one side."""
    held = user_fold(seed) < int(round(held_fraction * 10000))
    return df.filter(~held), df.filter(held)


def keep_frequent_items(df: DataFrame, max_items: int) -> DataFrame:
    """Rows of the ``max_items`` most frequent items; ties are broken by the larger item id."""
    vocabulary = (
        df.groupBy("item_id")
        .agg(F.count(F.lit(1)).alias("_n"))
        .orderBy(F.desc("_n"), F.desc("item_id"))
        .limit(max_items)
        .select("item_id")
    )
    return df.join(vocabulary, "item_id", "left_semi")


def latest_pairs(df: DataFrame) -> DataFrame:
    """One row per (user, item): the one with the largest ``pos``."""
    others = [c for c in df.columns if c not in ("user_id", "item_id")]
    return (
        df.groupBy("user_id", "item_id")
        .agg(F.max_by(F.struct(*others), "pos").alias("_row"))
        .select("user_id", "item_id", "_row.*")
    )
