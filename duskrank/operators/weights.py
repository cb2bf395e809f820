"""Weighted training sets (user_id, item_id, weight, datetime, pos) derived from the factor part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskrank.functions.exprs import any_reaction, watch_ratio
from duskrank.functions.ordered import HOT_ROWS, Hot, positions

# fixed value: distance between item ids and the ids of pseudo-items made from sources
SOURCE_OFFSET = 1_000_000


def _weighted(df: DataFrame, weight: Column, datetime: Column | None = None) -> DataFrame:
    when = F.lit(1) if datetime is None else datetime
    return df.select(
        "user_id",
        "item_id",
        weight.cast("double").alias("weight"),
        when.cast("long").alias("datetime"),
        "pos",
    )


def like(df: DataFrame, like_weight: float = 1.0) -> DataFrame:
    """Rows with a like or a dislike; weight = like * like_weight - dislike."""
    rows = df.filter(F.col("like") + F.col("dislike") >= 1)
    return _weighted(rows, F.col("like") * F.lit(like_weight) - F.col("dislike"))


def like_book_share(
    df: DataFrame,
    share_weight: float = 1.0,
    bookmarks_weight: float = 1.0,
    like_weight: float = 1.0,
    truncate: bool = False,
) -> DataFrame:
    """Rows with any reaction; the weighted positive sum, or -1 when there is a dislike."""
    positive = (
        F.col("like") * F.lit(like_weight)
        + F.col("share") * F.lit(share_weight)
        + F.col("bookmarks") * F.lit(bookmarks_weight)
    )
    weight = F.when(F.col("dislike") == 0, positive).otherwise(F.lit(-1.0))
    if truncate:
        weight = weight.cast("tinyint")
    return _weighted(df.filter(any_reaction() >= 1), weight)


def timespent(df: DataFrame, items: DataFrame, floor: float = 0.5, cap: float = 3.0) -> DataFrame:
    """Watched share of the item, clipped to [0, cap], where above ``floor``; datetime = rn."""
    joined = df.join(items.select("item_id", "duration"), "item_id").withColumn(
        "_ratio", watch_ratio(F.col("timespent"), F.col("duration"), cap)
    )
    return _weighted(joined.filter(F.col("_ratio") > floor), F.col("_ratio"), F.col("rn"))


def like_all(df: DataFrame) -> DataFrame:
    """Rows without dislike, share or bookmark; weight = like (0 or 1)."""
    rows = df.filter(F.col("dislike") + F.col("share") + F.col("bookmarks") == 0)
    return _weighted(rows, F.col("like"))


def log_decay(weighted: DataFrame, direction: str = "forward", hot: Hot = True, limit: int = HOT_ROWS) -> DataFrame:
    """weight / ln(k + 1), k = the row's 1-based place in the user's set.

    ``forward`` counts from the first row, so later rows weigh less; ``backward`` counts from the last.
    """
    place = {"forward": "seq", "backward": "rn"}[direction]
    return (
        positions(weighted, hot=hot, limit=limit)
        .withColumn("weight", F.col("weight") / F.log(F.col(place) + 1))
        .select(*weighted.columns)
    )


def to_sources(df: DataFrame, items: DataFrame) -> DataFrame:
    """Replace every item by its source; rows of unknown items are dropped."""
    return (
        df.join(items.select("item_id", "source_id"), "item_id")
        .drop("item_id")
        .withColumnRenamed("source_id", "item_id")
        .select(*df.columns)
    )


def source_rollup(weighted: DataFrame, items: DataFrame) -> DataFrame:
    """One row per (user, source): latest datetime and summed weight."""
    return (
        to_sources(weighted, items)
        .groupBy("user_id", "item_id")
        .agg(F.max("datetime").alias("datetime"), F.sum("weight").alias("weight"))
    )


def with_pseudo_items(weighted: DataFrame, items: DataFrame) -> DataFrame:
    """The set itself plus one pseudo-item per (user, source).

    An item id that pseudo-items could meet is an error; ``with_typed_pseudo_items`` takes any id.
    """
    pseudo = source_rollup(weighted, items).withColumn("item_id", F.col("item_id") + SOURCE_OFFSET)
    meets = F.raise_error(F.concat(F.lit("item id reaches the pseudo-items: "), F.col("item_id").cast("string"))).cast("long")
    own = weighted.withColumn("item_id", F.when(F.col("item_id") >= SOURCE_OFFSET, meets).otherwise(F.col("item_id")))
    return own.select(*pseudo.columns).unionByName(pseudo)


# kinds of a typed item key
ITEM, SOURCE = 0, 1


def with_typed_pseudo_items(weighted: DataFrame, items: DataFrame) -> DataFrame:
    """Like ``with_pseudo_items``, with ``item_id`` a (kind, id) pair, so no item can meet a pseudo-item."""

    def typed(df: DataFrame, kind: int) -> DataFrame:
        key = F.struct(F.lit(kind).alias("kind"), F.col("item_id").cast("long").alias("id"))
        return df.filter("item_id IS NOT NULL").withColumn("item_id", key)

    pseudo = typed(source_rollup(weighted, items), SOURCE)
    own = typed(weighted, ITEM)
    return own.select(*pseudo.columns).unionByName(pseudo)


def training_sets(
    factor: DataFrame, items: DataFrame, like_weight: float = 1.0, hot: Hot = True
) -> dict[str, DataFrame]:
    """The six sets the first-stage models are fitted on."""
    base = like(factor, like_weight)
    wide = like_book_share(factor, like_weight=like_weight)
    return {
        "like": base,
        "like_time_weighted": log_decay(base, hot=hot),
        "like_book_share": wide,
        "like_book_share_time_weighted": log_decay(wide, hot=hot),
        "timespent": timespent(factor, items),
        "like_all": like_all(factor),
    }
