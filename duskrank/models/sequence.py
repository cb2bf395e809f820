"""Item embeddings learned from the order of users' histories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskrank.functions.ordered import HOT_ROWS, Hot, positions
from duskrank.models.blocks import ROWS_PER_CELL
from duskrank.models.pairwise import fit_pairwise
from duskrank.operators.scoring import score_pairs
from duskrank.operators.vectors import mean_vectors
from duskrank.session import cut

# items per row of the histories as text
SENTENCE = 1000


def sentences(train: DataFrame, hot: Hot = True, limit: int = HOT_ROWS) -> DataFrame:
    """Histories in ``pos`` order as rows (user_id, chunk, items): the chunk-th SENTENCE places of a history.

    The chunks of a user, one after another, are the whole history; the cut keeps a very long one from becoming one
    array. The fit takes histories whole, from ``context_pairs``.
    """
    placed = positions(train.select("user_id", "item_id", "pos"), hot=hot, limit=limit)
    chunk = F.floor((F.col("seq") - 1) / SENTENCE)
    return (
        placed.filter(F.col("item_id").isNotNull())
        .groupBy("user_id", chunk.alias("chunk"))
        .agg(F.array_sort(F.collect_list(F.struct("seq", "item_id"))).alias("_rows"))
        .select("user_id", "chunk", F.transform("_rows", lambda r: r["item_id"].cast("string")).alias("items"))
    )


def context_pairs(
    train: DataFrame, window: int = 5, min_count: int = 5, hot: Hot = True, limit: int = HOT_ROWS
) -> DataFrame:
    """(user_id: centre item, item_id: context item, weight: how often) within ``window`` places of a history.

    Items rarer than ``min_count`` are taken out of the histories first. Neighbours meet by user and
    place, so a very long history spreads over as many keys as it has rows.
    """
    rows = train.select("user_id", "item_id", "pos").dropna(subset=["user_id", "item_id"])
    frequent = rows.groupBy("item_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_count)
    placed = positions(rows.join(frequent.select("item_id"), "item_id", "left_semi"), hot=hot, limit=limit)
    placed = cut(placed.select("user_id", "item_id", "seq"), "places")
    ahead = placed.withColumn("_k", F.explode(F.array(*map(F.lit, range(1, window + 1)))))
    ahead = ahead.select("user_id", F.col("item_id").alias("a"), (F.col("seq") + F.col("_k")).alias("seq"))
    met = ahead.join(placed.withColumnRenamed("item_id", "b"), ["user_id", "seq"])
    counts = met.groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    both = counts.unionByName(counts.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    return both.groupBy(F.col("a").alias("user_id"), F.col("b").alias("item_id")).agg(F.sum("weight").alias("weight"))


def fit_sequence(
    train: DataFrame,
    n_factors: int = 128,
    epochs: int = 10,
    min_count: int = 5,
    window: int = 5,
    seed: int = 42,
    rows_per_cell: int = ROWS_PER_CELL,
    hot: Hot = True,
) -> dict[str, DataFrame]:
    """Skip-gram vectors per item (id, features); rarer items than ``min_count`` get none.

    The counted context pairs are the entries of a sparse matrix, fitted in cells of a bounded number of
    pairs with negatives drawn by count^0.75: neither the vectors nor the vocabulary pass through the driver.
    """
    pairs = context_pairs(train, window, min_count, hot)
    model = fit_pairwise(pairs, n_factors, epochs, "skipgram", seed, rows_per_cell=rows_per_cell)
    return {"items": model["users"].select("id", "features")}


def user_vectors(history: DataFrame, item_vectors: DataFrame) -> DataFrame:
    """Mean vector of a user's history (items without a vector are skipped)."""
    rows = history.select("user_id", F.col("item_id").alias("id")).join(item_vectors, "id")
    return mean_vectors(rows, "user_id", "features").withColumnRenamed("user_id", "id")


def score_sequence(
    pairs: DataFrame,
    history: DataFrame,
    model: dict[str, DataFrame],
    name: str = "predict",
    cold: float | None = -1.0,
) -> DataFrame:
    return score_pairs(pairs, user_vectors(history, model["items"]), model["items"], name, cold)
