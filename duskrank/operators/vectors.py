"""Mean vectors of histories and similarities of pairs to them."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskrank.functions.exprs import dot, positive_feedback
from duskrank.session import cut


def mean_vectors(df: DataFrame, key: str = "user_id", vector: str = "embeddings") -> DataFrame:
    """Element-wise mean of an array column per key, merged from partial sums on the map side."""
    return (
        df.filter(F.col(vector).isNotNull())
        .groupBy(key)
        .agg(vector_to_array(Summarizer.mean(array_to_vector(F.col(vector)))).alias(vector))
    )


def taste_vectors(factor: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mean item vector of what every user liked, and of what they disliked."""
    vectors = items.select("item_id", "embeddings")
    liked = factor.filter(positive_feedback() >= 1).select("user_id", "item_id").join(vectors, "item_id")
    disliked = factor.filter(F.col("dislike") == 1).select("user_id", "item_id").join(vectors, "item_id")
    return mean_vectors(liked), mean_vectors(disliked)


def embedding_sims(pairs: DataFrame, items: DataFrame, liked: DataFrame, disliked: DataFrame) -> DataFrame:
    """Dot product of each pair's item vector with the user's liked and disliked mean vectors.

    A user without such a vector gets the mean over all pairs; pairs of unknown items are left out.
    The products are written once, since both the means and the result read them.
    """
    products = (
        pairs.select("user_id", "item_id")
        .join(items.select("item_id", "embeddings"), "item_id")
        .join(liked.withColumnRenamed("embeddings", "_liked"), "user_id", "left")
        .join(disliked.withColumnRenamed("embeddings", "_disliked"), "user_id", "left")
        .select(
            "user_id",
            "item_id",
            dot(F.col("embeddings"), F.col("_liked")).alias("liked_embeddings_sim"),
            dot(F.col("embeddings"), F.col("_disliked")).alias("disliked_embeddings_sim"),
        )
    )
    sims = cut(products, "sims")
    columns = ["liked_embeddings_sim", "disliked_embeddings_sim"]
    # a one-row aggregate, read as a scalar subquery
    means = sims.agg(F.struct(*[F.avg(c).alias(c) for c in columns]).alias("_means")).scalar()
    return sims.withColumn("_means", means).select(
        "user_id", "item_id", *[F.coalesce(c, F.col("_means")[c]).alias(c) for c in columns]
    )
