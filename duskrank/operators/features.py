"""Wide (user, item) feature table for the second-stage ranker."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PolynomialExpansion
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duskrank.functions.exprs import gender_likelihood
from duskrank.operators.stats import ODD_DECILES
from duskrank.schemas import fixed_length

# fixed values: the statistics columns that the user's own age and gender are compared with
AGE_COLUMNS = ("mean_age", *[f"age_q{p}" for p in ODD_DECILES], "mean_age_positive", "mean_age_negative")
GENDER_COLUMNS = ("mean_gender", "mean_gender_positive", "mean_gender_negative")
# fixed values: columns of the log that must never become features
RAW_COLUMNS = ("like", "dislike", "share", "bookmarks", "timespent", "target", "rn", "pos", "weight", "datetime")


def suffix_shared(right: DataFrame, left_columns: Sequence[str], keys: Sequence[str], suffix: str) -> DataFrame:
    """Rename the non-key columns of ``right`` that already exist on the left."""
    clash = set(left_columns) - set(keys)
    return right.withColumnsRenamed({c: c + suffix for c in right.columns if c in clash})


def join_features(
    pairs: DataFrame,
    scores: DataFrame | None,
    item_stats: DataFrame,
    source_stats: DataFrame,
    items: DataFrame,
    user_stats: DataFrame,
    user_source_stats: DataFrame | None = None,
    sims: DataFrame | None = None,
    users: DataFrame | None = None,
    likelihoods: bool = True,
) -> DataFrame:
    """Left-join every feature family onto ``pairs``; the number of rows does not change.

    ``pairs`` has unique (user, item) rows. ``likelihoods=False`` and no ``user_source_stats`` give
    the smaller table used by the parameter search, which keeps ``source_id`` and the mode lists.
    """
    # Everything that hangs on the item is gathered on the catalogue first, everything on the user likewise,
    # so the pairs are shuffled once per key and not once per table.
    source_side = suffix_shared(source_stats, item_stats.columns, ["source_id"], "_source")
    item_side = (
        item_stats.join(items.select("item_id", "source_id"), "item_id", "full").join(source_side, "source_id", "left")
    )
    user_side = user_stats if users is None else user_stats.join(users, "user_id", "full")
    # A family travels as one struct: rows as wide as the table make generated code too long to be compiled.
    df, names, packed = pairs, pairs.columns, {}
    for k, (right, keys, suffix) in enumerate((
        (scores, ["user_id", "item_id"], ""),
        (sims, ["user_id", "item_id"], ""),
        (item_side, ["item_id"], "_item"),
        (user_source_stats, ["user_id", "source_id"], "_user2source_feature"),
        (user_side, ["user_id"], ""),
    )):
        if right is not None:
            right = suffix_shared(right, names, keys, suffix)
            own = [c for c in right.columns if c not in keys]
            names = [*keys, *[c for c in names if c not in keys], *own]
            inside = [c for c in own if c != "source_id"]  # a key of a later join
            packed |= {c: F.col(f"_family{k}")[c].alias(c) for c in inside}
            plain = [c for c in right.columns if c not in inside]
            df = df.join(right.select(*plain, F.struct(*inside).alias(f"_family{k}")), keys, "left")
    df = df.select(*[packed.get(c, c) for c in names])

    derived: dict[str, Column] = {}
    if users is not None:
        for own, columns in (("age", AGE_COLUMNS), ("gender", GENDER_COLUMNS)):
            for c in [base + s for s in ("", "_source") for base in columns]:
                derived[f"{c}_diff"] = F.col(own) - F.col(c)
                derived[f"{c}_diff_abs"] = F.abs(F.col(own) - F.col(c))
    rate = F.col("user_like_perc") * F.col("mean_like")
    derived["user2item_like_perc"] = rate
    if not likelihoods:
        return df.withColumns(derived)
    if users is not None:
        item_side = gender_likelihood(F.col("mean_gender"), F.col("gender"))
        derived["gender_distr"] = item_side
        derived["gender_source_distr"] = gender_likelihood(F.col("mean_gender_source"), F.col("gender"))
        derived["user2item_like_perc_gender"] = rate * item_side
    for name, modes in (
        ("is_user_source_id_mode", "user_source_id_mode"),
        ("is_liked_source_id_mode", "user_liked_source_id_mode"),
    ):
        derived[name] = F.array_contains(F.col(modes), F.col("source_id"))
    return df.withColumns(derived).drop("source_id", "user_source_id_mode", "user_liked_source_id_mode")


def feature_columns(pairs_features: DataFrame) -> list[str]:
    """Scalar features of the submission pairs' table; raw reactions must not be among them."""
    columns = [
        f.name
        for f in pairs_features.schema
        if f.name not in ("user_id", "item_id", "source_id") and not isinstance(f.dataType, T.ArrayType)
    ]
    leaked = sorted(set(columns) & set(RAW_COLUMNS))
    if leaked:
        raise ValueError(f"raw columns among the features: {leaked}")
    return columns


def categorical_values(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """The columns as a long table (id, feature, value) of text values; nulls are left out, repeats count once."""
    values = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns])
    long = df.select(F.col(key).alias("id"), F.explode(values).alias("_v")).select("id", "_v.feature", "_v.value")
    return long.dropna().distinct()


def with_item_vectors(df: DataFrame, items: DataFrame) -> DataFrame:
    """Attach the raw item vector, used as a block of features."""
    return df.join(items.select("item_id", "embeddings"), "item_id", "left")


class FeatureAssembler:
    """Turns the feature table into one vector column.

    A null becomes a value just below the column's observed minimum and, for columns that held nulls
    while fitting, an indicator is added; so trees can tell missing from small. The fitted state is
    one number per column.
    """

    def __init__(self, columns: Sequence[str], vector: str | None = None, width: int = 0, degree: int = 1):
        self.columns, self.vector, self.width, self.degree = list(columns), vector, width, degree
        self.fill: dict[str, float] = {}
        self.flagged: list[str] = []

    @staticmethod
    def _value(name: str):
        value = F.col(name).cast("double")
        return F.when(~F.isnan(value), value)

    @property
    def names(self) -> list[str]:
        """The vector's elements by name (of a fitted assembler of degree 1)."""
        block = [f"{self.vector}_{k}" for k in range(self.width)] if self.vector is not None else []
        return [*self.columns, *[f"{c}_missing" for c in self.flagged], *block]

    def fit(self, df: DataFrame) -> "FeatureAssembler":
        row = df.agg(
            *[F.min(self._value(c)).alias(f"m{i}") for i, c in enumerate(self.columns)],
            *[F.count(self._value(c)).alias(f"n{i}") for i, c in enumerate(self.columns)],
            F.count(F.lit(1)).alias("rows"),
        ).first()
        for i, c in enumerate(self.columns):
            low = row[f"m{i}"]
            self.fill[c] = -1.0 if low is None else float(low) - 1.0
            if row[f"n{i}"] < row["rows"]:
                self.flagged.append(c)
        return self

    def transform(self, df: DataFrame, output: str = "features") -> DataFrame:
        values = [F.coalesce(self._value(c), F.lit(self.fill[c])) for c in self.columns]
        values += [self._value(c).isNull().cast("double") for c in self.flagged]
        array = F.array(*values)
        if self.vector is not None:
            zeros = F.array_repeat(F.lit(0.0), self.width)
            vector = fixed_length(F.col(self.vector).cast("array<double>"), self.width, self.vector)
            array = F.concat(array, F.coalesce(vector, zeros))
        if self.degree == 1:
            return df.withColumn(output, array_to_vector(array))
        plain = df.withColumn("_plain", array_to_vector(array))
        expand = PolynomialExpansion(degree=self.degree, inputCol="_plain", outputCol=output)
        return expand.transform(plain).drop("_plain")
