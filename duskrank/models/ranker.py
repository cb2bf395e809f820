"""Second stage: boosted trees on a per-user ranking loss, a classifier, and stacking of both.

The ranking gradients follow the stochastic scheme of YetiRank (Gulin et al., 2011): every user's rows are
ordered by score plus logistic noise, and neighbours with different targets form the pairs. That is
linear in the rows, where all pairs of a user would be quadratic.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskrank.functions.ordered import HOT_ROWS, Hot, detect_hot, neighbours
from duskrank.models import trees
from duskrank.operators.split import split_users
from duskrank.session import cut, use_checkpoints


def noise(draw: int, permutation: int, seed: int) -> Column:
    """Logistic noise from a hash of (user, item, seed, draw, permutation)."""
    name = F.concat_ws(":", "user_id", "item_id", F.lit(seed), F.lit(draw), F.lit(permutation))
    unit = (F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)
    return F.log(unit / (1 - unit))


def ranking_gradients(
    df: DataFrame, draw: int, seed: int, permutations: int, decay: float, hot: Hot = False, limit: int = HOT_ROWS
) -> DataFrame:
    """Add ``grad`` and ``hess`` of the pair-logistic loss over noisy neighbours, summed over permutations.

    Neighbours and places are those of the user's whole list, however long it is.
    """
    orders = [f"_falling{k}" for k in range(permutations)]
    placed = df.withColumns({name: -(F.col("score") + noise(draw, k, seed)) for k, name in enumerate(orders)})
    placed = neighbours(placed, "user_id", orders, "item_id", ["score", "target"], hot, limit)
    terms = []
    for k in range(permutations):
        for side, first in ((f"_next{k}", 1), (f"_prev{k}", 2)):
            gap = f"(target - {side}.target)"
            wrong = f"(1 / (1 + exp(signum{gap} * (score - {side}.score))))"
            weight = f"(pow({decay!r}D, _place{k} - {first}) * abs{gap} * {wrong})"
            terms.append((f"coalesce({weight} * signum{gap}, 0D)", f"coalesce({weight} * (1 - {wrong}), 0D)"))
    sums = (F.expr(" + ".join(t)) for t in zip(*terms))
    return placed.withColumns(dict(zip(("grad", "hess"), sums))).select(*df.columns, "grad", "hess")


@dataclass
class FittedRanker:
    trees: list[trees.Tree]
    leaves: list[list[float]]
    features: str = "features"

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        """Adds the sum of the trees' leaf values: one pass and one expression however many trees there are."""
        return df.withColumn(output, trees.summed_leaves(self.trees, self.leaves, self.features))


def boost(
    rows: DataFrame,
    limits: Sequence[np.ndarray],
    rounds: int,
    depth: int,
    bins: int,
    rate: float,
    l2: float,
    gradients: Callable[[DataFrame, int], DataFrame],
    keys: Sequence[str],
    cut_every: int,
) -> tuple[list[trees.Tree], list[list[float]]]:
    """Trees fitted one after another to ``gradients(rows, round)`` of rows (keys, target, bins).

    Rows lie in place by the first key (for the windows of the gradients), and a round is one pass per level: the
    first pass also computes the gradients from the scores of the round before. After ``cut_every`` rounds the
    scores are written, so lost executors cost that many rounds at most.
    """
    columns = [*keys, "target", "bins", "score"]
    state = rows.withColumn("score", F.lit(0.0)).select(*columns).repartition(keys[0])
    grown, leaves, before = [], [], None
    for r in range(rounds):
        graded = gradients(state, r).persist(StorageLevel.MEMORY_AND_DISK)
        tree, value = trees.grow(graded, limits, depth, bins, l2)
        value = (rate * value).tolist()
        grown.append(tree)
        leaves.append(value)
        state = graded.select(*columns[:-1], F.expr(f"score + {tree.expression('bins', value)}").alias("score"))
        if before is not None:
            before.unpersist()
        before = graded
        if (r + 1) % cut_every == 0 and r + 1 < rounds:
            state = cut(state, "boosted").repartition(keys[0])
            before.unpersist()
            before = None
    if before is not None:
        before.unpersist()
    return grown, leaves


@dataclass(frozen=True)
class RankerSpec:
    """Boosted ranking trees; ``fit`` wants user_id, item_id, target (-1, 0, 1) and the vector column."""

    rounds: int = 50
    depth: int = 6
    rate: float = 0.1
    bins: int = 64
    l2: float = 3.0
    permutations: int = 3
    decay: float = 0.85
    seed: int = 32
    features: str = "features"
    cut_every: int = 10
    hot_rows: int = HOT_ROWS

    def binned(self, df: DataFrame) -> tuple[DataFrame, list[np.ndarray]]:
        """Rows with a byte per feature, written once, and the limits of the bins."""
        keys = ["user_id", "item_id", "target"]
        rows = df.select("user_id", "item_id", F.col("target").cast("double").alias("target"), self.features)
        limits = trees.bin_limits(rows, self.features, self.bins)
        return cut(trees.with_bins(rows, self.features, limits, keys), "binned"), limits

    def fit(self, df: DataFrame) -> FittedRanker:
        rows, limits = self.binned(df)
        hot = detect_hot(rows, ["user_id"], self.hot_rows)

        def gradients(state: DataFrame, r: int) -> DataFrame:
            return ranking_gradients(state, r, self.seed, self.permutations, self.decay, hot, self.hot_rows)

        grown, leaves = boost(
            rows, limits, self.rounds, self.depth, self.bins, self.rate, self.l2, gradients, ["user_id", "item_id"], self.cut_every
        )
        return FittedRanker(grown, leaves, self.features)


@dataclass
class FittedClassifier:
    model: FittedRanker | LogisticRegressionModel
    features: str

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        if isinstance(self.model, FittedRanker):
            return self.model.predict(df, output).withColumn(output, 1 / (1 + F.exp(-F.col(output))))
        model = self.model.copy()
        model.setPredictionCol("").setRawPredictionCol("_raw").setProbabilityCol("_probability")
        scored = model.transform(df).withColumn(output, vector_to_array("_probability")[1])
        return scored.drop("_raw", "_probability")


def logistic_gradients(df: DataFrame) -> DataFrame:
    """Add ``grad`` and ``hess`` of the logistic loss of a like (target 1 against the rest)."""
    chance = 1 / (1 + F.exp(-F.col("score")))
    return df.withColumn("_chance", chance).withColumns(
        {"grad": (F.col("target") == 1).cast("double") - F.col("_chance"), "hess": F.col("_chance") * (1 - F.col("_chance"))}
    ).drop("_chance")


@dataclass(frozen=True)
class ClassifierSpec:
    """Probability of a like (target 1 against the rest) from boosted trees or a logistic model."""

    kind: str = "gbt"
    rounds: int = 100
    depth: int = 5
    seed: int = 32
    features: str = "features"
    rate: float = 0.1
    bins: int = 64
    l2: float = 3.0
    cut_every: int = 10

    def fit(self, df: DataFrame) -> FittedClassifier:
        if self.kind == "gbt":
            shape = RankerSpec(self.rounds, self.depth, self.rate, self.bins, self.l2, features=self.features)
            rows, limits = shape.binned(df)
            grown, leaves = boost(
                rows, limits, self.rounds, self.depth, self.bins, self.rate, self.l2,
                lambda state, r: logistic_gradients(state), ["user_id", "item_id"], self.cut_every,
            )
            return FittedClassifier(FittedRanker(grown, leaves, self.features), self.features)
        if self.kind != "logistic":
            raise ValueError(f"unknown classifier {self.kind!r}")
        use_checkpoints(df.sparkSession)
        learner = LogisticRegression(maxIter=self.rounds, regParam=0.01, featuresCol=self.features, labelCol="_label")
        return FittedClassifier(learner.fit(df.withColumn("_label", (F.col("target") == 1).cast("double"))), self.features)


@dataclass
class FittedStack:
    base: list
    final: FittedRanker
    columns: list[str] = field(default_factory=list)

    def base_predictions(self, df: DataFrame) -> DataFrame:
        out = df
        for model, column in zip(self.base, self.columns):
            out = model.predict(out, column)
        return out

    def predict(self, df: DataFrame, output: str = "prediction", return_features: bool = False) -> DataFrame:
        stacked = VectorAssembler(inputCols=self.columns, outputCol="_stack").transform(self.base_predictions(df))
        out = self.final.predict(stacked, output).drop("_stack")
        return out if return_features else out.drop(*self.columns)


@dataclass(frozen=True)
class StackSpec:
    """Base models fitted on most users, a final ranker on their predictions for the held-out users."""

    base: Sequence
    final: RankerSpec
    held: float = 0.1
    seed: int = 422

    def fit(self, df: DataFrame) -> FittedStack:
        train, held = split_users(df, self.held, self.seed)
        columns = [f"col_{k}" for k in range(len(self.base))]
        stack = FittedStack([spec.fit(train) for spec in self.base], None, columns)
        predictions = cut(
            stack.base_predictions(held).select("user_id", "item_id", "target", *columns), "stack"
        )
        assembled = VectorAssembler(inputCols=columns, outputCol="_stack").transform(predictions)
        stack.final = replace(self.final, features="_stack").fit(assembled)
        return stack


def fit_mean(specs: Sequence[RankerSpec], df: DataFrame) -> list[FittedRanker]:
    """Members of a weighted-mean ensemble (see ``operators.scoring.mean_ensemble``)."""
    return [spec.fit(df) for spec in specs]


def predict_mean(
    models: Sequence[FittedRanker], df: DataFrame, weights: Sequence[float] | None = None, output: str = "prediction"
) -> DataFrame:
    from duskrank.operators.scoring import mean_ensemble

    columns = [f"_m{k}" for k in range(len(models))]
    for model, column in zip(models, columns):
        df = model.predict(df, column)
    return df.withColumn(output, mean_ensemble(columns, weights)).drop(*columns)
