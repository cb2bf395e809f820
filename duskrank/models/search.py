"""Random search over the ranker's parameters, judged by the mean per-user AUC of held-out users."""

from __future__ import annotations

import random
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from duskrank.models.ranker import RankerSpec
from duskrank.operators.metrics import mean_auc

# fixed values: the searched ranges
ROUNDS, DEPTHS, BINS, L2 = (400, 1500), (5, 7), (32, 64, 96), (0.001, 0.5)
TRIALS = T.StructType(
    [
        T.StructField("trial", T.IntegerType()),
        T.StructField("rounds", T.IntegerType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("bins", T.IntegerType()),
        T.StructField("l2", T.DoubleType()),
        T.StructField("mean_auc", T.DoubleType()),
    ]
)


def sample_trials(
    n: int, seed: int = 0, rounds: Sequence[int] = ROUNDS, depths: Sequence[int] = DEPTHS
) -> list[dict[str, float]]:
    rng = random.Random(seed)
    return [
        {
            "rounds": rng.randint(*rounds),
            "depth": rng.randint(*depths),
            "bins": rng.choice(BINS),
            "l2": rng.uniform(*L2),
        }
        for _ in range(n)
    ]


def search(
    train: DataFrame,
    valid: DataFrame,
    trials: Sequence[Mapping[str, float]],
    base: RankerSpec = RankerSpec(),
    parallelism: int = 1,
    on_trial: Callable[[dict], None] | None = None,
) -> DataFrame:
    """One row per trial, best first. Trials are independent jobs, a few at a time."""
    spark = train.sparkSession

    def run(numbered: tuple[int, Mapping[str, float]]) -> tuple:
        k, p = numbered
        model = replace(base, **p).fit(train)
        score = mean_auc(model.predict(valid, "prediction"), "prediction").first()["mean_auc"]
        row = {"trial": k, **p, "mean_auc": score}
        if on_trial is not None:
            on_trial(row)
        return tuple(row[f.name] for f in TRIALS)

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        rows = list(pool.map(run, enumerate(trials)))
    rows.sort(key=lambda r: (r[-1] is None, -(r[-1] or 0.0)))
    return spark.createDataFrame(rows, TRIALS)
