"""The three jobs: split the log, train and submit, search the ranker's parameters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskrank.functions.exprs import target
from duskrank.functions.ordered import Hot, detect_hot
from duskrank.models.ranker import RankerSpec, fit_mean, predict_mean
from duskrank.models.search import sample_trials, search
from duskrank.operators import features, metrics, split, stats, vectors, weights
from duskrank.plans.fleet import FLEET, SEARCH_FLEET, FleetParams, ModelSpec, run_fleet
from duskrank.session import cut
from duskrank.sources import io
from duskrank.sources.store import ModelStore, RunLog


@dataclass(frozen=True)
class JobConfig:
    fleet: Sequence[ModelSpec] = FLEET
    params: FleetParams = field(default_factory=FleetParams)
    rankers: Sequence[RankerSpec] = (RankerSpec(rounds=50, depth=7),)
    like_weight: float = 1.0
    holdout_in_training: bool = False  # True for the final submission fit: the report is then in-sample
    positive_threshold: int = 2
    min_rows: int = 5
    min_user_rows: int = 1
    min_source_rows: int = 10
    save_features: bool = False
    extended: bool = True  # False: the smaller feature table of the search


def split_job(
    spark: SparkSession, interactions: DataFrame, path: str, test_rows: int = 20, ranker_fraction: float = 0.2
) -> dict[str, DataFrame]:
    """Write the three parts and return them as tables."""
    hot = detect_hot(interactions, ["user_id"])
    io.write_split(split.split_log(interactions, test_rows, ranker_fraction, hot=hot), path)
    return io.read_split(spark, path)


@dataclass
class Prepared:
    train: DataFrame
    test: DataFrame
    submit: DataFrame
    columns: list[str]
    score_columns: list[str]
    cold: DataFrame


def build_features(
    parts: dict[str, DataFrame],
    items: DataFrame,
    users: DataFrame,
    pairs: DataFrame,
    config: JobConfig,
    folder: str,
    store: ModelStore | None = None,
) -> Prepared:
    """Statistics, similarities, fleet scores and their assembly for the three pair sets."""
    factor, ranker, test = parts[split.FACTOR], parts[split.RANKER], parts[split.TEST]
    hot: Hot = detect_hot(factor, ["user_id"])
    if config.holdout_in_training:
        ranker = split.append_holdout(ranker, test)
    if config.extended:
        ranker, test = split.users_with_target(ranker), split.users_with_target(test)
    ranker = cut(split.latest_pairs(ranker), "ranker_pairs")
    test = cut(split.latest_pairs(test), "test_pairs")
    submit = cut(pairs.select("user_id", "item_id").distinct(), "submit_pairs")
    keys = [df.select("user_id", "item_id") for df in (ranker, test, submit)]
    all_pairs = cut(reduce(DataFrame.unionByName, keys).distinct(), "all_pairs")

    sets = {
        name: cut(df, f"set_{name}")
        for name, df in weights.training_sets(factor, items, config.like_weight, hot).items()
        if any(m.train_set == name for m in config.fleet)
    }
    scores, cold = run_fleet(config.fleet, sets, all_pairs, items, config.params, folder, store, hot)
    scores = cut(scores, "scores")

    limits = dict(positive_threshold=config.positive_threshold, min_users=config.min_rows)
    sources = factor.select("item_id").join(items.select("item_id", "source_id"), "item_id")
    item_stats = cut(
        stats.item_stats(factor, items, users, "item_id", hot=detect_hot(factor, ["item_id"]), **limits), "item_stats"
    )
    source_stats = cut(
        stats.combine_source_stats(
            stats.item_stats(factor, items, users, "source_id", hot=detect_hot(sources, ["source_id"]), **limits),
            stats.source_duration_stats(items, hot=detect_hot(items, ["source_id"])),
        ),
        "source_stats",
    )
    user_stats = cut(stats.user_stats(factor, items, config.min_user_rows, hot=hot), "user_stats")
    user_source = None
    if config.extended:
        user_source = cut(stats.user_source_stats(factor, items, config.min_source_rows), "user_source_stats")
    liked, disliked = (cut(v, "taste") for v in vectors.taste_vectors(factor, items))

    def assemble(df: DataFrame, label: str) -> DataFrame:
        wide = features.join_features(
            df,
            scores,
            item_stats,
            source_stats,
            items,
            user_stats,
            user_source,
            vectors.embedding_sims(df, items, liked, disliked),
            users,
            likelihoods=config.extended,
        )
        if "like" in df.columns:
            wide = wide.withColumn("target", target())
        if config.extended:
            wide = features.with_item_vectors(wide, items)
        return cut(wide, label)

    submit_features = assemble(submit, "features_submit")
    return Prepared(
        assemble(ranker, "features_train"),
        assemble(test, "features_test"),
        submit_features,
        features.feature_columns(submit_features),
        [m.name for m in config.fleet],
        cold,
    )


def _assembler(prepared: Prepared, config: JobConfig, items: DataFrame) -> features.FeatureAssembler:
    width = 0
    if config.extended:
        width = items.select(F.size("embeddings").alias("n")).agg(F.max("n")).first()[0] or 0
    vector = "embeddings" if config.extended else None
    return features.FeatureAssembler(prepared.columns, vector, width).fit(prepared.train)


def train_job(
    spark: SparkSession,
    parts: dict[str, DataFrame],
    items: DataFrame,
    users: DataFrame,
    pairs: DataFrame,
    folder: str,
    config: JobConfig = JobConfig(),
) -> dict[str, object]:
    """Fit everything, report the AUC of every score column, write the submission; all logged."""
    log = RunLog(spark, f"{folder}/run_log")
    log.params(**asdict(config.params), like_weight=config.like_weight, models=[m.name for m in config.fleet])
    prepared = build_features(parts, items, users, pairs, config, folder, ModelStore(f"{folder}/models"))
    if config.save_features:
        for name, df in (("train", prepared.train), ("test", prepared.test), ("test_pairs", prepared.submit)):
            log.artifact(f"features_{name}", io.write_features(df, folder, name))
    assembler = _assembler(prepared, config, items)
    log.params(
        ranker=[asdict(r) for r in config.rankers], feature_columns=prepared.columns, n_features=len(prepared.columns)
    )
    models = fit_mean(config.rankers, assembler.transform(prepared.train))
    tested = cut(
        predict_mean(models, assembler.transform(prepared.test)).select(
            "user_id", "item_id", "target", *prepared.score_columns, "prediction"
        ),
        "tested",
    )
    report = cut(metrics.auc_report(tested, [*prepared.score_columns, "prediction"]), "report")
    log.metrics_from(report, "model", "mean_auc")
    log.metrics_from(prepared.cold, "model", "cold_share", "_cold_share")
    submission = predict_mean(models, assembler.transform(prepared.submit), output="predict")
    path = io.write_submission(submission, f"{folder}/submissions")
    log.artifact("submission_path", path)
    return {"report": report, "submission": path, "log": log, "models": models, "prepared": prepared}


def search_job(
    spark: SparkSession,
    parts: dict[str, DataFrame],
    items: DataFrame,
    users: DataFrame,
    pairs: DataFrame,
    folder: str,
    config: JobConfig | None = None,
    trials: Sequence[dict] | None = None,
    parallelism: int = 1,
) -> DataFrame:
    """Build the smaller feature table once and try parameter sets on it; trials are logged."""
    if config is None:
        config = JobConfig(
            fleet=SEARCH_FLEET,
            params=replace(FleetParams(), sequence_epochs=10),
            positive_threshold=10,
            min_rows=20,
            min_user_rows=10,
            extended=False,
        )
    trials = sample_trials(100) if trials is None else trials
    log = RunLog(spark, f"{folder}/search_log")
    prepared = build_features(parts, items, users, pairs, config, folder, ModelStore(f"{folder}/models"))
    assembler = _assembler(prepared, config, items)
    train = cut(assembler.transform(prepared.train).select("user_id", "item_id", "target", "features"), "search_train")
    valid = cut(assembler.transform(prepared.test).select("user_id", "item_id", "target", "features"), "search_valid")
    out = search(
        train,
        valid,
        trials,
        config.rankers[0],
        parallelism,
        lambda row: log.metrics({f"trial_{row['trial']}": row["mean_auc"]}),
    )
    best = out.first().asDict()
    log.params(best={k: v for k, v in best.items()})
    return out
