"""Queries over the benchmark tables: one per operator, each reading its whole inputs."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duskrank.functions.exprs import target
from duskrank.functions.ordered import Hot, detect_hot, mode_rows, nearest_quantiles
from duskrank.models import ease, ranker, search, sequence
from duskrank.operators import features, metrics, scoring, split, stats, vectors, weights
from duskrank.plans import fleet
from duskrank.session import cut, scratch_root
from duskrank.sources import fixtures, io, store

Query = Callable[[SparkSession, str], DataFrame]

# length of the test tables' vectors
VECTOR_SIZE = 64


class Inputs:
    """Logical tables and the parts of the split, built from one folder of Parquet files.

    ``stored`` writes the split once, as the split job does, for queries that read it many times.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, stored: bool = False):
        self.stored = stored
        self.spark, self.sf_dir = spark, sf_dir
        self.interactions = fixtures.interactions(spark, sf_dir)
        self.items = fixtures.items(spark, sf_dir)
        self.users = fixtures.users(spark, sf_dir)

    @cached_property
    def hot_users(self) -> Hot:
        """Users with very many rows; one look at the raw log serves all its parts."""
        return detect_hot(self.interactions, ["user_id"])

    @cached_property
    def hot_items(self) -> Hot:
        return detect_hot(self.interactions, ["item_id"])

    @cached_property
    def hot_sources(self) -> Hot:
        sources = self.interactions.select("item_id").join(self.items.select("item_id", "source_id"), "item_id")
        return detect_hot(sources, ["source_id"])

    @cached_property
    def parts(self) -> DataFrame:
        parts = split.split_log(self.interactions, hot=self.hot_users)
        return cut(parts, "split", "split") if self.stored else parts

    def part(self, name: str) -> DataFrame:
        return split.part_of(self.parts, name)

    @cached_property
    def factor(self) -> DataFrame:
        return self.part(split.FACTOR)

    @cached_property
    def ranker(self) -> DataFrame:
        return self.part(split.RANKER)

    @cached_property
    def test(self) -> DataFrame:
        if self.stored:
            return self.part(split.TEST)
        return split.last_n_holdout(self.interactions, hot=self.hot_users)

    @cached_property
    def test_pairs(self) -> DataFrame:
        return self.test.select("user_id", "item_id").distinct()

    @cached_property
    def like(self) -> DataFrame:
        return weights.like(self.factor)

    def item_stats(self) -> DataFrame:
        return stats.item_stats(self.factor, self.items, self.users, hot=self.hot_items)

    def source_stats(self) -> DataFrame:
        return stats.item_stats(
            self.factor,
            self.items,
            self.users,
            column="source_id",
            positive_threshold=2,
            min_users=5,
            hot=self.hot_sources,
        )

    def combined_source_stats(self) -> DataFrame:
        return stats.combine_source_stats(self.source_stats(), stats.source_duration_stats(self.items))

    def user_stats(self) -> DataFrame:
        return stats.user_stats(self.factor, self.items, hot=self.hot_users)

    def user_source_stats(self) -> DataFrame:
        return stats.user_source_stats(self.factor, self.items, min_interactions=3)

    def sims(self, pairs: DataFrame) -> DataFrame:
        liked, disliked = vectors.taste_vectors(self.factor, self.items)
        return vectors.embedding_sims(pairs, self.items, liked, disliked)

    def statistics(self) -> dict[str, DataFrame]:
        return {
            "item_stats": self.item_stats(),
            "source_stats": self.combined_source_stats(),
            "user_stats": self.user_stats(),
            "user_source_stats": self.user_source_stats(),
        }

    def feature_table(self, pairs: DataFrame, statistics: dict[str, DataFrame] | None = None) -> DataFrame:
        return features.join_features(
            pairs,
            None,
            items=self.items,
            sims=self.sims(pairs),
            users=self.users,
            **(statistics or self.statistics()),
        )

    def popularity_scores(self) -> DataFrame:
        """Holdout rows scored by the user's like rate times the item's like rate in the factor part."""
        by_user = self.factor.groupBy("user_id").agg(F.avg("like").alias("_user_rate"))
        by_item = self.factor.groupBy("item_id").agg(F.avg("like").alias("_item_rate"))
        return (
            self.test.select("user_id", "item_id", "timespent", target())
            .join(by_user, "user_id", "left")
            .join(by_item, "item_id", "left")
            .withColumn("predictions", F.col("_user_rate") * F.col("_item_rate"))
        )

    def known_ids(self, table: str, key: str) -> DataFrame:
        """Factor table whose ids are the ``key`` values of a table that also have a stored vector."""
        ids = self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet").select(F.col(key).alias("id")).distinct()
        return ids.join(
            self.items.select(F.col("item_id").alias("id"), F.col("embeddings").alias("features")), "id"
        )

    def fixed_sides(self) -> tuple[DataFrame, DataFrame]:
        return self.known_ids("supplier", "s_suppkey"), self.known_ids("part", "p_partkey")

    def fixed_factor_scores(self) -> DataFrame:
        """Interactions scored against stored vectors; users that are no supplier are cold."""
        pairs = self.interactions.select("user_id", "item_id").distinct()
        return scoring.score_pairs(pairs, *self.fixed_sides())


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits, so that summation order does not show.

    The shift keeps exact half-way values (means of two-decimal numbers) off the rounding boundary.
    """
    return df.select(
        *[
            F.round(F.col(f.name) + F.lit(3e-10), digits).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f.name)
            for f in df.schema
        ]
    )


def _query(build: Callable[[Inputs], DataFrame], stored: bool = False) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(build(Inputs(spark, sf_dir, stored)))

    return run


def _score_pivot(i: Inputs) -> DataFrame:
    per_pair = i.interactions.groupBy("user_id", "item_id").agg(
        F.count(F.lit(1)).cast("double").alias("n_rows"),
        F.avg("timespent").alias("mean_time"),
        F.sum("like").cast("double").alias("likes"),
    )
    names = ["n_rows", "mean_time", "likes"]
    return scoring.pivot_scores([scoring.to_long(per_pair, n) for n in names], names)


def _mean_ensemble(i: Inputs) -> DataFrame:
    ensemble = scoring.mean_ensemble(["n_rows", "mean_time", "likes"], [1.0, 0.5, 2.0])
    return _score_pivot(i).select("user_id", "item_id", ensemble.alias("prediction"))


def _auc_report(i: Inputs) -> DataFrame:
    rows = i.popularity_scores().withColumn("neg_time", -F.col("timespent"))
    return metrics.auc_report(rows, ["predictions", "timespent", "neg_time"], hot=i.hot_users)


def _user_mean_vector(i: Inputs) -> DataFrame:
    liked, _ = vectors.taste_vectors(i.factor, i.items)
    return liked.select("user_id", F.posexplode("embeddings").alias("dim", "value"))


def _mode_ties(i: Inputs) -> DataFrame:
    return mode_rows(i.interactions, "user_id", "item_id", {"modes": None}).drop("name")


def _user_stats(i: Inputs) -> DataFrame:
    """Mode lists as text, so that both engines compare them alike."""
    return _modes_as_text(i.user_stats())


def _modes_as_text(df: DataFrame) -> DataFrame:
    for c in ("user_source_id_mode", "user_liked_source_id_mode"):
        df = df.withColumn(c, F.array_join(F.col(c).cast("array<string>"), ","))
    return df


def _timespent_auc(i: Inputs) -> DataFrame:
    return metrics.user_auc(i.interactions.select("user_id", "timespent", target()), "timespent", hot=i.hot_users)


def _fixed_biased(i: Inputs) -> DataFrame:
    """The four outputs of a biased model, with biases made from the ids."""
    users, items = i.fixed_sides()
    pairs = i.interactions.select("user_id", "item_id").distinct()
    return scoring.score_pairs_biased(
        pairs,
        users.withColumn("bias", F.col("id") / 100.0),
        items.withColumn("bias", -F.col("id") / 10.0),
        cold=None,
    )


def _fixed_source(i: Inputs) -> DataFrame:
    """Source wrapper: distinct (user, source) pairs are scored and handed down to the items."""
    users, items = i.fixed_sides()
    pairs = i.interactions.select("user_id", "item_id").distinct()
    return scoring.score_by_source(pairs, i.items, lambda p: scoring.score_pairs(p, users, items))


def _fixed_sequence(i: Inputs) -> DataFrame:
    """Sequence scoring with the stored vectors: mean history vector times candidate vector."""
    model = {"items": i.items.select(F.col("item_id").alias("id"), F.col("embeddings").alias("features"))}
    return sequence.score_sequence(i.test_pairs, i.like, model)


def _sentences(i: Inputs) -> DataFrame:
    """The chunks of the histories as text."""
    return sequence.sentences(i.like, i.hot_users).select("user_id", "chunk", F.array_join("items", " ").alias("sentence"))


RELATIONAL: dict[str, Callable[[Inputs], DataFrame]] = {
    "split_positions": lambda i: split.with_reverse_position(i.interactions, hot=i.hot_users),
    "split_holdout": lambda i: i.test,
    "split_train": lambda i: split.without_pairs(split.with_reverse_position(i.interactions, hot=i.hot_users), i.test),
    "split_tail_ratio": lambda i: split.tail_ratio(
        split.without_pairs(split.with_reverse_position(i.interactions, hot=i.hot_users), i.test), hot=i.hot_users
    ),
    "split_tail_cb": lambda i: i.ranker,
    "split_tail_als": lambda i: i.factor,
    "append_holdout": lambda i: split.append_holdout(i.ranker, i.test),
    "users_with_target": lambda i: split.users_with_target(i.ranker),
    "latest_pairs": lambda i: split.latest_pairs(i.interactions),
    "top_items": lambda i: split.keep_frequent_items(i.like, 50),
    "w_like": lambda i: weights.like(i.factor, like_weight=2.0),
    "w_like_book_share": lambda i: weights.like_book_share(i.factor, 0.5, 2.0, 1.0),
    "w_timespent": lambda i: weights.timespent(i.factor, i.items),
    "w_like_all": lambda i: weights.like_all(i.factor),
    "w_log_decay": lambda i: weights.log_decay(i.like, hot=i.hot_users),
    "source_rekey": lambda i: weights.to_sources(i.like, i.items),
    "source_rollup": lambda i: weights.source_rollup(i.like, i.items),
    "pseudo_items": lambda i: weights.with_pseudo_items(i.like, i.items),
    "target": lambda i: i.interactions.select("user_id", "item_id", "pos", target()),
    "item_stats": lambda i: i.item_stats(),
    "source_stats": lambda i: i.source_stats(),
    "source_duration_stats": lambda i: stats.source_duration_stats(i.items),
    "source_stats_combined": lambda i: i.combined_source_stats(),
    "user2source_stats": lambda i: i.user_source_stats(),
    "user_stats": _user_stats,
    "nearest_quantiles": lambda i: nearest_quantiles(i.interactions, ["item_id"], {"timespent": stats.DECILES}, hot=i.hot_items),
    "mode_ties": _mode_ties,
    "user_mean_vector": _user_mean_vector,
    "embedding_sims": lambda i: i.sims(i.test_pairs),
    "feature_table": lambda i: i.feature_table(split.latest_pairs(i.test)),
    "score_pivot": _score_pivot,
    "mean_ensemble": _mean_ensemble,
    "cold_fill": lambda i: i.fixed_factor_scores(),
    "cold_share": lambda i: metrics.cold_share(i.fixed_factor_scores()),
    "biased_fill": _fixed_biased,
    "source_fill": _fixed_source,
    "sequence_fill": _fixed_sequence,
    "sequence_sentences": _sentences,
    "sequence_pairs": lambda i: sequence.context_pairs(i.like, hot=i.hot_users).select(
        F.col("user_id").alias("centre"), F.col("item_id").alias("context"), "weight"
    ),
    "ease_gram": lambda i: ease.gram_table(i.like),
    "user_auc": _timespent_auc,
    "mean_auc": lambda i: metrics.mean_auc(i.popularity_scores(), hot=i.hot_users),
    "auc_report": _auc_report,
}


# queries that read the split more than once
_STORED = {
    "users_with_target",
    "item_stats",
    "source_stats",
    "source_stats_combined",
    "user_stats",
    "embedding_sims",
    "feature_table",
    "sequence_fill",
    "mean_auc",
    "auc_report",
}


def relational_queries() -> dict[str, Query]:
    return {name: _query(build, name in _STORED) for name, build in RELATIONAL.items()}


# Fitted models: small sizes, whole tables. SQL cannot express the fits; tests check them against numpy.
_SMALL = fleet.FleetParams(
    als_iterations=5,
    als_factors=8,
    pairwise_factors=8,
    pairwise_epochs=5,
    ease_regularization=500.0,
    sequence_factors=8,
    sequence_epochs=2,
    svd_factors=8,
    blocks=4,
    cell_rows=1 << 14,
)


def _scored_by(name: str) -> Callable[[Inputs], DataFrame]:
    """Fit the fleet's model ``name`` on its set and score the holdout pairs."""
    spec = next(m for m in fleet.FLEET if m.name == name)

    def build(i: Inputs) -> DataFrame:
        train = cut(weights.training_sets(i.factor, i.items, hot=i.hot_users)[spec.train_set], "set")
        model = fleet.fit_model(spec, train, i.items, _SMALL, hot=i.hot_users)
        return fleet.score_model(spec, model, i.test_pairs, train, i.items)

    return build


def _cold_flags(i: Inputs) -> DataFrame:
    """Which holdout pairs the fitted tables of four kinds of model know: (model, user_id, item_id, is_cold)."""
    train, out = cut(i.like, "set"), []
    for name in ("predict_als_item_like", "predict_svd_like", "predict_lfm_item_like", "predict_lfm_source_add_like"):
        spec = next(m for m in fleet.FLEET if m.name == name)
        model = fleet.fit_model(spec, train, i.items, _SMALL, hot=i.hot_users)
        scored = fleet.score_model(spec, model, i.test_pairs, train, i.items)
        out.append(scored.select(F.lit(name).alias("model"), "user_id", "item_id", "is_cold"))
    return reduce(DataFrame.unionByName, out)


def _side_features(i: Inputs) -> fleet.SideFeatures:
    """Gender and age of users, source of items, parity of sources."""
    whole = i.users.select("user_id", F.col("gender").cast("int").alias("gender"), F.col("age").cast("int").alias("age"))
    sources = i.items.select("source_id", (F.col("source_id") % 2).alias("parity"))
    return fleet.SideFeatures(
        features.categorical_values(whole, "user_id", ["gender", "age"]),
        features.categorical_values(i.items, "item_id", ["source_id"]),
        features.categorical_values(sources, "source_id", ["parity"]),
    )


def _side_values(i: Inputs) -> DataFrame:
    side = _side_features(i)
    tables = {"user": side.users, "item": side.items, "source": side.sources}
    return reduce(DataFrame.unionByName, [df.withColumn("side", F.lit(name)) for name, df in tables.items()])


def _side_flags(i: Inputs) -> DataFrame:
    """Which holdout pairs the pairwise models know with side features: (model, user_id, item_id, is_cold)."""
    train, side, out = cut(i.like, "set"), _side_features(i), []
    for name in ("predict_lfm_item_like", "predict_lfm_source_like"):
        spec = next(m for m in fleet.FLEET if m.name == name)
        model = fleet.fit_model(spec, train, i.items, _SMALL, hot=i.hot_users, side=side)
        scored = fleet.score_model(spec, model, i.test_pairs, train, i.items)
        out.append(scored.select(F.lit(name).alias("model"), "user_id", "item_id", "is_cold"))
    return reduce(DataFrame.unionByName, out)


def _ranker_gradients(i: Inputs) -> DataFrame:
    """Gradients of the ranker's rows in the first round, and in the second with scores made from the ids."""
    rows = split.latest_pairs(i.ranker).select("user_id", "item_id", target().cast("double").alias("target"))
    spec, out = ranker.RankerSpec(), []
    for draw, score in enumerate((F.lit(0.0), F.col("item_id") % 7 / 3.0)):
        state = rows.withColumn("score", score)
        graded = ranker.ranking_gradients(state, draw, spec.seed, spec.permutations, spec.decay, i.hot_users, spec.hot_rows)
        out.append(graded.select(F.lit(draw).alias("draw"), "user_id", "item_id", "target", "grad", "hess"))
    return reduce(DataFrame.unionByName, out)


def _vectors(i: Inputs) -> tuple[DataFrame, DataFrame]:
    """Assembled ranker rows: (rows of the ranker part, holdout rows)."""
    tables = {name: cut(df, name) for name, df in i.statistics().items()}
    train = i.feature_table(split.latest_pairs(i.ranker), tables).withColumn("target", target())
    held = i.feature_table(split.latest_pairs(i.test), tables).withColumn("target", target())
    train, held = cut(train, "train_features"), cut(held, "test_features")
    columns = features.feature_columns(train.drop(*features.RAW_COLUMNS))
    assembler = features.FeatureAssembler(columns).fit(train)
    keep = ["user_id", "item_id", "target", "features"]
    return (
        cut(assembler.transform(train).select(*keep), "train_vectors"),
        cut(assembler.transform(held).select(*keep), "test_vectors"),
    )


_RANKER = ranker.RankerSpec(rounds=3, depth=4)


def _predicted(spec) -> Callable[[Inputs], DataFrame]:
    def build(i: Inputs) -> DataFrame:
        train, held = _vectors(i)
        return spec.fit(train).predict(held).select("user_id", "item_id", "target", "prediction")

    return build


def _stacked(i: Inputs) -> DataFrame:
    train, held = _vectors(i)
    base = [_RANKER, ranker.ClassifierSpec("logistic", 10)]
    stack = ranker.StackSpec(base, ranker.RankerSpec(rounds=2, depth=3)).fit(train)
    return stack.predict(held, return_features=True).drop("features")


def _mean_of_rankers(i: Inputs) -> DataFrame:
    train, held = _vectors(i)
    models = ranker.fit_mean([ranker.RankerSpec(rounds=2, depth=4, seed=s) for s in (32, 42)], train)
    return ranker.predict_mean(models, held, [1.0, 0.5]).drop("features")


def _trials(i: Inputs) -> DataFrame:
    train, held = _vectors(i)
    trials = search.sample_trials(2, seed=1, rounds=(1, 3), depths=(2, 4))
    return search.search(train, held, trials)


def _user_split(i: Inputs) -> DataFrame:
    kept, held = split.split_users(i.interactions, 0.2)
    sides = kept.withColumn("side", F.lit("kept")).unionByName(held.withColumn("side", F.lit("held")))
    return sides.select("user_id", "item_id", "pos", "side")


def _run_log(i: Inputs) -> DataFrame:
    log = store.RunLog(i.spark, f"{scratch_root(i.spark)}/run_log_{uuid.uuid4().hex}", run_id="run")
    log.params(test_rows=20, ranker_fraction=0.2)
    log.metrics_from(_auc_report(i), "model", "mean_auc")
    # values are text in the log; as numbers they compare across engines
    return log.read().select("run_id", "kind", "key", F.round(F.col("value").cast("double") + 3e-10, 6).alias("value"))


def _folder(i: Inputs) -> str:
    return f"{scratch_root(i.spark)}/duskrank/{uuid.uuid4().hex}"


def _split_files(i: Inputs) -> DataFrame:
    """Written split, read back, with the holdout among the ranker's rows."""
    path = _folder(i)
    io.write_split(split.split_log(i.interactions, hot=i.hot_users), path)
    parts = io.read_split(i.spark, path, with_holdout=True)
    rows = [df.select("user_id", "item_id", "pos", F.lit(name).alias("part")) for name, df in parts.items()]
    return reduce(DataFrame.unionByName, rows)


def _pair_files(i: Inputs) -> DataFrame:
    path = _folder(i)
    i.test_pairs.write.csv(path, header=True)
    return io.read_pairs(i.spark, path)


def _submission_files(i: Inputs) -> DataFrame:
    scored = i.popularity_scores().select("user_id", "item_id", F.round("timespent", 6).alias("score"))
    path = io.write_submission(scored, _folder(i), "score")
    return i.spark.read.csv(path, header=True, schema="user_id long, item_id long, predict double")


def _feature_files(i: Inputs) -> DataFrame:
    """The holdout's feature table, written and read back."""
    return i.spark.read.parquet(io.write_features(i.feature_table(split.latest_pairs(i.test)), _folder(i), "test"))


def _search_features(i: Inputs) -> DataFrame:
    """The smaller feature table of the parameter search; mode lists as text."""
    pairs = split.latest_pairs(i.test)
    tables = {name: df for name, df in i.statistics().items() if name != "user_source_stats"}
    return _modes_as_text(
        features.join_features(pairs, None, items=i.items, sims=i.sims(pairs), users=i.users, likelihoods=False, **tables)
    )


def _feature_pool(i: Inputs) -> DataFrame:
    """What rankers are fitted on: the assembled vector of selected columns, indicators and raw item vectors.

    One row per element: how many rows, least and largest value, sum.
    """
    table = features.with_item_vectors(i.feature_table(split.latest_pairs(i.test)), i.items)
    table = cut(table, "pool")
    columns = features.feature_columns(table.drop(*features.RAW_COLUMNS))
    assembler = features.FeatureAssembler(columns, "embeddings", VECTOR_SIZE).fit(table)
    long = assembler.transform(table).select(F.posexplode(vector_to_array("features")).alias("_k", "v"))
    name = F.element_at(F.array(*map(F.lit, assembler.names)), F.col("_k") + 1)
    sums = long.groupBy("_k").agg(F.count(F.lit(1)).alias("n_rows"), F.min("v").alias("low"), F.max("v").alias("high"), F.avg("v").alias("mean"))
    return sums.select(name.alias("feature"), "n_rows", "low", "high", "mean")


def _item_vectors(i: Inputs) -> DataFrame:
    """Items read back with the length of their vectors checked."""
    path = f"{_folder(i)}/items"
    i.items.write.parquet(path)
    items = io.read_items(i.spark, path, VECTOR_SIZE)
    total = F.aggregate("embeddings", F.lit(0.0), lambda s, x: s + x)
    return items.select("item_id", F.size("embeddings").alias("n"), total.alias("total"))


def _table_files(i: Inputs) -> DataFrame:
    """Interactions, items and users through their readers' schemas; one count and sum per table."""
    tables = {}
    for name, df, read in (
        ("interactions", i.interactions, io.read_interactions),
        ("items", i.items, io.read_items),
        ("users", i.users, io.read_users),
    ):
        path = f"{_folder(i)}/{name}"
        df.write.parquet(path)
        tables[name] = read(i.spark, path)
    sums = {"interactions": F.sum("pos"), "items": F.sum("source_id"), "users": F.sum("user_id")}
    rows = [
        df.agg(F.count(F.lit(1)).alias("n_rows"), sums[name].cast("long").alias("total")).withColumn("name", F.lit(name))
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def _cached(i: Inputs) -> DataFrame:
    """A cached function's first and second answer; the second comes from the cache."""
    calls = []

    def popular(log: DataFrame) -> DataFrame:
        calls.append(log)
        return log.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.sum("like").alias("likes"))

    cached = store.cached_table(_folder(i), popular)
    first = cached(i.interactions).withColumn("answer", F.lit(1))
    second = cached(i.interactions).withColumn("answer", F.lit(2))
    return first.unionByName(second).withColumn("computed", F.lit(len(calls)))


def _stored_model(i: Inputs) -> DataFrame:
    """Tables of a model that is fitted once and then read from the store."""
    models, fits = store.ModelStore(_folder(i)), []

    def fit() -> dict[str, DataFrame]:
        fits.append(1)
        sums = i.like.groupBy(F.col("item_id").alias("id")).agg(F.sum("weight").alias("weight"))
        return {"items": sums, "users": i.like.select(F.col("user_id").alias("id")).distinct()}

    for _ in range(2):
        model = models.fit("sums", {"scale": 1}, i.like, fit)
    items = model["items"].select(F.lit("items").alias("side"), "id", "weight")
    users = model["users"].select(F.lit("users").alias("side"), "id", F.lit(None).cast("double").alias("weight"))
    return items.unionByName(users).withColumn("fits", F.lit(len(fits)))


MODELS: dict[str, Callable[[Inputs], DataFrame]] = {
    "als_scores": _scored_by("predict_als_item_like"),
    "als_source_scores": _scored_by("predict_als_source_like"),
    "sequence_scores": _scored_by("w2v_predict_like"),
    "sequence_source_scores": _scored_by("w2v_predict_like_source"),
    "svd_scores": _scored_by("predict_svd_like"),
    "ease_scores": _scored_by("predict_ease_like"),
    "ease_source_scores": _scored_by("predict_ease_source_like"),
    "bpr_scores": _scored_by("predict_lfm_item_like"),
    "warp_scores": _scored_by("predict_lfm_item_like_warp"),
    "pairwise_source": _scored_by("predict_lfm_source_like"),
    "pairwise_pseudo": _scored_by("predict_lfm_source_add_like"),
    "pairwise_time_weighted": _scored_by("predict_lfm_item_like_time_weighted"),
    "als_timespent_scores": _scored_by("predict_als_item_timespent"),
    "ranker_scores": _predicted(_RANKER),
    "classifier_scores": _predicted(ranker.ClassifierSpec("gbt", 3, 3)),
    "stacked_scores": _stacked,
    "ranker_mean_scores": _mean_of_rankers,
    "search_trials": _trials,
    "fingerprint": lambda i: store.fingerprint(i.interactions),
    "user_split": _user_split,
    "run_log": _run_log,
    "cold_flags": _cold_flags,
    "side_values": _side_values,
    "side_feature_flags": _side_flags,
    "ranker_gradients": _ranker_gradients,
    "split_files": _split_files,
    "pair_files": _pair_files,
    "submission_files": _submission_files,
    "feature_files": _feature_files,
    "search_feature_table": _search_features,
    "feature_pool": _feature_pool,
    "item_vectors": _item_vectors,
    "table_files": _table_files,
    "output_cache": _cached,
    "model_cache": _stored_model,
}


def queries() -> dict[str, Query]:
    return {**relational_queries(), **{name: _query(build, True) for name, build in MODELS.items()}}
