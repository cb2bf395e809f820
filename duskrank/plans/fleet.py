"""The first-stage model fleet: what is fitted on which training set, and how pairs are scored."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskrank.functions.ordered import Hot
from duskrank.models import als, ease, pairwise, sequence, svd
from duskrank.models.blocks import ROWS_PER_CELL
from duskrank.operators import metrics, scoring, split, weights
from duskrank.sources.store import ModelStore, fingerprint_value, hash_dict, read_if_complete


@dataclass(frozen=True)
class ModelSpec:
    name: str  # output column
    kind: str  # als, pairwise, ease, svd, sequence
    train_set: str
    scope: str = "item"  # item, source, or pseudo (items plus pseudo-items made from sources)
    loss: str = "bpr"
    cold: float | None = None

    @property
    def outputs(self) -> tuple[str, ...]:
        if self.kind == "pairwise":
            return tuple(self.name + s for s in scoring.BIASED_SUFFIXES)
        return (self.name,)


@dataclass(frozen=True)
class FleetParams:
    # fixed values: sizes and strengths the reported runs used
    als_iterations: int = 49
    als_alpha: float = 44.0
    als_regularization: float = 0.07702668794141683
    als_factors: int = 128
    pairwise_factors: int = 128
    pairwise_epochs: int = 50
    ease_items: int = 35_000
    ease_sources: int = 5_000
    ease_regularization: float = 2000.0
    sequence_factors: int = 128
    sequence_epochs: int = 30
    sequence_min_count: int = 5
    svd_factors: int = 128
    # factor blocks of the ALS fits, entries per cell of the others: part of the fit, not of the session
    blocks: int = 64
    cell_rows: int = ROWS_PER_CELL
    seed: int = 42


# fixed values in the following lists: the output column names, which set each model is fitted on, its loss
def _reaction_models(s: str) -> list[ModelSpec]:
    """The eleven models fitted on a reaction set (``like`` or ``like_book_share``)."""
    return [
        ModelSpec(f"predict_als_item_{s}", "als", s),
        ModelSpec(f"predict_als_source_{s}", "als", s, "source"),
        ModelSpec(f"predict_lfm_item_{s}", "pairwise", s),
        ModelSpec(f"predict_lfm_item_{s}_warp", "pairwise", s, loss="warp"),
        ModelSpec(f"predict_lfm_source_{s}", "pairwise", s, "source"),
        ModelSpec(f"predict_lfm_source_{s}_warp", "pairwise", s, "source", "warp"),
        ModelSpec(f"predict_lfm_source_add_{s}", "pairwise", s, "pseudo"),
        ModelSpec(f"predict_lfm_source_add_{s}_warp", "pairwise", s, "pseudo", "warp"),
        ModelSpec(f"predict_ease_{s}", "ease", s),
        ModelSpec(f"predict_ease_source_{s}", "ease", s, "source"),
        ModelSpec(f"predict_svd_{s}", "svd", s),
    ]


def _time_weighted_models(s: str, svd_name: str) -> list[ModelSpec]:
    t = f"{s}_time_weighted"
    return [
        ModelSpec(f"predict_als_item_{t}", "als", t),
        ModelSpec(f"predict_lfm_item_{t}", "pairwise", t),
        ModelSpec(f"predict_lfm_item_{s}_warp_time_weighted", "pairwise", t, loss="warp"),
        ModelSpec(svd_name, "svd", t),
    ]


FLEET: tuple[ModelSpec, ...] = (
    ModelSpec("w2v_predict_like_source", "sequence", "like", "source", cold=-1.0),
    ModelSpec("w2v_predict_like", "sequence", "like", cold=-1.0),
    *_reaction_models("like"),
    *_reaction_models("like_book_share"),
    ModelSpec("w2v_predict_like_book_share", "sequence", "like_book_share", cold=-1.0),
    ModelSpec("predict_lfm_item_like_all", "pairwise", "like_all"),
    ModelSpec("predict_als_item_timespent", "als", "timespent"),
    ModelSpec("predict_lfm_item_timespent", "pairwise", "timespent"),
    ModelSpec("w2v_predict_timespent", "sequence", "timespent", cold=-1.0),
    *_time_weighted_models("like_book_share", "predict_svd_like_book_share_warp_time_weighted"),
    *_time_weighted_models("like", "predict_svd_like_time_weighted"),
)

# the smaller fleet of the parameter search; unknown pairs keep the models' default there
SEARCH_FLEET: tuple[ModelSpec, ...] = tuple(
    ModelSpec(m.name, m.kind, m.train_set, m.scope, m.loss, cold=-1.0)
    for m in FLEET
    if m.kind in ("als", "pairwise") and m.scope != "pseudo" and m.train_set in ("like", "like_book_share", "timespent")
)


def scoped(df: DataFrame, spec: ModelSpec, items: DataFrame) -> DataFrame:
    """The training set (or history) in the model's own id space."""
    if spec.scope == "pseudo":
        return weights.with_typed_pseudo_items(df, items)
    if spec.scope == "source":
        return weights.source_rollup(df, items) if spec.kind == "ease" else weights.to_sources(df, items)
    return df


@dataclass(frozen=True)
class SideFeatures:
    """Categorical values (id, feature, value) of users, items and sources for the pairwise models."""

    users: DataFrame | None = None
    items: DataFrame | None = None
    sources: DataFrame | None = None

    def of_items(self, scope: str) -> DataFrame | None:
        """The values in the id space of the scope's items."""
        if scope == "source":
            return self.sources
        if scope == "item":
            return self.items
        typed = [
            df.withColumn("id", F.struct(F.lit(kind).alias("kind"), F.col("id").cast("long").alias("id")))
            for df, kind in ((self.items, weights.ITEM), (self.sources, weights.SOURCE))
            if df is not None
        ]
        return reduce(DataFrame.unionByName, typed) if typed else None


def fit_model(
    spec: ModelSpec,
    train: DataFrame,
    items: DataFrame,
    p: FleetParams,
    store: ModelStore | None = None,
    hot: Hot = True,
    content: str | None = None,
    side: SideFeatures | None = None,
) -> dict[str, DataFrame]:
    """Fitted tables of one model, from the store when the same fit was done before.

    ``content`` is the fingerprint of what the model is fitted on, if it is known already. Only the pairwise
    models use side features.
    """
    own = scoped(train, spec, items)
    if spec.kind == "ease":
        # the fleet's definition, not the fit's: the model knows the most frequent items or sources only
        own = split.keep_frequent_items(own, p.ease_sources if spec.scope == "source" else p.ease_items)
    params: dict[str, Any] = {
        "als": dict(iterations=p.als_iterations, alpha=p.als_alpha, regularization=p.als_regularization, n_factors=p.als_factors, seed=p.seed, blocks=p.blocks),
        "pairwise": dict(n_factors=p.pairwise_factors, epochs=p.pairwise_epochs, loss=spec.loss, seed=p.seed, rows_per_cell=p.cell_rows),
        "ease": dict(regularization=p.ease_regularization),
        "svd": dict(n_factors=p.svd_factors, seed=p.seed, rows_per_cell=p.cell_rows),
        "sequence": dict(n_factors=p.sequence_factors, epochs=p.sequence_epochs, min_count=p.sequence_min_count, seed=p.seed, rows_per_cell=p.cell_rows),
    }[spec.kind]
    given = {}
    if spec.kind == "pairwise" and side is not None:
        found = {"user_features": side.users, "item_features": side.of_items(spec.scope)}
        given = {name: df for name, df in found.items() if df is not None}
    fit = {
        "als": als.fit_als,
        "pairwise": lambda df, **kw: pairwise.fit_pairwise(df, **kw, **given),
        "ease": ease.fit_ease,
        "svd": svd.fit_svd,
        "sequence": lambda df, **kw: sequence.fit_sequence(df, hot=hot, **kw),
    }[spec.kind]
    if store is None:
        model = fit(own, **params)
    else:
        caps = {"items": p.ease_items, "sources": p.ease_sources} if spec.kind == "ease" else {}
        named = {**params, **caps, "scope": spec.scope, **{name: fingerprint_value(df) for name, df in given.items()}}
        model = store.fit(spec.kind, named, own, lambda: fit(own, **params), content=content)
    if spec.scope == "pseudo":
        # pairs hold items only: their vectors get the plain ids back, those of pseudo-items are not needed
        known = model["items"].filter(F.col("id.kind") == weights.ITEM)
        model = {**model, "items": known.withColumn("id", F.col("id.id"))}
    return model


def score_model(
    spec: ModelSpec, model: Mapping[str, DataFrame], pairs: DataFrame, history: DataFrame, items: DataFrame
) -> DataFrame:
    """(user_id, item_id, outputs..., is_cold) for every pair."""
    own_history = scoped(history, spec, items) if spec.kind in ("ease", "sequence") else history

    def score(p: DataFrame) -> DataFrame:
        if spec.kind == "pairwise":
            return scoring.score_pairs_biased(p, model["users"], model["items"], spec.name, spec.cold)
        if spec.kind == "ease":
            return ease.score_ease(p, own_history, dict(model), spec.name, spec.cold)
        if spec.kind == "sequence":
            return sequence.score_sequence(p, own_history, dict(model), spec.name, spec.cold)
        return scoring.score_pairs(p, model["users"], model["items"], spec.name, spec.cold)

    if spec.scope == "source":
        return scoring.score_by_source(pairs, items, score, spec.cold)
    return score(pairs)


def run_fleet(
    fleet: Sequence[ModelSpec],
    sets: Mapping[str, DataFrame],
    pairs: DataFrame,
    items: DataFrame,
    params: FleetParams,
    folder: str,
    store: ModelStore | None = None,
    hot: Hot = True,
) -> tuple[DataFrame, DataFrame]:
    """Fit and score every model; returns (scores with a column per output, cold share per model).

    ``pairs`` holds the distinct pairs of all sets to be scored: a pair's score does not depend on the
    set it is in, so each model scores once. The long scores of every model are written as they are
    made and pivoted together at the end. Their folders are named after the contents of the sets, items and
    pairs and after the parameters, so a rerun goes on where the last one stopped.
    """
    spark = pairs.sparkSession
    # every table is fingerprinted once, however many models use it
    prints = {name: fingerprint_value(sets[name]) for name in sorted({spec.train_set for spec in fleet})}
    on_items, on_pairs = fingerprint_value(items), fingerprint_value(pairs)
    paths = []
    for spec in fleet:
        content = hash_dict({"train": prints[spec.train_set], "items": on_items})
        key = hash_dict({**asdict(params), **asdict(spec), "content": content, "pairs": on_pairs})
        paths.append(f"{folder}/scores/{spec.name}-{key[:16]}")
        if read_if_complete(spark, paths[-1]) is not None:
            continue
        model = fit_model(spec, sets[spec.train_set], items, params, store, hot, content)
        scored = score_model(spec, model, pairs, sets[spec.train_set], items)
        scored.unpivot(["user_id", "item_id", "is_cold"], list(spec.outputs), "model", "score").write.mode(
            "overwrite"
        ).parquet(paths[-1])
    long = spark.read.parquet(*paths)
    names = [name for spec in fleet for name in spec.outputs]
    cold = metrics.cold_share(long.filter(F.col("model").isin([s.name for s in fleet])), ["model"])
    return scoring.pivot_scores(long, names), cold
