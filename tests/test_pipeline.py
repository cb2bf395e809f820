"""The three jobs end to end on a small fleet."""

import pytest
from pyspark.sql import functions as F

from duskrank.models.ranker import RankerSpec
from duskrank.plans import pipeline
from duskrank.plans.fleet import FLEET, SEARCH_FLEET, FleetParams
from duskrank.plans.registry import Inputs

SMALL = FleetParams(als_iterations=2, als_factors=4, pairwise_factors=4, pairwise_epochs=2, ease_regularization=50.0)


@pytest.fixture(scope="module")
def data(spark, sf_dir, tmp_path_factory):
    inputs = Inputs(spark, sf_dir)
    parts = pipeline.split_job(spark, inputs.interactions, str(tmp_path_factory.mktemp("split")))
    return inputs, parts


def test_split_job(data):
    inputs, parts = data
    assert {k: v.count() for k, v in parts.items()} == {"als": 468, "cb": 105, "test": 300}


def test_train_job(spark, data, tmp_path):
    inputs, parts = data
    names = ("predict_als_source_like", "predict_lfm_item_like", "predict_ease_like")
    config = pipeline.JobConfig(
        fleet=[m for m in FLEET if m.name in names],
        params=SMALL,
        rankers=(RankerSpec(rounds=2, depth=3),),
        save_features=True,
    )
    unknown = spark.createDataFrame([(10**6, 1), (0, 10**5)], "user_id long, item_id long")
    pairs = inputs.test_pairs.unionByName(unknown)
    out = pipeline.train_job(spark, parts, inputs.items, inputs.users, pairs, str(tmp_path), config)

    submitted = spark.read.csv(out["submission"], header=True)
    assert submitted.count() == pairs.count() and submitted.filter("predict is null").count() == 0
    report = {r.model: r.mean_auc for r in out["report"].collect()}
    assert set(report) == {*names, "prediction"} and all(0 <= v <= 1 for v in report.values())
    prepared = out["prepared"]
    assert {f"predict_lfm_item_like{s}" for s in ("", "_only_item_bias")} <= set(prepared.columns)
    assert prepared.submit.count() == pairs.count()
    kinds = {r.kind: r.n for r in out["log"].read().groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert kinds["metric"] == 2 * len(names) + 1 and kinds["artifact"] == 4
    for name in ("train", "test", "test_pairs"):
        assert spark.read.parquet(f"{tmp_path}/ranker_dataset_{name}.parquet").count() > 0


def test_search_job(spark, data, tmp_path):
    inputs, parts = data
    config = pipeline.JobConfig(
        fleet=[m for m in SEARCH_FLEET if m.name == "predict_als_item_like"],
        params=SMALL,
        positive_threshold=10,
        min_rows=20,
        min_user_rows=10,
        extended=False,
    )
    trials = [{"rounds": 1, "depth": 2, "bins": 32, "l2": 0.1}, {"rounds": 2, "depth": 3, "bins": 64, "l2": 0.01}]
    out = pipeline.search_job(spark, parts, inputs.items, inputs.users, inputs.test_pairs, str(tmp_path), config, trials)
    rows = out.collect()
    assert sorted(r.trial for r in rows) == [0, 1] and rows[0].mean_auc >= rows[1].mean_auc
