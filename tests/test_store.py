"""Fingerprints, caches, run log, readers and writers."""

import os

import pytest
from pyspark.sql import functions as F

from duskrank.operators.split import split_log
from duskrank.plans.registry import Inputs
from duskrank.session import cut, scratch_root
from duskrank.sources import io, store


def test_fingerprint(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (2, None, 1.5), (2, None, 1.5)], "k long, s string, v double")
    base = store.fingerprint_value(df)
    assert store.fingerprint_value(df.repartition(5).orderBy(F.desc("v"))) == base
    assert store.fingerprint_value(df.select("v", "k", "s")) == base
    changed = df.withColumn("v", F.when(F.col("k") == 1, 0.25).otherwise(F.col("v")))
    assert store.fingerprint_value(changed) != base
    assert store.fingerprint_value(df.dropDuplicates()) != base
    swapped = spark.createDataFrame([(None, 1)], "a long, b long"), spark.createDataFrame([(1, None)], "a long, b long")
    assert store.fingerprint_value(swapped[0]) != store.fingerprint_value(swapped[1])


def test_cached_table(spark, tmp_path):
    calls = []

    def double(df, k):
        calls.append(k)
        return df.withColumn("v", F.col("v") * k)

    cached = store.cached_table(str(tmp_path), double)
    df = spark.createDataFrame([(1,), (2,)], "v long")
    first = sorted(r.v for r in cached(df, 3).collect())
    again = sorted(r.v for r in cached(df.repartition(3), 3).collect())
    assert first == again == [3, 6] and calls == [3]
    cached(df, 4)
    cached(df.union(df), 3)
    assert calls == [3, 4, 3]


def test_model_store(spark, tmp_path):
    models, fits = store.ModelStore(str(tmp_path)), []
    train = spark.createDataFrame([(1, 2, 1.0)], "user_id long, item_id long, weight double")

    def fit():
        fits.append(1)
        return {"items": train.select("item_id"), "users": train.select("user_id")}

    for rank in (4, 4, 8):
        tables = models.fit("als", {"rank": rank}, train, fit)
        assert set(tables) == {"items", "users"} and tables["items"].first()[0] == 2
    assert len(fits) == 2


def test_run_log(spark, tmp_path):
    log = store.RunLog(spark, f"{tmp_path}/log")
    log.params(a=1, b=[1, 2])
    log.metrics_from(spark.createDataFrame([("m", 0.5)], "model string, mean_auc double"), "model", "mean_auc")
    log.artifact("out", "/x")
    rows = {(r.kind, r.key): r.value for r in log.read().collect()}
    assert rows == {("param", "a"): "1", ("param", "b"): "[1, 2]", ("metric", "m_rocauc"): "0.5", ("artifact", "out"): "/x"}


def test_split_round_trip(spark, sf_dir, tmp_path):
    inputs = Inputs(spark, sf_dir)
    io.write_split(split_log(inputs.interactions), f"{tmp_path}/split")
    parts = io.read_split(spark, f"{tmp_path}/split", with_holdout=True)
    assert parts["test"].count() == 300 and parts["als"].count() == 468
    assert parts["cb"].count() == 105 + 300 and parts["cb"].filter("rn = 1").count() >= 300


def test_pairs_and_submission(spark, tmp_path):
    (tmp_path / "pairs.csv").write_text("user_id,item_id\n1,2\n3,4\n")
    pairs = io.read_pairs(spark, f"{tmp_path}/pairs.csv")
    assert [tuple(r) for r in pairs.orderBy("user_id").collect()] == [(1, 2), (3, 4)]
    path = io.write_submission(pairs.withColumn("predict", F.lit(0.5)), str(tmp_path), now=17)
    assert path.endswith("/17_submission.csv")
    back = spark.read.csv(path, header=True)
    assert back.columns == ["user_id", "item_id", "predict"] and back.count() == 2


def test_cut_uses_the_named_folder(spark):
    table = cut(spark.range(5), "numbers")
    assert table.count() == 5 and table.inputFiles()[0].replace("file://", "").startswith(scratch_root(spark))
    assert os.path.isdir(scratch_root(spark))


def test_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "yarn"})()

    with pytest.raises(ValueError):
        scratch_root(Session())
