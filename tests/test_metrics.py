"""Graded AUC from ranks against the pairs spelled out."""

import math
import random

import pytest
from pyspark.sql import functions as F

from duskrank.operators import metrics


def brute(rows):
    out = {}
    for user in {r[0] for r in rows}:
        num = den = 0.0
        own = [r for r in rows if r[0] == user]
        for _, ta, sa in own:
            for _, tb, sb in own:
                if (ta, tb) not in ((1, 0), (0, -1)):
                    continue
                den += 1
                if sa is None or sb is None:
                    continue
                nan_a, nan_b = math.isnan(sa), math.isnan(sb)
                if nan_a and nan_b or sa == sb:
                    num += 0.5
                elif nan_a or (not nan_b and sa > sb):
                    num += 1
        if den:
            out[user] = (num, den)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    scores = [None, float("nan"), float("inf"), -1.0, 0.0, 0.25, 0.25, 3e5]
    out = [(u, rng.choice([-1, 0, 0, 1]), rng.choice([*scores, rng.random()])) for u in range(12) for _ in range(25)]
    out += [(50, rng.choice([-1, 0, 1]), rng.random()) for _ in range(300)]  # half of all rows
    out += [(60, 1, 0.5), (60, -1, 0.1), (61, 0, 0.5), (62, 1, 0.4), (62, 0, 0.6)]
    return out


@pytest.mark.parametrize("options", [dict(hot=False), dict(hot=True, limit=20), dict(hot=True, limit=2)])
def test_user_auc(spark, rows, options):
    df = spark.createDataFrame(rows, "user_id long, target int, predictions double")
    got = {r.user_id: (r.num, r.den) for r in metrics.user_auc(df, **options).collect()}
    want = brute(rows)
    assert set(got) == set(want) and 60 not in got and 61 not in got
    for user, pair in want.items():
        assert got[user] == pytest.approx(pair)


def test_report_has_every_column(spark, rows):
    df = spark.createDataFrame(rows, "user_id long, target int, a double").withColumn("b", -F.col("a"))
    report = {r.model: r for r in metrics.auc_report(df, ["a", "b"]).collect()}
    assert set(report) == {"a", "b"}
    single = metrics.mean_auc(df, "a").first()
    assert report["a"].mean_auc == pytest.approx(single.mean_auc) and report["a"].n_users == single.n_users


def test_cold_share(spark):
    df = spark.createDataFrame([("m", True), ("m", False), ("n", False)], "model string, is_cold boolean")
    assert {r.model: r.cold_share for r in metrics.cold_share(df, ["model"]).collect()} == {"m": 0.5, "n": 0.0}
