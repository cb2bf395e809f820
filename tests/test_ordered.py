"""Order primitives: the sliced path for hot keys must equal the plain one and brute force."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from duskrank.functions.ordered import (
    SLICES,
    _mark_by_value,
    dense_index,
    detect_hot,
    nearest_quantiles,
    positions,
    running_totals,
    mode_rows,
    tied_modes,
)


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(1)
    # user 0 holds a third of all rows
    users = [0] * 200 + [rng.randrange(1, 20) for _ in range(400)]
    pos = rng.sample(range(100_000), len(users))
    rows = [(u, p, rng.choice([None, rng.gauss(0, 50), 1.5, 0.0]), rng.randrange(6)) for u, p in zip(users, pos)]
    return spark.createDataFrame(rows, "user_id long, pos long, v double, s long").cache()


def _hot_choices(log):
    return {
        "plain": dict(hot=False),
        "found in the plan": dict(hot=True, limit=50),
        "given": dict(hot=detect_hot(log, ["user_id"], 50), limit=50),
        "tiny slices": dict(hot=True, limit=3),
    }


def test_detect_hot(log):
    assert detect_hot(log, ["user_id"], 10_000) is False
    assert [r.user_id for r in detect_hot(log, ["user_id"], 50).collect()] == [0]


def test_positions_all_paths(log):
    pdf = log.select("user_id", "pos").toPandas()
    pdf["seq"] = pdf.groupby("user_id")["pos"].rank().astype(int)
    pdf["n_rows"] = pdf.groupby("user_id")["pos"].transform("count")
    pdf["rn"] = pdf["n_rows"] - pdf["seq"] + 1
    want = pdf.sort_values(["user_id", "pos"]).reset_index(drop=True)
    for label, options in _hot_choices(log).items():
        got = positions(log, **options).select(*want.columns).toPandas()
        got = got.sort_values(["user_id", "pos"]).reset_index(drop=True)
        pd.testing.assert_frame_equal(got, want, check_dtype=False, obj=label)


def test_running_totals_all_paths(log):
    counts = log.groupBy("user_id", "v").agg(F.count("*").alias("c"))
    base = running_totals(counts, ["user_id"], "v", ["c"], hot=False).toPandas()
    pdf = counts.toPandas()
    for r in base.itertuples():
        own = pdf[pdf.user_id == r.user_id]
        smaller = own[own.v < r.v] if not math.isnan(r.v) else own.iloc[:0]
        nulls = own[own.v.isna()] if not math.isnan(r.v) else own.iloc[:0]
        assert r.c_before == smaller.c.sum() + nulls.c.sum()
        assert r.c_total == own.c.sum()
    key = ["user_id", "v"]
    want = base.sort_values(key).reset_index(drop=True)
    for limit in (50, 2):
        got = running_totals(counts, ["user_id"], "v", ["c"], hot=True, limit=limit).toPandas()
        got = got[base.columns].sort_values(key).reset_index(drop=True)
        pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_slices_follow_the_values(spark):
    """Scores in a narrow range are cut as finely as any others, and the totals stay exact."""
    rows = [(0, 0.49 + 0.02 * k / 5000) for k in range(5000)] + [(1, 1e6 + k) for k in range(40)]
    df = spark.createDataFrame(rows, "user_id long, v double").withColumn("c", F.lit(1))
    marked, _ = _mark_by_value(df, ["user_id"], True, "v", 100)
    sizes = marked.filter("user_id = 0").groupBy("_slice").count().toPandas()["count"]
    assert len(sizes) > 200 and sizes.max() < 2 * 5000 / SLICES + 20
    got = running_totals(df, ["user_id"], "v", ["c"], hot=True, limit=100).filter("user_id = 0").toPandas()
    assert (got.sort_values("v")["c_before"].to_numpy() == range(5000)).all() and (got["c_total"] == 5000).all()


def _nearest(values, percent):
    values = sorted(v for v in values if v is not None and not math.isnan(v))
    return values[int(math.floor((len(values) - 1) * (percent / 100.0) + 0.5))] if values else None


def test_nearest_quantiles_all_paths(log):
    percents = [10, 30, 50, 70, 90]
    pdf = log.toPandas()
    for options in _hot_choices(log).values():
        got = nearest_quantiles(log, ["user_id"], {"v": percents}, **options).toPandas().set_index("user_id")
        for user, rows in pdf.groupby("user_id"):
            for p in percents:
                assert got.loc[user, f"v_q{p}"] == _nearest(rows.v, p)


def test_nearest_quantiles_keep_null_groups_and_sketch_agrees(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), (1, 2.0), (1, None)], "k long, v double")
    got = {r.k: r.v_q50 for r in nearest_quantiles(df, ["k"], {"v": [50]}).collect()}
    assert got == {None: 3.0, 1: 2.0}
    sketch = nearest_quantiles(df, ["k"], {"v": [50]}, exact=False)
    assert set(sketch.columns) == {"k", "v_q50"} and sketch.count() == 2


def test_tied_modes(spark):
    rows = [(1, 5), (1, 5), (1, 2), (1, 2), (1, 9), (2, None), (2, 7), (3, None)]
    df = spark.createDataFrame(rows, "user_id long, s long")
    names = {"m": None, "small": F.col("s") < 5, "none": F.lit(False)}
    got = {r.user_id: (r.m, r.small, r.none) for r in tied_modes(df, "user_id", "s", names).collect()}
    assert got == {1: ([2, 5], [2], []), 2: ([7], [], []), 3: ([], [], [])}


def test_dense_index(spark):
    ids = spark.createDataFrame([(x,) for x in [10**12, 5, 5, -3, 7, None] + list(range(100, 400))], "id long")
    rows = dense_index(ids, "id", "n").collect()
    assert sorted(r.n for r in rows) == list(range(len(rows)))
    assert len({r.id for r in rows}) == len(rows) == 304


def test_modes_of_a_key_with_very_many_values(spark):
    """A key of 100,000 distinct values that all tie, one with a single mode, a null key, a key of nulls."""
    hot = spark.range(100_000).select(F.lit(1).cast("long").alias("k"), F.col("id").alias("v"))
    rows = spark.createDataFrame([(2, 7), (2, 7), (2, 8), (None, 3), (4, None)], "k long, v long")
    df = hot.unionByName(rows)
    found = mode_rows(df, "k", "v", {"all": None, "even": F.col("v") % 2 == 0})
    sizes = {(r.k, r["name"]): (r.n, r.s) for r in found.groupBy("k", "name").agg(F.count("*").alias("n"), F.sum("v").alias("s")).collect()}
    assert sizes == {
        (1, "all"): (100_000, 99_999 * 50_000), (1, "even"): (50_000, 49_999 * 50_000),
        (2, "all"): (1, 7), (2, "even"): (1, 8), (None, "all"): (1, 3),
    }
    lists = {r.k: (len(r["all"]), len(r["even"])) for r in tied_modes(df, "k", "v", {"all": None, "even": F.col("v") % 2 == 0}).collect()}
    assert lists == {1: (100_000, 50_000), 2: (1, 1), None: (1, 0), 4: (0, 0)}
    # the counts meet the maxima in a join that can split a hot key; no window holds a key together
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "collect_list" not in plan
