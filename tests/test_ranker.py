"""Second stage on planted data: the target follows one feature within each user."""

import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from duskrank.functions.ordered import detect_hot
from duskrank.models import ranker, search, trees
from duskrank.operators import metrics


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    out = []
    for u in range(80):
        offset = rng.normal(0, 3)
        for i in range(25 if u else 200):
            signal = rng.normal()
            target = int(signal > 0.7) - int(signal < -0.7)
            out.append((u, i, target, [float(signal), float(rng.normal()), float(offset)]))
    df = spark.createDataFrame(pd.DataFrame(out, columns=["user_id", "item_id", "target", "x"]))
    return df.withColumn("features", array_to_vector("x")).drop("x").cache()


def score(df):
    return metrics.mean_auc(df, "prediction").first()["mean_auc"]


@pytest.mark.parametrize("hot_rows", [1 << 20, 40])
def test_ranker_learns(rows, hot_rows):
    spec = ranker.RankerSpec(rounds=4, depth=3, rate=0.3, cut_every=2, hot_rows=hot_rows)
    predicted = spec.fit(rows).predict(rows)
    assert predicted.count() == rows.count()
    assert score(predicted) > 0.9


def test_gradients_balance_and_point_the_right_way(rows):
    state = rows.withColumn("score", F.lit(0.0))
    graded = ranker.ranking_gradients(state, 0, 1, 2, 0.85)
    # every pair adds the same amount to its winner as it takes from its loser
    assert abs(graded.agg(F.sum("grad")).first()[0]) < 1e-9
    by_target = {r.target: r.g for r in graded.groupBy("target").agg(F.avg("grad").alias("g")).collect()}
    assert by_target[1] > by_target[0] > by_target[-1]


def test_gradients_of_hot_users_are_exact(rows):
    """Slices of a few rows and whole lists give the same neighbours, places and gradients."""
    state = rows.withColumn("score", F.col("item_id") % 7 / 3.0)
    hot = detect_hot(rows, ["user_id"], 40)
    for draw in (0, 5):
        plain, sliced = (
            {(r.user_id, r.item_id): (r.grad, r.hess) for r in df.collect()}
            for df in (ranker.ranking_gradients(state, draw, 1, 3, 0.85), ranker.ranking_gradients(state, draw, 1, 3, 0.85, hot, 10))
        )
        assert plain.keys() == sliced.keys()
        assert max(abs(a - b) for k in plain for a, b in zip(plain[k], sliced[k])) < 1e-12


def brute_gradients(lists, draw, seed, permutations, decay):
    """Straight from the definition: lists of (user, item, target, score)."""
    out = {}
    for u, rows in lists.items():
        for k in range(permutations):
            def noisy(row):
                h = int(hashlib.md5(f"{u}:{row[0]}:{seed}:{draw}:{k}".encode()).hexdigest()[:8], 16)
                x = (h + 0.5) / 2**32
                return -(row[2] + math.log(x / (1 - x))), row[0]

            order = sorted(rows, key=noisy)
            for place, (a, b) in enumerate(zip(order, order[1:])):
                if a[1] == b[1]:
                    continue
                win, lose = (a, b) if a[1] > b[1] else (b, a)
                w = decay**place * abs(a[1] - b[1])
                wrong = 1 / (1 + math.exp(win[2] - lose[2]))
                for row, sign in ((win, 1), (lose, -1)):
                    g, h = out.get((u, row[0]), (0.0, 0.0))
                    out[u, row[0]] = g + sign * w * wrong, h + w * wrong * (1 - wrong)
    return out


def test_gradients_equal_the_definition(rows):
    state = rows.withColumn("score", F.col("item_id") % 5 / 2.0)
    lists = {}
    for r in state.collect():
        lists.setdefault(r.user_id, []).append((r.item_id, r.target, r.score))
    want = brute_gradients(lists, 2, 9, 3, 0.85)
    for r in ranker.ranking_gradients(state, 2, 9, 3, 0.85).collect():
        assert (r.grad, r.hess) == pytest.approx(want.get((r.user_id, r.item_id), (0.0, 0.0)), abs=1e-12)


def brute_tree(x, g, h, limits, depth, l2):
    """Greedy splits by trying every limit of every feature: {node: (feature, threshold)}."""
    out, todo = {}, [(0, np.ones(len(x), bool))]
    while todo:
        node, rows = todo.pop()
        if node >= 2**depth - 1:
            continue
        base, best = g[rows].sum() ** 2 / (h[rows].sum() + l2), (1e-9, None, None)
        for f, ends in enumerate(limits):
            for end in ends:
                left = rows & (x[:, f] <= end)
                right = rows & ~left
                if left.any() and right.any():
                    gain = sum(g[s].sum() ** 2 / (h[s].sum() + l2) for s in (left, right)) - base
                    if gain > best[0] + 1e-9:
                        best = gain, f, end
        if best[1] is not None:
            out[node] = best[1], best[2]
            left = rows & (x[:, best[1]] <= best[2])
            todo += [(2 * node + 1, left), (2 * node + 2, rows & ~left)]
    return out


def test_trees_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    x = np.column_stack([rng.normal(size=600), rng.integers(0, 3, 600), np.where(rng.random(600) < 0.1, np.nan, rng.random(600)), np.ones(600)])
    g = np.where(x[:, 0] > 0.3, 1.0, -0.5) * (1 + x[:, 1]) + np.where(np.isnan(x[:, 2]), 2.0, 0.0) + rng.normal(0, 0.3, 600)
    h = rng.uniform(0.1, 1.0, 600)
    frame = list(zip(range(600), x.tolist(), g.tolist(), h.tolist()))
    df = spark.createDataFrame(frame, "k long, x array<double>, grad double, hess double")
    df = df.withColumn("features", array_to_vector("x")).repartition(7)
    limits = trees.bin_limits(df, "features", 16)
    assert [len(e) for e in limits][1:] == [3, 15, 1] and len(limits[0]) == 15
    binned = trees.with_bins(df, "features", limits, ["k", "grad", "hess"])
    for depth, l2 in ((1, 0.5), (4, 3.0)):
        tree, value = trees.grow(binned, limits, depth, 16, l2)
        got = {k: (int(tree.feature[k]), float(tree.threshold[k])) for k in range(len(tree.feature)) if tree.feature[k] >= 0}
        assert got == brute_tree(x, g, h, limits, depth, l2)
        leaf = tree.leaf_of_values(x)
        for k in np.unique(leaf):
            assert value[k] == pytest.approx(g[leaf == k].sum() / (h[leaf == k].sum() + l2))
        codes = np.array([list(r.bins) for r in binned.orderBy("k").collect()])
        assert (tree.leaf_of_bins(codes) == leaf).all()
        text = binned.select("k", F.expr(tree.expression("bins", value)).alias("v")).orderBy("k").toPandas()
        np.testing.assert_allclose(text.v, value[leaf])
        added = df.select("k", trees.summed_leaves([tree, tree], [value, value], "features").alias("v")).orderBy("k").toPandas()
        np.testing.assert_allclose(added.v, 2 * value[leaf])


def test_limits_are_quantiles_of_any_number_of_rows(spark):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.exponential(size=60_000), rng.integers(0, 3, 60_000), np.full(60_000, np.nan)])
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").repartition(5)
    limits = trees.bin_limits(df.withColumn("features", array_to_vector("x")), "features", 20)
    shares = [(x[:, 0] <= end).mean() for end in limits[0]]
    np.testing.assert_allclose(shares, np.arange(1, 20) / 20, atol=0.002)
    assert limits[1].tolist() == [0.0, 1.0, 2.0] and len(limits[2]) == 0
    few = x[:400, :1]
    df = spark.createDataFrame([(r.tolist(),) for r in few], "x array<double>").withColumn("features", array_to_vector("x"))
    want = np.unique(np.quantile(few, np.arange(1, 8) / 8, method="inverted_cdf"))
    assert trees.bin_limits(df.repartition(3), "features", 8)[0].tolist() == want.tolist()


def test_rows_without_a_gain_stay_one_leaf(spark):
    df = spark.createDataFrame([([1.0, float(k)], 1.0, 1.0) for k in range(6)], "x array<double>, grad double, hess double")
    df = df.withColumn("features", array_to_vector("x"))
    limits = trees.bin_limits(df, "features", 4)
    tree, value = trees.grow(trees.with_bins(df, "features", limits, ["grad", "hess"]), limits, 3, 4, 0.0)
    assert (tree.feature == -1).all() and value[0] == 1.0
    with pytest.raises(ValueError):
        trees.bin_limits(df, "features", 500)


@pytest.mark.parametrize("kind", ["gbt", "logistic"])
def test_classifier(rows, kind):
    predicted = ranker.ClassifierSpec(kind, 5, 3).fit(rows).predict(rows)
    low, high = predicted.agg(F.min("prediction"), F.max("prediction")).first()
    assert 0 <= low < high <= 1 and score(predicted) > 0.75


def test_stack_and_mean(rows):
    base = [ranker.RankerSpec(rounds=2, depth=3), ranker.ClassifierSpec("logistic", 5)]
    stack = ranker.StackSpec(base, ranker.RankerSpec(rounds=3, depth=3, rate=0.3), held=0.3).fit(rows)
    full = stack.predict(rows, return_features=True)
    assert {"col_0", "col_1", "prediction"} <= set(full.columns)
    assert score(full) > 0.8
    assert "col_0" not in stack.predict(rows).columns

    models = ranker.fit_mean([ranker.RankerSpec(rounds=1, depth=2, seed=s) for s in (1, 2)], rows)
    one, two = (m.predict(rows, f"p{k}") for k, m in enumerate(models))
    both = ranker.predict_mean(models, rows, [1.0, 3.0])
    key = ["user_id", "item_id"]
    gap = both.join(one.select(*key, "p0"), key).join(two.select(*key, "p1"), key)
    assert gap.agg(F.max(F.abs(F.col("prediction") - (F.col("p0") + 3 * F.col("p1")) / 2))).first()[0] < 1e-12


def test_search(rows):
    trials = search.sample_trials(2, seed=3, rounds=(1, 2), depths=(2, 3))
    assert trials == search.sample_trials(2, seed=3, rounds=(1, 2), depths=(2, 3))
    assert all(400 <= t["rounds"] <= 1500 and t["bins"] in (32, 64, 96) for t in search.sample_trials(20))
    seen = []
    out = search.search(rows, rows, trials, parallelism=2, on_trial=seen.append).collect()
    assert len(out) == len(seen) == 2 and out[0].mean_auc >= out[1].mean_auc > 0.5


def test_many_trees_are_added_in_one_pass(rows):
    model = ranker.RankerSpec(rounds=4, depth=3).fit(rows)
    key = ["user_id", "item_id"]
    large = ranker.FittedRanker(model.trees * 40, model.leaves * 40)
    many = large.predict(rows, "c").join(model.predict(rows, "a").select(*key, "a"), key)
    assert many.agg(F.max(F.abs(F.col("c") - 40 * F.col("a")))).first()[0] < 1e-9


def test_scores_do_not_depend_on_how_often_they_are_written(rows):
    key = ["user_id", "item_id"]
    one, two = (ranker.RankerSpec(rounds=5, depth=3, cut_every=k).fit(rows).predict(rows, f"p{k}") for k in (2, 100))
    both = one.select(*key, "p2").join(two.select(*key, "p100"), key)
    assert both.agg(F.max(F.abs(F.col("p2") - F.col("p100")))).first()[0] < 1e-9
